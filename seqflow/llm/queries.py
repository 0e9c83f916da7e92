"""The operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqflow.llm import chat, decontamination, fingerprints, langid, mixing, sharding, simhash, suffix_dedup, token_ids, toxicity
from seqflow.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.train(documents))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_ids.write(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return token_ids.read(spark, path)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_h")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(both.alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.parse_chats(chat.write_chats(rows.unionByName(extra)))
    said = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_langid, op4_suffix_dedup, op5_fingerprints, op6_mixing, op7_token_ids, op8_simhash, op9_decontamination, op10_chat)}

ORACLE_SQL = {
    "op4_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
-- pieces of 1000 bytes and the 49 after them, in hexadecimal digits, then every 50-byte string
p as (select doc_id, h, unnest(range(0, length(h) // 2 - 49, 1000)) as pos from d where length(h) >= 100),
c as (select doc_id, pos, substr(h, 2 * pos + 1, 2098) as h from p),
w as (select doc_id, pos + k as pos, substr(h, 2 * k + 1, 100) as s from (select *, unnest(range(0, length(h) // 2 - 49)) as k from c)),
f as (select s, min(doc_id) as least from w group by s having min(doc_id) < max(doc_id)),
r as (select doc_id, pos from w join f using (s) where f.least < doc_id),
i as (select *, sum(fresh) over (partition by doc_id order by pos) as run
      from (select *, case when pos <= lag(pos) over (partition by doc_id order by pos) + 50 then 0 else 1 end as fresh from r)),
runs as (select doc_id, run, min(pos) as a, max(pos) + 50 as b from i group by doc_id, run),
gaps as (select doc_id, b as a, lead(a) over (partition by doc_id order by a) as b from runs union all select doc_id, 0, min(a) from runs group by doc_id),
left_ as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' order by a) as h from gaps join d using (doc_id) group by doc_id),
sums as (select doc_id, sum(b - a) as removed, count(*) as spans from runs group by doc_id)
select doc_id, length(d.h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(unhex(coalesce(left_.h, d.h))) as kept_sha256
from d left join sums using (doc_id) left join left_ using (doc_id)""",
    "op9_decontamination": r"""
with d as (select distinct doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
i as (select distinct item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct doc_id, text, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s from d),
its as (select distinct item_id, text, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s from i),
n as (select item_id, text, count(*) as of from its group by all)
select doc_id, its.item_id, cast(any_value(n.of) as integer) as n_item_shingles, cast(count(*) as integer) as n_shared,
       count(*) / any_value(n.of) as containment
from ds join its using (s) join n on n.item_id = its.item_id and n.text = its.text
group by doc_id, ds.text, its.item_id, its.text having count(*) >= 0.8 * any_value(n.of)""",
    "op10_chat": r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as fresh,
         length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[SEP\]')) as text_len,
         length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[SEP\]')) as role_len
  from rows_)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(text_len + case when fresh then 3 + 6 + role_len + 7 + 4 else 5 end) as bigint) as formatted_chars
from marked group by conv_id""",
}
