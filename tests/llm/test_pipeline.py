"""The pipeline and the operators' queries, stage by stage against brute force."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute_groups, brute_leaks
from test_shards_and_mixes import check_shards, wanted

import corpus_pipeline
from seqflow.llm.queries import ORACLE_SQL, QUERIES


def test_each_stage_on_its_input(spark, sf_dir, documents, tmp_path):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns
            assert set(after) <= set(before)
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not any(map(str.isalpha, r.text or ""))}
        elif name == "near_duplicates":
            ids = [r.doc_id for r in before]
            found, sure = brute_groups([(r.doc_id, r.text) for r in before])
            left = {r.doc_id for r in after}
            assert len(left) == len(after) < len(ids)
            assert left <= set(sure) and left >= set(found)
        elif name == "decontaminate":
            leaks = {d for d, *_ in brute_leaks([(r.doc_id, r.text) for r in before], items)}
            assert leaks and Counter(after) == Counter(r for r in before if r.doc_id not in leaks)
        elif name == "mix":
            size = lambda r: len(r.text.encode().split())
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += size(r)
            for r in after:
                taken[r.source] += size(r)
            assert max(Counter(r.doc_id for r in after).values()) <= 3
            assert sum(taken.values()) == pytest.approx(sum(wanted(sizes).values()), rel=0.05)
        else:
            assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in after) == Counter(map(tuple, before))
            check_shards(after, 40, 0.02)
        docs = out


CLASHES = "lang_pred string, score double, _kept_id long, _leak string, _row_h long, _copy int, _text_to_score string, keep_text string, _h string, _id string, size string, shard string, slot string, `a.b` string, tags map<string,int>"


@pytest.mark.parametrize("kind", ["awkward", "nothing"])
def test_stages_on_awkward_rows_and_clashing_names(spark, sf_dir, awkward, nothing, kind):
    docs = {"awkward": awkward, "nothing": nothing}[kind].select("doc_id", "text", "lang", "source", "n_chars")
    extra = {c.split()[0].strip("`"): c.split()[1] for c in CLASHES.split(", ")}
    docs = docs.select("*", *[F.lit(None if t.startswith("map") else 1).cast(t).alias(c) for c, t in extra.items()])
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        key = lambda r: tuple(str(r[c]) for c in docs.columns)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {key(r) for r in rows} <= {key(r) for r in docs.collect()}
            assert kind == "nothing" or rows
        else:
            assert len(rows) == docs.count() and own <= set(out.columns)
            names = [c if c == "doc_id" or c not in own else f"doc_{c}" for c in docs.columns]
            assert Counter(tuple(str(r[n]) for n in names) for r in rows) == Counter(map(key, docs.collect()))
        docs = out if i < len(corpus_pipeline.STAGES) - 1 else docs


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_shards(rows, 40, 0.02)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(str(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall())
    assert Counter(tuple(map(str, r)) for r in df.collect()) == want


def test_there_is_a_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
