"""Chat formatting in Spark expressions only.

Turns are collected and sorted, adjacent turns of one role are merged to blocks, and blocks are concatenated:

    <s>[INST]role[/INST]text[SEP]text</s>

Escaping: each backslash is doubled, and a backslash goes behind the first character of each control string, so that
no control string is left in a role or text and the original comes back by dropping one backslash of each pair or
escape. The loss mask is a list of (start, length) in UTF-8 bytes of the formatted string, one for each assistant text.

Defined results: null roles and texts are empty; turns with one number are ordered by role and text; null is a
conversation of its own; an empty table gives an empty result; other columns are ignored. A conversation is one
output row, so its turns must fit in a task's memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import scratch

#: The template's control strings (fixed values).
BEGIN, HEAD, HEAD_END, SEP, END = "<s>", "[INST]", "[/INST]", "[SEP]", "</s>"
CONTROLS = r"(<(?=/?s>)|\[(?=/?INST\]|SEP\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROLS, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def blocks_of(turns: Column) -> Column:
    """Sorted turns to blocks of adjacent turns of one role: array<struct<role, texts>>."""

    def add(done: Column, turn: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fresh = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        joined = F.array(F.struct(turn["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts")))
        return F.when(last["role"] == turn["role"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), joined)).otherwise(F.concat(done, fresh))

    return F.aggregate(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), add)


def format_chats(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of struct<start, bytes>) for each conversation."""
    turns = df.groupBy(F.col(conv_col).alias("conv_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(turn_col).alias("turn"),
                    F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"),
                )
            )
        ).alias("_turns")
    )
    head = lambda role: F.concat(F.lit(BEGIN + HEAD), role, F.lit(HEAD_END))
    blocks = turns.withColumn("_blocks", blocks_of(F.col("_turns"))).withColumn(
        "_blocks",
        F.transform(
            "_blocks",
            lambda b: F.struct(
                (b["role"] == loss_role).alias("loss"),
                head(escape(b["role"])).alias("head"),
                F.transform(b["texts"], escape).alias("texts"),
            ),
        ),
    )
    text = F.array_join(
        F.transform("_blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], SEP), F.lit(END))), ""
    )
    # what lies between the end of the text before and the start of this one
    pieces = F.flatten(
        F.transform(
            "_blocks",
            lambda b, i: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(j > 0, len(SEP)).otherwise(F.octet_length(b["head"]) + F.when(i > 0, len(END)).otherwise(0)).cast("long").alias("skip"),
                    F.octet_length(t).cast("long").alias("take"),
                    b["loss"].alias("loss"),
                ),
            ),
        )
    )
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,bytes:long>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + p["skip"] + p["take"]).alias("at"),
            F.when(p["loss"], F.array_append(a["spans"], F.struct((a["at"] + p["skip"]).alias("start"), p["take"].alias("bytes")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return blocks.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct<role, text>), loss_texts (the text of each span), formatted: undoes format_chats."""
    blocks = F.split("formatted", END, -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(BEGIN + HEAD) + 1)), r"\[/INST\]", 2)
        return F.transform(
            F.split(F.get(halves, F.lit(1)), r"\[SEP\]", -1),
            lambda t: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(t).alias("text")),
        )

    raw = F.col("formatted").cast("binary")
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))).alias("loss_texts"),
        "formatted",
    )


def write_chats(df: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Format, write as Parquet and read back."""
    spark = df.sparkSession
    path = path or f"{scratch(spark)}/chats-{uuid.uuid4().hex}"
    out = format_chats(df, **kw)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
