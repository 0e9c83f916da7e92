"""The corpus pipeline: each stage takes the rows that its predecessor kept, as columns of documents, and applies one operator.

Defined results: documents may have other columns of any names, which all stages keep (the last one under another name
where it clashes with its own); nulls in any column, empty and repeated rows and ties are handled as the operators'
docstrings say; an empty table gives an empty table at each stage. Copies that the mix takes are repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqflow.llm import decontamination, langid, mixing, sharding, simhash
from seqflow.llm.common import cut, discard, fresh, named, table

#: Least score of a document's language; documents without letters have 0.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.recognised(docs, langid.train(docs), least=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.deduplicate(docs, rule=simhash.SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    columns = docs.columns
    mixed = mixing.mix(docs, keep=tuple(columns)).where("copies > 0")
    repeated = mixed.withColumn(fresh(mixed, "copy")[0], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[named(f"keep_{c}").alias(c) for c in columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row, and the row; a column whose name is one of the shards' is called doc_<name>."""
    placed = sharding.shard(docs, 40, keep=tuple(c for c in docs.columns if c != "doc_id"))
    own = {c.lower() for c in placed.columns if not c.startswith("keep_")}
    names = {}
    for c in docs.columns:
        if c != "doc_id":
            name = c
            while name.lower() in own:
                name = f"doc_{name}"
            own.add(name.lower())
            names[f"keep_{c}"] = name
    return placed.select(*[named(c).alias(names.get(c, c)) for c in placed.columns])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: No stage but decontamination can be stated in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
            discard(*before)  # the last stage reads its own input when it is run
            before = [docs]
    return docs
