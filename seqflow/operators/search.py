"""Search in ordered sequences: the least position that satisfies a condition, the length where there is none.

The position of a key is the number of keys below it, so find needs two aggregates and no order at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.operators.sequence import Sequence


def position_of(df: DataFrame, key: str, first: DataFrame) -> DataFrame:
    """first: one row with _k, a key or null. One row: pos, the rows before it (all where it is null)."""
    return df.select(F.col(key).alias("_key")).crossJoin(F.broadcast(first)).agg(F.count_if(F.col("_k").isNull() | (F.col("_key") < F.col("_k"))).alias("pos"))


def find_if(df: DataFrame, key: str, predicate: Column) -> DataFrame:
    """The least position where the predicate holds; n where it never does."""
    return position_of(df, key, df.agg(F.min(F.when(predicate, F.col(key))).alias("_k")))


def sorted_search(df: DataFrame, key: str, value) -> DataFrame:
    """pos, found: the number of keys below value, and whether it is one. Only keys up to value are read, where the files have bounds."""
    return df.where(F.col(key) <= value).agg(F.count_if(F.col(key) < value).alias("pos"), (F.count_if(F.col(key) == value) > 0).alias("found"))


def find(df: DataFrame, key: str, column: str, value) -> DataFrame:
    return find_if(df, key, F.col(column) == value)


def find_first_of(df: DataFrame, key: str, column: str, among: DataFrame, among_column: str) -> DataFrame:
    """The least position whose value is in another sequence: a semi-join, whose strategy the optimizer picks by size."""
    hits = df.join(among.select(F.col(among_column).alias("_a")).distinct(), F.col(column) == F.col("_a"), "left_semi")
    return position_of(df, key, hits.agg(F.min(key).alias("_k")))


def adjacent_find(seq: Sequence, value: str | Column, predicate=lambda a, b: a == b) -> DataFrame:
    """The least i with predicate(v[i], v[i+1]); n where there is none."""
    return seq.neighbours(value).agg(
        F.coalesce(F.min(F.when(F.col("next").isNotNull() & predicate(F.col("v"), F.col("next")), F.col("pos"))), F.count("*")).alias("pos")
    )


def search(seq: Sequence, value: str, pattern: list) -> DataFrame:
    """The least start of a contiguous pattern; n where there is none. Rows meet their pattern places by value, then their start."""
    places = seq.df.sparkSession.createDataFrame([(float(x), i) for i, x in enumerate(pattern)], "pv double, pp long")
    rows = seq.with_pos().select("pos", F.col(value).cast("double").alias("v"))
    starts = rows.join(F.broadcast(places), F.col("v") == F.col("pv")).groupBy((F.col("pos") - F.col("pp")).alias("start")).count().where(F.col("count") == len(pattern))
    return starts.agg(F.min("start").alias("_s")).crossJoin(rows.agg(F.count("*").alias("_n"))).select(F.coalesce("_s", "_n").alias("pos"))


def search_n(seq: Sequence, condition: Column, n: int) -> DataFrame:
    """The least start of n places in a row where the condition holds; the length where there is none.

    A run's places share the number of places before them that fail (gaps and islands), from the two-level scan.
    """
    bad = Sequence(seq.df.withColumn("_bad", F.when(condition, 0).otherwise(1)), seq.key, seq.n_blocks).scan("_bad")
    runs = bad.where("v = 0").groupBy("p").agg(F.min("pos").alias("start"), F.count("*").alias("len")).where(F.col("len") >= n)
    return runs.agg(F.min("start").alias("_s")).crossJoin(seq.df.agg(F.count("*").alias("_n"))).select(F.coalesce("_s", "_n").alias("pos"))


def equal(zipped: DataFrame, predicate=lambda a, b: a == b) -> DataFrame:
    return zipped.agg(F.coalesce(F.bool_and(F.coalesce(predicate(F.col("v1"), F.col("v2")), F.lit(False))), F.lit(True)).alias("equal"))


def mismatch(zipped: DataFrame, predicate=lambda a, b: a == b) -> DataFrame:
    """The first position whose pair fails, or has no partner; n where there is none."""
    ok = F.coalesce(predicate(F.col("v1"), F.col("v2")), F.lit(False))
    return zipped.agg(F.coalesce(F.min(F.when(~ok, F.col("pos"))), F.count("*")).alias("pos"))


def is_sorted(seq: Sequence, value: str) -> DataFrame:
    """Whether no value is below the one before it, and the first position where one is (n if none)."""
    down = F.col("next") < F.col("v")
    return seq.neighbours(value).agg(
        (~F.coalesce(F.bool_or(down), F.lit(False))).alias("sorted"), F.coalesce(F.min(F.when(down, F.col("pos") + 1)), F.count("*")).alias("pos")
    )
