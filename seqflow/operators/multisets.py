"""Sorted-multiset operations: a value occurs max(m, n) times in the union, min(m, n) in the intersection, max(m - n, 0) in the difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(a: DataFrame, b: DataFrame, value: str, how: str) -> DataFrame:
    """v, n: each value of the result and how often it occurs. One shuffle of both sides' partial counts."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(F.col(value).alias("v"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = both.groupBy("v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    n = {"union": F.greatest("_a", "_b"), "intersection": F.least("_a", "_b"), "difference": F.greatest(F.col("_a") - F.col("_b"), F.lit(0))}[how]
    return counts.select("v", n.alias("n")).where("n > 0")


def expand(counts: DataFrame) -> DataFrame:
    """Each value as often as it occurs."""
    return counts.select("v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")
