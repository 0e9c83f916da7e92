"""Statistics of a column: moments, distributions, counters by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(v: Column) -> list[Column]:
    """count, total, least, most, mean, population variance and deviation, deviation over mean."""
    return [
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"), F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv"),
    ]


def distribution(df: DataFrame, v: Column, thresholds: list[float]) -> DataFrame:
    """bin, n: counts in (-inf, t0), [t0, t1), ..., [tn, inf); empty bins are kept."""
    spark = df.sparkSession
    bin_ = sum((F.when(v >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    counts = df.where(v.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(len(thresholds) + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rollup(df: DataFrame, kid: str, counters: list[str]) -> DataFrame:
    """kid, each counter's sum, is_total: a row for each processor and one for all."""
    return df.rollup(kid).agg(*[F.sum(c).alias(c) for c in counters], F.grouping(kid).cast("int").alias("is_total"))
