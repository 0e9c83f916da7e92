"""Small text sources: tables of samples, property files, and reading a result row by row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A table parted by white space, its first line the names; numbers are whole or real."""
    words = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"))
    first = words.first()
    if first is None:
        return spark.createDataFrame([], "value string")
    names = list(first["w"])
    body = words.where(F.array_join("w", " ") != " ".join(names))
    whole = body.agg(*[F.bool_and(F.get("w", F.lit(i)).try_cast("bigint").isNotNull()).alias(f"c{i}") for i in range(len(names))]).first()
    return body.select(*[F.get("w", F.lit(i)).try_cast("bigint" if whole[i] else "double").alias(n) for i, n in enumerate(names)])


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """name = value lines; # begins a comment. Settings of a program, so a few."""
    parts = F.split("value", "=", 2)
    rows = spark.read.text(path).where(F.col("value").contains("=") & ~F.ltrim("value").startswith("#"))
    return {r[0]: r[1] for r in rows.select(F.trim(parts[0]), F.trim(parts[1])).collect()}


def write_properties(spark: SparkSession, properties: dict[str, str], path: str) -> None:
    rows = [(f"{k} = {v}",) for k, v in properties.items()] or [("# none",)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)


def cursor(df: DataFrame) -> Iterator[Row]:
    """Rows in the frame's order, a partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
