"""Tables of a folder of Parquet files, and the canonical schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACE = "evtno short, type short, kid int, gid long, date_ns long, d0 long, d1 long, d2 long, file string"
EDGE = "src long, dst long, kind string"
MATRIX = "i long, j long, v double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
