"""Structured Streaming forms of the trace operators. Each runs to the end of what there is and reads back its sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqflow.lineage import scratch


def events_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone: the session's


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available, to Parquet files in the shared folder."""
    spark = stream.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """start, event_type, n, total for each window that the watermark has closed."""
    grouped = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """user_id, start, n for each session that the watermark has closed."""
    grouped = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def intervals(stream: DataFrame) -> DataFrame:
    """kid, beg, end: odd events of a kid begin, the next ends, kept as one open begin in each kid's state.

    A kid's events must come in order between batches; within one they are sorted.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("event_id")
        open_ = state.get[0] if state.exists else -1
        out = []
        for t in rows["t"]:
            if open_ < 0:
                open_ = int(t)
            else:
                out.append((key[0], open_, int(t)))
                open_ = -1
        state.update((open_,))
        yield pd.DataFrame(out, columns=["kid", "beg", "end"])

    source = stream.select(F.col("user_id").alias("kid"), "event_id", (F.unix_micros("ts") * 1000).alias("t"))
    return source.groupBy("kid").applyInPandasWithState(run, "kid long, beg long, end long", "open long", "append", "NoTimeout")
