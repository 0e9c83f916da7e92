"""Binary trace files, edge lists, and the text forms of traces and graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqflow.operators.traces import EVENTS
from seqflow.sources.tables import TRACE

#: The trace file: a header, then records of 40 bytes (fixed values).
HEADER = np.dtype([("version", "<i4"), ("minor", "<i4"), ("trace_version", "<i4"), ("cpucount", "<i4"), ("event_mask", "<u8"), ("package", "S128")])
RECORD = np.dtype([("evtno", "u1"), ("type", "u1"), ("kid", "<u2"), ("gid", "<u4"), ("date_ns", "<u8"), ("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8")])


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All records of trace files, through Spark's own file reader; empty files are skipped. A file is one task's."""

    def rows(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                body = np.frombuffer(content, RECORD, offset=HEADER.itemsize) if len(content) >= HEADER.itemsize else []
                if len(body):
                    out = pd.DataFrame({n: body[n].astype("int64") for n in RECORD.names})
                    yield out.assign(file=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, TRACE)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    def rows(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                if len(content) >= HEADER.itemsize:
                    h = np.frombuffer(content, HEADER, 1)[0]
                    yield pd.DataFrame([{"file": name, **{n: (int(h[n]) if n != "package" else h[n].decode()) for n in HEADER.names}}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, version int, minor int, trace_version int, cpucount int, event_mask long, package string")


def to_bytes(events: pd.DataFrame, cpucount: int = 1, package: str = "seqflow") -> bytes:
    """A trace file's content."""
    head = np.zeros(1, HEADER)
    head["version"], head["trace_version"], head["cpucount"], head["event_mask"], head["package"] = 1, 1, cpucount, (1 << 36) - 1, package.encode()
    body = np.zeros(len(events), RECORD)
    for n in RECORD.names:
        body[n] = events[n] if n in events else 0
    return head.tobytes() + body.tobytes()


def as_text(trace: DataFrame) -> DataFrame:
    """A line for each event: time, processor, name, data."""
    names = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    return trace.select(F.format_string("%d: %d -> %s, d0: %d, d1: %d", "t", "kid", F.coalesce(F.element_at(names, F.col("evtno")), F.lit("?")), "d0", "d1").alias("value"))


def as_paje(spans: DataFrame, state: str = "a") -> DataFrame:
    """A line for each push and pop of a state, in seconds, as Paje's grammar has them (7 pushes, 8 pops); ordered by time."""
    push = spans.where("balanced").select(F.col("beg").alias("t"), F.format_string('7 %d.%09d "%d" ST %s', F.expr("beg div 1000000000"), F.expr("beg % 1000000000"), F.col("kid"), F.lit(state)).alias("value"))
    pop = spans.where("balanced").select(F.col("end").alias("t"), F.format_string('8 %d.%09d "%d" ST', F.expr("`end` div 1000000000"), F.expr("`end` % 1000000000"), F.col("kid")).alias("value"))
    return push.union(pop)


def as_dot(edges: DataFrame) -> DataFrame:
    """A line for each edge of a graph."""
    return edges.select(F.format_string("%d -> %d;", "src", "dst").alias("value"))


def write_dot(edges: DataFrame, path: str, name: str = "G", nodes: DataFrame | None = None) -> None:
    """A folder whose files, one after another by name, are a DOT graph. nodes: id, label, where they are to be named."""
    spark = edges.sparkSession
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    out = line(f"digraph {name} {{")
    if nodes is not None:
        out = out.union(nodes.select(F.format_string('%d [label="%s"];', "id", F.regexp_replace("label", r'(["\\])', r"\\$1")).alias("value")))
    out.union(as_dot(edges)).union(line("}")).write.text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge list: a line with the number of nodes, then a line "from to" for each edge."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.size(parts) == 2)
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def write_edges(edges: DataFrame, path: str) -> None:
    nodes = edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).cast("string").alias("value"))
    nodes.union(edges.select(F.concat_ws(" ", "src", "dst").alias("value"))).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence of each record of a FASTA file."""
    records = spark.read.option("lineSep", ">").text(path)
    lines = F.split("value", "\n")
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "")
    return records.select(F.trim(lines[0]).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence")).where("sequence <> ''")
