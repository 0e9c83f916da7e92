"""Graph and list workloads by iterated joins; each round reads the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqflow.lineage import cut

#: Tables that a union of levels has at most.
PIECES = 16


def bfs(edges: DataFrame, start: int, max_levels: int = 1_000_000) -> DataFrame:
    """node, level: the least number of edges from start. Nodes that can't be reached are absent; a deeper graph than max_levels is an error."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, 0)], "node long, level int")
    seen, pieces = frontier, 1
    for level in range(1, max_levels):
        reached = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.limit(1).count() == 0:
            return seen
        seen, pieces = seen.union(frontier), pieces + 1
        if pieces == PIECES:  # so that the plan stays short however many levels there are
            seen, pieces = cut(seen, "seen"), 1
    raise RuntimeError(f"nodes are left beyond {max_levels - 1} levels")


def shortest_path(edges: DataFrame, start: int, to: int, unreachable: int | None = None) -> DataFrame:
    """One row, length: the least number of edges; `unreachable` (null by default, 0 for parity) where there is no path."""
    found = bfs(edges, start).where(F.col("node") == to).agg(F.min("level").alias("length"))
    return found.select(F.coalesce("length", F.lit(unreachable)).cast("int").alias("length"))


def list_rank(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """id, rank: the number of nodes before each in its linked list. nodes: id, next (null at the end). Pointer doubling."""
    before = nodes.where("next is not null").select(F.col("next").alias("_of"), F.col("id").alias("_prev"))
    state = cut(nodes.select("id").join(before, F.col("id") == F.col("_of"), "left").select("id", F.col("_prev").alias("p"), F.when(F.col("_prev").isNull(), 0).otherwise(1).cast("long").alias("rank")), "ranks")
    for _ in range(max_rounds):
        if state.where("p is not null").limit(1).count() == 0:
            return state.select("id", "rank")
        other = state.select(F.col("id").alias("_id"), F.col("p").alias("_p"), F.col("rank").alias("_r"))
        state = cut(state.join(other, F.col("p") == F.col("_id"), "left").select("id", F.col("_p").alias("p"), (F.col("rank") + F.coalesce("_r", F.lit(0))).alias("rank")), "ranks")
    raise RuntimeError("the list has a cycle")
