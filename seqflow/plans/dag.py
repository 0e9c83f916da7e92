"""Task graphs: dependencies from access modes, readiness, critical path, partitions.

Accesses to a datum fall into versions: consecutive accesses that may run together (all reads, or all cumulative
writes) share one, an exclusive access (write, read-write) has one of its own. An access waits for all of the version
before its own. Versions, not pairs of tasks, carry the dependencies, so a datum with n accesses has n links, not n^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqflow.lineage import cut

CONCURRENT = ("R", "CW")
#: Tables that a union of levels has at most.
PIECES = 16


def versions(accesses: DataFrame) -> DataFrame:
    """task_id, datum, mode, version, ready, renamed, reduced, waits_for (accesses in the version before).

    accesses: task_id, datum, mode of V, R, W, RW, CW in program order of task_id.
    """
    order = Window.partitionBy("datum").orderBy("task_id")
    before = F.lag("mode").over(order)
    together = F.coalesce((F.col("mode") == before) & F.col("mode").isin(*CONCURRENT), F.lit(False))
    numbered = accesses.withColumn("_new", F.when(together, 0).otherwise(1)).withColumn("version", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    sizes = numbered.groupBy("datum", "version").agg(F.count("*").alias("_n"))
    earlier = sizes.select("datum", (F.col("version") + 1).alias("version"), F.col("_n").alias("waits_for"))
    first = F.col("version") == 0
    return numbered.join(earlier, ["datum", "version"], "left").select(
        "task_id",
        "datum",
        "mode",
        "version",
        (first | F.col("mode").isin("W", "V")).alias("ready"),  # a pure write is renamed, so it need not wait
        ((F.col("mode") == "W") & ~first).alias("renamed"),
        (F.col("mode") == "CW").alias("reduced"),
        F.coalesce("waits_for", F.lit(0)).alias("waits_for"),
    )


def ready_tasks(versioned: DataFrame) -> DataFrame:
    """Tasks all of whose accesses are ready."""
    return versioned.groupBy("task_id").agg(F.count_if(~F.col("ready")).alias("blocked")).where("blocked = 0").select("task_id")


def conflict_edges(versioned: DataFrame) -> DataFrame:
    """src, dst, kind (RAW, WAR, WAW) between tasks of neighbouring versions of a datum."""
    a = versioned.select("datum", (F.col("version") + 1).alias("version"), F.col("task_id").alias("src"), F.col("mode").alias("_a"))
    b = versioned.select("datum", "version", F.col("task_id").alias("dst"), F.col("mode").alias("_b"))
    kind = F.when(F.col("_a") == "R", "WAR").when(F.col("_b") == "R", "RAW").when(F.col("_b") == "RW", "RAW").otherwise("WAW")
    return a.join(b, ["datum", "version"]).select("src", "dst", kind.alias("kind"))


def critical_path(tasks: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """task_id, date: 0 at sinks, else one more than the greatest of the successors. By levels from the sinks.

    A round fixes the tasks whose successors all have dates; each round reads the last one's table, so plans stay short.
    Tasks that get no date, as on a cycle or on a path longer than max_rounds, are an error.
    """
    left = cut(edges.groupBy("src").agg(F.count("*").alias("_open")), "open")
    done = cut(tasks.join(left, F.col("task_id") == F.col("src"), "left_anti").select("task_id", F.lit(0).alias("date")), "dates")
    frontier, out = done, [done]
    for level in range(1, max_rounds):
        closed = edges.join(frontier.select(F.col("task_id").alias("dst")), "dst").groupBy("src").agg(F.count("*").alias("_closed"))
        left = cut(left.join(closed, "src", "left").select("src", (F.col("_open") - F.coalesce("_closed", F.lit(0))).alias("_open")), "open")
        frontier = cut(left.where("_open = 0").select(F.col("src").alias("task_id"), F.lit(level).alias("date")), "dates")
        if frontier.limit(1).count() == 0:
            break
        left = left.where("_open > 0")
        out.append(frontier)
        if len(out) == PIECES:
            out = [cut(union_all(out), "dates")]
    if left.limit(1).count() > 0:
        raise RuntimeError(f"tasks are left without a date: the graph has a cycle, a path of {max_rounds} edges or more, or an edge to no task")
    return union_all(out)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def activated(edges: DataFrame, done: DataFrame) -> DataFrame:
    """task_id of the tasks that become ready: not done, with predecessors, all of which are done. done: task_id."""
    finished = done.select("task_id").distinct().withColumn("_done", F.lit(True))
    met = edges.select("src", "dst").distinct().join(finished, F.col("src") == F.col("task_id"), "left").groupBy("dst").agg(F.bool_and(F.col("_done").isNotNull()).alias("_all"))
    return met.where("_all").select(F.col("dst").alias("task_id")).join(done.select("task_id"), "task_id", "left_anti")


def priority(date: Column, longest: Column, levels: int, how: str = "linear") -> Column:
    """A task's priority from its date: the date itself, scaled to levels, or all that is on a longest path first."""
    match how:
        case "identity":
            return date
        case "linear":
            return F.floor(date * (levels - 1) / F.greatest(longest, F.lit(1)))
        case "max":
            return F.when(date == longest, levels - 1).otherwise(0)
    raise ValueError(how)


def cut_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between partitions: src, dst, src_part, dst_part. parts: task_id, part."""
    p = lambda end: parts.select(F.col("task_id").alias(end), F.col("part").alias(f"{end}_part"))
    return edges.join(p("src"), "src").join(p("dst"), "dst").where("src_part <> dst_part").select("src", "dst", "src_part", "dst_part")
