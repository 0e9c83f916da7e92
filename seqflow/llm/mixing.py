"""Mixing sources to target weights by entropy balancing.

Each document gets the rate min(cap, exp(lambda * size / mean size)) that is nearest to 1 in relative entropy, among
the rates of at most cap that meet its source's token constraint. The convex dual has one lambda for each source;
its Newton steps are aggregates over (source, size) cells, never over a source's rows in one task. Main path:
DataFrame functions only.

Defined results: a null or empty text has size 0 and takes 0; null is a source of its own, the last one; null and
repeated ids and repeated rows are documents like any other; among rows of one source and size a hash of their ids and
texts says which get the odd copy; an empty table gives an empty result; other columns are ignored, or kept whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqflow.llm.common import WORD, cut, named

#: Documented parameters of the solver: relative error of a source's tokens, most Newton steps (beyond it an error is
#: raised), steps in one statement, repair rounds.
TOLERANCE, MAX_STEPS, FUSED, REPAIRS = 1e-7, 90, 3, 5


def targets(cells: DataFrame, cap: float) -> DataFrame:
    """_s, source_size, target. Weights 1, 2, 3 repeating by code point, null last; a row for each source."""
    sources = cells.groupBy("_s").agg(F.sum(F.col("_x") * F.col("_n")).alias("source_size"))
    ranked = sources.withColumn(
        "_w", ((F.row_number().over(Window.orderBy(F.col("_s") == "n", "_s")) - 1) % 3 + 1).cast("double")
    )
    # targets are min(cap * size, weight * level); the level comes from the sources in the order they reach their cap
    total, order = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_left", F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / (F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))))
    )
    met = F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(total)
    return levels.select(
        "_s", "source_size",
        F.least(F.col("_cap"), F.col("_w") * F.coalesce(met["_level"], F.lit(math.inf))).alias("target"),
    )


def rate(cap: float) -> F.Column:
    return F.when(F.col("_full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("_lambda") * F.col("_x") / F.col("_mean"))))


def solve(cells: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """goals with each source's lambda, by Newton steps kept inside a bracket."""
    sizes = cells.groupBy("_s").agg((F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    state = cut(
        goals.join(sizes, "_s")
        .withColumn("_mean", F.greatest("_mean", F.lit(1e-9)))
        .withColumn("_full", F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)))
        .withColumn("_lambda", F.when(F.col("_full"), 0.0).otherwise(F.log(F.col("target") / F.col("source_size"))))
        .withColumn("_lo", F.col("_mean") * -60.0)
        .withColumn("_hi", F.col("_mean") * (math.log(cap) + 0.1) + 1.0)
        .withColumn("_done", F.col("_full")),
        "mix-state",
    )
    for _ in range(0, MAX_STEPS, FUSED):
        if state.where("not _done").limit(1).count() == 0:
            return state
        for _ in range(FUSED):
            state = step(cells, state, cap)
        state = cut(state, "mix-state")
    if state.where("not _done").limit(1).count():
        raise RuntimeError(f"sources without a solution after {MAX_STEPS} steps")
    return state


def step(cells: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """A Newton step for each source that is not done; a bisection where it would leave the bracket."""
    r, x, n = rate(cap), F.col("_x"), F.col("_n")
    sums = (
        cells.join(state.where("not _done").select("_s", "_lambda", "_mean", "_full"), "_s")
        .groupBy("_s")
        .agg(F.sum(n * x * r).alias("_got"), F.sum(F.when(r < cap, n * x * x / F.col("_mean") * r).otherwise(0.0)).alias("_slope"))
    )
    over = F.col("_got") - F.col("target")
    moved = state.join(sums, "_s", "left")
    moved = moved.withColumn("_lo", F.when(over < 0, F.col("_lambda")).otherwise(F.col("_lo"))).withColumn(
        "_hi", F.when(over > 0, F.col("_lambda")).otherwise(F.col("_hi"))
    )
    moved = moved.withColumn("_next", F.when(F.col("_slope") > 0, F.col("_lambda") - F.try_divide(over, F.col("_slope"))))
    bisect = (F.col("_lo") + F.col("_hi")) / 2
    tight = F.col("_hi") - F.col("_lo") <= F.col("_mean") * 1e-12  # no double lies between: as near as it gets
    keep = F.col("_done") | (F.abs(over) <= F.col("target") * TOLERANCE) | tight
    good = (F.col("_next") > F.col("_lo")) & (F.col("_next") < F.col("_hi"))
    return moved.select(
        "_s", "source_size", "target", "_mean", "_full",
        F.when(keep, F.col("_lambda")).when(good, F.col("_next")).otherwise(bisect).alias("_lambda"),
        "_lo", "_hi", F.coalesce(keep, F.lit(False)).alias("_done"),
    )


def rounded(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """cells with _k, the copies of the documents of a cell together.

    Rates are rounded along the sizes, largest first, so that the copies so far are never off by more than a half;
    then, a few times, the largest cell whose size fits the source's remaining error gives or takes copies.
    """
    order = Window.partitionBy("_s").orderBy(F.desc("_x"))
    upto = F.sum(F.col("_n") * rate(float(cap))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    copies = (
        cells.join(state, "_s")
        .withColumn("_c", F.floor(upto + 0.5 + 1e-9))
        .withColumn("_k", F.least(F.col("_c") - F.coalesce(F.lag("_c").over(order), F.lit(0)), F.col("_n") * cap))
        .withColumn("_k", F.greatest("_k", F.lit(0)))
        .select("_s", "_x", "_n", "_k", "source_size", "target")
    )
    for i in range(REPAIRS):
        copies = cut(copies, f"mix-copies-{i}")
        off = copies.groupBy("_s").agg((F.first("target") - F.sum(F.col("_k") * F.col("_x"))).alias("_off"))
        with_off = copies.join(off, "_s")
        room = F.when(F.col("_off") > 0, F.col("_n") * cap - F.col("_k")).otherwise(F.col("_k"))
        fits = (F.col("_x") > 0) & (F.col("_x") <= F.abs("_off") + F.col("_x") * 0.49) & (room > 0)
        pick = with_off.groupBy("_s").agg(F.max(F.when(fits, F.col("_x"))).alias("_pick"), F.first("_off").alias("_off"))
        by = F.least(room, F.greatest(F.lit(1), F.floor(F.abs("_off") / F.col("_x"))))
        copies = copies.join(pick, "_s").withColumn(
            "_k", F.when(F.col("_x") == F.col("_pick"), F.col("_k") + F.when(F.col("_off") > 0, by).otherwise(-by)).otherwise(F.col("_k"))
        ).select("_s", "_x", "_n", "_k", "source_size", "target")
    return copies


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken = copies * size for each row of df, and its columns in keep.

    size: words of the text. No document is copied more than cap times. Which documents of one source and size get
    the odd copy depends on a hash of their ids and texts.
    """
    keys = df.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_s"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_x"),
        F.xxhash64(id_col, text_col).alias("_h"),
        *[named(c).alias(f"_keep_{c}") for c in keep],
    )
    lean = keys if keep else cut(keys, "mix-keys")
    cells = cut(lean.groupBy("_s", "_x").agg(F.count("*").alias("_n")), "mix-cells")
    state = solve(cells, targets(cells, cap), float(cap))
    copies = cut(rounded(cells, state, cap), "mix-copies")

    # a rank of each document in its cell, by parts so that no cell meets in one task
    rows = cells.agg(F.sum("_n")).first()[0] or 0
    n_parts = max(1, math.isqrt(rows))
    part = F.pmod(F.xxhash64("_h", F.lit("part")), F.lit(n_parts)).cast("int")
    parted = keys if keep else lean
    parted = parted.withColumn("_part", part)
    earlier = Window.partitionBy("_s", "_x").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        lean.withColumn("_part", part)
        .groupBy("_s", "_x", "_part")
        .agg(F.count("*").alias("_m"))
        .withColumn("_from", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
        .join(copies, ["_s", "_x"])
    )
    own = Window.partitionBy("_s", "_x", "_part").orderBy(F.xxhash64("_h", F.lit("rank")), "_h", *[F.xxhash64(named(f"_keep_{c}")) for c in keep if "map<" not in df.schema[c].dataType.simpleString()])
    # there are as many parts as the root of the rows for each cell: merged, never broadcast
    ranked = parted.withColumn("_rn", F.row_number().over(own)).join(parts.hint("merge"), ["_s", "_x", "_part"])
    n_copies = F.expr("_k div _n") + F.when(F.col("_from") + F.col("_rn") <= F.col("_k") % F.col("_n"), 1).otherwise(0)
    return ranked.select(
        F.col("_id").alias("doc_id"),
        F.col("_x").alias("size"),
        "source_size",
        "target",
        n_copies.alias("copies"),
        (n_copies * F.col("_x")).alias("taken"),
        *[named(f"_keep_{c}").alias(f"keep_{c}") for c in keep],
    )
