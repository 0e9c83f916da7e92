"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges, overfull ranges subdivided.

The key of a record is a 64-bit hash of its text, so equal texts are neighbours. Main path: DataFrame functions only.

Defined results: a null text has 0 bytes and the checksum of the empty text; null ids, repeated ids and repeated rows
are records like any other; an empty table gives an empty result; other columns of the input are ignored, or kept,
whatever their names. A record larger than a shard's share is placed whole.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqflow.llm.common import cut, named, uniform

#: Bounds of what the driver holds: splitters, and samples (8 bytes each).
MAX_RANGES, SAMPLES_PER_RANGE = 8192, 16
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def splitters(keys: DataFrame, n_ranges: int, total: int) -> list[int]:  # keys: _h, the key; _size; _id
    """Boundaries at the quantiles of a size-weighted sample of _h; a key that fills several ranges is repeated.

    A row of size s is drawn s * rate times on average, so the sample has about n_ranges * SAMPLES_PER_RANGE values,
    whatever the number of rows.
    """
    rate = n_ranges * SAMPLES_PER_RANGE / total
    draws = F.floor(F.col("_size") * F.lit(rate) + uniform(F.col("_h"), F.col("_id"), F.lit("draw")))
    drawn = keys.select("_h", draws.alias("_n")).where("_n > 0").groupBy("_h").agg(F.sum("_n").alias("_n")).collect()
    drawn.sort()
    at, seen, out = 1, 0, []
    n = sum(r["_n"] for r in drawn)
    for r in drawn:
        seen += r["_n"]
        while at < n_ranges and seen >= at * n / n_ranges:
            out.append(r["_h"])
            at += 1
    return out


def at_or_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below value: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to a constant

    def step(found: Column, by: Column) -> Column:
        return F.when((found + by <= len(bounds)) & (F.get(array, found + by - 1) <= value), found + by).otherwise(found)

    return F.aggregate(F.lit(steps) if len(steps) > 1 else F.array(F.lit(1)), F.lit(0), step)


def shard(
    df: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    range_bytes: int = 64 << 20,
    group_share: float = 0.01,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A shard and a gapless slot in it for each row, by law "bytes": the shards' sizes are near equal.

    size: UTF-8 bytes of the text plus overhead. A group of equal texts stays in one shard unless it is larger than
    group_share of a shard. Shards differ by that share and one record at most. Columns in keep follow as keep_<name>.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = cut(
        df.select(
            F.col(id_col).cast("long").alias("_id"),
            (F.octet_length(text).cast("long") + overhead).alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.xxhash64(text).alias("_h"),
            # where there is no id, the row's place in this table, which is written: a group without ids can be parted
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("_place_of_null"),
            *[named(c).alias(f"keep_{c}") for c in keep],
        ),
        "shard-keys",
    )
    kept = [f"keep_{c}" for c in keep]
    total = keys.agg(F.sum("_size")).first()[0]
    if not total:
        return df.sparkSession.createDataFrame([], SCHEMA + "".join(f", `keep_{c}` {df.schema[c].dataType.simpleString()}" for c in keep))
    n_ranges = min(MAX_RANGES, max(4 * n_shards, math.ceil(total / range_bytes)))
    drawn = splitters(keys, n_ranges, total)
    bounds = sorted(set(drawn))
    heavy = [b for b, n in Counter(drawn).items() if n > 1]
    is_heavy = F.col("_h").isin(heavy) if heavy else F.lit(False)
    # two ids a range: one for its heavy splitter alone, one for the rest
    ranged = keys.withColumn("_heavy", is_heavy).withColumn(
        "_range", 2 * at_or_below(F.col("_h"), bounds) + F.when(F.col("_heavy"), 0).otherwise(1)
    )
    sizes = ranged.groupBy("_range").agg(F.sum("_size").alias("bytes")).collect()  # 2 * MAX_RANGES rows at most
    full = total / n_ranges
    parts = [1] * (2 * len(bounds) + 2)
    for r in sizes:
        if r["bytes"] > 2 * full:
            parts[r["_range"]] = math.ceil(r["bytes"] / full)
    ranged = ranged.withColumn(
        "_sub",
        F.pmod(
            F.when(F.col("_heavy"), F.xxhash64("_id", "_place_of_null", F.lit("part"))).otherwise(F.xxhash64("_h", F.lit("part"))),
            F.get(F.lit(parts), F.col("_range")),
        ).cast("int"),
    )

    before = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range part
    offsets = (
        ranged.groupBy("_range", "_sub")
        .agg(F.sum("_size").alias("_bytes"))
        .select("_range", "_sub", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"))
    )
    own = Window.partitionBy("_range", "_sub").orderBy("_h", "_id", "_size")
    group = Window.partitionBy("_range", "_sub", "_h")
    small = F.lit(int(total / n_shards * group_share))
    place = F.when(F.col("_group") <= small, F.col("_group_from") + F.expr("_group div 2")).otherwise(
        F.col("_at") + F.expr("_size div 2")
    )
    placed = cut(
        ranged.join(F.broadcast(offsets), ["_range", "_sub"])
        .withColumn("_rn", F.row_number().over(own))
        .withColumn("_at", F.col("_from") + F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_group", F.sum("_size").over(group))
        .withColumn("_group_from", F.min("_at").over(group))
        .withColumn("_place", place)
        .selectExpr(
            "_id", "_size", "_crc", "_range", "_sub", "_rn",
            f"least(cast(floor(_place / {total}D * {n_shards}) as int), {n_shards - 1}) as _shard",
            *[f"`{c.replace('`', '``')}`" for c in kept],
        ),
        "shard-placed",
    )
    rows_before = Window.partitionBy("_shard").orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy("_range", "_sub", "_shard")
        .agg(F.count("*").alias("_n"), F.min("_rn").alias("_first"))
        .select("_range", "_sub", "_shard", "_first", F.coalesce(F.sum("_n").over(rows_before), F.lit(0)).alias("_slots"))
    )
    # a part of a range meets few shards, so there are as many pieces as parts and shards together at most
    return placed.join(F.broadcast(pieces), ["_range", "_sub", "_shard"]).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_slots") + F.col("_rn") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *map(named, kept),
    )
