"""Pairs of sets of hashes in different groups whose Jaccard similarity is t tenths or more: all of them, by prefixes.

A set of n hashes shares need(n) = ceil(t n / 10) or more with any such partner. So in each order of hashes the first k
that two partners share are among the first n - need(n) + k of either. Three passes use that, none with a cap:

1. In the order of the hashes, with k = a tenth of n: sets stay of whose prefix enough is in another group's prefix.
2. Whole sets of those: sets stay of which need(n) hashes are in another group's set.
3. In the order of how many of these sets have a hash, with k = 1: sets that meet are compared hash by hash.

Hashes are dealt to as many buckets as their number needs, and passes 1 and 2 only count within a hash. Equality of 64-bit
hashes stands for that of the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import cut, discard

#: Hashes in a bucket, about; a task holds one or a few.
BUCKET = 1 << 20
#: A prefix of pass 1 has 1 in so many of the set's hashes more than the set may lack.
MORE = 10


def need(n: int, tenths: int) -> int:
    """Hashes that a set of n shares with a partner, at least."""
    return -(-tenths * n // 10)


def prefix(hashes: np.ndarray, tenths: int) -> np.ndarray:
    """The part of a set, sorted, that pass 1 compares."""
    n = len(hashes)
    return hashes[: n - need(n, tenths) + max(1, n // MORE)]


def _need(n: Column, tenths: int) -> Column:
    return F.ceil(F.lit(tenths) * n / F.lit(10)).cast("int")


def _deal(buckets: int):
    """Rows (set, group, hashes) to a row for each bucket that they meet."""

    def dealt(numbers: list[np.ndarray], lists: list[np.ndarray]) -> pa.RecordBatch:
        hashes, own = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        begins = np.flatnonzero(np.diff(bucket, prepend=-1))
        columns = [np.split(x, begins[1:]) for x in (hashes[order], *(x[own[order]] for x in numbers))]
        arrays = [pa.array([x.tobytes() for x in c], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), *arrays], ["bucket", "hashes", "sets", "groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lists, first, size = [batch.column(k).to_numpy() for k in (0, 1)], [], 0, 0
            for i, x in enumerate(batch.column(2), 1):
                lists.append(np.frombuffer(x.as_buffer(), np.uint64))
                size += len(lists[-1])
                if size >= BUCKET or i == batch.num_rows:
                    yield dealt([x[first:i] for x in numbers], lists)
                    lists, first, size = [], i, 0

    return run


def _count(each: bool):
    """Of hashes that sets of two or more groups have: each one with its sets, or how many of them a set has in a bucket."""

    def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, own, group = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, own, group = h[order], own[order], group[order]
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(begins, len(h)))
        several = np.repeat(np.minimum.reduceat(group, begins) != np.maximum.reduceat(group, begins), sizes)
        h, own, sizes = h[several], own[several], np.repeat(sizes, sizes)[several]
        if not each:
            own, sizes = np.unique(own, return_counts=True)
            h = np.zeros(len(own), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(h.view(np.int64)), pa.array(sizes.astype(np.int64))], ["_set", "hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and parts:
                    yield found(parts)
                    parts = []
                now = bucket
                parts.append(tuple(np.frombuffer(x, t) for x, t in zip(part, (np.uint64, np.int64, np.int64), strict=True)))
        if parts:
            yield found(parts)

    return run


def _shared(sets: DataFrame, hashes: str, each: bool) -> DataFrame:
    """_set, hash, n: see _count."""
    entries = sets.agg(F.sum(F.length(hashes))).first()[0] or 0
    buckets = max(1, entries // 8 // BUCKET)
    dealt = sets.select("_set", "_group", hashes).mapInArrow(_deal(buckets), "bucket long, hashes binary, sets binary, groups binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(each), "_set long, hash long, n long")


def pairs(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], tenths: int) -> DataFrame:
    """a, b: the groups of two sets, for all pairs of similar sets in different groups.

    sets: _set (its number), _group, _n (its size, over 0), _prefix (see prefix(), as bytes) and what whole() needs, which
    gives rows of it their _hashes (all, as bytes, sorted).
    """
    least, n = _need(F.col("_n"), tenths), F.col("_n")
    counts = _shared(sets, "_prefix", False).groupBy("_set").agg(F.sum("n").alias("_met"))
    first = F.col("_met") >= F.greatest(F.lit(1), F.floor(least / F.lit(MORE)))
    some = cut(sets.join(counts, "_set").where(first).drop("_met", "_prefix"), "similar-some")
    full = cut(whole(some).select("_set", "_group", "_n", "_hashes"), "similar-whole")

    # rare hashes first: a hash that no other group has precedes all, so that of these only the number is needed
    listed = _shared(full, "_hashes", True).groupBy("_set").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("_list"))
    shared = F.size("_list")
    kept = full.select("_set", "_group", "_n").join(listed, "_set").where(shared >= least)
    kept = cut(kept.select("_set", "_group", "_n", F.col("_list.hash").alias("_list"), (shared - least + 1).alias("_first")), "similar-kept")
    discard(some, full)

    rare = kept.select("_set", "_group", "_n", F.explode(F.slice("_list", 1, F.col("_first"))).alias("hash"))
    a, b = (rare.select("hash", *[F.col(c).alias(f"{c}_{side}") for c in ("_set", "_group", "_n")]) for side in "ab")
    sizes = F.least("_n_a", "_n_b") * F.lit(10) >= F.greatest("_n_a", "_n_b") * F.lit(tenths)
    met = a.join(b, "hash").where((F.col("_set_a") < F.col("_set_b")) & (F.col("_group_a") != F.col("_group_b")) & sizes)
    met = met.select(*[f"{c}_{side}" for side in "ab" for c in ("_set", "_group", "_n")]).distinct()
    for side in "ab":
        met = met.join(kept.select(F.col("_set").alias(f"_set_{side}"), F.col("_list").alias(f"_list_{side}")), f"_set_{side}")
    both = F.size(F.array_intersect("_list_a", "_list_b"))
    similar = both * F.lit(10 + tenths) >= (F.col("_n_a") + F.col("_n_b")) * F.lit(tenths)
    out = cut(met.where(similar).select(F.col("_group_a").alias("a"), F.col("_group_b").alias("b")).distinct(), "similar-pairs")
    discard(kept)
    return out
