"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to its bit counts in 32 segments of two bits, a point whose Manhattan distance never
exceeds the Hamming distance. The segments form groups. Points meet in a cell of a grid, spanned by some of the groups,
if they agree wholly in these: one equi-join key a grid. In a cell the Manhattan distance is the first filter, the
Hamming distance the second and, where the rule has one, a second and longer print the third.

CONTRACT: shingles of four words, links at 4 or fewer differing bits. Of 7 groups at most 4 can differ, so the grids over
3 groups find every pair for certain.
SIMILAR: shingles of five words, a similarity of 0.8 or more. Five-word prints of such pairs differ in some 10 of 64 bits,
beyond what grids can find, while prints of their distinct two-word shingles differ in 8 or fewer. So those are searched,
and a pair is verified on 256 bits of its distinct five-word shingles: a similarity s is expected to differ in
256 arccos(2 s / (1 + s)) / pi of them, 39 at 0.8, and links have 47 or fewer. The grids are certain for pairs whose
two-word prints differ in 5 or fewer bits and miss some beyond, and prints of some similar pairs differ in more bits. So
between the groups that the grids give, similar.pairs() then finds every pair of 0.8 or more that is left, on the
shingles themselves: none is missed. What only prints link, mostly pairs of 0.6 to 0.8, stays linked.

Counts 0, 1, 2 are held as 00, 01, 11, so that a Manhattan distance is the bit count of an exclusive or.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows and ids have one
fingerprint each; null ids belong to components, whose id is the least non-null one (null where there is none); an
empty table gives an empty result; other columns are ignored, or kept whatever their names by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.llm import similar
from seqflow.llm.common import cut, discard, fresh, named
from seqflow.llm.components import components

SEED = 42
#: Members up to which a cell is compared in one task; larger ones are dealt out as pairs of blocks of half that size.
CELL = 4096
LOW = 0x5555555555555555
#: 64-bit words of the second print.
CHECKS = 4


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, whether each counts once, greatest distance, groups and how many span a grid; words and greatest distance of the second print; tenths of similarity of its shingles that always link."""

    words: int = 4
    distinct: bool = False
    distance: int = 4
    groups: int = 7
    agree: int = 3
    check_words: int = 0
    check_distance: int = 0
    tenths: int = 0

    @property
    def columns(self) -> list[str]:
        return ["_fp", *(f"_c{i}" for i in range(CHECKS if self.check_words else 0))]


CONTRACT = Rule()
SIMILAR = Rule(words=2, distinct=True, distance=8, groups=8, agree=3, check_words=5, check_distance=47, tenths=8)


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each shingle of n words, or of all words if they are fewer."""
    count = max(1, len(words) - n + 1)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count]
    ends = ends[n - 1 :] if len(words) >= n else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of a hash, for each k."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def described(text: bytes | None, rule: Rule) -> tuple[list[int], np.ndarray]:
    """The fingerprint, unsigned, and the words of the second print; the hashes of its distinct shingles, sorted."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return [0] * len(rule.columns), np.empty(0, np.uint64)
    hashes = shingle_hashes(words, rule.words)
    out = [majority(np.unique(hashes) if rule.distinct else hashes)]
    if not rule.check_words:
        return out, np.empty(0, np.uint64)
    hashes = np.unique(shingle_hashes(words, rule.check_words))
    return out + [majority(mixed(hashes, k)) for k in range(CHECKS)], hashes


def prints_of(text: bytes | None, rule: Rule = CONTRACT) -> list[int]:
    """The fingerprint, unsigned, and the words of the second print."""
    return described(text, rule)[0]


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    return prints_of(text)[0]


def nodes(prints: np.ndarray) -> np.ndarray:
    """A number for each row of prints, the print itself where there is but one."""
    out = prints[:, 0].copy()
    for k in range(1, prints.shape[1]):
        out = mixed(out, k) ^ prints[:, k]
    return out


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """_id, _h (64-bit hash of the text), _node and the rule's columns for each row; where it has tenths, the set of shingles: _set (its hash), _n (its size), _prefix."""
    sets = ["_set", "_n", "_prefix"] if rule.tenths else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            rows, more = [], []
            for t in texts:
                row, hashes = described(t.as_py(), rule)
                rows.append(row)
                if sets:
                    more.append((xxhash.xxh64_intdigest(hashes.tobytes(), SEED), len(hashes), similar.prefix(hashes, rule.tenths).tobytes()))
            found = np.array(rows, np.uint64).reshape(-1, len(rule.columns))
            columns = [nodes(found), *found.T]
            arrays = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)]
            if sets:
                arrays += [pa.array(np.array([m[0] for m in more], np.uint64).view(np.int64)), pa.array([m[1] for m in more], pa.int32()), pa.array([m[2] for m in more], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "_h", "_node", *rule.columns, *sets])

    text = F.col(text_col)
    source = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))
    schema = "_id long, _h long, _node long, " + ", ".join(f"{c} long" for c in rule.columns)
    return source.mapInArrow(run, schema + (", _set long, _n int, _prefix binary" if sets else ""))


def embedding(fp: Column) -> Column:
    """The counts of the 32 segments of two bits, in unary."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def masks(rule: Rule = CONTRACT) -> list[int]:
    """A mask for each grid, signed: the segments of its groups."""
    groups = [0] * rule.groups
    for segment in range(32):
        groups[segment * rule.groups // 32] |= 3 << (2 * segment)
    out = [sum(g) for g in combinations(groups, rule.agree)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def unary(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(LOW), (fp >> np.uint64(1)) & np.uint64(LOW)
    return low | high | ((low & high) << np.uint64(1))


def forest(key: np.ndarray, prints: np.ndarray, rule: Rule = CONTRACT) -> list[tuple[int, int]]:
    """Links that connect all members of runs of one key that are joined by chains of links."""
    fp = prints[:, 0]
    point, parent, out = unary(fp), np.arange(len(fp)), []
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))

    def roots(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while (r != (q := parent[r])).any():
            r = q
        parent[i] = r
        return r

    left, k = np.arange(len(fp)), 0
    while True:
        k += 1
        left = left[left + k < len(fp)]
        left = left[run[left] == run[left + k]]
        if not len(left):
            return out
        if k & (k - 1) == 0 and k > 1:  # runs that are connected wholly need no more comparisons
            r = roots(np.arange(len(fp)))
            whole = np.minimum.reduceat(r, begins) == np.maximum.reduceat(r, begins)
            left = left[~whole[run[left]]]
        near = left[np.bitwise_count(point[left] ^ point[left + k]) <= rule.distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= rule.distance]
        if rule.check_words and len(near):
            near = near[np.bitwise_count(prints[near, 1:] ^ prints[near + k, 1:]).sum(1, dtype=np.int64) <= rule.check_distance]
        if not len(near):
            continue
        a, b = roots(near), roots(near + k)
        for i in near[a != b].tolist():
            ra, rb = i, i + k
            while parent[ra] != ra:
                ra = int(parent[ra])
            while parent[rb] != rb:
                rb = int(parent[rb])
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((i, i + k))


def _scan(limit: int, rule: Rule):
    """Over rows (key, prints) sorted by key: links within each key, and the members of keys with more than limit rows."""
    width = len(rule.columns)

    def table(a: np.ndarray, b: np.ndarray, key: np.ndarray, big: bool, prints: np.ndarray) -> pa.RecordBatch:
        columns = [a, b, key, *prints[:, 1:].T]
        arrays = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns]
        return pa.RecordBatch.from_arrays([*arrays[:3], pa.array(np.full(len(a), big)), *arrays[3:]], ["a", "b", "key", "big", *rule.columns[1:]])

    def members(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        return table(prints[:, 0], prints[:, 0], key, True, prints)

    def links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        pairs, node = np.array(forest(key, prints, rule), np.int64).reshape(-1, 2), nodes(prints)
        return table(node[pairs[:, 0]], node[pairs[:, 1]], key[pairs[:, 0]], False, prints[pairs[:, 0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints, streaming = np.empty(0, np.int64), np.empty((0, width), np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column(0).to_numpy(), np.column_stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]])
            if streaming is not None:  # the rest of a large cell
                n = int(np.searchsorted(new[0], streaming, "right")) if new[0][0] == streaming else 0
                if n:
                    yield members(new[0][:n], new[1][:n])
                new = new[0][n:], new[1][n:]
                if not len(new[0]):
                    continue
                streaming = None
            key, prints = np.concatenate((key, new[0])), np.concatenate((prints, new[1]))
            last = int(np.searchsorted(key, key[-1], "left"))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            big = np.repeat(sizes > limit, sizes)
            if big.any():
                yield members(key[big], prints[big])
                streaming = key[-1] if big[-1] else None
            done = ~big[:last]
            if done.any():
                yield links(key[:last][done], prints[:last][done])
            keep = slice(len(key) if streaming is not None else last, None)
            key, prints = key[keep], prints[keep]
        if len(key):
            yield links(key, prints)

    return run


def links(prints: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """a, b: links between the nodes of prints (distinct rows of the rule's columns) that give all components of the rule's graph."""
    schema = "a long, b long, key long, big boolean" + "".join(f", {c} long" for c in rule.columns[1:])
    point = embedding(F.col("_fp"))
    cells = F.array(*[F.xxhash64(F.lit(i), point.bitwiseAND(F.lit(m))) for i, m in enumerate(masks(rule))])
    # each print becomes a row for each grid, so that few rows are dealt to as many tasks as their grids' rows need
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select(*rule.columns).distinct().repartition(tasks, F.col("_fp")).select(F.explode(cells).alias("key"), *rule.columns)
    met = cut(rows.repartition("key").sortWithinPartitions("key", *rule.columns).mapInArrow(_scan(CELL, rule), schema), "cells")

    # cells too large for one task: each pair of its blocks is a cell of its own
    large = met.where("big").select("key", F.col("a").alias("_fp"), *rule.columns[1:])
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(CELL // 2)).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64(*rule.columns, F.lit("block")), F.col("_blocks")).cast("int")
    pairs = (
        large.join(sizes, "key")
        .withColumn("_block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(F.xxhash64("key", F.least("_block", "_other"), F.greatest("_block", "_other")).alias("key"), *rule.columns)
    )
    rest = pairs.repartition("key").sortWithinPartitions("key", *rule.columns).mapInArrow(_scan(1 << 62, rule), schema)
    return met.where("not big").select("a", "b").union(rest.select("a", "b"))


def whole_sets(df: DataFrame, sets: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """sets (rows with _id and _h of a row of df that has the set) with all _hashes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            for i in range(0, len(texts), 256):
                hashes = [np.unique(shingle_hashes(t.as_py().lower().split(), rule.check_words)).tobytes() for t in texts[i : i + 256]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 256) for k in range(3)), pa.array(hashes, pa.binary())], ["_set", "_group", "_n", "_hashes"])

    text = F.col(text_col)
    texts = df.select(F.col(id_col).cast("long").alias("_tid"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    found = texts.join(sets, (F.col("_th") == F.col("_h")) & F.col("_tid").eqNullSafe(F.col("_id")))
    hashed = found.select("_set", "_group", "_n", "_text").mapInArrow(run, "_set long, _group long, _n int, _hashes binary")
    return hashed.dropDuplicates(["_set"])  # of rows that are repeated


def complete(df: DataFrame, prints: DataFrame, roots: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """roots (id, root of all nodes) with groups joined that hold a pair of the rule's tenths of similarity."""
    row = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h")).alias("_row")
    sets = prints.where("_n > 0").groupBy("_set").agg(row, F.min("_node").alias("id"), F.min("_n").alias("_n"), F.first("_prefix").alias("_prefix"))
    sets = cut(sets.join(roots, "id").select("_set", F.col("root").alias("_group"), "_n", "_prefix", "_row._id", "_row._h"), "sets")
    joined = components(similar.pairs(sets, lambda some: whole_sets(df, some, rule, id_col, text_col), rule.tenths))
    discard(sets)
    joined = joined.select(F.col("id").alias("root"), F.col("root").alias("_whole"))
    return roots.join(joined, "root", "left").select("id", F.coalesce("_whole", "root").alias("root"))


def simhash(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, _h, fingerprint (16 hexadecimal digits), component_id, _class (a node that names the component) for each row."""
    rows = prints = cut(fingerprints(df, id_col=id_col, text_col=text_col, rule=rule), "fingerprints")
    firsts = cut(prints.groupBy("_node", *[c for c in rule.columns if rule.check_words]).agg(F.min("_id").alias("_first")), "distinct")
    roots = components(links(firsts if rule.check_words else firsts.withColumnRenamed("_node", "_fp"), rule))
    if rule.tenths:
        prints = cut(rows.drop("_set", "_n", "_prefix"), "prints")
        own = cut(firsts.join(roots, F.col("_node") == F.col("id"), "left").select(F.col("_node").alias("id"), F.coalesce("root", "_node").alias("root")), "roots")
        roots = complete(df, rows, own, rule, id_col, text_col)
        discard(rows)
    linked = firsts.join(roots, F.col("_node") == F.col("id")).select("_node", "_first", "root")
    least = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    # written, so that a fingerprint that many rows share is split by the join below
    classes = cut(
        firsts.select("_node", "_first").join(linked.join(least, "root").select("_node", "_least", "root"), "_node", "left").select(
            "_node", F.coalesce("_least", "_first").alias("component_id"), F.coalesce("root", "_node").alias("_class")
        ),
        "classes",
    )
    discard(firsts)
    return prints.join(classes, "_node").select(
        F.col("_id").alias("doc_id"), "_h", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "_class"
    )


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule = SIMILAR) -> DataFrame:
    """One row of each group of near-duplicates: of those with its least id (null where no row has one) the least hash of a text."""
    found = simhash(df, id_col=id_col, text_col=text_col, rule=rule)
    kept_id, kept_h, row_h = fresh(df, "kept_id", "kept_h", "row_h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("_kept")
    kept = cut(found.groupBy("_class").agg(first).select(F.col("_kept.doc_id").alias(kept_id), F.col("_kept._h").alias(kept_h)), "kept")
    marked = df.withColumn(row_h, F.xxhash64(F.col(text_col)))
    out = marked.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(row_h) == F.col(kept_h)), "left_semi")
    repeated = df.groupBy(F.col(id_col).alias("_rid")).count().where("count > 1").limit(1).count() > 0
    return (out.dropDuplicates([id_col, row_h]) if repeated else out).select(*map(named, df.columns))
