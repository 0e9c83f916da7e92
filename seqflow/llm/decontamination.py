"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number n of distinct word shingles, [2^c, 2^(c+1)). An item's sketch is its k shingles
of least hash (a bottom-k MinHash). With containment t or more an item misses floor((1 - t) n) shingles at most, so with
k = floor((1 - t) (2^(c+1) - 1)) + 1 a document that contains it has one of the sketch for certain: the search loses
nothing, however long the document. Candidates are verified on the shingles themselves. Main path: DataFrame
functions only.

Words are runs of letters and digits in lower case; shingles are five words. Defined results: an item of fewer than
five words has one shingle, all of them, and documents are then cut to shingles of as many words; items and texts
without words match nothing; null ids are kept; a document that is repeated word for word under one id gives one
result; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import cut, fresh

WORDS, THRESHOLD = 5, 0.8
#: Rows of sketches (16 bytes each) up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_shared int, containment double"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def each_shingle(words: Column, n: int, f) -> Column:
    """f(i) for the index of each shingle's first word; an empty array if there are fewer words."""
    empty = F.array().cast("array<int>")
    return F.transform(F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(empty), f)


def shingle_hashes(hashes: Column, n: int) -> Column:
    return each_shingle(hashes, n, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))


def shingles(words: Column, n: int) -> Column:
    """words must be a plain column: an expression would be evaluated for each shingle."""
    return F.array_distinct(each_shingle(words, n, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))


def sketches(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """_item, _sh: the least hashes of each item's shingles, as many as its size class asks for."""
    hashed = items.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_all", F.array_distinct(shingle_hashes(F.col("_wh"), n)))
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.size("_all"))) + 1) - 1
    k = (F.floor(F.lit(1 - threshold) * most + 1e-9) + 1).cast("int")
    # ordered by a second hash, so that the sample does not depend on the join key's own order
    ordered = F.array_sort(F.transform("_all", lambda h: F.struct(F.xxhash64(h, F.lit("min")).alias("o"), h.alias("h"))))
    return hashed.where(F.size("_all") > 0).select("_item", F.explode(F.slice(ordered, F.lit(1), k)).alias("_s")).select("_item", F.col("_s.h").alias("_sh"))


def contained(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, _h (hash of the text), item_id, n_item_shingles, n_shared, containment for each item in a document."""
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), words_of(F.col(item_text_col)).alias("_words")).distinct().withColumn(
        "_n", F.least(F.size("_words"), F.lit(WORDS))
    )
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    lengths = sorted(r[0] for r in items.where("_n > 0").select("_n").distinct().collect())  # WORDS values at most
    out = None
    for n in lengths or [WORDS]:
        own = items.where(F.col("_n") == n)
        sketch = cut(sketches(own, n, threshold), "sketches")
        if sketch.count() <= BROADCAST_ROWS:
            sketch = F.broadcast(sketch)
        hashes = source.select("_id", "_h", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)).alias("_wh"))
        hits = hashes.select("_id", "_h", F.explode(shingle_hashes(F.col("_wh"), n)).alias("_sh")).join(sketch, "_sh")
        candidates = cut(hits.groupBy("_id", "_h").agg(F.collect_set(F.struct("_item")).alias("_items")), "candidates")
        full = own.select(F.col("_item").alias("_full_item"), shingles(F.col("_words"), n).alias("_item_shingles")).where(F.size("_item_shingles") > 0)
        same = F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_h") == F.col("_ch"))
        pairs = (
            source.join(candidates.select(F.col("_id").alias("_cid"), F.col("_h").alias("_ch"), "_items"), same)
            .select("_id", "_h", words_of(F.col("_text")).alias("_words"), "_items")
            .select("_id", "_h", shingles(F.col("_words"), n).alias("_doc_shingles"), F.explode("_items").alias("_c"))
        )
        shared = F.size(F.array_intersect("_doc_shingles", "_item_shingles"))
        found = (
            pairs.join(full, F.col("_c._item").eqNullSafe(F.col("_full_item")))
            .select("_id", "_h", "_full_item", F.size("_item_shingles").alias("_of"), shared.alias("_shared"))
            .where(F.col("_shared") >= F.col("_of") * threshold)
        )
        out = found if out is None else out.union(found)
    return out.distinct().select(
        F.col("_id").alias("doc_id"),
        "_h",
        F.col("_full_item").alias("item_id"),
        F.col("_of").alias("n_item_shingles"),
        F.col("_shared").alias("n_shared"),
        (F.col("_shared") / F.col("_of")).alias("containment"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that contain no benchmark item, all columns."""
    leak_id, leak_h = fresh(docs, "leak_id", "leak_h")
    leaks = contained(docs, benchmark, id_col=id_col, text_col=text_col, **kw).select(F.col("doc_id").alias(leak_id), F.col("_h").alias(leak_h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(leak_id)) & (F.xxhash64(F.col(text_col)) == F.col(leak_h))
    return docs.join(cut(leaks, "leaks"), same, "left_anti")
