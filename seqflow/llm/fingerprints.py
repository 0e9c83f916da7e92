"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by their counts. For each slot and word, hashes of the two give r and c from
Gamma(2, 1) and b from [0, 1); with weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The word of the
least a, with its t, is the slot's sample. Two documents have one sample in a slot with the probability of their
generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater. Main path: DataFrame
functions only.

Rows are dealt to cells, ranges of the id, so that a row's successor is in its cell; each cell also gets a copy of the
first row of the cell after it. All further steps stay in the cells: texts are shuffled once.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is like itself (1) and nothing
else (0); rows with equal ids follow one another by a hash of their text; null ids come last; a lone row is its own
successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqflow.llm.common import GAP, cut
from seqflow.llm.sharding import at_or_below, splitters

#: Samples of a fingerprint, slots computed in one row, hexadecimal digits of a sample.
SLOTS, WIDTH, DIGITS = 32, 4, 4
#: Bits of the tables of gamma quantiles.
R_BITS, C_BITS = 12, 14
CELL_BYTES, MAX_CELLS = 2 << 20, 65536
SPACE = " \t\n\v\f\r"
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def word_hashes(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, GAP), lambda w: F.xxhash64(w)))


def gamma_quantiles(n: int) -> list[float]:
    """Quantiles (i + 1/2) / n of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    out = []
    low = 0.0
    for i in range(n):
        q, high = (i + 0.5) / n, 60.0
        a = low
        while high - a > 1e-12 * high:
            x = (a + high) / 2
            a, high = (x, high) if 1 - (1 + x) * math.exp(-x) < q else (a, x)
        low = a
        out.append(a)
    return out


def literal(values: list[float]) -> Column:
    """An array constant, folded once when the plan is made."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def bits(h: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1))


def samples(base: Column, slot: int, log_weights: list[Column], r_table: Column, ln_c_table: Column) -> list[Column]:
    """For each weight: ln a in the upper bits, scaled, and bits of the word and t in the lower 16, so that the least value wins.

    base: a hash of the word and the chunk of slots. The gamma variables come from tables of their quantiles, which
    takes no logarithm a slot. ln a lies between -100 and 10.
    """
    h = F.xxhash64(base, F.lit(slot))
    r = F.get(r_table, bits(h, 0, R_BITS).cast("int"))
    ln_c = F.get(ln_c_table, bits(h, R_BITS, C_BITS).cast("int"))
    b = bits(h, R_BITS + C_BITS, 24) / F.lit(float(1 << 24))
    out = []
    for ln_w in log_weights:
        t = F.floor(ln_w / r + b)
        scaled = F.floor((ln_c - r * (t - b + 1) + 128) * F.lit(float(1 << 39)))
        sample = F.shiftrightunsigned(h, 48).bitwiseXOR(t * 40503).bitwiseAND(F.lit((1 << (DIGITS * 4)) - 1))
        out.append(F.shiftleft(scaled, DIGITS * 4) + sample)
    return out


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    piece = lambda c, i: F.substring(c, 1 + i * DIGITS, DIGITS)
    same = sum((F.when(piece(a, i) == piece(b, i), 1).otherwise(0) for i in range(SLOTS)), F.lit(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / F.lit(float(SLOTS)))


def in_cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """_cell, _rn (order in the cell, descending ids), _guest (a copy of the next cell's first row), _id, _text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text"))
    keys = cut(
        rows.select("_id", F.coalesce("_id", F.lit(-(1 << 63))).alias("_h"), (F.octet_length("_text").cast("long") + 16).alias("_size"), "_th"), "rows"
    )
    total = keys.agg(F.sum("_size")).first()[0]
    if not total:
        return None
    n_cells = min(MAX_CELLS, max(1, math.ceil(total / CELL_BYTES)))
    drawn = splitters(keys.select("_id", "_h", "_size"), n_cells, total)
    bounds = sorted(set(drawn))
    heavy = {b: n for b, n in Counter(drawn).items() if n > 1}  # an id that fills several ranges is split by the texts' hash

    def celled(d: DataFrame, key: Column) -> DataFrame:
        number = F.when(key.isin(list(heavy)), F.element_at(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv]), key)).otherwise(1) if heavy else F.lit(1)
        sub = F.floor((F.col("_th") / F.lit(float(1 << 64)) + 0.5) * number) if heavy else F.lit(0)
        return d.withColumn("_order", F.struct(-at_or_below(key, bounds), F.col("_id").isNull(), F.bitwise_not("_id"), sub.cast("int"))).withColumn(
            "_cell", F.struct(F.col("_order.col1").alias("range"), *([F.when(key.isin(list(heavy)), key).alias("key"), sub.cast("int").alias("sub")] if heavy else []))
        )

    # the first row of each cell, and the cell before it
    first = (
        celled(keys, F.col("_h"))
        .groupBy("_cell")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("null"), F.bitwise_not("_id").alias("down"), F.col("_th").alias("th"))).alias("_first"))
    )
    order = Window.orderBy("_cell.range", "_first")  # a row for each cell: 2 * MAX_CELLS at most
    around = Window.partitionBy()
    before = F.coalesce(F.lag("_cell").over(order), F.max(F.struct("_cell.range", "_first", "_cell")).over(around)["_cell"])
    hosts = cut(first.select(before.alias("_host"), "_cell", "_first"), "cells").select(
        F.col("_host"), F.col("_first.null").alias("_fn"), F.col("_first.down").alias("_fd"), F.col("_first.th").alias("_ft")
    )
    own = celled(rows, F.coalesce("_id", F.lit(-(1 << 63)))).select("_cell", F.lit(False).alias("_guest"), "_id", "_th", "_text")
    is_first = (F.col("_id").isNull() == F.col("_fn")) & F.bitwise_not("_id").eqNullSafe(F.col("_fd")) & (F.col("_th") == F.col("_ft"))
    guests = rows.join(F.broadcast(hosts), is_first).select(F.col("_host").alias("_cell"), F.lit(True).alias("_guest"), "_id", "_th", "_text")
    together = own.union(guests).withColumn("_cell", F.xxhash64("_cell"))
    w = Window.partitionBy("_cell").orderBy("_guest", F.col("_id").isNull(), F.bitwise_not("_id"), "_th")
    return together.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("_text").over(w), F.lit("")))


def neighbours(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; the columns are SCHEMA.

    The edited text has its last half, rounded down, replaced by as many characters from the start of the next text.
    """
    rows = in_cells(df, id_col, text_col)
    if rows is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    half = F.expr("_n div 2").cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), F.col("_n").cast("int") - half), F.substr("_next", F.lit(1), half))
    sha = F.sha2(F.col("_edited"), 256)
    # four longs hold the digest, so that it travels with the words through the aggregates below
    digest = [F.conv(F.substring("_sha", 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]
    listed = (
        rows.withColumn("_n", F.length("_text").cast("long"))
        .withColumn("_edited", edited)
        .withColumn("_sha", sha)
        .select(
            "_cell", "_rn",
            word_hashes(F.col("_text")).alias("_own"),
            word_hashes(F.col("_edited")).alias("_new"),
            F.array(F.col("_id"), F.col("_n"), F.col("_guest").cast("long"), *digest).alias("_facts"),
        )
    )
    n_own, n_all = F.col("_n_own"), F.col("_n_all")
    exploded = listed.select(
        "_cell", "_rn",
        F.size("_own").alias("_n_own"), (F.size("_own") + F.size("_new")).alias("_n_all"),
        F.posexplode(F.concat("_own", "_new", "_facts")).alias("_at", "_v"),
    )
    fact = F.when(F.col("_at") < n_all, 0).otherwise(F.col("_at") - n_all + 1)
    terms = exploded.groupBy("_cell", "_rn", fact.alias("_fact"), "_v").agg(
        F.sum(F.when(F.col("_at") < n_own, 1).otherwise(0)).alias("_w"),
        F.sum(F.when((F.col("_at") >= n_own) & (F.col("_at") < n_all), 1).otherwise(0)).alias("_e"),
    )
    chunked = terms.withColumn("_chunk", F.explode(F.when(F.col("_fact") == 0, F.sequence(F.lit(0), F.lit(SLOTS // WIDTH - 1))).otherwise(F.array(F.lit(0)))))
    # sampled in a projection of its own: narrow enough to be compiled, and nothing is computed twice
    log = lambda w: F.ln(F.greatest(w, F.lit(1)).cast("double"))
    chunked = chunked.withColumn("_base", F.xxhash64("_v", "_chunk")).withColumns({"_lw": log("_w"), "_le": log("_e")})
    tables = literal(gamma_quantiles(1 << R_BITS)), literal([math.log(x) for x in gamma_quantiles(1 << C_BITS)])
    drawn, aggs = [], [F.max(F.when(F.col("_fact") == i + 1, F.col("_v"))).alias(name) for i, name in enumerate(("_id", "_n", "_guest", "_d0", "_d1", "_d2", "_d3"))]
    word = F.col("_fact") == 0
    for i in range(WIDTH):
        own, new = samples(F.col("_base"), i, [F.col("_lw"), F.col("_le")], *tables)
        drawn += [own.alias(f"_w{i}"), new.alias(f"_e{i}")]
        aggs += [F.min(F.when(word & (F.col("_w") > 0), F.col(f"_w{i}"))).alias(f"_w{i}"), F.min(F.when(word & (F.col("_e") > 0), F.col(f"_e{i}"))).alias(f"_e{i}")]
    chunked = chunked.select("_cell", "_rn", "_chunk", "_fact", "_v", "_w", "_e", *drawn)
    digits = lambda c: F.lower(F.lpad(F.hex(F.col(c).bitwiseAND(F.lit((1 << (DIGITS * 4)) - 1))), DIGITS, "0"))
    chunks = chunked.groupBy("_cell", "_rn", "_chunk").agg(*aggs)
    piece = lambda k: F.concat(*[digits(f"_{k}{i}") for i in range(WIDTH)])
    facts = ("_id", "_n", "_guest", "_d0", "_d1", "_d2", "_d3")
    docs = chunks.groupBy("_cell", "_rn").agg(
        F.array_sort(F.collect_list(F.struct("_chunk", piece("w").alias("w"), piece("e").alias("e")))).alias("_c"), *[F.max(c).alias(c) for c in facts]
    )
    joined = lambda k: F.array_join(F.transform("_c", lambda x: F.coalesce(x[k], F.lit(""))), "")
    w = Window.partitionBy("_cell").orderBy("_rn")
    done = docs.select("_cell", "_rn", *facts, joined("w").alias("_fp"), joined("e").alias("_ef")).withColumn("_nf", F.lead("_fp").over(w))
    return done.where("_guest = 0").select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_chars"),
        F.lower(F.concat(*[F.lpad(F.hex(f"_d{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"),
        F.col("_fp").alias("fingerprint"),
        F.col("_ef").alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_ef")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_nf")).alias("near_next"),
    )
