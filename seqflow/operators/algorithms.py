"""Algorithms over sequences as functions: maps, fills, replacements, folds, orders and merges.

A map takes and returns columns, so it is a projection that the optimizer fuses. Orders are range partitions of any
orderable columns, written once; the place of a row is its place in its range and the sizes of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqflow.functions.reductions import Reducer, reduce_with, reduction
from seqflow.lineage import cut
from seqflow.operators.sequence import Sequence

# --- maps ----------------------------------------------------------------------------------------------------------


def transform(df: DataFrame, f: Callable[..., Column], *columns: str, to: str = "v") -> DataFrame:
    """df with `to` as f of the columns: one for a unary, two or more (of zipped sequences) for an n-ary operation."""
    return df.withColumn(to, f(*map(F.col, columns)))


def for_each(df: DataFrame, body: Callable[[Column], Column], column: str = "v") -> DataFrame:
    """The column replaced by what body makes of it."""
    return transform(df, body, column, to=column)


def fill(df: DataFrame, value, column: str = "v") -> DataFrame:
    return df.withColumn(column, F.lit(value))


def generate(df: DataFrame, f: Callable[[Column], Column], column: str = "v", pos: str = "pos") -> DataFrame:
    """The column from each row's position."""
    return transform(df, f, pos, to=column)


def generate_n(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> DataFrame:
    """pos, v for positions below n."""
    return spark.range(n).select(F.col("id").alias("pos"), f(F.col("id")).alias("v"))


def replace(df: DataFrame, old, new, column: str = "v", to: str | None = None) -> DataFrame:
    """Values equal to old become new; with `to`, in a column beside the old one (a copy)."""
    return replace_if(df, lambda v: v.eqNullSafe(F.lit(old)), new, column, to)


def replace_if(df: DataFrame, predicate: Callable[[Column], Column], new, column: str = "v", to: str | None = None) -> DataFrame:
    v = F.col(column)
    return df.withColumn(to or column, F.when(predicate(v), F.lit(new)).otherwise(v))


def swap_ranges(a: DataFrame, b: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Two (pos, v) sequences with the values of places first to last - 1 exchanged; places that either lacks are left alone."""
    inside = F.col("pos").between(first, last - 1)

    def with_other(own: DataFrame, other: DataFrame) -> DataFrame:
        moved = other.where(inside).select("pos", F.col("v").alias("_w"), F.lit(True).alias("_met"))
        return own.join(moved, "pos", "left").select("pos", F.when(F.col("_met"), F.col("_w")).otherwise(F.col("v")).alias("v"))

    return with_other(a, b), with_other(b, a)


def foreach(spark: SparkSession, first: int, last: int, body: Callable[[Column], dict[str, Column]], stride: int = 1) -> DataFrame:
    """i and the columns that body makes of it, for i = first, first + stride, ... below last (above it for a negative stride)."""
    if stride == 0:
        raise ValueError("a loop needs a stride")
    i = F.col("id")
    return spark.range(first, last, stride).select(i.alias("i"), *[c.alias(n) for n, c in body(i).items()])


def foreach_blocks(spark: SparkSession, first: int, last: int, body: Callable[[Column, Column], dict[str, Column]], grain: int) -> DataFrame:
    """i, j and what body makes of them for blocks [i, j) of at most grain places that cover [first, last)."""
    i = F.col("id")
    j = F.least(i + grain, F.lit(last))
    return spark.range(first, last, grain).select(i.alias("i"), j.alias("j"), *[c.alias(n) for n, c in body(i, j).items()])


# --- folds ---------------------------------------------------------------------------------------------------------


def accumulate(df: DataFrame, value: str, init=0, op: str | Reducer = "plus", key: str | None = None, kind: str = "dbl") -> DataFrame:
    """One row, result: init op v op v ...; op is a built-in reduction or a Reducer, an ordered one in the order of key."""
    if isinstance(op, str):
        return df.agg(reduction(op, F.col(value), kind, F.lit(init)).alias("result"))
    folded = reduce_with(df, value, op, key)
    merge = op.merge
    return folded.mapInPandas(lambda frames: (f.assign(result=[merge(init, x) for x in f["result"]]) for f in frames), "result double")


def inner_product(zipped: DataFrame, init=0, op0: str | Reducer = "plus", op1: Callable[[Column, Column], Column] = lambda a, b: a * b) -> DataFrame:
    """One row, result: init op0 op1(v1, v2) op0 ...; zipped has pos, v1, v2."""
    return accumulate(zipped.select("pos", op1(F.col("v1"), F.col("v2")).cast("double").alias("v")), "v", init, op0, "pos")


def extreme_element(df: DataFrame, key: str, by: Column, greatest: bool = False, last: bool = True) -> DataFrame:
    """One row, _k: the key of the least (greatest) element by an expression; of ties the last, or the first. Null if empty."""
    order = -F.col(key) if last != greatest else F.col(key)
    pick = F.max_by if greatest else F.min_by
    return df.where(by.isNotNull()).agg(pick(F.col(key), F.struct(by.alias("by"), order.alias("at"))).alias("_k"))


def adjacent_difference(seq: Sequence, value: str | Column, op: Callable[[Column, Column], Column] = lambda v, before: v - before) -> DataFrame:
    """pos, v, d: op of each value and the one before it; the first value itself."""
    return seq.neighbours(value).select("pos", "v", F.when(F.col("pos") == 0, F.col("v")).otherwise(op(F.col("v"), F.col("prev"))).alias("d"))


# --- orders --------------------------------------------------------------------------------------------------------


def sort(df: DataFrame, *by: str | Column, pos: str = "pos") -> DataFrame:
    """df with pos, its place in the order of any orderable columns (Columns may be descending). Ties have places in no certain order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(pos, F.col("_from") + own - 1).drop("_range", "_from")


def merge(a: DataFrame, b: DataFrame, by: str, order: str) -> DataFrame:
    """pos, by, order, side: two sequences merged by a value; of equals a's come first, each side's in its order."""
    both = a.select(by, order, F.lit(0).alias("side")).unionByName(b.select(by, order, F.lit(1).alias("side")))
    return sort(both, by, "side", order)


def reverse(df: DataFrame, pos: str = "pos") -> DataFrame:
    n = df.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn(pos, F.col("_n") - 1 - F.col(pos)).drop("_n")  # one row


def stable_partition(seq: Sequence, predicate: Column) -> DataFrame:
    """The rows with pos: those that hold first, each part in its order, without a sort: places come from a scan."""
    marked = Sequence(seq.df.withColumn("_bad", F.when(F.coalesce(predicate, F.lit(False)), 0).otherwise(1)), seq.key, seq.n_blocks)
    places = marked.scan("_bad").select(F.col("key").alias("_key"), F.col("pos").alias("_at"), F.col("v").alias("_bad"), F.col("p").alias("_upto"))
    good = marked.df.agg(F.count_if(F.col("_bad") == 0).alias("_good"))  # one row
    to = F.when(F.col("_bad") == 0, F.col("_at") - F.col("_upto")).otherwise(F.col("_good") + F.col("_upto") - 1)
    return seq.df.join(places, F.col(seq.key) == F.col("_key")).crossJoin(F.broadcast(good)).withColumn("pos", to).drop("_key", "_at", "_bad", "_upto", "_good")


def as_sequence(counts: DataFrame) -> DataFrame:
    """pos, v of a multiset given as v, n: its elements in ascending order, each n times."""
    return sort(counts.where("n > 0").select("v", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")), "v", "_i").drop("_i")
