"""Ordered sequences over a total order, without a window over the whole input.

A sequence is a DataFrame with a unique numeric key that orders it and value columns. Rows are dealt to blocks, ranges
of the key between quantiles; one aggregate gives a row for each block (its size, sum, first and last value), and
windows over that small table carry counts, sums and neighbours from block to block (SURVEY 7.4, the two-level scan).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS_MAX = 4096


def in_range_blocks(df: DataFrame, key: str, n_blocks: int | None = None) -> DataFrame:
    """df with _b, the number of key quantiles below or at the key. A key without order is refused."""
    spark = df.sparkSession
    n = n_blocks or min(BLOCKS_MAX, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    if not bounds:
        return df.withColumn("_b", F.lit(0))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.array(*[F.lit(float(x)) for x in bounds])
    value = F.col(key).cast("double")

    def step(found: Column, by: Column) -> Column:
        return F.when((found + by <= len(bounds)) & (F.get(array, found + by - 1) <= value), found + by).otherwise(found)

    return df.withColumn("_b", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step))


@dataclass
class Sequence:
    """df: the rows; key: the column that orders them, unique."""

    df: DataFrame
    key: str
    n_blocks: int | None = None

    def assert_total(self) -> Sequence:
        """Refuse an order with ties or nulls."""
        n, distinct, known = self.df.agg(F.count("*"), F.count_distinct(self.key), F.count(self.key)).first()
        if not n == distinct == known:
            raise ValueError(f"{self.key} is not a total order: {n} rows, {distinct} values, {n - known} nulls")
        return self

    def _blocks(self, value: Column | None = None, totals: bool = False) -> tuple[DataFrame, DataFrame]:
        rows = in_range_blocks(self.df, self.key, self.n_blocks)
        v = value if value is not None else F.lit(0)
        sums = rows.groupBy("_b").agg(
            F.count("*").alias("_n"),
            F.sum(v if totals else F.lit(0)).alias("_sum"),
            F.max(v if totals else F.lit(0)).alias("_max"),
            F.min_by(v, self.key).alias("_first"),
            F.max_by(v, self.key).alias("_last"),
        )
        order = Window.orderBy("_b")  # a row for each block, BLOCKS_MAX at most
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(
            "_b",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            F.sum("_sum").over(before).alias("_psum"),
            F.max("_max").over(before).alias("_pmax"),
            F.lag("_last").over(order).alias("_plast"),
            F.lead("_first").over(order).alias("_nfirst"),
        )
        return rows, carried

    def _own(self) -> Window:
        return Window.partitionBy("_b").orderBy(self.key)

    def with_pos(self) -> DataFrame:
        """Positions from 0."""
        rows, carried = self._blocks()
        return rows.join(F.broadcast(carried), "_b").withColumn("pos", F.col("_off") + F.row_number().over(self._own()) - 1).drop("_b", "_off", "_psum", "_pmax", "_plast", "_nfirst")

    def neighbours(self, value: Column | str) -> DataFrame:
        """pos, key, v, prev, next: the value before and after; null at the ends."""
        v = F.col(value) if isinstance(value, str) else value
        rows, carried = self._blocks(v)
        w = self._own()
        return rows.join(F.broadcast(carried), "_b").select(
            (F.col("_off") + F.row_number().over(w) - 1).alias("pos"),
            F.col(self.key).alias("key"),
            v.alias("v"),
            F.when(F.row_number().over(w) == 1, F.col("_plast")).otherwise(F.lag(v).over(w)).alias("prev"),
            F.when(F.lead(F.lit(1)).over(w).isNull(), F.col("_nfirst")).otherwise(F.lead(v).over(w)).alias("next"),
        )

    def scan(self, value: Column | str, op: str = "sum") -> DataFrame:
        """pos, key, v, p: inclusive prefix by sum or max."""
        v = F.col(value) if isinstance(value, str) else value
        rows, carried = self._blocks(v, totals=True)
        upto = self._own().rowsBetween(Window.unboundedPreceding, 0)
        p = F.coalesce(F.col("_psum"), F.lit(0)) + F.sum(v).over(upto) if op == "sum" else F.greatest(F.col("_pmax"), F.max(v).over(upto))
        return rows.join(F.broadcast(carried), "_b").select(
            (F.col("_off") + F.row_number().over(self._own()) - 1).alias("pos"), F.col(self.key).alias("key"), v.alias("v"), p.alias("p")
        )

    def shifted(self, names: list[str], by: int) -> DataFrame:
        """with_pos, and each column's value `by` places on, as name_by, by a join on the position."""
        s = self.with_pos()
        other = s.select((F.col("pos") - by).alias("pos"), *[F.col(n).alias(f"{n}_{by}") for n in names])
        return s.join(other, "pos", "left")


def zip_sequences(*parts: DataFrame) -> DataFrame:
    """Join (pos, v) frames on the position to pos, v1, v2, ...; the first gives the length."""
    out = parts[0].select("pos", F.col("v").alias("v1"))
    for i, p in enumerate(parts[1:], 2):
        out = out.join(p.select("pos", F.col("v").alias(f"v{i}")), "pos", "left")
    return out
