"""Search workloads that branch: queens, knapsack, Fibonacci."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _apart(row: int):
    """Whether a queen of an earlier row and one in this row, column c, leave each other alone."""
    return lambda q, i: (q != F.col("c")) & (F.abs(q - F.col("c")) != F.lit(row) - i)


def queens(spark: SparkSession, n: int) -> DataFrame:
    """n, solutions: boards are extended row by row by explode and filter; a board is its columns' numbers."""
    boards = spark.range(n).select(F.array(F.col("id").cast("int")).alias("b")).repartition(max(1, n))
    for row in range(1, n):
        boards = boards.select("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
        free = F.forall(F.transform("b", _apart(row)), lambda ok: ok)
        boards = boards.where(free).select(F.array_append("b", F.col("c")).alias("b"))
    return boards.agg(F.lit(n).alias("n"), F.count("*").alias("solutions"))


def knapsack(items: DataFrame, capacity: int) -> DataFrame:
    """best: the greatest value of a subset of items (weight, value) within the capacity, for a bounded list of items.

    An array of the best value for each capacity is carried over the items: what branch and bound would prune is
    dominated there.
    """
    listed = items.agg(F.collect_list(F.struct(F.col("weight").cast("int").alias("w"), F.col("value").cast("long").alias("v"))).alias("items"))
    zero = F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda _: F.lit(0).cast("long"))

    def add(best, item):
        return F.transform(best, lambda x, i: F.when(i >= item["w"], F.greatest(x, F.get(best, i - item["w"]) + item["v"])).otherwise(x))

    return listed.select(F.get(F.aggregate("items", zero, add), F.lit(capacity)).alias("best"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """n, fib for 0 to n, by folding a pair."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("id").cast("int"), F.lit(1))),
        F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")),
        lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")),
    )
    return spark.range(n + 1).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") == 0, F.lit(0).cast("long")).otherwise(pair["a"]).alias("fib"))
