"""Matrices and grids as (i, j, v) rows; index maps; stencils."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b as (i, j, v); an equi-join on the inner index and partial sums before the shuffle."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_w"))
    return a.join(right, F.col("j") == F.col("_k")).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def norms(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"), F.max(F.abs("v")).alias("largest"))


def jacobi2d(a: DataFrame, c: float = 0.125) -> DataFrame:
    """c (4 v + north + south + east + west); 0 beyond the border."""
    row, column = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    at = lambda f, w: F.coalesce(f("v").over(w), F.lit(0.0))
    return a.select("i", "j", (c * (4 * F.col("v") + at(F.lag, row) + at(F.lead, row) + at(F.lag, column) + at(F.lead, column))).alias("v"))


def poisson3d(grid: DataFrame) -> DataFrame:
    """The mean of a cell's neighbours in x, y and z, 0 beyond the border: one aggregate over shifted copies."""
    shift = F.explode(F.array(*[F.struct(*[F.lit(s if d == k else 0).alias(n) for k, n in enumerate("xyz")]) for d in range(3) for s in (-1, 1)])).alias("s")
    moved = grid.select("x", "y", "z", "v", shift).select(*[(F.col(n) + F.col(f"s.{n}")).alias(n) for n in "xyz"], "v")
    return grid.select("x", "y", "z").join(moved.groupBy("x", "y", "z").agg((F.sum("v") / 6).alias("v")), ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("v", F.lit(0.0)).alias("v"))


def rescale(a: DataFrame, by: int) -> DataFrame:
    """Every by-th row and column."""
    return a.where((F.col("i") % by == 0) & (F.col("j") % by == 0)).select(F.expr(f"i div {by}").alias("i"), F.expr(f"j div {by}").alias("j"), "v")


def block_cyclic(i: Column, size: int, n_parts: int) -> tuple[Column, Column, Column]:
    """Part, block and place in the block of an index dealt in blocks of `size` to n_parts in turn."""
    m = size * n_parts
    return F.floor((i % m) / size), F.floor(i / m), i % size


def block_cyclic_inverse(part: Column, block: Column, place: Column, size: int, n_parts: int) -> Column:
    return part * size + block * (size * n_parts) + place


def factor(a: DataFrame, kind: str = "cholesky", largest: int = 4096) -> DataFrame:
    """Cholesky's factor, or LU without pivots (L below the diagonal, U from it), of one dense matrix of bounded order.

    The matrix is one task's: orders above `largest` (128 MB) are refused.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = int(f[["i", "j"]].to_numpy().max()) + 1
        if n > largest:
            raise ValueError(f"order {n} is above {largest}")
        m = np.zeros((n, n))
        m[f["i"], f["j"]] = f["v"]
        if kind == "cholesky":
            m = np.linalg.cholesky(m)
        else:
            for k in range(n - 1):
                m[k + 1 :, k] /= m[k, k]
                m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
        i, j = np.nonzero(m)
        return pd.DataFrame({"i": i, "j": j, "v": m[i, j]})

    return a.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "i long, j long, v double")


def forward_substitution(lower: DataFrame, b: DataFrame, largest: int = 4096) -> DataFrame:
    """x with L x = b for one dense lower triangle of bounded order. lower: i, j, v; b: i, v."""
    both = lower.select("i", "j", "v").union(b.select("i", F.lit(-1).cast("long").alias("j"), "v"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = int(f["i"].max()) + 1
        if n > largest:
            raise ValueError(f"order {n} is above {largest}")
        m, y = np.zeros((n, n)), np.zeros(n)
        t, r = f[f["j"] >= 0], f[f["j"] < 0]
        m[t["i"], t["j"]], y[r["i"]] = t["v"], r["v"]
        x = np.zeros(n)
        for k in range(n):
            x[k] = (y[k] - m[k, :k] @ x[:k]) / m[k, k]
        return pd.DataFrame({"i": np.arange(n), "v": x})

    return both.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "i long, v double")
