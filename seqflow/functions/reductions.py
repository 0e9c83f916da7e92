"""Typed reductions with explicit identities, over the ten built-in operations and the numeric types.

An empty input gives the identity (or the caller's initial value), where Spark's aggregates give null; max and min have
none that all types share and give the initial value, or null without one. A product is a double.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numeric types and the Spark types that hold them without loss (fixed values); there are no unsigned types.
TYPES = {
    "char": "byte", "schar": "byte", "shrt": "short", "int": "int", "long": "long", "llong": "long",
    "int8": "byte", "int16": "short", "int32": "int", "int64": "long",
    "uchar": "short", "ushrt": "int", "uint": "long", "ulong": "decimal(20,0)", "ullong": "decimal(20,0)",
    "uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)",
    "flt": "float", "dbl": "double", "ldbl": "double",
}
FLOATS = {"flt", "dbl", "ldbl"}
BITWISE = {"and", "or", "xor"}


def reduction(op: str, value: Column, kind: str = "long", init: Column | None = None) -> Column:
    """An aggregate for one operation: plus, mul, minus, and, or, xor, land, lor, max, min."""
    if kind not in TYPES:
        raise ValueError(f"no such type: {kind}")
    if op in BITWISE and kind in FLOATS:
        raise TypeError(f"{op} is for integers, not {kind}")
    v = value.cast(TYPES[kind])
    start = init if init is not None else F.lit(None)
    match op:
        case "plus":
            return F.coalesce(start, F.lit(0)) + F.coalesce(F.sum(v), F.lit(0))
        case "minus":  # defined as init minus the sum: the only reading that does not depend on how work is split
            return F.coalesce(start, F.lit(0)) - F.coalesce(F.sum(v), F.lit(0))
        case "mul":
            return F.coalesce(start, F.lit(1)) * F.coalesce(F.product(v), F.lit(1.0))
        case "and":
            return F.coalesce(F.bit_and(v), F.lit(-1)).bitwiseAND(F.coalesce(start, F.lit(-1)))
        case "or":
            return F.coalesce(F.bit_or(v), F.lit(0)).bitwiseOR(F.coalesce(start, F.lit(0)))
        case "xor":
            return F.coalesce(F.bit_xor(v), F.lit(0)).bitwiseXOR(F.coalesce(start, F.lit(0)))
        case "land":
            return (F.coalesce(F.bool_and(v != 0), F.lit(True)) & (F.coalesce(start, F.lit(1)) != 0)).cast("int")
        case "lor":
            return (F.coalesce(F.bool_or(v != 0), F.lit(False)) | (F.coalesce(start, F.lit(0)) != 0)).cast("int")
        case "max":
            return F.greatest(F.max(v), start) if init is not None else F.max(v)
        case "min":
            return F.least(F.min(v), start) if init is not None else F.min(v)
    raise ValueError(f"no such operation: {op}")


@dataclass(frozen=True)
class Reducer:
    """A user's reduction: an identity, a step over a batch's values, and an associative merge of partial results."""

    identity: float
    reduce: Callable[[float, pd.Series], float]
    merge: Callable[[float, float], float]
    ordered: bool = False


def reduce_with(df: DataFrame, value: str, reducer: Reducer, key: str | None = None) -> DataFrame:
    """One row: result. Each task folds its rows to one partial result; the partials, a row a task, are merged in order.

    With reducer.ordered, rows are dealt by ranges of the key and sorted, so that merge need not be commutative.
    """
    if reducer.ordered:
        if key is None:
            raise ValueError("an ordered reduction needs a key")
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, key).sortWithinPartitions(key)

    def partial(frames):
        state, seen, part = reducer.identity, False, -1
        for f in frames:
            if len(f):
                state, seen, part = reducer.reduce(state, f["v"]), True, int(f["p"].iloc[0])
        if seen:
            yield pd.DataFrame({"p": [part], "s": [state]})

    def merge(s: pd.DataFrame) -> pd.DataFrame:
        state = reducer.identity
        for x in s.sort_values("p")["s"]:
            state = reducer.merge(state, x)
        return pd.DataFrame({"result": [state]})

    partials = df.select(F.spark_partition_id().alias("p"), F.col(value).cast("double").alias("v")).mapInPandas(partial, "p int, s double")
    return partials.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(merge, "result double")
