"""What the operators share: words, table access, numbers that depend on a row's values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.lineage import cut, discard, scratch, sweep
from seqflow.sources.tables import table

__all__ = ["GAP", "WORD", "cut", "discard", "fresh", "named", "scratch", "sweep", "table", "uniform"]

#: A run of characters that are neither a space nor \\t \\n \\v \\f \\r, and a run of those.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")
