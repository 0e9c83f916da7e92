"""Connected components by hooking and pointer jumping, all in distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import cut

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). Returns id, root: one root, a member's id, for each component.

    Each round a node takes the least grandparent among its own and its neighbours', offers it to its parent, and
    jumps; rounds grow as the logarithm of the longest path in practice. No node's edges meet in one task but as
    partial minima.
    """
    pairs = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    state = pairs.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("f"))
    for _ in range(MAX_ROUNDS):
        parents = state.select(F.col("id").alias("p"), F.col("f").alias("gf"))
        grand = state.join(parents, F.col("f") == F.col("p")).select("id", "f", "gf")
        least = (
            pairs.join(grand.select(F.col("id").alias("b"), F.col("gf").alias("ngf")), "b")
            .groupBy("a")
            .agg(F.min("ngf").alias("n"))
        )
        seen = cut(grand.join(least, F.col("id") == F.col("a")).select("id", "f", "gf", "n"), "hooks")
        if seen.where("gf < f or n < f").limit(1).count() == 0:
            return seen.select("id", F.col("f").alias("root"))
        best = F.least("f", "gf", "n").alias("v")
        state = seen.select("id", best).union(seen.select(F.col("f").alias("id"), best)).groupBy("id").agg(F.min("v").alias("f"))
    raise RuntimeError("components did not converge")
