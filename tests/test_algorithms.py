"""Algorithms on tiny inputs: empty, ties, nulls, user operations."""

import pytest
from pyspark.sql import functions as F

from seqflow.functions import scalars
from seqflow.functions.reductions import Reducer, reduction
from seqflow.operators import algorithms, graphs, search
from seqflow.operators.sequence import Sequence
from seqflow.plans import dag
from seqflow.sources import traces as trace_io


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, v double").repartition(3)


def by_pos(df, column="v"):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r.pos)]


def test_maps(spark):
    df = frame(spark, [3.0, None, 1.0])
    assert by_pos(algorithms.for_each(df, lambda v: v * 2)) == [6.0, None, 2.0]
    assert by_pos(algorithms.transform(df, lambda v, p: v + p, "v", "pos", to="w"), "w") == [3.0, None, 3.0]
    assert by_pos(algorithms.fill(df, 7.0)) == [7.0] * 3
    assert by_pos(algorithms.generate(df, lambda p: p * p)) == [0, 1, 4]
    assert by_pos(algorithms.generate_n(spark, 3, lambda p: p + 1)) == [1, 2, 3]
    assert by_pos(algorithms.replace(df, 1.0, 9.0)) == [3.0, None, 9.0]
    assert by_pos(algorithms.replace(df, None, 0.0)) == [3.0, 0.0, 1.0]
    copied = algorithms.replace_if(df, lambda v: v > 2, 0.0, to="w")
    assert by_pos(copied, "w") == [0.0, None, 1.0] and by_pos(copied) == [3.0, None, 1.0]
    a, b = algorithms.swap_ranges(frame(spark, [1.0, 2.0, 3.0]), frame(spark, [4.0, None]), 1, 3)
    assert by_pos(a) == [1.0, None, 3.0] and by_pos(b) == [4.0, 2.0]


def test_loops(spark):
    assert [tuple(r) for r in algorithms.foreach(spark, 5, 0, lambda i: {"sq": i * i}, -2).orderBy("i").collect()] == [(1, 1), (3, 9), (5, 25)]
    blocks = algorithms.foreach_blocks(spark, 0, 5, lambda i, j: {"n": j - i}, 2).orderBy("i").collect()
    assert [tuple(r) for r in blocks] == [(0, 2, 2), (2, 4, 2), (4, 5, 1)]
    with pytest.raises(ValueError, match="stride"):
        algorithms.foreach(spark, 0, 5, lambda i: {}, 0)


def test_folds(spark):
    one = lambda df: df.first()[0]
    df, none = frame(spark, [2.0, 5.0, 4.0]), frame(spark, [])
    assert one(algorithms.accumulate(df, "v", 1.0)) == 12.0 and one(algorithms.accumulate(none, "v", 1.0)) == 1.0
    assert one(algorithms.accumulate(df, "v", 9.0, "max")) == 9.0
    digits = Reducer(0.0, lambda s, v: float("".join(str(int(x)) for x in [*([s] if s else []), *v])), lambda a, b: float(f"{int(a) if a else ''}{int(b) if b else ''}" or 0), ordered=True)
    assert one(algorithms.accumulate(df, "v", 1.0, digits, "pos")) == 1254.0
    pairs = df.select("pos", F.col("v").alias("v1"), (F.col("v") + 1).alias("v2"))
    assert one(algorithms.inner_product(pairs)) == 56.0
    assert one(algorithms.inner_product(pairs, 0.0, "max", lambda a, b: a - b)) == 0.0
    ties = frame(spark, [1.0, 3.0, 1.0, 3.0])
    assert [one(algorithms.extreme_element(ties, "pos", F.col("v"), g, last)) for g in (False, True) for last in (True, False)] == [2, 0, 3, 1]
    assert one(algorithms.extreme_element(none, "pos", F.col("v"))) is None
    assert by_pos(algorithms.adjacent_difference(Sequence(df, "pos"), "v"), "d") == [2.0, 3.0, -1.0]
    row = none.agg(reduction("land", F.col("v"), init=F.lit(0)).alias("a"), reduction("lor", F.col("v"), init=F.lit(3)).alias("o")).first()
    assert (row.a, row.o) == (0, 1)


def test_orders(spark):
    texts = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 0)], "v string, k long")
    assert by_pos(algorithms.sort(texts, "v", "k"), "k") == [2, 3, 0, 1]
    assert by_pos(algorithms.sort(texts, F.desc("v"), F.asc("k")), "k") == [0, 1, 3, 2]
    assert algorithms.sort(texts.limit(0), "v").count() == 0
    near = spark.createDataFrame([(0.001,), (0.003,), (0.002,)], "v double")
    assert by_pos(algorithms.sort(near, "v")) == [0.001, 0.002, 0.003]
    other = spark.createDataFrame([("a", 9), ("c", 8)], "v string, k long")
    assert by_pos(algorithms.merge(texts.where("v is not null"), other, "v", "k"), "k") == [3, 9, 0, 1, 8]
    df = frame(spark, [5.0, 1.0, 7.0, 2.0])
    assert by_pos(algorithms.reverse(df)) == [2.0, 7.0, 1.0, 5.0]
    assert by_pos(algorithms.stable_partition(Sequence(df.withColumnRenamed("pos", "key"), "key"), F.col("v") > 4)) == [5.0, 7.0, 1.0, 2.0]
    counts = spark.createDataFrame([("b", 2), ("a", 1), ("z", 0)], "v string, n int")
    assert by_pos(algorithms.as_sequence(counts)) == ["a", "b", "b"]
    assert tuple(search.sorted_search(df, "pos", 2).first()) == (2, True) and tuple(search.sorted_search(df, "pos", 9).first()) == (4, False)


def test_nothing_is_left_out_silently(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    with pytest.raises(RuntimeError, match="left beyond"):
        graphs.bfs(edges, 0, 4)
    monkeypatch.setattr(graphs, "PIECES", 3)
    monkeypatch.setattr(dag, "PIECES", 3)
    assert {r.node: r.level for r in graphs.bfs(edges, 0).collect()} == {i: i for i in range(8)}
    tasks = spark.range(8).select(F.col("id").alias("task_id"))
    assert {r.task_id: r.date for r in dag.critical_path(tasks, edges).collect()} == {i: 7 - i for i in range(8)}
    with pytest.raises(Exception, match="exponent"):
        spark.range(1 << 40, (1 << 40) + 1).select(scalars.power_mod(2, F.col("id"), 97)).collect()


def test_activation(spark):
    edges = spark.createDataFrame([(0, 2), (1, 2), (0, 3), (2, 4)], "src long, dst long")
    done = lambda *ids: spark.createDataFrame([(i,) for i in ids], "task_id long")
    assert {r.task_id for r in dag.activated(edges, done(0)).collect()} == {3}
    assert {r.task_id for r in dag.activated(edges, done(0, 1, 3)).collect()} == {2}


def test_bits(spark):
    row = spark.createDataFrame([(12, 0, -(1 << 63))], "a long, b long, c long").select(
        *[scalars.first_one(F.col(c)).alias(c) for c in "abc"], scalars.set_bit(F.col("a"), 0).alias("s"), scalars.unset_bit(F.col("a"), 3).alias("u"), scalars.set_bit(F.col("b"), 63).alias("t")
    )
    assert tuple(row.first()) == (3, 0, 64, 13, 4, -(1 << 63))


def test_dot_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    trace_io.write_dot(edges, str(tmp_path / "g"), nodes=spark.createDataFrame([(0, 'a "b" \\')], "id long, label string"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.splitlines() == ["digraph G {", '0 [label="a \\"b\\" \\\\"];', "0 -> 1;", "}"]
