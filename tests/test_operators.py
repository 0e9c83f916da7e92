"""Operators on tiny inputs: empty, one element, ties, not found, unbalanced, unordered."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqflow.functions import scalars
from seqflow.functions.reductions import Reducer, reduce_with, reduction
from seqflow.operators import arrays, graphs, multisets, search, searches, statistics, traces
from seqflow.operators.sequence import Sequence, zip_sequences
from seqflow.plans import dag, queries
from seqflow.sources import traces as trace_io


def seq(spark, values, blocks=3):
    df = spark.createDataFrame([(10 * i + 5, float(v)) for i, v in enumerate(values)], "key long, v double").repartition(3)
    return Sequence(df, "key", blocks)


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("values", [[], [4], [1, 2], [3, 1, 2, 2, 9, -4, 0, 0, 7]])
def test_positions_scans_and_neighbours(spark, values):
    s = seq(spark, values)
    assert sorted((r.pos, r.v) for r in s.with_pos().collect()) == list(enumerate(map(float, values)))
    scan = {r.pos: r.p for r in s.scan("v").collect()}
    assert scan == {i: float(sum(values[: i + 1])) for i in range(len(values))}
    top = {r.pos: r.p for r in s.scan("v", "max").collect()}
    assert top == {i: float(max(values[: i + 1])) for i in range(len(values))}
    around = {r.pos: (r.prev, r.next) for r in s.neighbours("v").collect()}
    padded = [None, *map(float, values), None]
    assert around == {i: (padded[i], padded[i + 2]) for i in range(len(values))}


def test_order_must_be_total(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "key long, v double")
    with pytest.raises(ValueError, match="total order"):
        Sequence(df, "key").assert_total()
    seq(spark, [1, 2]).assert_total()


@pytest.mark.parametrize(("values", "found"), [([], 0), ([7], 0), ([1, 2], 2), ([1, 7, 7], 1)])
def test_find(spark, values, found):
    assert one(search.find(seq(spark, values).df, "key", "v", 7.0)) == found


def test_searches_of_runs(spark):
    s = seq(spark, [1, 1, 2, 3, 1, 1, 1, 2])
    assert one(search.search(s, "v", [1, 2])) == 1
    assert one(search.search(s, "v", [1, 1, 1, 2])) == 4
    assert one(search.search(s, "v", [9])) == 8
    assert one(search.search_n(s, F.col("v") == 1, 3)) == 4
    assert one(search.search_n(s, F.col("v") == 1, 4)) == 8
    assert one(search.adjacent_find(s, "v")) == 0
    assert one(search.adjacent_find(seq(spark, [1, 2, 3]), "v")) == 3
    assert one(search.adjacent_find(seq(spark, [1]), "v")) == 1
    assert tuple(search.is_sorted(seq(spark, [1, 2, 2, 1]), "v").first()) == (False, 3)
    assert tuple(search.is_sorted(seq(spark, []), "v").first()) == (True, 0)


def test_pairs(spark):
    a, b = seq(spark, [1, 2, 3]).with_pos(), seq(spark, [1, 2]).with_pos()
    assert one(search.equal(zip_sequences(b, a))) is True
    assert one(search.equal(zip_sequences(a, b))) is False
    assert one(search.mismatch(zip_sequences(a, b))) == 2
    assert one(search.mismatch(zip_sequences(b, a))) == 2


def test_reductions_have_identities(spark):
    none = spark.createDataFrame([], "k long")
    k = F.col("k")
    r = none.agg(reduction("plus", k).alias("p"), reduction("and", k).alias("a"), reduction("land", k).alias("l"), reduction("max", k).alias("m")).first()
    assert (r.p, r.a, r.l, r.m) == (0, -1, 1, None)
    low = spark.createDataFrame([(-3,), (-9,)], "k long")
    assert one(low.agg(reduction("max", k))) == -3
    assert one(low.agg(reduction("minus", k, init=F.lit(5)))) == 17
    with pytest.raises(TypeError):
        reduction("xor", k, "dbl")


def test_ordered_user_reduction(spark):
    """Digits to a number: associative on (value, length), not commutative."""
    df = seq(spark, [3, 1, 4, 1, 5]).df
    digits = Reducer(0.0, lambda s, v: float(str(int(s) if s else "") + "".join(str(int(x)) for x in v)), lambda a, b: float(f"{int(a) if a else ''}{int(b)}"), ordered=True)
    assert one(reduce_with(df, "v", digits, "key")) == 31415


def test_distribution_keeps_empty_bins(spark):
    rows = statistics.distribution(seq(spark, [1, 5, 5]).df, F.col("v"), [0, 5, 9]).collect()
    assert {r.bin: r.n for r in rows} == {0: 0, 1: 1, 2: 2, 3: 0}


def test_multisets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    b = spark.createDataFrame([(1,), (3,)], "k long")
    got = {h: sorted((r.v, r.n) for r in multisets.combine(a, b, "k", h).collect()) for h in ("union", "intersection", "difference")}
    assert got == {"union": [(1, 2), (2, 1), (3, 1)], "intersection": [(1, 1)], "difference": [(1, 1), (2, 1)]}


def test_intervals_nest_and_report_imbalance(spark):
    steps = [(1, 10, 1), (1, 20, 1), (1, 30, -1), (1, 40, 1), (1, 50, -1), (1, 60, -1), (1, 70, -1), (2, 5, 1)]
    t = spark.createDataFrame(steps, "kid long, t long, s int")
    got = {(r.kid, r.depth, r.beg, r.end, r.balanced) for r in traces.intervals(t, F.col("s")).collect()}
    assert got == {(1, 1, 10, 60, True), (1, 2, 20, 30, True), (1, 2, 40, 50, True), (1, 0, None, 70, False), (2, 1, 5, None, False)}
    spans = traces.intervals(t, F.col("s"))
    assert one(traces.utilisation(spans, 16).agg(F.sum("busy"))) == 70


def test_trace_files(spark, tmp_path):
    events = pd.DataFrame({"evtno": [2, 3], "kid": [1, 1], "date_ns": [5, 2**62], "d0": [7, 8]})
    (tmp_path / "a.bin").write_bytes(trace_io.to_bytes(events, cpucount=4))
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = trace_io.read_traces(spark, str(tmp_path)).orderBy("date_ns").collect()
    assert [(r.evtno, r.kid, r.date_ns, r.d0) for r in rows] == [(2, 1, 5, 7), (3, 1, 2**62, 8)]
    assert trace_io.read_headers(spark, str(tmp_path)).first().cpucount == 4


def test_edge_lists_and_fasta(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 5)], "src long, dst long")
    trace_io.write_edges(edges, str(tmp_path / "e"))
    assert sorted(map(tuple, trace_io.read_edges(spark, str(tmp_path / "e")).collect())) == [(0, 1), (1, 2), (5, 5)]
    (tmp_path / "p.aa").write_text("Number of sequences is 2\n>one\nAC\nGT\n>two\nTT\n")
    assert {(r.name, r.sequence) for r in trace_io.read_fasta(spark, str(tmp_path / "p.aa")).collect()} == {("one", "ACGT"), ("two", "TT")}


def test_breadth_first(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3), (3, 3), (9, 8)], "src long, dst long")
    assert {(r.node, r.level) for r in graphs.bfs(edges, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 1)}
    assert one(graphs.shortest_path(edges, 0, 8)) is None
    assert one(graphs.shortest_path(edges, 0, 8, unreachable=0)) == 0


def test_breadth_first_takes_all_edges_of_the_events(spark, tmp_path):
    """A path longer than 12 edges between numbers that differ modulo 7."""
    path = [0, *range(80, 94)]
    pairs = [*zip(path, path[1:], strict=False), (93, 0), (5, 6), (None, 80), (80, None)]
    start = pd.Timestamp("2024-01-01")
    events = [(i, (start + pd.Timedelta(seconds=i)).to_pydatetime(), a, "view", 1.0, "{}" if b is None else f'{{"k": {b}}}') for i, (a, b) in enumerate(pairs)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.node: r.level for r in queries.QUERIES["bfs_levels_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: i for i, x in enumerate(path)}
    assert one(queries.QUERIES["bfs_shortest_path_whole"](spark, str(tmp_path))) == 14


def test_list_rank(spark):
    order = [4, 2, 9, 1, 7]
    nodes = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], None], strict=True)], "id long, next long")
    assert {r.id: r.rank for r in graphs.list_rank(nodes).collect()} == {x: i for i, x in enumerate(order)}


def test_access_versions(spark):
    modes = ["W", "R", "R", "W", "CW", "CW", "RW"]
    acc = spark.createDataFrame([(i, 0, m) for i, m in enumerate(modes)], "task_id long, datum long, mode string")
    v = dag.versions(acc)
    assert [r.version for r in v.orderBy("task_id").collect()] == [0, 1, 1, 2, 3, 3, 4]
    assert {r.task_id for r in dag.ready_tasks(v).collect()} == {0, 3}
    kinds = {(r.src, r.dst): r.kind for r in dag.conflict_edges(v).collect()}
    assert kinds[(0, 1)] == "RAW" and kinds[(2, 3)] == "WAR" and kinds[(3, 4)] == "WAW" and kinds[(5, 6)] == "RAW"


def test_critical_path(spark):
    tasks = spark.createDataFrame([(i,) for i in range(5)], "task_id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    assert {r.task_id: r.date for r in dag.critical_path(tasks, edges).collect()} == {0: 0, 1: 3, 2: 2, 3: 1, 4: 0}


def test_critical_path_leaves_no_task_out(spark):
    tasks = spark.createDataFrame([(i,) for i in range(4)], "task_id long")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert {r.task_id: r.date for r in dag.critical_path(tasks, chain, max_rounds=4).collect()} == {0: 3, 1: 2, 2: 1, 3: 0}
    with pytest.raises(RuntimeError, match="without a date"):
        dag.critical_path(tasks, chain, max_rounds=3)
    with pytest.raises(RuntimeError, match="without a date"):
        dag.critical_path(tasks, spark.createDataFrame([(0, 1), (1, 2), (2, 1), (1, 3)], "src long, dst long"))


def test_matrices(spark):
    m = spark.createDataFrame([(0, 0, 4.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 5.0)], "i long, j long, v double")
    low = {(r.i, r.j): r.v for r in arrays.factor(m).collect()}
    assert low == {(0, 0): 2.0, (1, 0): 1.0, (1, 1): 2.0}
    b = spark.createDataFrame([(0, 2.0), (1, 5.0)], "i long, v double")
    assert {r.i: r.v for r in arrays.forward_substitution(arrays.factor(m), b).collect()} == {0: 1.0, 1: 2.0}
    assert {(r.i, r.j): r.v for r in arrays.matmul(m, m).collect()}[(0, 1)] == 18.0


def test_workloads(spark):
    assert one(searches.queens(spark, 6).select("solutions")) == 4
    assert [r.fib for r in searches.fibonacci(spark, 6).orderBy("n").collect()] == [0, 1, 1, 2, 3, 5, 8]
    items = spark.createDataFrame([(3, 4), (4, 5), (2, 3)], "weight int, value int")
    assert one(searches.knapsack(items, 6)) == 8


def test_scalars(spark):
    row = spark.createDataFrame([("3:5,!4,9", "12", "x", "18446744073709551616")], "a string, b string, c string, d string").select(
        scalars.cpu_set(F.col("a")).alias("s"), scalars.parse(F.col("b"), "long").alias("b"), scalars.parse(F.col("c"), "double").alias("c"), scalars.parse(F.col("d"), "ulong").alias("d")
    )
    assert tuple(row.first()) == ([3, 5, 9], 12, None, None)
    assert one(spark.range(11, 12).select(scalars.power_mod(2, F.col("id"), 1000))) == 48


def test_efficiency_of_nested_suspends_stops_and_starts(spark):
    # kid 1: starts at 10, idle 20-40, suspended in idle 25-35, waits from 60, stops at 80, starts again at 95
    events = [(1, 10, 0), (1, 20, 10), (1, 25, 12), (1, 35, 13), (1, 40, 11), (1, 60, 15), (1, 70, 16), (1, 80, 1), (1, 95, 0), (2, 5, 11), (2, 99, 8)]
    trace = spark.createDataFrame([(kid, t, i, code, 1) for i, (kid, t, code) in enumerate(events)], "kid long, t long, event long, evtno int, d2 long")
    got = {(r["kid"], r["bucket"]): (r["active"], r["idle"]) for r in traces.efficiency(trace, 30).collect()}
    own = lambda t: next((a for a, b, e in [(True, 10, 20), (False, 20, 40), (True, 40, 60), (False, 60, 70), (True, 70, 80), (False, 80, 95), (True, 95, 120)] if b <= t < e), None)
    for b in range(4):
        states = [own(t) for t in range(b * 30, b * 30 + 30)]
        assert got[1, b] == (states.count(True), states.count(False))
        assert got[2, b] == (0, 0)  # never started
    last = traces.efficiency(trace, 30).where("kid = 2 and bucket = 3").first()
    assert (last["tasks"], last["efficiency"]) == (1, 0.0)
    assert traces.efficiency(trace.limit(0), 30).count() == 0


def test_task_statistics_of_a_kid_without_intervals(spark):
    events = [(1, 0, 2), (1, 5, 3), (1, 6, 10), (1, 8, 12), (1, 9, 13), (1, 16, 11), (1, 17, 17), (1, 19, 18), (1, 20, 2), (2, 1, 19)]
    trace = spark.createDataFrame(events, "kid long, t long, evtno int")
    got = {r["kid"]: (r["tasks"], r["total"], r["idle"], r["suspended"], r["requests"], r["steals"]) for r in traces.task_statistics(trace).collect()}
    assert got == {1: (1, 5, 9, 1, 2, 0), 2: (0, 0, 0, 0, 0, 1)}
