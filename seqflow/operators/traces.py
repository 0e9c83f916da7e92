"""Event traces: intervals, pairings, task statistics and utilisation.

A trace has kid (processor), t (nanoseconds) and an event; times stay LONG, since a timestamp would lose nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event codes and names; the codes are the trace format's (fixed values).
CATALOGUE = """
0 KPROC_START
1 KPROC_STOP
2 TASK_BEG
3 TASK_END
4 FRAME_TL_BEG
5 FRAME_TL_END
6 STATIC_BEG
7 STATIC_END
8 STATIC_TASK_BEG
9 STATIC_TASK_END
10 SCHED_IDLE_BEG
11 SCHED_IDLE_END
12 SCHED_SUSPEND_BEG
13 SCHED_SUSPEND_END
14 SCHED_SUSPEND_POST
15 SCHED_SUSPWAIT_BEG
16 SCHED_SUSPWAIT_END
17 REQUESTS_BEG
18 REQUESTS_END
19 STEAL_OP
20 SEND_REPLY
21 RECV_REPLY
25 FOREACH_BEG
26 FOREACH_END
27 FOREACH_STEAL
28 CUDA_GPU_HTOD_BEG
29 CUDA_GPU_HTOD_END
30 CUDA_GPU_DTOH_BEG
31 CUDA_GPU_DTOH_END
32 CUDA_GPU_KERNEL_BEG
33 CUDA_GPU_KERNEL_END
34 CUDA_CPU_SYNC_BEG
35 CUDA_CPU_SYNC_END
"""
#: Event classes of the recorder's mask (fixed values).
CLASSES = {
    "startup": {0, 1},
    "compute": {2, 3, 6, 7, 8, 9, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35},
    "idle": {10, 11, 12, 13, 15, 16},
    "stealop": {17, 18, 19, 20, 21},
}
#: Events whose intervals the task statistics time.
TIMED = {2: "task", 3: "task", 10: "idle", 11: "idle", 12: "suspend", 13: "suspend", 17: "requests", 18: "requests"}
#: Events that take one from a processor's count of activity, and those that give it back.
RELEASES, RESUMES = {10, 12, 15}, {11, 13, 16}
EVENTS = {int(code): name for code, name in (line.split() for line in CATALOGUE.split("\n") if line)}


def catalogue(spark) -> DataFrame:
    rows = [(code, name, name.endswith("_BEG"), name.endswith("_END"), next((c for c, of in CLASSES.items() if code in of), "other")) for code, name in EVENTS.items()]
    return spark.createDataFrame(rows, "evtno int, name string, is_begin boolean, is_end boolean, class string")


def in_classes(trace: DataFrame, classes: list[str]) -> DataFrame:
    """The recorder's mask: a filter that reaches the scan. Startup events are always in."""
    codes = sorted(set().union(CLASSES["startup"], *(CLASSES[c] for c in classes)))
    return trace.where(F.col("evtno").isin(codes))


def in_time_order(traces: list[DataFrame]) -> DataFrame:
    """All traces merged by time; equal times by processor, then event."""
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t)
    return out.orderBy("t", "kid", "event")


def intervals(trace: DataFrame, sign: Column, order: str = "t", kind: str | None = None) -> DataFrame:
    """kid, depth, beg, end, balanced for each begin or unmatched end; with kind, each kind of interval on its own.

    sign is 1 at a begin and -1 at an end. A begin's depth is the number of open intervals with it, an end's that of the
    one it closes; at one depth begins and ends alternate unless the trace is unbalanced, which is reported.
    """
    own = ["kid", kind] if kind else ["kid"]
    by_kid = Window.partitionBy(*own).orderBy(order)
    run = F.sum("_s").over(by_kid.rowsBetween(Window.unboundedPreceding, 0))
    at = trace.withColumn("_s", sign).withColumn("depth", F.when(F.col("_s") > 0, run).otherwise(run + 1))
    level = Window.partitionBy(*own, "depth").orderBy(order)
    seen = at.withColumn("_next_s", F.lead("_s").over(level)).withColumn("_next_t", F.lead("t").over(level)).withColumn("_last_s", F.lag("_s").over(level))
    begins, closed = F.col("_s") > 0, F.coalesce(F.col("_next_s") < 0, F.lit(False))
    stray = (F.col("_s") < 0) & ~F.coalesce(F.col("_last_s") > 0, F.lit(False))
    return seen.where(begins | stray).select(
        *own,
        F.col("depth").cast("int").alias("depth"),
        F.when(begins, F.col("t")).alias("beg"),
        F.when(begins & closed, F.col("_next_t")).when(stray, F.col("t")).alias("end"),
        (begins & closed).alias("balanced"),
    )


def statistics(spans: DataFrame, z: float = 2.576) -> DataFrame:
    """For each kid: n, total, least, most, mean, population variance and deviation, half-width z sqrt(var / (n - 1))."""
    d = (F.col("end") - F.col("beg")).cast("double")
    return spans.where("balanced").groupBy("kid").agg(
        F.count("*").alias("n"),
        F.sum(d).alias("total"),
        F.min(d).alias("least"),
        F.max(d).alias("most"),
        F.avg(d).alias("mean"),
        F.var_pop(d).alias("variance"),
        F.stddev_pop(d).alias("deviation"),
        F.when(F.count("*") > 1, z * F.sqrt(F.try_divide(F.var_pop(d), F.count("*") - 1))).alias("half_width"),
    )


def task_statistics(trace: DataFrame, order: str = "t") -> DataFrame:
    """For each kid: tasks, total, idle, suspended, requests (ns in such intervals) and steals (STEAL_OP events).

    idle is without the time suspended. Intervals without an end count nothing; a kid without any has zeros.
    """
    kind = F.create_map(*[F.lit(x) for kv in TIMED.items() for x in kv])[F.col("evtno").cast("int")]
    begins = F.col("evtno").isin([code for code in TIMED if EVENTS[code].endswith("_BEG")])
    spans = intervals(trace.withColumn("kind", kind).where("kind is not null"), F.when(begins, 1).otherwise(-1), order, "kind").where("balanced")
    spent = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("end") - F.col("beg"))), F.lit(0))
    times = spans.groupBy("kid").agg(
        F.count_if(F.col("kind") == "task").alias("tasks"), spent("task").alias("total"), (spent("idle") - spent("suspend")).alias("idle"), spent("suspend").alias("suspended"), spent("requests").alias("requests")
    )
    steals = trace.groupBy("kid").agg(F.count_if(F.col("evtno") == 19).alias("steals"))
    return steals.join(times, "kid", "left").fillna(0, ["tasks", "total", "idle", "suspended", "requests"])


def efficiency(trace: DataFrame, step: int, order: str = "event") -> DataFrame:
    """kid, bucket, active, idle, efficiency, steals, tasks for each kid and bucket [b * step, (b + 1) * step) of the trace.

    A processor starts with a count of one and stops with none; IDLE, SUSPEND (which may nest) and SUSPWAIT take one from
    it until they end. Time at a count of one is active, other time since the start is idle. efficiency is active's share,
    0 before the start. steals (RECV_REPLY with d2 other than 0) and tasks (STATIC_TASK_BEG) count all up to the bucket.

    Counts are scanned in two levels: within a kid's bucket, then over one row for each bucket, so no task meets all
    events of a processor.
    """
    e = F.col("evtno")
    change = F.when(e.isin(sorted(RELEASES)), -1).when(e.isin(sorted(RESUMES)), 1).otherwise(0)
    base = F.when(e == 0, 1).when(e == 1, 0)
    at = trace.withColumn("_bucket", F.expr(f"t div {step}"))
    moves = at.where(e.isin(sorted({0, 1} | RELEASES | RESUMES))).select("kid", "_bucket", "t", order, change.alias("_d"), base.alias("_to"))
    moves = moves.transform(_count, Window.partitionBy("kid", "_bucket").orderBy("t", order))
    after = F.lead("t").over(Window.partitionBy("kid", "_bucket").orderBy("t", order))
    spans = moves.withColumn("_span", F.coalesce(after, (F.col("_bucket") + 1) * step) - F.col("t"))
    ends = spans.groupBy("kid", "_bucket").agg(F.max_by(F.struct("_known", "_count"), F.struct("t", order)).alias("_end"), F.min("t").alias("_first"))
    counts = at.groupBy("kid", "_bucket").agg(F.count_if((e == 21) & (F.col("d2") != 0)).alias("_steals"), F.count_if(e == 8).alias("_tasks"))

    reach = trace.agg(F.expr(f"min(t) div {step}").alias("_lo"), F.expr(f"max(t) div {step}").alias("_hi"))  # one row
    grid = trace.select("kid").distinct().crossJoin(F.broadcast(reach)).select("kid", F.explode(F.sequence("_lo", "_hi")).alias("_bucket"))
    by_kid = Window.partitionBy("kid").orderBy("_bucket")
    upto = by_kid.rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.col("_end._known"), F.lit(False))
    grid = grid.join(ends, ["kid", "_bucket"], "left").join(counts, ["kid", "_bucket"], "left")
    grid = grid.withColumn("_to", F.when(known, F.col("_end._count"))).withColumn("_d", F.when(known, 0).otherwise(F.coalesce(F.col("_end._count"), F.lit(0))))
    grid = grid.transform(_count, by_kid).withColumn("_carried", F.lag(F.when(F.col("_known"), F.col("_count"))).over(by_kid))
    grid = grid.select(
        "kid", "_bucket", "_carried",
        (F.coalesce(F.col("_first"), (F.col("_bucket") + 1) * step) - F.col("_bucket") * step).alias("_before"),
        F.coalesce(F.sum("_steals").over(upto), F.lit(0)).alias("steals"),
        F.coalesce(F.sum("_tasks").over(upto), F.lit(0)).alias("tasks"),
    )

    # the time at each count, relative to what the bucket began with where that is not yet known
    held = spans.groupBy("kid", "_bucket", "_known", "_count").agg(F.sum("_span").alias("_span"))
    now = F.when(F.col("_known"), F.col("_count")).otherwise(F.col("_carried") + F.col("_count"))
    own = grid.select("kid", "_bucket", "_carried").join(held, ["kid", "_bucket"]).groupBy("kid", "_bucket").agg(F.sum(F.when(now == 1, F.col("_span"))).alias("_active"), F.sum(F.when(now != 1, F.col("_span"))).alias("_idle"))
    zero = F.lit(0)
    active = F.coalesce(F.col("_active"), zero) + F.when(F.col("_carried") == 1, F.col("_before")).otherwise(zero)
    idle = F.coalesce(F.col("_idle"), zero) + F.when(F.col("_carried") != 1, F.col("_before")).otherwise(zero)
    out = grid.join(own, ["kid", "_bucket"], "left").select("kid", F.col("_bucket").alias("bucket"), active.alias("active"), idle.alias("idle"), "steals", "tasks")
    return out.withColumn("efficiency", F.coalesce(F.try_divide(F.col("active").cast("double"), F.col("active") + F.col("idle")), F.lit(0.0)))


def _count(df: DataFrame, order) -> DataFrame:
    """_count, the sum of _d since _to was last set, and what it was set to; _known, whether it was set."""
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum("_d").over(w))
    df = df.withColumn("_since", F.last(F.when(F.col("_to").isNotNull(), F.col("_sum")), ignorenulls=True).over(w)).withColumn("_base", F.last("_to", ignorenulls=True).over(w))
    return df.withColumn("_known", F.col("_base").isNotNull()).withColumn("_count", F.col("_sum") - F.coalesce("_since", F.lit(0)) + F.coalesce("_base", F.lit(0))).drop("_sum", "_since", "_base")


def utilisation(spans: DataFrame, step: int) -> DataFrame:
    """kid, bucket, busy: the time in intervals in each half-open bucket [b * step, (b + 1) * step)."""
    whole = spans.where("balanced and `end` > beg")
    buckets = whole.withColumn("bucket", F.explode(F.sequence(F.expr(f"beg div {step}"), F.expr(f"(`end` - 1) div {step}"))))
    overlap = F.least(F.col("end"), (F.col("bucket") + 1) * step) - F.greatest(F.col("beg"), F.col("bucket") * step)
    return buckets.groupBy("kid", "bucket").agg(F.sum(overlap).alias("busy"))


def steals(ops: DataFrame, replies: DataFrame) -> DataFrame:
    """ops and replies: kid, serial, t; replies also status. A row for each op: latency, status, corrupt."""
    r = replies.select("kid", "serial", F.col("t").alias("_rt"), "status")
    late = F.col("_rt") > F.col("t")
    return ops.join(r, ["kid", "serial"], "left").select(
        "kid", "serial", F.when(late, F.col("_rt") - F.col("t")).alias("latency"), F.when(late, F.col("status")).alias("status"), (~F.coalesce(late, F.lit(False))).alias("corrupt")
    )


def links(sends: DataFrame, receipts: DataFrame) -> DataFrame:
    """Replies sent and received, on the key serial * 100000 + thief, of successful steals from another processor."""
    s = sends.select((F.col("serial") * 100000 + F.col("thief")).alias("key"), "victim", "thief", F.col("t").alias("sent"))
    r = receipts.where("status = 1").select((F.col("serial") * 100000 + F.col("thief")).alias("key"), F.col("t").alias("received"))
    return s.where("victim <> thief").join(r, "key")


def active_time(trace: DataFrame, on: Column, off: Column, order: str = "t") -> DataFrame:
    """kid, active, idle: time after a switching-on event and after a switching-off one, up to the kid's last event."""
    by_kid = Window.partitionBy("kid").orderBy(order)
    state = F.last(F.when(on, 1).when(off, 0), ignorenulls=True).over(by_kid.rowsBetween(Window.unboundedPreceding, 0))
    span = F.lead("t").over(by_kid) - F.col("t")
    steps = trace.withColumn("_state", F.coalesce(state, F.lit(0))).withColumn("_span", span)
    return steps.groupBy("kid").agg(
        F.coalesce(F.sum(F.when(F.col("_state") == 1, F.col("_span"))), F.lit(0)).alias("active"), F.coalesce(F.sum(F.when(F.col("_state") == 0, F.col("_span"))), F.lit(0)).alias("idle")
    )
