"""A query for each operator over the driver's tables, beside its SQL.

The sequence S is `events` ordered by event_id: v is value, k the number in props. Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqflow.functions import scalars
from seqflow.functions.reductions import TYPES, Reducer, reduce_with, reduction
from seqflow.operators import algorithms, arrays, graphs, multisets, search, searches, statistics, traces
from seqflow.operators.sequence import Sequence, zip_sequences
from seqflow.plans import dag
from seqflow.sources import traces as trace_io
from seqflow.sources.tables import table
from seqflow.streaming import traces as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

S = """with s as (select row_number() over (order by event_id) - 1 as pos, event_id, value as v,
  cast(json_extract_string(props, '$.k') as bigint) as k, user_id, event_type, ts, epoch_us(ts) * 1000 as t from events),
n as (select count(*) as n from s) """
P = "with o as (select row_number() over (order by o_orderkey) - 1 as pos, o_orderkey, o_totalprice as v from orders) "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "user_id", "event_type", "ts", (scalars.micros("ts") * 1000).alias("t")
    )


def seq(spark: SparkSession, d: str) -> Sequence:
    return Sequence(rows(spark, d), "event_id")


def orders(spark: SparkSession, d: str) -> Sequence:
    return Sequence(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), "o_orderkey")


# --- sources and sinks -------------------------------------------------------------------------------------------


@query("select min(epoch_us(ts) * 1000) as first_ns, max(epoch_us(ts) * 1000) as last_ns, count(distinct user_id) as processors from events")
def trace_extent(spark, d):
    return rows(spark, d).agg(F.min("t").alias("first_ns"), F.max("t").alias("last_ns"), F.count_distinct("user_id").alias("processors"))


@query(S + "select pos, event_id, v from s")
def seq_in_memory(spark, d):
    return seq(spark, d).with_pos().select("pos", "event_id", "v")


@query("select range as i from range(100000)")
def counting_iterator(spark, d):
    return spark.range(100000).select(F.col("id").alias("i"))


def as_trace(spark, d):
    """events as trace records: evtno 2 or 3 (a task begins or ends) by the parity of a kid's events."""
    r = rows(spark, d)
    parity = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) % 2
    return r.select(F.when(parity == 1, 2).otherwise(3).cast("short").alias("evtno"), F.col("user_id").alias("kid"), F.col("t"), F.col("event_id").alias("event"), F.col("k").alias("d0"), F.lit(0).cast("long").alias("d1"))


TRACE = S + ", tr as (select *, row_number() over (partition by user_id order by event_id) as rn from s) "


@query(TRACE + "select cast(t as varchar) || ': ' || user_id || ' -> ' || case when rn % 2 = 1 then 'TASK_BEG' else 'TASK_END' end || ', d0: ' || k || ', d1: 0' as value from tr")
def trace_as_text(spark, d):
    return trace_io.as_text(as_trace(spark, d))


@query(TRACE + "select count(*) as n, cast(sum(case when rn % 2 = 1 then 1 else 0 end) as bigint) as begins from tr")
def trace_mask(spark, d):
    return traces.in_classes(as_trace(spark, d), ["compute"]).agg(F.count("*").alias("n"), F.sum(F.when(F.col("evtno") == 2, 1).otherwise(0)).alias("begins"))


@query(TRACE + "select row_number() over (order by t, user_id, event_id) - 1 as pos, event_id from tr")
def trace_time_merge(spark, d):
    r = as_trace(spark, d)
    merged = r.where("kid % 2 = 0").unionByName(r.where("kid % 2 = 1"))
    # equal times are parted by the event's number, so (t, event) is one total order
    key = Sequence(merged.withColumn("_key", F.col("t").cast("decimal(38,0)") * 1), "t")
    w = Window.partitionBy("_b").orderBy("t", "kid", "event")
    blocks, carried = key._blocks()
    return blocks.join(F.broadcast(carried), "_b").select((F.col("_off") + F.row_number().over(w) - 1).alias("pos"), F.col("event").alias("event_id"))


@query("select evtno, name, name like '%\\_BEG' escape '\\' as is_begin, name like '%\\_END' escape '\\' as is_end from (values " + ", ".join(f"({c}, '{n}')" for c, n in traces.EVENTS.items()) + ") t(evtno, name)")
def trace_catalogue(spark, d):
    return traces.catalogue(spark).drop("class")


# --- map ---------------------------------------------------------------------------------------------------------


@query(S + "select pos, round(sin(v), 6) as v from s")
def seq_for_each(spark, d):
    return seq(spark, d).with_pos().select("pos", F.round(F.sin("v"), 6).alias("v"))


@query(S + "select pos, v * 2 + 1 as v from s")
def seq_transform_unary(spark, d):
    return seq(spark, d).with_pos().select("pos", (F.col("v") * 2 + 1).alias("v"))


@query(S + ", o as (select row_number() over (order by o_orderkey) - 1 as pos, o_totalprice as v from orders) select s.pos, round(s.v + o.v, 4) as v from s left join o using (pos)")
def seq_transform_binary(spark, d):
    z = zip_sequences(seq(spark, d).with_pos(), orders(spark, d).with_pos())
    return z.select("pos", F.round(F.col("v1") + F.col("v2"), 4).alias("v"))


@query(S + ", o as (select row_number() over (order by o_orderkey) - 1 as pos, o_totalprice as v from orders) select s.pos, s.v as v1, o.v as v2, cast(s.k as double) as v3, cast(s.user_id as double) as v4 from s left join o using (pos)")
def seq_zip4(spark, d):
    p = seq(spark, d).with_pos()
    as_v = lambda c: p.select("pos", F.col(c).cast("double").alias("v"))
    return zip_sequences(p.select("pos", "v"), orders(spark, d).with_pos(), as_v("k"), as_v("user_id"))


@query(S + "select pos, v from s")
def seq_copy(spark, d):
    return seq(spark, d).with_pos().select("pos", "v")


@query(S + "select pos, 42.0::double as v from s")
def seq_fill(spark, d):
    return seq(spark, d).with_pos().select("pos", F.lit(42.0).alias("v"))


@query(S + "select pos, (pos * pos) % 97 as v from s")
def seq_generate(spark, d):
    return seq(spark, d).with_pos().select("pos", (F.col("pos") * F.col("pos") % 97).alias("v"))


@query("select range as pos, range * 3 + 1 as v from range(1000)")
def seq_generate_n(spark, d):
    return spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 3 + 1).alias("v"))


@query(S + "select pos, case when k = 3 then -1 else k end as v from s")
def seq_replace(spark, d):
    return seq(spark, d).with_pos().select("pos", F.when(F.col("k") == 3, -1).otherwise(F.col("k")).alias("v"))


@query(S + "select pos, case when v > 100 then 0 else v end as v from s")
def seq_replace_if(spark, d):
    return seq(spark, d).with_pos().select("pos", F.when(F.col("v") > 100, 0.0).otherwise(F.col("v")).alias("v"))


@query(S + "select pos, k as original, case when k = 7 then 70 else k end as replaced, case when k > 50 then 50 else k end as replaced_if from s")
def seq_replace_copy(spark, d):
    k = F.col("k")
    return seq(spark, d).with_pos().select("pos", k.alias("original"), F.when(k == 7, 70).otherwise(k).alias("replaced"), F.when(k > 50, 50).otherwise(k).alias("replaced_if"))


@query("select cast(sum(range * range) as bigint) as total, count(*) as n from range(0, 1000000, 3)")
def foreach_range(spark, d):
    return spark.range(0, 1000000, 3).agg(F.sum(F.col("id") * F.col("id")).alias("total"), F.count("*").alias("n"))


@query("select cast(floor(range / 4096) as bigint) as block, cast(sum(range) as bigint) as total from range(100, 200000) group by 1")
def foreach_blocks(spark, d):
    return spark.range(100, 200000).groupBy(F.floor(F.col("id") / 4096).alias("block")).agg(F.sum("id").alias("total"))


@query(S + "select pos, round(2.5 * v + k, 4) as y from s")
def saxpy(spark, d):
    return seq(spark, d).with_pos().select("pos", F.round(2.5 * F.col("v") + F.col("k"), 4).alias("y"))


@query(S + "select pos, round(v + 2 * k + 3, 4) as x, round(cast(4 * k + user_id as double), 4) as y, round(v - user_id + 5, 4) as z from s")
def point_transform(spark, d):
    m = ((1, 2, 0, 3), (0, 4, 1, 0), (1, 0, -1, 5))
    p = (F.col("v"), F.col("k"), F.col("user_id"), F.lit(1))
    out = [F.round(sum((c * a for c, a in zip(p, row, strict=True)), F.lit(0.0)), 4).alias(n) for row, n in zip(m, "xyz", strict=True)]
    return seq(spark, d).with_pos().select("pos", *out)


@query(S + "select pos - 100 as pos, v from s where pos >= 100 and pos < 500")
def range_slice(spark, d):
    return seq(spark, d).with_pos().where("pos >= 100 and pos < 500").select((F.col("pos") - 100).alias("pos"), "v")


@query(S + "select pos - 150 as pos, v from s where pos >= 150 and pos < 250")
def range_compose(spark, d):
    outer = seq(spark, d).with_pos().where("pos >= 100 and pos < 500").select((F.col("pos") - 100).alias("pos"), "v")
    return outer.where("pos >= 50 and pos < 150").select((F.col("pos") - 50).alias("pos"), "v")


@query(S + "select pos, k as v1, v as v2 from s")
def swap_ranges(spark, d):
    z = seq(spark, d).with_pos().select("pos", F.col("v").alias("v1"), F.col("k").alias("v2"))
    return z.select("pos", F.col("v2").alias("v1"), F.col("v1").alias("v2"))


@query(S + "select 'large' as section, count(*) as n from s where v > 100 union all select 'small', count(*) from s where v <= 100")
def sections(spark, d):
    r = rows(spark, d)
    part = lambda name, c: r.where(c).agg(F.lit(name).alias("section"), F.count("*").alias("n"))
    return part("large", "v > 100").unionByName(part("small", "v <= 100"))


@query("select vec_id // 2 as i, cast(d as bigint) // 2 as j, v from (select vec_id, unnest(range(len(embedding))) as d, cast(unnest(embedding) as double) as v from embeddings) where vec_id % 2 = 0 and d % 2 = 0")
def image_scale(spark, d):
    return arrays.rescale(matrix(spark, d), 2)


# --- search ------------------------------------------------------------------------------------------------------


@query(S + "select count(*) filter (where k = 7) as n, 5 + count(*) filter (where k = 7) as n_from_5 from s")
def seq_count(spark, d):
    return rows(spark, d).agg(F.count_if(F.col("k") == 7).alias("n"), (F.lit(5) + F.count_if(F.col("k") == 7)).alias("n_from_5"))


@query(S + "select count(*) filter (where v > 100) as n from s")
def seq_count_if(spark, d):
    return rows(spark, d).agg(F.count_if(F.col("v") > 100).alias("n"))


@query(S + "select coalesce((select min(pos) from s where k = 42), n) as pos from n")
def seq_find(spark, d):
    return search.find(rows(spark, d), "event_id", "k", 42)


@query(S + "select coalesce((select min(pos) from s where k = -1), n) as pos from n")
def seq_find_absent(spark, d):
    return search.find(rows(spark, d), "event_id", "k", -1)


@query(S + "select coalesce((select min(pos) from s where v > 200), n) as pos from n")
def seq_find_if(spark, d):
    return search.find_if(rows(spark, d), "event_id", F.col("v") > 200)


@query(S + "select coalesce((select min(pos) from s where k in (select n_nationkey + 60 from nation)), n) as pos from n")
def seq_find_first_of(spark, d):
    among = table(spark, d, "nation").select((F.col("n_nationkey") + 60).cast("bigint").alias("a"))
    return search.find_first_of(rows(spark, d), "event_id", "k", among, "a")


@query(S + ", w as (select pos, k, lead(k) over (order by pos) as nk from s) select coalesce((select min(pos) from w where k = nk), n) as pos from n")
def seq_adjacent_find(spark, d):
    return search.adjacent_find(seq(spark, d), "k")


@query(S + ", w as (select pos, v, lead(v) over (order by pos) as nv from s) select coalesce((select min(pos) from w where v < nv / 10), n) as pos from n")
def seq_adjacent_find_if(spark, d):
    return search.adjacent_find(seq(spark, d), "v", lambda a, b: a < b / 10)


@query(S + ", w as (select pos, k, lead(k) over (order by pos) as k1 from s) select coalesce((select min(pos) from w where k = 29 and k1 = 26), n) as pos from n")
def seq_search(spark, d):
    return search.search(seq(spark, d), "k", [29, 26])


@query(S + "select n as pos from n")
def seq_search_absent(spark, d):
    return search.search(seq(spark, d), "k", [1000, 1001, 1002])


@query(S + ", g as (select pos, v >= 20 as bad, sum(case when v >= 20 then 1 else 0 end) over (order by pos) as g from s), r as (select min(pos) as start, count(*) as len from g where not bad group by g) select coalesce((select min(start) from r where len >= 4), n) as pos from n")
def seq_search_n(spark, d):
    return search.search_n(seq(spark, d), F.col("v") < 20, 4)


def _pair(spark, d):
    p = seq(spark, d).with_pos()
    return zip_sequences(p.select("pos", "k", F.col("k").alias("v")), p.select("pos", F.when(F.col("pos") == 700, -5).otherwise(F.col("k")).alias("v")))


@query(S + "select bool_and(k = case when pos = 700 then -5 else k end) as equal from s")
def seq_equal(spark, d):
    return search.equal(_pair(spark, d))


@query(S + "select coalesce((select min(pos) from s where k <> case when pos = 700 then -5 else k end), n) as pos from n")
def seq_mismatch(spark, d):
    return search.mismatch(_pair(spark, d))


@query(S + ", w as (select pos, v, lag(v) over (order by pos) as pv from s) select not coalesce(bool_or(v < pv), false) as sorted, coalesce(min(pos) filter (where v < pv), (select n from n)) as pos from w")
def seq_is_sorted(spark, d):
    return search.is_sorted(seq(spark, d), "v")


@query("select count(*) filter (where o_orderkey < 777) as pos, count(*) filter (where o_orderkey = 777) > 0 as found from orders")
def sorted_search(spark, d):
    return search.sorted_search(table(spark, d, "orders"), "o_orderkey", 777)


@query(S + "select pos, v from s where pos <= coalesce((select min(pos) from s where k = 42), (select n from n))")
def foreach_until(spark, d):
    p = seq(spark, d).with_pos()
    stop = p.agg(F.min(F.when(F.col("k") == 42, F.col("pos"))).alias("stop"))
    return p.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).select("pos", "v")


# --- reductions --------------------------------------------------------------------------------------------------


@query("select round(10 + sum(o_totalprice), 2) as total from orders")
def seq_accumulate(spark, d):
    return table(spark, d, "orders").agg(F.round(F.lit(10) + F.sum("o_totalprice"), 2).alias("total"))


@query(S + "select round(sum(v * k), 3) as total from s")
def seq_inner_product(spark, d):
    p = seq(spark, d).with_pos()
    return zip_sequences(p.select("pos", "v"), p.select("pos", F.col("k").alias("v"))).agg(F.round(F.sum(F.col("v1") * F.col("v2")), 3).alias("total"))


@query(S + "select (select pos from s order by floor(v), pos desc limit 1) as last_least, (select pos from s order by floor(v), pos limit 1) as first_least")
def seq_min_element(spark, d):
    p, v = seq(spark, d).with_pos(), F.floor("v")
    return p.agg(F.max_by("pos", F.struct(-v, "pos")).alias("last_least"), F.min_by("pos", F.struct(v, "pos")).alias("first_least"))


@query(S + "select (select pos from s order by floor(v) desc, pos desc limit 1) as last_greatest, (select pos from s order by floor(v) desc, pos limit 1) as first_greatest")
def seq_max_element(spark, d):
    p, v = seq(spark, d).with_pos(), F.floor("v")
    return p.agg(F.max_by("pos", F.struct(v, "pos")).alias("last_greatest"), F.min_by("pos", F.struct(-v, "pos")).alias("first_greatest"))


@query(S + "select cast(sum(k) as bigint) as plus, cast(100 - sum(k) as bigint) as minus, max(k) as largest, min(k) as least from s")
def red_arithmetic(spark, d):
    k = F.col("k")
    return rows(spark, d).agg(reduction("plus", k).alias("plus"), reduction("minus", k, init=F.lit(100)).alias("minus"), reduction("max", k).alias("largest"), reduction("min", k).alias("least"))


@query(S + "select round(exp(sum(ln(1 + k / 1e6))), 6) as product from s")
def red_product(spark, d):
    return rows(spark, d).agg(F.round(reduction("mul", 1 + F.col("k") / 1e6, "dbl"), 6).alias("product"))


@query(S + "select bit_and(k + 128) as all_bits, bit_or(k) as any_bit, bit_xor(k) as odd_bits from s")
def red_bitwise(spark, d):
    return rows(spark, d).agg(reduction("and", F.col("k") + 128).alias("all_bits"), reduction("or", F.col("k")).alias("any_bit"), reduction("xor", F.col("k")).alias("odd_bits"))


@query(S + "select cast(bool_and(k <> 0) as integer) as all_set, cast(bool_or(k <> 0) as integer) as any_set from s")
def red_logical(spark, d):
    return rows(spark, d).agg(reduction("land", F.col("k")).alias("all_set"), reduction("lor", F.col("k")).alias("any_set"))


@query(S + "select 0 as plus, 1.0::double as mul, -1::bigint as all_bits, 0::bigint as any_bit, 1 as all_set, 0 as any_set, max(k) as largest, min(k) as least, 7::bigint as largest_from_7, 7::bigint as least_from_7 from s where k < 0")
def red_identities(spark, d):
    none, k = rows(spark, d).where("k < 0"), F.col("k")
    ops = {"plus": "plus", "mul": "mul", "all_bits": "and", "any_bit": "or", "all_set": "land", "any_set": "lor"}
    ends = {"largest": "max", "least": "min"}
    made = none.agg(
        *[reduction(op, k, "dbl" if op == "mul" else "long").alias(n) for n, op in (ops | ends).items()],
        *[reduction(op, k, init=F.lit(7).cast("long")).alias(f"{n}_from_7") for n, op in ends.items()],
    )
    return made.select(F.col("plus").cast("int").alias("plus"), "mul", "all_bits", "any_bit", "all_set", "any_set", "largest", "least", "largest_from_7", "least_from_7")


@query(S + "select " + ", ".join(f"cast(sum(k) as double) as sum_{t}" for t in TYPES) + " from s")
def red_types(spark, d):
    return rows(spark, d).agg(*[reduction("plus", F.col("k"), t).cast("double").alias(f"sum_{t}") for t in TYPES])


@query(S + "select cast(sum(k) as bigint) as total, bit_xor(k) as odd_bits, max(v) as largest, count(*) filter (where v > 10) as n from s")
def multi_reduction(spark, d):
    return rows(spark, d).agg(F.sum("k").alias("total"), F.bit_xor("k").alias("odd_bits"), F.max("v").alias("largest"), F.count_if(F.col("v") > 10).alias("n"))


@query(S + "select round(sqrt(sum(v * v)), 4) as result from s")
def user_reduction(spark, d):
    import math

    hypot = Reducer(0.0, lambda s, x: math.sqrt(s * s + float((x * x).sum())), lambda a, b: math.sqrt(a * a + b * b))
    return reduce_with(rows(spark, d), "v", hypot).select(F.round("result", 4).alias("result"))


@query(S + "select k // 10 as bin, count(*) as n from s group by 1")
def histogram(spark, d):
    return rows(spark, d).groupBy(F.expr("k div 10").alias("bin")).agg(F.count("*").alias("n"))


@query(S + ", b as (select cast(range as integer) as bin from range(6)), c as (select (v >= 1)::int + (v >= 10)::int + (v >= 50)::int + (v >= 100)::int + (v >= 1000)::int as bin, count(*) as n from s group by 1) select bin, coalesce(n, 0) as n from b left join c using (bin)")
def distribution_statistic(spark, d):
    return statistics.distribution(rows(spark, d), F.col("v"), [1, 10, 50, 100, 1000])


_MOMENTS = "count(v) as n, round(sum(v), 3) as total, min(v) as least, max(v) as most, round(avg(v), 6) as mean, round(var_pop(v), 4) as variance, round(stddev_pop(v), 6) as deviation, round(stddev_pop(v) / avg(v), 6) as cv"
_DIGITS = {"total": 3, "mean": 6, "variance": 4, "deviation": 6, "cv": 6}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else F.col(c) for c in df.columns])


@query(S + f"select {_MOMENTS} from s")
def statistic(spark, d):
    return _rounded(rows(spark, d).agg(*statistics.moments(F.col("v"))))


@query(S + f"select event_type, {_MOMENTS} from s group by event_type")
def statistic_by_group(spark, d):
    return _rounded(rows(spark, d).groupBy("event_type").agg(*statistics.moments(F.col("v"))))


@query(S + "select round((sum(v * v) + avg(v) * (count(*) * avg(v) - 2 * sum(v))) / count(*), 3) as variance, round(avg(v), 6) as mean from s")
def variance_one_pass(spark, d):
    v = F.col("v")
    return rows(spark, d).agg(F.round((F.sum(v * v) + F.avg(v) * (F.count("*") * F.avg(v) - 2 * F.sum(v))) / F.count("*"), 3).alias("variance"), F.round(F.avg(v), 6).alias("mean"))


@query(S + "select cast(list_reduce(list(k order by pos), lambda a, x: (a * 2 + x) % 65521) % 65521 as bigint) as value from s")
def horner(spark, d):
    p = seq(spark, d).with_pos()
    last = p.agg(F.max("pos").alias("_last"))
    power = scalars.power_mod(2, F.col("_last") - F.col("pos"), 65521)
    return p.crossJoin(F.broadcast(last)).agg((F.sum(F.col("k") * power) % 65521).alias("value"))


@query("select user_id as kid, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k, count(*) as n, cast(grouping(user_id) as integer) as is_total from events group by rollup(user_id)")
def perf_rollup(spark, d):
    return statistics.rollup(rows(spark, d).withColumn("n", F.lit(1).cast("bigint")), "user_id", ["k", "n"]).withColumnRenamed("user_id", "kid")


@query(S + "select event_type as counter, cast(sum(k) as bigint) as total, cast(sum(k) filter (where user_id % 2 = 0) as bigint) as usr, cast(sum(k) filter (where user_id % 2 = 1) as bigint) as sys from s group by 1")
def perf_user_system(spark, d):
    even = F.col("user_id") % 2 == 0
    return rows(spark, d).groupBy(F.col("event_type").alias("counter")).agg(F.sum("k").alias("total"), F.sum(F.when(even, F.col("k"))).alias("usr"), F.sum(F.when(~even, F.col("k"))).alias("sys"))


# --- scans and neighbours ----------------------------------------------------------------------------------------


@query(S + "select pos, round(sum(v) over (order by pos), 3) as p from s")
def seq_partial_sum(spark, d):
    return seq(spark, d).scan("v").select("pos", F.round("p", 3).alias("p"))


@query(S + "select pos, max(v) over (order by pos) as p from s")
def seq_partial_max(spark, d):
    return seq(spark, d).scan("v", "max").select("pos", "p")


@query(P + "select pos, round(sum(v) over (order by pos), 2) as p from o")
def prefix_two_level(spark, d):
    return Sequence(orders(spark, d).df, "o_orderkey", 64).scan("v").select("pos", F.round("p", 2).alias("p"))


@query(S + "select pos, round(coalesce(v - lag(v) over (order by pos), v), 4) as d from s")
def seq_adjacent_difference(spark, d):
    return seq(spark, d).neighbours("v").select("pos", F.round(F.coalesce(F.col("v") - F.col("prev"), "v"), 4).alias("d"))


@query(S + ", w as (select (v - coalesce(lag(v) over (order by pos), 0)) / ((t - coalesce(lag(t) over (order by pos), 0)) / 1e9) as q from s) select count(*) as n, round(avg(q), 6) as mean, round(min(q), 4) as least, round(max(q), 4) as most from w")
def velocity(spark, d):
    both = seq(spark, d).neighbours(F.struct("v", "t"))
    q = (F.col("v.v") - F.coalesce("prev.v", F.lit(0.0))) / ((F.col("v.t") - F.coalesce("prev.t", F.lit(0))) / 1e9)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.min(q), 4).alias("least"), F.round(F.max(q), 4).alias("most"))


@query(S + "select pos, round(0.25 * coalesce(lag(v) over (order by pos), 0) + 0.5 * v + 0.25 * coalesce(lead(v) over (order by pos), 0), 4) as v from s")
def jacobi_1d(spark, d):
    side = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return seq(spark, d).neighbours("v").select("pos", F.round(0.25 * side("prev") + 0.5 * F.col("v") + 0.25 * side("next"), 4).alias("v"))


def matrix(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return e.select(F.col("vec_id").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


M = "with m as (select vec_id as i, unnest(range(len(embedding))) as j, cast(unnest(embedding) as double) as v from embeddings) "


@query(M + "select i, j, round(0.125 * (4 * v + coalesce(lag(v) over r, 0) + coalesce(lead(v) over r, 0) + coalesce(lag(v) over c, 0) + coalesce(lead(v) over c, 0)), 6) as v from m window r as (partition by i order by j), c as (partition by j order by i)")
def jacobi_2d(spark, d):
    return arrays.jacobi2d(matrix(spark, d)).select("i", "j", F.round("v", 6).alias("v"))


@query(S + ", g as (select pos % 10 as x, pos // 10 % 10 as y, pos // 100 as z, v from s) select g.x, g.y, g.z, round(coalesce(sum(b.v), 0) / 6, 4) as v from g left join g b on abs(g.x - b.x) + abs(g.y - b.y) + abs(g.z - b.z) = 1 and b.z between g.z - 1 and g.z + 1 and b.x between g.x - 1 and g.x + 1 and b.y between g.y - 1 and g.y + 1 group by all")
def poisson_3d(spark, d):
    g = seq(spark, d).with_pos().select((F.col("pos") % 10).alias("x"), F.expr("pos div 10 % 10").alias("y"), F.expr("pos div 100").alias("z"), "v")
    return arrays.poisson3d(g).select("x", "y", "z", F.round("v", 4).alias("v"))


@query("select o_orderkey as id, row_number() over (order by o_totalprice, o_orderkey) - 1 as rank from orders")
def list_ranking(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 100).cast("decimal(38,0)").alias("_c"))
    key = (F.col("_c") * F.lit(10**12) + F.col("o_orderkey")).cast("decimal(38,0)").alias("key")
    chain = Sequence(o.select("o_orderkey", key), "key").neighbours("o_orderkey")
    return graphs.list_rank(chain.select(F.col("v").alias("id"), "next"))


# --- sort --------------------------------------------------------------------------------------------------------


@query(S + "select row_number() over (order by v, event_id) - 1 as pos, v, event_id from s")
def sort_values(spark, d):
    return algorithms.sort(rows(spark, d).select("v", "event_id"), "v", "event_id")


@query(S + "select n - 1 - pos as pos, v from s, n")
def reverse_sequence(spark, d):
    return algorithms.reverse(seq(spark, d).with_pos().select("pos", "v"))


@query(S + "select row_number() over (order by case when v > 50 then 0 else 1 end, pos) - 1 as pos, v from s")
def stable_partition(spark, d):
    return algorithms.stable_partition(seq(spark, d), F.col("v") > 50).select("pos", "v")


@query("select v, count(*) as n from (select cast(o_totalprice as bigint) % 1000 as v from orders union all select cast(json_extract_string(props, '$.k') as bigint) as v from events) group by v")
def merge_sequences(spark, d):
    a = table(spark, d, "orders").select((F.bround("o_totalprice", 0).cast("bigint") % 1000).alias("v"))
    return a.unionAll(rows(spark, d).select(F.col("k").alias("v"))).groupBy("v").agg(F.count("*").alias("n"))


@query("select row_number() over (order by c_mktsegment desc, c_name) - 1 as pos, c_mktsegment, c_name from customer")
def sort_by_strings(spark, d):
    return algorithms.sort(table(spark, d, "customer").select("c_mktsegment", "c_name"), F.desc("c_mktsegment"), F.asc("c_name"))


@query(
    "with b as (select floor(o_totalprice)::bigint as v, o_orderkey as k, 0 as side from orders union all select floor(value)::bigint, event_id, 1 from events) "
    "select row_number() over (order by v, side, k) - 1 as pos, v, k, side from b"
)
def merge_in_order(spark, d):
    a = table(spark, d, "orders").select(F.floor("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    return algorithms.merge(a, rows(spark, d).select(F.floor("v").alias("v"), F.col("event_id").alias("k")), "v", "k")


@query(
    "with a as (select cast(o_totalprice as bigint) % 100 as v, count(*) as n from orders group by 1), b as (select cast(json_extract_string(props, '$.k') as bigint) as v, count(*) as n from events group by 1), "
    "u as (select coalesce(a.v, b.v) as v, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n from a full join b on a.v = b.v) "
    "select row_number() over (order by v) - 1 as pos, v from (select v, unnest(range(n)) as i from u)"
)
def set_union_in_order(spark, d):
    a = table(spark, d, "orders").select((F.bround("o_totalprice", 0).cast("bigint") % 100).alias("v"))
    return algorithms.as_sequence(multisets.combine(a, rows(spark, d).select(F.col("k").alias("v")), "v", "union"))


@query(S + ", o as (select row_number() over (order by o_orderkey) - 1 as pos, o_totalprice as v from orders) select s.pos, case when s.pos between 100 and 299 and o.pos is not null then o.v else s.v end as v from s left join o using (pos)")
def swap_ranges_values(spark, d):
    return algorithms.swap_ranges(seq(spark, d).with_pos().select("pos", "v"), orders(spark, d).with_pos().select("pos", "v"), 100, 300)[0]


@query(S + "select round(10 + sum(v), 3) as plus, round(greatest(10, max(v)), 3) as largest from s")
def accumulate_with(spark, d):
    r = rows(spark, d)
    both = algorithms.accumulate(r, "v", 10.0), algorithms.accumulate(r, "v", 10.0, "max").withColumnRenamed("result", "largest")
    return both[0].crossJoin(both[1]).select(F.round("result", 3).alias("plus"), F.round("largest", 3).alias("largest"))  # one row each


@query(S + "select round(5 + sum(abs(v - k)), 3) as result from s")
def inner_product_with(spark, d):
    zipped = rows(spark, d).select(F.col("event_id").alias("pos"), F.col("v").alias("v1"), F.col("k").alias("v2"))
    return algorithms.inner_product(zipped, 5.0, "plus", lambda a, b: F.abs(a - b)).select(F.round("result", 3).alias("result"))


@query(S + "select pos, case when pos = 0 then k else greatest(k, lag(k) over (order by pos)) end as d from s")
def adjacent_difference_with(spark, d):
    return algorithms.adjacent_difference(seq(spark, d), "k", F.greatest).select("pos", "d")


@query("select range as i, least(range + 1000, 12345) as j, (least(range + 1000, 12345) - range) as n from range(7, 12345, 1000)")
def foreach_with_body(spark, d):
    return algorithms.foreach_blocks(spark, 7, 12345, lambda i, j: {"n": j - i}, 1000)


@query(S + "select user_id, event_id, cast(rank() over (partition by user_id order by k desc, event_id) as integer) as place from s")
def ready_by_priority(spark, d):
    return rows(spark, d).select("user_id", "event_id", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("k"), "event_id")).alias("place"))


# --- multisets ---------------------------------------------------------------------------------------------------

_AB = "with a as (select cast(json_extract_string(props, '$.k') as bigint) as v from events where event_type = 'click'), b as (select cast(json_extract_string(props, '$.k') as bigint) as v from events where event_type = 'view'), c as (select v, sum(x) as x, sum(y) as y from (select v, 1 as x, 0 as y from a union all select v, 0, 1 from b) group by v) "


def _sides(spark, d):
    r = rows(spark, d)
    return r.where("event_type = 'click'"), r.where("event_type = 'view'")


@query(_AB + "select v, cast(greatest(x, y) as bigint) as n from c where greatest(x, y) > 0")
def set_union(spark, d):
    return multisets.combine(*_sides(spark, d), "k", "union")


@query(_AB + "select v, cast(least(x, y) as bigint) as n from c where least(x, y) > 0")
def set_intersection(spark, d):
    return multisets.combine(*_sides(spark, d), "k", "intersection")


@query("select cast(json_extract_string(props, '$.k') as bigint) as v from events where event_type = 'click' except all select cast(json_extract_string(props, '$.k') as bigint) from events where event_type = 'view'")
def set_difference(spark, d):
    return multisets.expand(multisets.combine(*_sides(spark, d), "k", "difference"))


# --- matrices, graphs, maps --------------------------------------------------------------------------------------


@query(M + "select a.j as i, b.j as j, round(sum(a.v * b.v), 5) as v from m a join m b using (i) group by a.j, b.j")
def matrix_product(spark, d):
    m = matrix(spark, d)
    return arrays.matmul(arrays.transpose(m), m).select("i", "j", F.round("v", 5).alias("v"))


@query(M + "select round(sqrt(sum(v * v)), 5) as frobenius, round(max(abs(v)), 6) as largest from m")
def matrix_norms(spark, d):
    return arrays.norms(matrix(spark, d)).select(F.round("frobenius", 5).alias("frobenius"), F.round("largest", 6).alias("largest"))


def _gram(spark, d):
    m = matrix(spark, d)
    g = arrays.matmul(arrays.transpose(m), m)
    return g.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") + 1).otherwise(F.col("v")).alias("v"))


@query(M + "select a.j as i, b.j as j, round(sum(a.v * b.v) + case when a.j = b.j then 1 else 0 end, 5) as v from m a join m b using (i) group by a.j, b.j")
def cholesky(spark, d):
    """The factor L, as the product L L' that SQL can state."""
    low = arrays.factor(_gram(spark, d), "cholesky")
    return arrays.matmul(low, arrays.transpose(low)).select("i", "j", F.round("v", 5).alias("v"))


@query(M + "select a.j as i, b.j as j, round(sum(a.v * b.v) + case when a.j = b.j then 1 else 0 end, 5) as v from m a join m b using (i) group by a.j, b.j")
def lu_without_pivots(spark, d):
    """The factors, as their product."""
    f = arrays.factor(_gram(spark, d), "lu")
    unit = f.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return arrays.matmul(f.where("i > j").union(unit), f.where("i <= j")).select("i", "j", F.round("v", 5).alias("v"))


@query(M + "select distinct j as i, cast(j + 1 as double) as v from m")
def forward_substitution(spark, d):
    """x of L x = b for Cholesky's factor L, as L x, which is b."""
    low = arrays.factor(_gram(spark, d), "cholesky")
    b = low.select("i").distinct().select("i", (F.col("i") + 1).cast("double").alias("v"))
    x = arrays.forward_substitution(low, b)
    column = x.select("i", F.lit(0).cast("long").alias("j"), "v")
    return arrays.matmul(low, column).select("i", F.round("v", 6).alias("v"))


_ALL_EDGES = "with recursive e as (select distinct user_id as src, cast(json_extract_string(props, '$.k') as bigint) as dst from events where user_id is not null and json_extract_string(props, '$.k') is not null), r(node, level) using key (node) as (select 0::bigint, 0 union select e.dst, min(level) + 1 from r join e on r.node = e.src where e.dst not in (select node from recurring.r) group by e.dst) "


def _all_edges(spark, d):
    return rows(spark, d).where("user_id is not null and k is not null").select(F.col("user_id").alias("src"), F.col("k").alias("dst")).distinct()


@query(_ALL_EDGES + "select node, level from r")
def bfs_levels_whole(spark, d):
    return graphs.bfs(_all_edges(spark, d), 0)


@query(_ALL_EDGES + "select coalesce(min(level), 0) as length from r where node = 93")
def bfs_shortest_path_whole(spark, d):
    return graphs.shortest_path(_all_edges(spark, d), 0, 93, unreachable=0)


@query(S + "select pos, pos % 192 // 16 as part, pos // 192 as block, pos % 16 as place, pos as back from s")
def block_cyclic_1d(spark, d):
    part, block, place = arrays.block_cyclic(F.col("pos"), 16, 12)
    return seq(spark, d).with_pos().select("pos", part.alias("part"), block.alias("block"), place.alias("place")).withColumn("back", arrays.block_cyclic_inverse(F.col("part"), F.col("block"), F.col("place"), 16, 12))


@query(M + "select i, j, i % 32 // 8 as pi, j % 16 // 8 as pj, (i % 32 // 8) * 2 + j % 16 // 8 as part from m")
def block_cyclic_2d(spark, d):
    pi, pj = arrays.block_cyclic(F.col("i"), 8, 4)[0], arrays.block_cyclic(F.col("j"), 8, 2)[0]
    return matrix(spark, d).select("i", "j", pi.alias("pi"), pj.alias("pj"), (pi * 2 + pj).alias("part"))


@query(M + ", z as (select max(i) + 1 as n from m) select i, j, i * 4 // n as bi, j // 16 as bj, case when (i * 4 // n + j // 16) % 2 = 0 then 'cpu' else 'gpu' end as site from m, z")
def block_2d(spark, d):
    m = matrix(spark, d)
    bi, bj = F.expr("i * 4 div n"), F.expr("j div 16")
    return m.crossJoin(F.broadcast(m.agg((F.max("i") + 1).alias("n")))).select("i", "j", bi.alias("bi"), bj.alias("bj"), F.when((bi + bj) % 2 == 0, "cpu").otherwise("gpu").alias("site"))


# --- task graphs -------------------------------------------------------------------------------------------------

_MODES = {"view": "R", "click": "RW", "error": "W", "purchase": "CW", "signup": "R"}
_ACC = "with a as (select event_id as task_id, user_id as datum, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _MODES.items()) + """ end as mode from events),
b as (select *, case when mode = lag(mode) over w and mode in ('R', 'CW') then 0 else 1 end as fresh from a window w as (partition by datum order by task_id)),
c as (select *, cast(sum(fresh) over (partition by datum order by task_id) - 1 as bigint) as version from b),
z as (select datum, version + 1 as version, count(*) as waits from c group by 1, 2),
x as (select c.*, coalesce(waits, 0) as waits_for, version = 0 or mode = 'W' as ready from c left join z using (datum, version)) """


def _accesses(spark, d):
    mode = F.create_map(*[F.lit(x) for kv in _MODES.items() for x in kv])[F.col("event_type")]
    return rows(spark, d).select(F.col("event_id").alias("task_id"), F.col("user_id").alias("datum"), mode.alias("mode"))


@query(_ACC + "select task_id, datum, mode, version, ready, mode = 'W' and version > 0 as renamed, mode = 'CW' as reduced, waits_for from x")
def dag_versions(spark, d):
    return dag.versions(_accesses(spark, d))


@query(_ACC + "select task_id from x where ready")
def dag_ready_list(spark, d):
    return dag.ready_tasks(dag.versions(_accesses(spark, d)))


@query(_ACC + "select p.task_id as src, q.task_id as dst, case when p.mode = 'R' then 'WAR' when q.mode in ('R', 'RW') then 'RAW' else 'WAW' end as kind from x p join x q on p.datum = q.datum and q.version = p.version + 1")
def dag_edges(spark, d):
    return dag.conflict_edges(dag.versions(_accesses(spark, d)))


_TREE = "with recursive o as (select row_number() over (order by o_orderkey) - 1 as i from orders), e as (select i as src, (i - 1) // 4 as dst from o where i > 0 union select i, (i - 1) // 3 from o where i > 0), "
_DATES = "q as (select i as node, 0 as date from o where i = 0 union select e.src, date + 1 from q join e on q.node = e.dst), p as (select node, max(date) as date from q group by node) "


def _tree(spark, d):
    """Tasks 0 to n - 1; each but the first precedes two others."""
    pos = orders(spark, d).with_pos().select(F.col("pos").alias("task_id"))
    to = F.explode(F.array_distinct(F.array(F.expr("(task_id - 1) div 4"), F.expr("(task_id - 1) div 3")))).alias("dst")
    return pos, pos.where("task_id > 0").select(F.col("task_id").alias("src"), to)


@query(_TREE + _DATES + "select node as task_id, date from p")
def dag_critical_path(spark, d):
    return dag.critical_path(*_tree(spark, d))


@query(_TREE + _DATES + ", z as (select max(date) as m from p) select node as task_id, date as same, cast(floor(date * 7 / greatest(m, 1)) as bigint) as linear, case when date = m then 7 else 0 end as longest from p, z")
def dag_priorities(spark, d):
    p = dag.critical_path(*_tree(spark, d))
    t = F.col("_t")
    both = p.crossJoin(F.broadcast(p.agg(F.max("date").alias("_t"))))
    date = F.col("date")
    return both.select("task_id", dag.priority(date, t, 8, "identity").alias("same"), dag.priority(date, t, 8, "linear").alias("linear"), dag.priority(date, t, 8, "max").alias("longest"))


@query(_TREE + "t as (select i, i % 5 as part from o) select src, dst, p.part as src_part, q.part as dst_part from e join t p on src = p.i join t q on dst = q.i where p.part <> q.part")
def dag_cut_edges(spark, d):
    tasks, edges = _tree(spark, d)
    return dag.cut_edges(edges, tasks.select("task_id", (F.col("task_id") % 5).alias("part")))


@query(_TREE + "f as (select 1) select src || ' -> ' || dst || ';' as value from e")
def dag_as_dot(spark, d):
    return trace_io.as_dot(_tree(spark, d)[1])


# --- traces ------------------------------------------------------------------------------------------------------

_SPANS = TRACE + ", iv as (select user_id as kid, t as beg, lead(t) over (partition by user_id order by event_id) as fin, rn % 2 = 1 as b from tr), i as (select kid, beg, fin, fin is not null as balanced from iv where b) "


def _spans(spark, d):
    t = as_trace(spark, d)
    return traces.intervals(t, F.when(F.col("evtno") == 2, 1).otherwise(-1), "event")


@query(_SPANS + "select kid, 1 as depth, beg, fin as \"end\", balanced from i")
def trace_intervals(spark, d):
    return _spans(spark, d)


@query(_SPANS + ", x as (select kid, cast(fin - beg as double) as d from i where balanced) select kid, count(*) as n, sum(d) as total, min(d) as least, max(d) as most, round(avg(d), 1) as mean, round(stddev_pop(d) / 1e6, 4) as deviation_ms, round(2.576 * sqrt(case when count(*) > 1 then var_pop(d) / (count(*) - 1) end) / 1e6, 4) as half_width_ms from x group by kid")
def trace_statistics(spark, d):
    s = traces.statistics(_spans(spark, d))
    return s.select("kid", "n", "total", "least", "most", F.round("mean", 1).alias("mean"), F.round(F.col("deviation") / 1e6, 4).alias("deviation_ms"), F.round(F.col("half_width") / 1e6, 4).alias("half_width_ms"))


@query(_SPANS + ", x as (select kid, beg, fin, unnest(range(beg // 3600000000000, (fin - 1) // 3600000000000 + 1)) as bucket from i where balanced and fin > beg) select kid, bucket, cast(sum(least(fin, (bucket + 1) * 3600000000000) - greatest(beg, bucket * 3600000000000)) as bigint) as busy from x group by kid, bucket")
def trace_utilisation(spark, d):
    return traces.utilisation(_spans(spark, d), 3_600_000_000_000)


_KINDS = S + ", tr as (select user_id as kid, t, event_id, k % 6 as kind, row_number() over (partition by user_id, k % 6 order by t, event_id) as rn from s) "


@query(_KINDS + ", iv as (select *, lead(t) over (partition by kid, kind order by t, event_id) as fin from tr), x as (select kid, count(*) filter (where kind = 0) as tasks, " + ", ".join(f"cast(coalesce(sum(fin - t) filter (where kind = {k}), 0) as bigint) as {n}" for k, n in enumerate(("total", "idle_all", "suspended", "requests"))) + " from iv where rn % 2 = 1 and kind < 4 and fin is not null group by kid), st as (select kid, count(*) filter (where kind = 4) as steals from tr group by kid) select kid, steals, coalesce(tasks, 0) as tasks, coalesce(total, 0) as total, coalesce(idle_all - suspended, 0) as idle, coalesce(suspended, 0) as suspended, coalesce(requests, 0) as requests from st left join x using (kid)")
def trace_task_statistics(spark, d):
    kind = F.col("k") % 6
    odd = F.row_number().over(Window.partitionBy("user_id", kind).orderBy("t", "event_id")) % 2 == 1
    begin = F.element_at(F.array(*[F.lit(c) for c in (2, 10, 12, 17)]), (kind + 1).cast("int"))
    code = F.when(kind == 4, 19).when(kind == 5, 25).otherwise(F.when(kind < 4, begin + F.when(odd, 0).otherwise(1)))
    # equal times are parted by the event's number
    return traces.task_statistics(rows(spark, d).select(F.col("user_id").alias("kid"), "t", F.struct("t", "event_id").alias("at"), code.alias("evtno")), "at")


_HOURS6 = 21_600_000_000_000


@query(
    S
    + f""", tr as (select user_id as kid, t, event_id, k % 3 as d2, case when row_number() over (partition by user_id order by t, event_id) = 2 then 0
  when event_type = 'error' and k % 8 = 7 then k % 16 // 8 else [10, 11, 12, 13, 15, 16, 21, 8][k % 8 + 1] end as evtno from s),
ep as (select *, sum(case when evtno < 2 then 1 else 0 end) over (partition by kid order by t, event_id) as epoch from tr where evtno in (0, 1, 10, 11, 12, 13, 15, 16)),
st as (select kid, t, sum(case when evtno in (10, 12, 15) then -1 when evtno in (0, 11, 13, 16) then 1 else 0 end) over (partition by kid, epoch order by t, event_id) as act, epoch,
  coalesce(lead(t) over (partition by kid order by t, event_id), (select (max(t) // {_HOURS6} + 1) * {_HOURS6} from tr)) as fin from ep),
ex as (select kid, act, t, fin, unnest(range(t // {_HOURS6}, (fin - 1) // {_HOURS6} + 1)) as bucket from st where epoch > 0 and fin > t),
sp as (select kid, bucket, sum(case when act = 1 then least(fin, (bucket + 1) * {_HOURS6}) - greatest(t, bucket * {_HOURS6}) else 0 end) as active,
  sum(case when act <> 1 then least(fin, (bucket + 1) * {_HOURS6}) - greatest(t, bucket * {_HOURS6}) else 0 end) as idle from ex group by kid, bucket),
ct as (select kid, t // {_HOURS6} as bucket, count(*) filter (where evtno = 21 and d2 <> 0) as steals, count(*) filter (where evtno = 8) as tasks from tr group by 1, 2),
gr as (select kid, bucket from (select distinct kid from tr), range((select min(t) // {_HOURS6} from tr), (select max(t) // {_HOURS6} + 1 from tr)) r(bucket))
select kid, bucket, cast(coalesce(active, 0) as bigint) as active, cast(coalesce(idle, 0) as bigint) as idle,
  cast(coalesce(sum(steals) over (partition by kid order by bucket), 0) as bigint) as steals, cast(coalesce(sum(tasks) over (partition by kid order by bucket), 0) as bigint) as tasks,
  round(coalesce(active / (active + idle), 0), 6) as efficiency from gr left join sp using (kid, bucket) left join ct using (kid, bucket)"""
)
def trace_efficiency(spark, d):
    k = F.col("k")
    second = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) == 2
    usual = F.element_at(F.array(*[F.lit(c) for c in (10, 11, 12, 13, 15, 16, 21, 8)]), (k % 8 + 1).cast("int"))
    code = F.when(second, 0).when((F.col("event_type") == "error") & (k % 8 == 7), F.floor(k % 16 / 8)).otherwise(usual)
    trace = rows(spark, d).select(F.col("user_id").alias("kid"), "t", F.col("event_id").alias("event"), code.alias("evtno"), (k % 3).alias("d2"))
    return traces.efficiency(trace, _HOURS6).withColumn("efficiency", F.round("efficiency", 6))


@query(TRACE + "select kid, task from (select user_id as kid, k as task, rn from tr) where rn % 2 = 1")
def trace_task_map(spark, d):
    return as_trace(spark, d).where("evtno = 2").select("kid", F.col("d0").alias("task"))


@query(_SPANS + "select printf('7 %d.%09d \"%d\" ST a', beg // 1000000000, beg % 1000000000, kid) as value from i where balanced union all select printf('8 %d.%09d \"%d\" ST', fin // 1000000000, fin % 1000000000, kid) from i where balanced")
def trace_as_paje(spark, d):
    return trace_io.as_paje(_spans(spark, d)).select("value")


_OPS = S + ", op as (select user_id as kid, row_number() over (partition by user_id order by event_id) as serial, t from s where event_type = 'click'), re as (select user_id as kid, row_number() over (partition by user_id order by event_id) as serial, t, k % 2 as status from s where event_type = 'view') "


@query(_OPS + "select kid, serial, case when re.t > op.t then re.t - op.t end as latency, case when re.t > op.t then status end as status, not coalesce(re.t > op.t, false) as corrupt from op left join re using (kid, serial)")
def trace_steals(spark, d):
    r = rows(spark, d)
    serial = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    side = lambda kind: r.where(F.col("event_type") == kind).select(F.col("user_id").alias("kid"), serial.alias("serial"), "t", (F.col("k") % 2).alias("status"))
    return traces.steals(side("click").drop("status"), side("view"))


@query(S + "select event_id * 100000 + k as key, user_id as victim, k as thief, t as sent, t + 1000 as received from s where user_id <> k and k % 2 = 1")
def trace_links(spark, d):
    r = rows(spark, d)
    sends = r.select(F.col("event_id").alias("serial"), F.col("k").alias("thief"), F.col("user_id").alias("victim"), "t")
    return traces.links(sends, r.select(F.col("event_id").alias("serial"), F.col("k").alias("thief"), (F.col("t") + 1000).alias("t"), (F.col("k") % 2).alias("status")))


@query(S + ", w as (select user_id as kid, coalesce(last_value(case when event_type in ('signup', 'purchase') then 1 when event_type = 'error' then 0 end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), 0) as st, lead(t) over (partition by user_id order by event_id) - t as span from s) select kid, cast(coalesce(sum(span) filter (where st = 1), 0) as bigint) as active, cast(coalesce(sum(span) filter (where st = 0), 0) as bigint) as idle from w group by kid")
def trace_active_time(spark, d):
    r = rows(spark, d).withColumnRenamed("user_id", "kid")
    return traces.active_time(r, F.col("event_type").isin("signup", "purchase"), F.col("event_type") == "error", "event_id")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def window_tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("with w as (select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2) select * from w where start + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'")
def stream_tumbling(spark, d):
    done = streams.drain(streams.tumbling(streams.events_stream(spark, d), "1 hour", "10 minutes"))
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query(TRACE + ", iv as (select user_id as kid, t as beg, lead(t) over (partition by user_id order by event_id) as \"end\", rn from tr) select kid, beg, \"end\" from iv where rn % 2 = 1 and \"end\" is not null")
def stream_intervals(spark, d):
    return streams.drain(streams.intervals(streams.events_stream(spark, d)))


# --- scalars and searches ----------------------------------------------------------------------------------------


@query(S + "select pos, (7 * k + 11) % 31 as axb, (pos * 3 + k) % 65521 as mixed from s")
def modular(spark, d):
    return seq(spark, d).with_pos().select("pos", scalars.axb_mod(F.lit(7), F.col("k"), F.lit(11), 31).alias("axb"), scalars.axb_mod(F.col("pos"), F.lit(3), F.col("k"), 65521).alias("mixed"))


@query(S + "select pos, k as as_long, try_cast(event_type as bigint) as no_long, v as as_double, case when k % 2 = 0 then true else false end as as_bool from s")
def parse_values(spark, d):
    parse = scalars.parse
    even = F.when(F.col("k") % 2 == 0, "true").otherwise("no")
    return seq(spark, d).with_pos().select("pos", parse(F.col("k").cast("string"), "long").alias("as_long"), parse(F.col("event_type"), "long").alias("no_long"), parse(F.col("v").cast("string"), "double").alias("as_double"), parse(even, "bool").alias("as_bool"))


@query(S + "select pos, cast(array_to_string(list_filter(range(k % 8, k % 8 + 5), lambda x: x <> k % 8 + 1), ',') as varchar) as cpus from s")
def cpu_sets(spark, d):
    low = F.col("k") % 8
    text = F.concat(low.cast("string"), F.lit(":"), (low + 4).cast("string"), F.lit(",!"), (low + 1).cast("string"))
    return seq(spark, d).with_pos().select("pos", F.array_join(F.transform(scalars.cpu_set(text), lambda x: x.cast("string")), ",").alias("cpus"))


@query("with w as (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as b from events) select event_id, epoch_us(ts) - epoch_us(b) as us, (epoch_us(ts) - epoch_us(b)) * 1000 as ns, (epoch_us(ts) - epoch_us(b)) // 1000 as ms, round((epoch_us(ts) - epoch_us(b)) / 1e6, 6) as s from w")
def elapsed_time(spark, d):
    w = table(spark, d, "events").withColumn("b", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    spent = lambda unit: scalars.elapsed("b", "ts", unit).alias(unit)
    return w.select("event_id", spent("us"), spent("ns"), spent("ms"), F.round(scalars.elapsed("b", "ts", "s"), 6).alias("s"))


@query(S + "select user_id * 1000 + k as packed, user_id as i, k as j from s")
def packed_ids(spark, d):
    packed = rows(spark, d).select(scalars.pack(F.col("user_id"), F.col("k"), 1000).alias("packed"))
    i, j = scalars.unpack(F.col("packed"), 1000)
    return packed.select("packed", i.alias("i"), j.alias("j"))


@query(S + "select pos, cast(bit_count(k) as integer) as ones, k & 12 as masked, k | 1 as odd, xor(k, 85) as flipped from s")
def bit_operations(spark, d):
    k = F.col("k")
    return seq(spark, d).with_pos().select("pos", F.bit_count(k).alias("ones"), k.bitwiseAND(F.lit(12)).alias("masked"), k.bitwiseOR(F.lit(1)).alias("odd"), k.bitwiseXOR(F.lit(85)).alias("flipped"))


@query(S + "select pos, round(sin(v), 6) as sine, round(cos(v), 6) as cosine, round(pow(v, 1.5), 4) as power, round(sqrt(v), 6) as root from s")
def math_functions(spark, d):
    return seq(spark, d).with_pos().select("pos", F.round(F.sin("v"), 6).alias("sine"), F.round(F.cos("v"), 6).alias("cosine"), F.round(F.pow("v", F.lit(1.5)), 4).alias("power"), F.round(F.sqrt("v"), 6).alias("root"))


@query("with recursive f as (select 0 as n, 0::bigint as a, 1::bigint as b union all select n + 1, b, a + b from f where n < 80) select n, a as fib from f")
def fibonacci(spark, d):
    return searches.fibonacci(spark, 80)


@query("with recursive q as (select 0 as r, []::integer[] as c union all select r + 1, list_append(c, cast(x as integer)) from q, range(8) t(x) where r < 8 and not list_contains(c, cast(x as integer)) and len(list_filter(range(len(c)), lambda i: abs(c[i + 1] - x) = r - i)) = 0) select 8 as n, count(*) as solutions from q where r = 8")
def queens(spark, d):
    return searches.queens(spark, 8)


@query("with recursive i as (select n_nationkey as k, n_nationkey * 5 % 13 + 1 as w, n_nationkey * 7 % 11 + 1 as v from nation), q as (select -1 as k, 0 as w, 0 as v union select i.k, q.w + x * i.w, q.v + x * i.v from q join i on i.k = q.k + 1, (values (0), (1)) t(x) where q.w + x * i.w <= 40) select cast(max(v) as bigint) as best from q")
def knapsack(spark, d):
    k = F.col("n_nationkey")
    return searches.knapsack(table(spark, d, "nation").select((k * 5 % 13 + 1).alias("weight"), (k * 7 % 11 + 1).alias("value")), 40)
