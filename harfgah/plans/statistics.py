"""Agreement, resampling, reports and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harfgah.operators import stats as S
from harfgah.plans import metrics as H
from harfgah.plans.registry import Registry
from harfgah.session import cut, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

B, SEED = 2_000, "42"
DRAWN_SQL = f"""(with rows as (select *, row_number() over (order by id) - 1 as place from {H.TIER_SQL}), n as (select count(*) as n from rows),
 draws as (select b, ('0x' || substr(md5('{SEED}:' || b || ':' || i), 1, 8))::uinteger::bigint % (select n from n) as place from range({B}) x(b), (select unnest(range(n)) as i from n))
 select b, sum(strict) / sum(total) as a, sum(accepted) / sum(total) as c from draws join rows using (place) group by b)"""


def drawn(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap(cut(H.tiers(spark, d).drop("eval_set", "category", "exact")), ["id"], {"a": ("strict", "total"), "c": ("accepted", "total")}, B, SEED)


@query(f"with s as (select list(round(a, 9) order by a) as l from {DRAWN_SQL}) select round((select sum(strict) / sum(total) from {H.TIER_SQL}), 6) as value, round(l[{int(0.025 * B) + 1}], 6) as lo, round(l[{int(0.975 * B) + 1}], 6) as hi from s")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Strict accuracy with its 95 per cent interval over resampled rows."""
    value = H.tiers(spark, d).agg(F.round(F.sum("strict") / F.sum("total"), 6).alias("value"))
    return value.join(F.broadcast(S.interval(drawn(spark, d), "a", B))).select("value", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    f"with s as (select list(round(c - a, 9) order by c - a) as l, avg((c - a > 0)::integer) as better from {DRAWN_SQL}), t as (select round(l[{int(0.025 * B) + 1}], 6) as lo, round(l[{int(0.975 * B) + 1}], 6) as hi, round(better, 6) as p_better from s) "
    "select lo, hi, p_better, case when lo > 0 or hi < 0 then 'real' else 'within noise' end as verdict from t"
)
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The gain of accepted over strict, both sides with the same draws; is it real?"""
    gap = drawn(spark, d).withColumn("gap", F.round(F.col("c") - F.col("a"), 9))
    ordered = F.array_sort(F.collect_list("gap"))  # as many as resamples
    r = gap.agg(F.round(F.get(ordered, F.lit(int(0.025 * B))), 6).alias("lo"), F.round(F.get(ordered, F.lit(int(0.975 * B))), 6).alias("hi"), F.round(F.avg((F.col("gap") > 0).cast("int")), 6).alias("p_better"))
    return r.withColumn("verdict", F.when((F.col("lo") > 0) | (F.col("hi") < 0), "real").otherwise("within noise"))


@query(f"select count(*) as n, count(distinct id) = count(*) as ids_are_unique, sum((accepted > strict)::integer)::bigint as better, sum((accepted < strict)::integer)::bigint as worse, sum((accepted = strict)::integer)::bigint as tied from {H.TIER_SQL}")
def ab_join(spark: SparkSession, d: str) -> DataFrame:
    """Two reports joined by id: rows that got better, worse, stayed."""
    t = H.tiers(spark, d)
    a, b = t.select("id", F.col("strict").alias("x")), t.select("id", F.col("accepted").alias("y"))
    n = lambda c: F.sum(c.cast("int"))
    return a.join(b, "id").agg(F.count("*").alias("n"), (F.count_distinct("id") == F.count("*")).alias("ids_are_unique"), n(F.col("y") > F.col("x")).alias("better"), n(F.col("y") < F.col("x")).alias("worse"), n(F.col("y") == F.col("x")).alias("tied"))


GRID = [(lo, hi, q) for lo in (0.02, 0.04) for hi in (0.06, 0.08) for q in (10, 24, 40)]


@query("select lo, hi, q, round(sum(case when l_discount between lo and hi and l_quantity < q then l_extendedprice * l_discount else 0 end), 2) as objective, count(*) filter (where l_discount between lo and hi and l_quantity < q) as n from lineitem, (select 0.02::double as lo union all select 0.04), (select 0.06::double as hi union all select 0.08), (select unnest([10, 24, 40]) as q) group by all")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    """An objective over every combination of three parameters, in one pass: each row adds to the settings that it meets."""
    grid = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(q).alias("q")) for a, b, q in GRID))
    rows = table(spark, d, "lineitem").select("l_discount", "l_quantity", "l_extendedprice", F.inline(grid))
    hit = F.col("l_discount").between(F.col("lo"), F.col("hi")) & (F.col("l_quantity") < F.col("q"))
    return rows.groupBy("lo", "hi", "q").agg(F.round(F.sum(F.when(hit, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0)), 2).alias("objective"), F.count_if(hit).alias("n"))


LAST_SQL = "(select span_key, judge, arg_max(v, (judged_at, v)) as v from (select span_key, judge, judged_at, lower(trim(verdict)) as v from judge_calibration) where v in ('accept', 'reject') group by all)"


def last_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "judge_calibration").select("span_key", "judge", "judged_at", F.lower(F.trim("verdict")).alias("v")).where("v in ('accept', 'reject')")
    return rows.groupBy("span_key", "judge").agg(F.max(F.struct("judged_at", "v"))["v"].alias("v"))


@query(f"select judge, count(*) as n, round((po - pe) / nullif(1 - pe, 0), 6) as kappa, sum(fa)::bigint as false_accepts, sum(fr)::bigint as false_rejects from (select *, avg((v = w)::integer) over (partition by judge) as po, avg((v = 'accept')::integer) over (partition by judge) * avg((w = 'accept')::integer) over (partition by judge) + avg((v = 'reject')::integer) over (partition by judge) * avg((w = 'reject')::integer) over (partition by judge) as pe, (v = 'accept' and w = 'reject')::integer as fa, (v = 'reject' and w = 'accept')::integer as fr from (select a.judge, a.v, b.v as w from {LAST_SQL} a join {LAST_SQL} b using (span_key) where b.judge = 'claude' and a.judge <> 'claude')) group by judge, po, pe")
def judge_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Each judge against one: Cohen's kappa, accepts and rejects that the other doesn't share."""
    v = last_verdicts(spark, d)
    both = v.where("judge <> 'claude'").join(v.where("judge = 'claude'").select("span_key", F.col("v").alias("w")), "span_key")
    n = lambda c: F.sum(c.cast("int"))
    up, ref = F.col("v") == "accept", F.col("w") == "accept"
    c = both.groupBy("judge").agg(F.count("*").alias("n"), n(F.col("v") == F.col("w")).alias("same"), n(up).alias("a"), n(ref).alias("b"), n(up & ~ref).alias("false_accepts"), n(~up & ref).alias("false_rejects"))
    value = F.try_divide(F.col("same") / F.col("n") - _expected(), 1 - _expected())
    return c.select("judge", "n", F.round(value, 6).alias("kappa"), "false_accepts", "false_rejects")


def _expected():
    a, b = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    return a * b + (1 - a) * (1 - b)


@query(f"select count(*) as n_items, count(*) filter (where a is not null and b is not null) as n_both, count(*) filter (where a = 'accept' and b = 'accept') as n_accepted, count(*) filter (where a <> b) as n_disagreed from (select span_key, max(v) filter (where judge = 'claude') as a, max(v) filter (where judge = 'luna') as b from {LAST_SQL} group by span_key)")
def judge_import(spark: SparkSession, d: str) -> DataFrame:
    """Items that two judges both saw, both accepted, or saw differently."""
    p = last_verdicts(spark, d).groupBy("span_key").pivot("judge", ["claude", "luna"]).agg(F.max("v"))
    a, b = F.col("claude"), F.col("luna")
    return p.agg(F.count("*").alias("n_items"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n_both"), F.count_if((a == "accept") & (b == "accept")).alias("n_accepted"), F.count_if(a != b).alias("n_disagreed"))


TALLY = "case when a = 'accept' and b = 'accept' then 'both' when a = 'accept' then 'claude only' when b = 'accept' then 'luna only' else 'neither' end"


@query(f"select {TALLY} as tally, nth > 1 as repeated, count(*) as n from (select lower(trim(claude)) as a, lower(trim(luna)) as b, row_number() over (partition by en order by loan_id) as nth from loanwords) group by all")
def review_tally(spark: SparkSession, d: str) -> DataFrame:
    """Who accepted; whether the entry was there before."""
    a, b = F.lower(F.trim("claude")) == "accept", F.lower(F.trim("luna")) == "accept"
    nth = F.row_number().over(Window.partitionBy("en").orderBy("loan_id"))
    kind = F.when(a & b, "both").when(a, "claude only").when(b, "luna only").otherwise("neither")
    return table(spark, d, "loanwords").select(kind.alias("tally"), (nth > 1).alias("repeated")).groupBy("tally", "repeated").agg(F.count("*").alias("n"))


@query("select coalesce(worker, 'all') as worker, coalesce(persona, 'all') as persona, count(*) as n, round(avg((latin = lower(latin))::integer), 6) as lower_share, round(avg(length(latin)), 4) as mean_length, round(avg(length(latin)), 4) between 20 and 80 as in_band from (select coalesce(worker, 'none') as worker, coalesce(persona, 'none') as persona, latin from example where latin is not null) group by grouping sets ((worker, persona), (persona), ())")
def typing_bands(spark: SparkSession, d: str) -> DataFrame:
    """Measures of each worker and persona, of each persona, of all; are they within bounds."""
    rows = table(spark, d, "example").where("latin is not null").select(F.coalesce("worker", F.lit("none")).alias("worker"), F.coalesce("persona", F.lit("none")).alias("persona"), "latin")
    g = rows.groupingSets([["worker", "persona"], ["persona"], []], "worker", "persona").agg(F.count("*").alias("n"), F.round(F.avg((F.col("latin") == F.lower("latin")).cast("int")), 6).alias("lower_share"), F.round(F.avg(F.length("latin")), 4).alias("mean_length"))
    return g.select(F.coalesce("worker", F.lit("all")).alias("worker"), F.coalesce("persona", F.lit("all")).alias("persona"), "n", "lower_share", "mean_length", F.col("mean_length").between(20, 80).alias("in_band"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_revision_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user: an aggregate, so that it combines before the shuffle and fits a stream."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"))
    return last.select("user_id", "x.event_id", "x.event_type", "x.value")


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and kind: the batch side of the windowed stream."""
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by all")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """A plain rollup over the star schema, as a control."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def nation_orders(spark: SparkSession, d: str) -> DataFrame:
    """A plain join over the star schema, as a control."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
