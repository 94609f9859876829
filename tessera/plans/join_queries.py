"""Queries of joins in time and pairings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import business_day_add, correlation, tidy
from ..operators.metrics import quantile_row
from ..operators import cross_section as X
from ..operators import joins as J
from .panels import BW, SM, R, brand_bars, market_bars, supplier_month, table
from .registry import query

ORD = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS date FROM orders)"


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("date"))


@query("jn_1_many_to_one", "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn_1(spark, d):
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return J.many_to_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"])


@query("jn_2_scores_and_label", f"WITH {SM} SELECT a.date, a.key, {R('a.x1')} AS s1, {R('b.x2')} AS s2, {R('a.y')} AS y FROM sm a JOIN sm b ON a.date = b.date AND a.key = b.key WHERE b.n >= 3 AND a.y IS NOT NULL")
def jn_2(spark, d):
    panel = supplier_month(spark, d)
    one = panel.select("date", "key", tidy("x1").alias("s1")).dropDuplicates(["date", "key"])
    two = panel.where("n >= 3").select("date", "key", tidy("x2").alias("s2")).dropDuplicates(["date", "key"])
    label = panel.where("y is not null").select("date", "key", tidy("y").alias("y"))
    return one.join(two, ["date", "key"]).join(label, ["date", "key"])


@query("jn_3_label_replacement", f"WITH {SM} SELECT date, key, {R('x1')} AS x1, {R('y')} AS label FROM sm WHERE n >= 4")
def jn_3(spark, d):
    panel = supplier_month(spark, d)
    scored = panel.select("date", "key", tidy("x1").alias("x1"), F.lit(0.0).alias("label"))
    return J.replace_label(scored, panel.where("n >= 4").select("date", "key", tidy("y").alias("label")), ["date", "key"], "label")


@query("jn_4_date_dimension", f"""WITH {SM}, r AS (SELECT DISTINCT date, CASE WHEN month(date) <= 6 THEN 'CALM' ELSE 'VOLATILE' END AS regime FROM sm WHERE month(date) <> 3)
SELECT coalesce(regime, 'NONE') AS regime, count(*)::BIGINT AS n, sum(volume)::BIGINT AS volume FROM sm LEFT JOIN r USING (date) GROUP BY 1""")
def jn_4(spark, d):
    panel = supplier_month(spark, d)
    regimes = panel.where(F.month("date") != 3).select("date", F.when(F.month("date") <= 6, "CALM").otherwise("VOLATILE").alias("regime")).distinct()
    return panel.join(regimes, "date", "left").groupBy(F.coalesce("regime", F.lit("NONE")).alias("regime")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("jn_5_benchmark_fill", f"""WITH {BW}, m AS (SELECT date, close FROM mk WHERE week(date) % 3 <> 0)
SELECT bw.date, key, {R('(SELECT arg_max(m.close, m.date) FROM m WHERE m.date <= bw.date)', 6)} AS bench FROM bw""")
def jn_5(spark, d):
    bars = brand_bars(spark, d)
    market = market_bars(bars).where(F.weekofyear("date") % 3 != 0)
    axis = bars.select("date").distinct().withColumn("k", F.lit(0))
    filled = J.as_of(axis, market.select(F.lit(0).alias("k"), "date", F.col("close").alias("bench")), "k", "date", ["bench"])
    return bars.join(F.broadcast(filled.drop("k")), "date").select("date", "key", tidy("bench", 6).alias("bench"))


@query("jn_6_exact_offset", f"WITH {BW} SELECT a.date, a.key, {R('c.close / b.close - 1')} AS r FROM bw a LEFT JOIN bw b ON a.key = b.key AND b.date = a.date + 7 LEFT JOIN bw c ON a.key = c.key AND c.date = a.date + 35")
def jn_6(spark, d):
    bars = brand_bars(spark, d)
    entry = J.offset_join(bars, "key", "date", "close", 7, "c1")
    both = J.offset_join(entry, "key", "date", "close", 35, "c2")
    return both.select("date", "key", tidy(F.col("c2") / F.col("c1") - 1).alias("r"))


@query("jn_7_as_of", f"""WITH {ORD}, e AS (SELECT o_custkey, date, max(o_totalprice) AS p FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o_orderkey, (SELECT arg_max(e.p, e.date) FROM e WHERE e.o_custkey = o.o_custkey AND e.date <= o.date) AS p FROM o""")
def jn_7(spark, d):
    all_orders = orders(spark, d)
    filled = all_orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "date").agg(F.max("o_totalprice").alias("p"))
    return J.as_of(all_orders, filled, "o_custkey", "date", ["p"]).select("o_orderkey", "p")


FOLDS = "f AS (SELECT (row_number() OVER (ORDER BY c) - 1)::INT AS fold, c AS cutoff FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2000-01-01', INTERVAL 180 DAY))::DATE AS c))"


def folds(spark):
    days = spark.range(1).select(F.explode(F.expr("sequence(date'1996-01-01', date'2000-01-01', interval 180 day)")).alias("cutoff"))
    return days.select((F.row_number().over(Window.orderBy("cutoff")) - 1).alias("fold"), "cutoff")


def add_bd_sql(x: str, n: int) -> str:
    """Business days forward in SQL, n > 0."""
    base = f"({x} - greatest(isodow({x})::INT - 5, 0))"
    w = f"least(isodow({x})::INT - 1, 4)"
    return f"({base} + (7 * (({w} + {n}) // 5) + ({w} + {n}) % 5 - {w})::INT)"


@query("jn_8_latest_fold", f"""WITH {SM}, {FOLDS}, e AS (SELECT fold, {add_bd_sql('cutoff', 20)} AS eff FROM f)
SELECT date, (SELECT max(fold) FROM e WHERE e.eff < d.date) AS fold FROM (SELECT DISTINCT date FROM sm) d""")
def jn_8(spark, d):
    effective = folds(spark).select(F.lit(0).alias("k"), business_day_add("cutoff", 20).alias("date"), "fold")
    dates = supplier_month(spark, d).select(F.lit(0).alias("k"), "date").distinct()
    return J.as_of(dates, effective, "k", "date", ["fold"], strict=True).select("date", "fold")


@query("jn_9_interval", f"""WITH {SM}, {FOLDS}, n AS (SELECT *, lead(cutoff) OVER (ORDER BY cutoff) AS nxt FROM f),
j AS (SELECT date, fold, nxt, row_number() OVER (PARTITION BY fold ORDER BY date) AS p FROM (SELECT DISTINCT date FROM sm) JOIN n ON date > cutoff AND (nxt IS NULL OR date <= nxt))
SELECT date, fold FROM j WHERE nxt IS NOT NULL OR p <= 4""")
def jn_9(spark, d):
    return J.interval_of(supplier_month(spark, d), folds(spark), 4)


@query("jn_10_formation_window", f"""WITH {BW}, r AS (SELECT date, key, close / lag(close) OVER (PARTITION BY key ORDER BY date) - 1 AS r FROM bw), m AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS m FROM mk),
a AS (SELECT DISTINCT date AS formed FROM bw WHERE month(date) % 6 = 0 AND day(date) <= 7)
SELECT formed, key, count(*)::BIGINT AS n, {R('avg(r - m)', 8)} AS excess FROM a JOIN r ON r.date > formed - 210 AND r.date <= formed - 14 JOIN m ON m.date = r.date WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2""")
def jn_10(spark, d):
    bars = brand_bars(spark, d)
    r = bars.select("date", "key", (F.col("close") / F.lag("close").over(Window.partitionBy("key").orderBy("date")) - 1).alias("r"))
    market = market_bars(bars).select("date", (F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1).alias("m"))
    formed = bars.where((F.month("date") % 6 == 0) & (F.day("date") <= 7)).select(F.col("date").alias("formed")).distinct()
    joined = r.join(F.broadcast(market), "date").where("r is not null and m is not null")
    inside = joined.join(F.broadcast(formed), (F.col("date") > F.date_sub("formed", 210)) & (F.col("date") <= F.date_sub("formed", 14)))
    return inside.groupBy("formed", "key").agg(F.count("*").alias("n"), tidy(F.avg(F.col("r") - F.col("m")), 8).alias("excess"))


@query("jn_11_common_pairs", f"""WITH {SM}, a AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM sm)), p AS (SELECT key, pos FROM sm JOIN a USING (date))
SELECT x.key, x.pos::INT AS pos FROM p x JOIN p y ON x.key = y.key AND y.pos = x.pos + 1 JOIN p z ON x.key = z.key AND z.pos = x.pos + 6""")
def jn_11(spark, d):
    panel = supplier_month(spark, d)
    placed = panel.join(F.broadcast(X.date_axis(panel)), "date").select("key", "pos")
    pairs = placed.select("key", F.explode(F.array(*[F.struct((F.col("pos") - lag).alias("pos"), F.lit(lag).alias("lag")) for lag in (0, 1, 6)])).alias("c")).select("key", "c.*")
    return pairs.groupBy("key", "pos").agg(F.countDistinct("lag").alias("n")).where("n = 3").select("key", "pos")


@query("jn_12_lag_join", f"""WITH {SM}, a AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM sm)), p AS (SELECT key, date, pos, x1 FROM sm JOIN a USING (date))
SELECT x.date, x.key, {R('x.x1')} AS x1, {R('y.x1')} AS later FROM p x JOIN p y ON x.key = y.key AND y.pos = x.pos + 3""")
def jn_12(spark, d):
    panel = supplier_month(spark, d).select("date", "key", tidy("x1").alias("x1"))
    return J.lag_join(panel, X.date_axis(panel), "key", "date", "x1", 3, "later").select("date", "key", "x1", "later")


@query("jn_13_fifo_pairs", f"""WITH {ORD}, t AS (SELECT o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 'buy' ELSE 'sell' END AS side, date, o_orderkey, o_totalprice FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY date, o_orderkey) AS rn FROM t)
SELECT b.key, b.rn::INT AS rn, b.o_orderkey AS buy, s.o_orderkey AS sell, {R('s.o_totalprice / b.o_totalprice - 1')} AS pnl FROM n b JOIN n s ON b.key = s.key AND b.rn = s.rn WHERE b.side = 'buy' AND s.side = 'sell'""")
def jn_13(spark, d):
    trades = orders(spark, d).select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell").alias("side"), "date", "o_orderkey", "o_totalprice")
    pairs = J.fifo_pairs(trades, "key", "side", ["date", "o_orderkey"])
    return pairs.select("key", "rn", F.col("b_o_orderkey").alias("buy"), F.col("s_o_orderkey").alias("sell"), tidy(F.col("s_o_totalprice") / F.col("b_o_totalprice") - 1).alias("pnl"))


@query("jn_14_full_pairs", f"""WITH {ORD}, a AS (SELECT date, count(*)::BIGINT AS na FROM o WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT date, count(*)::BIGINT AS nb FROM o WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT date, na, nb, CASE WHEN na IS NULL THEN 'only_second' WHEN nb IS NULL THEN 'only_first' ELSE 'paired' END AS reason FROM a FULL JOIN b USING (date)""")
def jn_14(spark, d):
    o = orders(spark, d)
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy("date").agg(F.count("*").alias(n))
    return J.full_pairs(side("F", "na"), side("P", "nb"), ["date"])


MODELS = "ms AS (SELECT date, key, 'm1' AS model, x1 AS score FROM sm UNION ALL SELECT date, key, 'm2', x2 FROM sm UNION ALL SELECT date, key, 'm3', close FROM sm)"


def models(spark, d):
    wide = supplier_month(spark, d).select("date", "key", F.col("x1").alias("m1"), F.col("x2").alias("m2"), F.col("close").alias("m3"))
    return wide.unpivot(["date", "key"], ["m1", "m2", "m3"], "model", "score")


@query("jn_15_model_pairs", f"""WITH {SM}, {MODELS} SELECT a.model AS a, b.model AS b, a.date, {R('covar_pop(a.score, b.score) / nullif(stddev_pop(a.score) * stddev_pop(b.score), 0)', 8)} AS rho
FROM ms a JOIN ms b ON a.date = b.date AND a.key = b.key AND a.model < b.model GROUP BY 1, 2, 3""")
def jn_15(spark, d):
    return J.model_pairs(models(spark, d), ["date", "key"]).groupBy("a", "b", "date").agg(tidy(correlation("sa", "sb"), 8).alias("rho"))


@query("jn_16_paired_dates", f"""WITH {ORD}, a AS (SELECT date, avg(o_totalprice) AS ra, count(*) AS na FROM o WHERE o_custkey % 2 = 0 GROUP BY 1), b AS (SELECT date, avg(o_totalprice) AS rb, count(*) AS nb FROM o WHERE o_custkey % 2 = 1 GROUP BY 1)
SELECT CASE WHEN na IS NULL THEN 'missing_first' WHEN nb IS NULL THEN 'missing_second' WHEN na < 3 OR nb < 3 THEN 'undersized' ELSE 'paired' END AS reason, count(*)::BIGINT AS n FROM a FULL JOIN b USING (date) GROUP BY 1""")
def jn_16(spark, d):
    o = orders(spark, d)
    side = lambda k, n: o.where(F.col("o_custkey") % 2 == k).groupBy("date").agg(F.count("*").alias(n))
    both = side(0, "na").join(side(1, "nb"), "date", "full")
    reason = F.when(F.col("na").isNull(), "missing_first").when(F.col("nb").isNull(), "missing_second").when((F.col("na") < 3) | (F.col("nb") < 3), "undersized").otherwise("paired")
    return both.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("jn_17_trial_grid", "SELECT r_name AS config, s.seed::INT AS seed, n_name AS cut FROM region, (VALUES (0), (1), (2)) s(seed), nation WHERE n_regionkey = r_regionkey")
def jn_17(spark, d):
    seeds = spark.range(3).select(F.col("id").cast("int").alias("seed"))
    cuts = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("cut"))
    return table(spark, d, "region").crossJoin(seeds).join(cuts, "r_regionkey").select(F.col("r_name").alias("config"), "seed", "cut")


@query("jn_18_index_diff", """WITH a AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 1), b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 2)
SELECT c_custkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'changed' END AS state
FROM (SELECT *, 1 AS k FROM a) a FULL JOIN (SELECT *, 1 AS k FROM b) b USING (c_custkey) WHERE a.k IS NULL OR b.k IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal""")
def jn_18(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    before = c.where("c_custkey % 10 <> 1")
    after = c.where("c_custkey % 10 <> 2").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 != 3, F.col("c_acctbal")))
    return J.index_diff(before, after, "c_custkey", "c_acctbal")


@query("jn_19_date_census", """WITH l AS (SELECT l_orderkey AS k, count(DISTINCT l_shipdate) AS c, min(l_shipdate)::DATE AS s FROM lineitem GROUP BY 1),
j AS (SELECT date_diff('day', o_orderdate::DATE, s) AS x FROM l JOIN orders ON k = o_orderkey WHERE c = 1)
SELECT (SELECT count(*) FROM l WHERE c > 1)::BIGINT AS refused, count(*)::BIGINT AS n, min(x)::BIGINT AS low, median(x)::DOUBLE AS mid, max(x)::BIGINT AS high FROM j""")
def jn_19(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_shipdate").alias("c"), F.to_date(F.min("l_shipdate")).alias("s"))
    joined = lines.join(table(spark, d, "orders"), "o_orderkey", "left").withColumn("x", F.when(F.col("c") == 1, F.datediff("s", F.to_date("o_orderdate"))))
    return joined.agg(F.count(F.when(F.col("c") > 1, 1)).alias("refused"), F.count("x").alias("n"), F.min("x").cast("long").alias("low"), F.max("x").cast("long").alias("high")).join(F.broadcast(quantile_row(joined, "x", {"mid": 0.5})))


@query("jn_20_departed_keys", "WITH u AS (SELECT ts::DATE AS date, user_id FROM events) SELECT DISTINCT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM u WHERE date = (SELECT max(date) FROM u))")
def jn_20(spark, d):
    u = table(spark, d, "events").select(F.to_date("ts").alias("date"), "user_id")
    last = u.join(F.broadcast(u.agg(F.max("date").alias("date"))), "date", "left_semi")
    return u.select("user_id").distinct().join(last.select("user_id"), "user_id", "left_anti")


@query("jn_21_input_parity", """WITH e AS (SELECT ts::DATE AS session, event_type AS arm, user_id, value, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT a.session, a.user_id IS NOT DISTINCT FROM b.user_id AS u, floor(a.value / 10) IS NOT DISTINCT FROM floor(b.value / 10) AS v FROM e a JOIN e b USING (session) WHERE a.arm = 'click' AND b.arm = 'view' AND a.rn = 1 AND b.rn = 1)
SELECT session, concat_ws(',', CASE WHEN NOT u THEN 'user' END, CASE WHEN NOT v THEN 'value' END) AS reasons, u AND v AS same FROM p""")
def jn_21(spark, d):
    e = table(spark, d, "events").withColumn("session", F.to_date("ts"))
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("session", "event_type").orderBy("ts", "event_id"))).where("rn = 1")
    arm = lambda t, p: first.where(F.col("event_type") == t).select("session", F.col("user_id").alias(f"{p}u"), F.floor(F.col("value") / 10).alias(f"{p}v"))
    both = arm("click", "a").join(arm("view", "b"), "session")
    reasons = F.array_compact(F.array(F.when(~F.col("au").eqNullSafe(F.col("bu")), F.lit("user")), F.when(~F.col("av").eqNullSafe(F.col("bv")), F.lit("value"))))
    return both.select("session", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("same"))
