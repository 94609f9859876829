"""Queries of rolling features, labels, calendars and splits over brand bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import avg_rank, tidy
from ..operators import cross_section as X
from ..operators import rolling as L
from ..operators import splits as W
from .join_queries import add_bd_sql
from .panels import BW, SM, R, avg_rank_sql, brand_bars, market_bars, supplier_month, table
from .registry import query

RT = f"""{BW}, rt AS (SELECT *, close / lag(close) OVER (PARTITION BY key ORDER BY date) - 1 AS ret FROM bw), mr AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS market FROM mk)"""
K = "PARTITION BY key ORDER BY date"


def returns(spark, d):
    bars = brand_bars(spark, d)
    market = market_bars(bars).select("date", (F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1).alias("market"))
    return bars.withColumn("ret", L.change("close", 1, L.by_key())).join(F.broadcast(market), "date")


@query("rol_1_lag_return", f"WITH {BW} SELECT date, key, {R(f'close / lag(close, 3) OVER ({K}) - 1')} AS back, {R(f'lead(close, 2) OVER ({K}) / close - 1')} AS ahead FROM bw")
def rol_1(spark, d):
    w = L.by_key()
    return brand_bars(spark, d).select("date", "key", tidy(L.change("close", 3, w)).alias("back"), tidy(F.lead("close", 2).over(w) / F.col("close") - 1).alias("ahead"))


@query("rol_2_momentum", f"""WITH {BW} SELECT date, key, {R(f'lag(close, 4) OVER ({K}) / lag(close, 52) OVER ({K}) - 1')} AS m12_1, {R(f'CASE WHEN count(*) OVER f = 20 THEN close / max(close) OVER f - 1 END')} AS high_20, {R('CASE WHEN count(*) OVER f = 20 THEN close / avg(close) OVER f - 1 END')} AS mean_20
FROM bw WINDOW f AS ({K} ROWS 19 PRECEDING)""")
def rol_2(spark, d):
    f = L.price_features(brand_bars(spark, d))
    return f.select("date", "key", tidy(L.skipped_momentum("close", 52, 4, L.by_key())).alias("m12_1"), tidy("high_20").alias("high_20"), tidy("mean_20").alias("mean_20"))


@query("rol_3_volatility", f"WITH {RT} SELECT date, key, {R('CASE WHEN count(ret) OVER f = 20 THEN stddev_samp(ret) OVER f * sqrt(52) END', 8)} AS vol FROM rt WINDOW f AS ({K} ROWS 19 PRECEDING)")
def rol_3(spark, d):
    return L.price_features(brand_bars(spark, d)).select("date", "key", tidy("vol_20", 8).alias("vol"))


@query("rol_4_downside", f"WITH {RT} SELECT date, key, {R('CASE WHEN count(ret) OVER f = 20 THEN sqrt(sum(least(ret, 0) ** 2) OVER f / 19) END', 8)} AS down FROM rt WINDOW f AS ({K} ROWS 19 PRECEDING)")
def rol_4(spark, d):
    return L.price_features(brand_bars(spark, d)).select("date", "key", tidy("down_20", 8).alias("down"))


@query("rol_5_level_spread", f"WITH {BW} SELECT date, key, {R('CASE WHEN count(*) OVER f = 20 THEN stddev_samp(close) OVER f / close END', 8)} AS level FROM bw WINDOW f AS ({K} ROWS 19 PRECEDING)")
def rol_5(spark, d):
    return L.price_features(brand_bars(spark, d)).select("date", "key", tidy("level_20", 8).alias("level"))


@query("rol_6_line_residual", f"""WITH {BW}, i AS (SELECT *, row_number() OVER ({K})::DOUBLE AS i FROM bw)
SELECT date, key, {R('CASE WHEN count(*) OVER f = 20 THEN sqrt(greatest(0, regr_syy(close, i) OVER f - (regr_sxy(close, i) OVER f) ** 2 / nullif(regr_sxx(close, i) OVER f, 0)) / 18) / close END', 7)} AS resid FROM i WINDOW f AS ({K} ROWS 19 PRECEDING)""")
def rol_6(spark, d):
    return L.residual_spread(brand_bars(spark, d), 20).select("date", "key", tidy("resid", 7).alias("resid"))


@query("rol_7_beta", f"""WITH {RT}, j AS (SELECT rt.date, key, CASE WHEN market IS NOT NULL THEN ret END AS r, CASE WHEN ret IS NOT NULL THEN market END AS m FROM rt JOIN mr USING (date))
SELECT date, key, {R('CASE WHEN count(r) OVER f = 20 THEN covar_samp(r, m) OVER f / nullif(var_samp(m) OVER f, 0) END', 6)} AS beta FROM j WINDOW f AS ({K} ROWS 19 PRECEDING)""")
def rol_7(spark, d):
    return L.rolling_beta(returns(spark, d), 20).select("date", "key", tidy("beta", 6).alias("beta"))


@query("rol_8_drawdown", f"""WITH {BW}, n AS (SELECT *, row_number() OVER ({K}) AS i FROM bw),
p AS (SELECT a.key, a.i, min(b.close / c.close - 1) AS dd FROM n a JOIN n b ON a.key = b.key AND b.i BETWEEN a.i - 12 AND a.i JOIN n c ON a.key = c.key AND c.i BETWEEN a.i - 12 AND b.i GROUP BY 1, 2)
SELECT n.date, n.key, CASE WHEN n.i >= 13 THEN {R('least(dd, 0)')} END AS drawdown FROM n JOIN p ON n.key = p.key AND n.i = p.i""")
def rol_8(spark, d):
    return L.rolling_drawdown(brand_bars(spark, d), 13).select("date", "key", tidy("drawdown").alias("drawdown"))


DIV = f"{BW}, dv AS (SELECT *, CASE WHEN volume % 9 = 0 THEN close / 100 END AS dividend FROM bw)"


def dividends(spark, d):
    return brand_bars(spark, d).withColumn("dividend", F.when(F.col("volume") % 9 == 0, F.col("close") / 100))


@query("rol_9_trailing_yield", f"WITH {DIV} SELECT date, key, {R(f'sum(coalesce(dividend, 0)) OVER ({K} ROWS 51 PRECEDING) / close')} AS yield FROM dv")
def rol_9(spark, d):
    return L.trailing_yield(dividends(spark, d), 52).select("date", "key", tidy("yield").alias("yield"))


@query("rol_10_total_return", f"WITH {DIV} SELECT date, key, {R(f'close / coalesce(exp(sum(ln(1 + coalesce(dividend, 0) / close)) OVER ({K} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1)', 5)} AS total FROM dv")
def rol_10(spark, d):
    return L.total_return(dividends(spark, d)).select("date", "key", tidy("total", 5).alias("total"))


@query("rol_11_forward_excess", f"""WITH {BW}, a AS (SELECT *, lead(date, 4) OVER ({K}) AS d2, lead(close, 4) OVER ({K}) / close - 1 AS r FROM bw)
SELECT a.date, key, {R('r - (m2.close / m1.close - 1)')} AS fwd FROM a LEFT JOIN mk m1 ON m1.date = a.date LEFT JOIN mk m2 ON m2.date = d2""")
def rol_11(spark, d):
    bars = brand_bars(spark, d)
    return L.forward_excess(bars, market_bars(bars), 4).select("date", "key", tidy("fwd").alias("fwd"))


@query("rol_12_trend", f"""WITH {BW}, p AS (SELECT *, row_number() OVER ({K}) AS i, count(*) OVER (PARTITION BY key) AS n, first_value(close) OVER ({K}) AS f, last_value(close) OVER ({K} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, sum(close) OVER ({K} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM bw),
t AS (SELECT *, (s + greatest(0, 3 - i) * f + greatest(0, 2 - (n - i)) * l) / 5 AS t FROM p) SELECT date, key, {R('t', 5)} AS trend, {R('close - t', 5)} AS seasonal FROM t""")
def rol_12(spark, d):
    return L.trend(brand_bars(spark, d), 5).select("date", "key", tidy("trend", 5).alias("trend"), tidy("seasonal", 5).alias("seasonal"))


@query("rol_13_last_normalised", f"WITH {BW}, s AS (SELECT date, key, list(volume) OVER ({K} ROWS 3 PRECEDING) AS v FROM bw) SELECT date, key, array_to_string(list_transform(v, lambda x: x - v[-1]), ',') AS seq FROM s WHERE len(v) = 4")
def rol_13(spark, d):
    seq = brand_bars(spark, d).withColumn("v", F.collect_list("volume").over(L.by_key().rowsBetween(-3, 0))).where(F.size("v") == 4)
    return seq.select("date", "key", F.array_join(F.transform(L.last_normalised("v"), lambda x: x.cast("string")), ",").alias("seq"))


@query("rol_14_sequences", f"""WITH {BW}, y AS (SELECT *, year(date) AS yr FROM bw), s AS (SELECT date, key, count(*) OVER f AS n, min(yr) OVER f AS a, max(yr) OVER f AS b, sum(volume) OVER f AS total FROM y WINDOW f AS ({K} ROWS 4 PRECEDING)),
g AS (SELECT *, count(*) OVER (PARTITION BY date) AS c FROM s WHERE n = 5 AND a = b) SELECT date, key, 5 AS steps, total::BIGINT AS total FROM g WHERE c >= 5""")
def rol_14(spark, d):
    panel = brand_bars(spark, d).withColumn("yr", F.year("date"))
    out = L.sequences(panel, ["volume", "close"], 5, split="yr", min_names=5)
    return out.select("date", "key", F.size("seq").alias("steps"), F.aggregate("seq", F.lit(0).cast("long"), lambda a, x: a + x[0].cast("long")).alias("total"))


@query("rol_15_forward_fill", f"WITH {BW} SELECT date, key, last_value(CASE WHEN volume % 3 = 0 THEN volume END IGNORE NULLS) OVER ({K} ROWS UNBOUNDED PRECEDING) AS v FROM bw")
def rol_15(spark, d):
    known = F.when(F.col("volume") % 3 == 0, F.col("volume"))
    return brand_bars(spark, d).select("date", "key", F.last(known, ignorenulls=True).over(L.by_key().rowsBetween(Window.unboundedPreceding, 0)).alias("v"))


@query("rol_16_time_shift", f"""WITH {BW}, s AS (SELECT *, year(date)::VARCHAR AS split FROM bw), x AS (SELECT date, key, volume, unnest([1, 4]) AS shift FROM s),
l AS (SELECT date, key, 1 AS shift, lead(volume, 1) OVER ({K}) AS shifted, split, lead(split, 1) OVER ({K}) AS sp FROM s UNION ALL SELECT date, key, 4, lead(volume, 4) OVER ({K}), split, lead(split, 4) OVER ({K}) FROM s)
SELECT date, key, shift::INT AS shift, shifted FROM l WHERE sp = split""")
def rol_16(spark, d):
    panel = brand_bars(spark, d).withColumn("split", F.year("date").cast("string"))
    return L.shifted_labels(panel, "volume", [1, 4], "split").select("date", "key", "shift", "shifted")


@query("rol_17_turnover", f"""WITH {SM}, t AS (SELECT date, key, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key) AS rn FROM sm), s AS (SELECT date, list(key) AS k FROM t WHERE rn <= 10 GROUP BY 1), g AS (SELECT date, k, lag(k) OVER (ORDER BY date) AS p FROM s)
SELECT date, CASE WHEN p IS NOT NULL THEN (len(list_filter(k, lambda x: NOT list_contains(p, x))) + len(list_filter(p, lambda x: NOT list_contains(k, x)))) / 20.0::DOUBLE END AS turnover FROM g""")
def rol_17(spark, d):
    return L.turnover(X.top_n(supplier_month(spark, d), "x2", 10), 10)


VS = f"{RT}, vs AS (SELECT date, key, close, CASE WHEN count(ret) OVER f = 10 THEN stddev_samp(ret) OVER f END AS sigma, row_number() OVER ({K}) AS i FROM rt WINDOW f AS ({K} ROWS 9 PRECEDING))"
BARRIER = f"""{VS}, h AS (SELECT a.date, a.key, a.close, a.sigma, b.i - a.i AS k, b.close AS c, b.close >= a.close * (1 + 1.0 * a.sigma) AS up, b.close <= a.close * (1 - 1.0 * a.sigma) AS dn FROM vs a JOIN vs b ON a.key = b.key AND b.i BETWEEN a.i + 1 AND a.i + 6 WHERE a.sigma IS NOT NULL),
e AS (SELECT date, key, any_value(close) AS close, coalesce(min(k) FILTER (up OR dn), max(k)) AS k, count(*) FILTER (up OR dn) AS t, max(k) AS later, any_value(sigma) AS sigma FROM h GROUP BY 1, 2)"""


def barriers(spark, d, short_exit):
    bars = brand_bars(spark, d).withColumn("ret", L.change("close", 1, L.by_key()))
    bars = bars.withColumn("sigma", L.full(F.stddev_samp("ret"), F.col("ret"), L.by_key(), 10))
    return L.triple_barrier(bars, 6, 1.0, 1.0, "sigma", short_exit=short_exit).where("days is not null")


@query("lbl_1_triple_barrier", f"WITH {BARRIER} SELECT e.date, e.key, e.k::INT AS days, CASE WHEN t = 0 THEN 'time' WHEN up THEN 'up' ELSE 'down' END AS hit, {R('c / e.close - 1')} AS outcome, CASE WHEN t = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM e JOIN h ON e.date = h.date AND e.key = h.key AND e.k = h.k WHERE later = 6 AND e.sigma <> 0")
def lbl_1(spark, d):
    return barriers(spark, d, False).select("date", "key", "days", "hit", tidy("outcome").alias("outcome"), "weight")


@query("lbl_2_event_barrier", f"WITH {BARRIER} SELECT e.date, e.key, (t > 0 AND dn)::INT AS meta, CASE WHEN t = 0 THEN sign(c / e.close - 1) WHEN up THEN 1 ELSE -1 END::INT AS side FROM e JOIN h ON e.date = h.date AND e.key = h.key AND e.k = h.k WHERE day(e.date) <= 7")
def lbl_2(spark, d):
    events = barriers(spark, d, True).where(F.day("date") <= 7)
    side = F.when(F.col("hit") == "time", F.signum("outcome")).when(F.col("hit") == "up", 1).otherwise(-1)
    return events.select("date", "key", (F.col("hit") == "down").cast("int").alias("meta"), side.cast("int").alias("side"))


FORM = f"""{RT}, j AS (SELECT rt.date, key, ret, market, volume FROM rt JOIN mr USING (date)),
fm AS (SELECT *, count(ret) OVER f AS c, exp(sum(ln(1 + ret)) OVER f) - 1 AS formation, avg((ret > 0)::INT) OVER f - avg((ret < 0)::INT) OVER f AS ud, sum(CASE WHEN ret > 0 THEN volume ELSE 0 END) OVER f - sum(CASE WHEN ret < 0 THEN volume ELSE 0 END) OVER f AS sv, sum(CASE WHEN ret IS NOT NULL THEN volume END) OVER f AS tv,
  regr_count(ret, market) OVER f AS n, regr_sxx(ret, market) OVER f AS sxx, regr_syy(ret, market) OVER f AS syy, regr_sxy(ret, market) OVER f AS sxy, regr_avgx(ret, market) OVER f AS mx, regr_intercept(ret, market) OVER f AS a,
  regr_slope(CASE WHEN market < 0 THEN ret END, CASE WHEN market < 0 THEN market END) OVER f AS b_dn, regr_slope(CASE WHEN market > 0 THEN ret END, CASE WHEN market > 0 THEN market END) OVER f AS b_up FROM j WINDOW f AS ({K} ROWS BETWEEN 27 PRECEDING AND 2 PRECEDING))"""


def formed(spark, d):
    return L.formation_features(returns(spark, d), 26, 2, 20)


@query("lbl_3_alpha_t", f"WITH {FORM} SELECT date, key, {R('CASE WHEN c >= 20 THEN a / nullif(sqrt(greatest(0, syy - sxy * sxy / nullif(sxx, 0)) / nullif(n - 2, 0) * (1.0 / n + mx * mx / nullif(sxx, 0))), 0) END', 6)} AS f1 FROM fm")
def lbl_3(spark, d):
    return formed(spark, d).select("date", "key", tidy("f1", 6).alias("f1"))


@query("lbl_4_discreteness", f"WITH {FORM} SELECT date, key, {R('CASE WHEN c >= 20 THEN sign(formation) * ud END', 8)} AS f2 FROM fm")
def lbl_4(spark, d):
    return formed(spark, d).select("date", "key", tidy("f2", 8).alias("f2"))


@query("lbl_5_sector_momentum", f"WITH {FORM} SELECT date, key, {R('avg(CASE WHEN c >= 20 THEN formation END) OVER (PARTITION BY date, right(key, 1))', 8)} AS f3 FROM fm")
def lbl_5(spark, d):
    sector = F.right("key", F.lit(1))
    return formed(spark, d).withColumn("s", sector).select("date", "key", tidy(F.avg("formation").over(Window.partitionBy("date", "s")), 8).alias("f3"))


@query("lbl_6_volume_agreement", f"WITH {FORM} SELECT date, key, {R('CASE WHEN c >= 20 THEN sv::DOUBLE / nullif(tv, 0) END')} AS f4 FROM fm")
def lbl_6(spark, d):
    return formed(spark, d).select("date", "key", tidy("f4").alias("f4"))


@query("lbl_7_downside_beta", f"WITH {FORM} SELECT date, key, {R('CASE WHEN c >= 20 THEN -(b_dn - b_up) END', 5)} AS f5 FROM fm")
def lbl_7(spark, d):
    return formed(spark, d).select("date", "key", tidy("f5", 5).alias("f5"))


@query("lbl_8_composite", f"""WITH {FORM}, v AS (SELECT date, key, CASE WHEN c >= 20 THEN formation END AS a, CASE WHEN c >= 20 THEN sign(formation) * ud END AS b, CASE WHEN c >= 20 THEN sv::DOUBLE / nullif(tv, 0) END AS e FROM fm),
z AS (SELECT date, key, (a - avg(a) OVER p) / nullif(stddev_pop(a) OVER p, 0) AS a, (b - avg(b) OVER p) / nullif(stddev_pop(b) OVER p, 0) AS b, (e - avg(e) OVER p) / nullif(stddev_pop(e) OVER p, 0) AS e FROM v WINDOW p AS (PARTITION BY date)),
l AS (SELECT date, key, unnest([a, b, e]) AS z FROM z) SELECT date, key, {R('CASE WHEN count(z) >= 2 THEN avg(z) END', 7)} AS score, count(z)::BIGINT AS used FROM l GROUP BY 1, 2""")
def lbl_8(spark, d):
    return L.composite(formed(spark, d), ["formation", "f2", "f4"], 2).select("date", "key", tidy("score", 7).alias("score"), "used")


@query("lbl_9_momentum_panel", f"WITH {FORM} SELECT date, count(*) FILTER (c >= 20)::BIGINT AS names, {R('avg(formation) FILTER (c >= 20)', 8)} AS mean FROM fm GROUP BY 1 HAVING count(*) FILTER (c >= 20) >= 10")
def lbl_9(spark, d):
    return formed(spark, d).groupBy("date").agg(F.count("formation").alias("names"), tidy(F.avg("formation"), 8).alias("mean")).where("names >= 10")


@query("lbl_10_factor_arms", f"""WITH {RT}, a AS (SELECT date, key, close / lag(close, 8) OVER ({K}) - 1 AS mom, CASE WHEN count(ret) OVER f = 10 THEN stddev_samp(ret) OVER f END AS vol FROM rt WINDOW f AS ({K} ROWS 9 PRECEDING)), g AS (SELECT *, median(vol) OVER (PARTITION BY date) AS mv FROM a WHERE mom IS NOT NULL AND vol > 0)
SELECT date, key, 'scaled' AS arm, {R('mom / vol', 7)} AS score FROM g UNION ALL SELECT date, key, 'gated', {R('CASE WHEN vol <= mv THEN mom END', 7)} FROM g UNION ALL SELECT date, key, 'conditional', {R('CASE WHEN vol <= mv THEN mom ELSE -mom END', 7)} FROM g""")
def lbl_10(spark, d):
    w = L.by_key()
    f = brand_bars(spark, d).withColumn("ret", L.change("close", 1, w)).withColumns({"mom": L.change("close", 8, w), "vol": L.full(F.stddev_samp("ret"), F.col("ret"), w, 10)})
    g = f.where("mom is not null and vol > 0").withColumn("mv", F.median("vol").over(Window.partitionBy("date")))
    calm = F.col("vol") <= F.col("mv")
    arms = g.select("date", "key", tidy(F.col("mom") / F.col("vol"), 7).alias("scaled"), tidy(F.when(calm, F.col("mom")), 7).alias("gated"), tidy(F.when(calm, F.col("mom")).otherwise(-F.col("mom")), 7).alias("conditional"))
    return arms.unpivot(["date", "key"], ["scaled", "gated", "conditional"], "arm", "score")


@query("lbl_11_orthogonal", f"""WITH {SM}, r AS (SELECT date, key, {avg_rank_sql('x2', 'date')} AS s, {avg_rank_sql('close', 'date')} AS b FROM sm) SELECT date, key, {R('s - regr_slope(s, b) OVER (PARTITION BY date) * b', 7)} AS resid FROM r""")
def lbl_11(spark, d):
    r = supplier_month(spark, d).select("date", "key", avg_rank("x2", "date").alias("s"), avg_rank("close", "date").alias("b"))
    beta = F.regr_slope("s", "b").over(Window.partitionBy("date"))
    return r.select("date", "key", tidy(F.col("s") - beta * F.col("b"), 7).alias("resid"))


# Calendars


@query("dt_1_business_add", f"SELECT o_orderkey, {add_bd_sql('d', 7)} AS ahead FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def dt_1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.business_day_add(F.to_date("o_orderdate"), 7).alias("ahead"))


@query("dt_2_business_between", """WITH l AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 40)::INT AS b FROM orders)
SELECT o_orderkey, (SELECT count(*) FROM generate_series(0, (b - a) - 1) g(i) WHERE isodow(a + i::INT) <= 5)::BIGINT AS days FROM l""")
def dt_2(spark, d):
    a = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", S.business_days_between(a, F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))).alias("days"))


@query("dt_3_nth_trading_day", """WITH a AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)), o AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)
SELECT o.date, b.date AS later, a.date IS NULL AS off_axis FROM o LEFT JOIN a ON a.date = o.date LEFT JOIN a b ON b.pos = a.pos + 10""")
def dt_3(spark, d):
    axis = X.date_axis(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))).select("date", "pos")
    later = axis.select(F.col("date").alias("later"), (F.col("pos") - 10).alias("pos"))
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return dates.join(axis, "date", "left").join(later, "pos", "left").select("date", "later", F.col("pos").isNull().alias("off_axis"))


@query("dt_4_session_close", """SELECT DISTINCT o_orderdate::DATE AS date, (o_orderdate::DATE + CASE WHEN day(o_orderdate) = 24 THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS close FROM orders""")
def dt_4(spark, d):
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    hour = F.when(F.day("date") == 24, 13).otherwise(16)
    local = F.make_timestamp(F.year("date"), F.month("date"), F.day("date"), hour, F.lit(0), F.lit(0))
    return dates.select("date", F.to_utc_timestamp(local, "America/New_York").cast("timestamp_ntz").alias("close"))


@query("dt_5_parse_timestamps", """WITH s AS (SELECT event_id, ts, event_id % 3 AS k FROM events) SELECT event_id, CASE WHEN k <> 2 THEN date_trunc('second', ts) END AS parsed, k = 0 AS zoned FROM s""")
def dt_5(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("soon"))
    s = table(spark, d, "events").select("event_id", text.alias("t"))
    return s.select("event_id", F.try_to_timestamp("t").cast("timestamp_ntz").alias("parsed"), F.col("t").rlike(r"(Z|[+-]\d\d:?\d\d)$").alias("zoned"))


@query("dt_6_utc_day", "SELECT event_id, ts::DATE AS day, ts::DATE + 3 AS later FROM events")
def dt_6(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.date_add(F.to_date("ts"), 3).alias("later"))


# Splits

AX = f"{SM}, ax AS (SELECT date, row_number() OVER (ORDER BY date)::INT AS pos, ntile(6) OVER (ORDER BY date) - 1 AS fold FROM (SELECT DISTINCT date FROM sm)), fo AS (SELECT fold, min(pos) AS first, max(pos) AS last, min(pos) - 4 AS train_last FROM ax WHERE fold > 0 GROUP BY 1 HAVING min(pos) - 4 >= 20)"


@query("wf_1_expanding_folds", f"WITH {AX} SELECT fold::INT AS fold, CASE WHEN pos <= train_last THEN 'train' ELSE 'val' END AS part, count(*)::BIGINT AS n, min(sm.date) AS a, max(sm.date) AS b FROM sm JOIN ax USING (date) JOIN fo ON pos <= train_last OR pos BETWEEN first AND last WHERE true GROUP BY fo.fold, 2 ORDER BY 1".replace("SELECT fold::INT", "SELECT fo.fold::INT"))
def wf_1(spark, d):
    panel = supplier_month(spark, d).select("date", "key")
    rows = W.fold_rows(panel, W.expanding_folds(panel, 5, 3))
    return rows.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))


@query("wf_2_cut_labels", f"WITH {BW} SELECT CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= {add_bd_sql(chr(68) + 'ATE ' + chr(39) + '1998-06-30' + chr(39), 20)} THEN 'embargo' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS split, count(*)::BIGINT AS n FROM bw GROUP BY 1")
def wf_2(spark, d):
    label = W.cut_label(F.col("date"), "1998-06-30", "1999-12-31", 20)
    return brand_bars(spark, d).groupBy(label.alias("split")).agg(F.count("*").alias("n"))


@query("wf_3_leakage", f"""WITH {BW}, s AS (SELECT c.cut, date, CASE WHEN date <= c.e THEN 'train' WHEN date > c.e + c.g THEN 'val' END AS split FROM bw, (VALUES ('tight', DATE '1998-06-30', 7), ('wide', DATE '1998-06-30', 60)) c(cut, e, g)),
m AS (SELECT cut, max(date) FILTER (split = 'train') AS a, min(date) FILTER (split = 'val') AS b FROM s GROUP BY 1), n AS (SELECT *, (SELECT count(*) FROM generate_series(0, (b - a) - 1) g(i) WHERE isodow(a + i::INT) <= 5)::BIGINT AS margin FROM m)
SELECT cut, a AS train_end, b AS val_start, margin, margin <= 20 AS violation FROM n""")
def wf_3(spark, d):
    cuts = F.explode(F.array(F.struct(F.lit("tight").alias("cut"), F.lit(7).alias("gap")), F.struct(F.lit("wide").alias("cut"), F.lit(60).alias("gap"))))
    end = F.lit("1998-06-30").cast("date")
    long = brand_bars(spark, d).select("date", cuts.alias("c")).select("date", "c.*")
    return W.leakage(long.withColumn("split", F.when(F.col("date") <= end, "train").when(F.col("date") > F.date_add(end, F.col("gap")), "val")), 20)


@query("wf_4_effective_cutoff", f"WITH {AX} SELECT fo.fold::INT AS fold, max(date) AS effective FROM fo JOIN ax ON pos <= train_last GROUP BY 1")
def wf_4(spark, d):
    panel = supplier_month(spark, d).select("date", "key")
    rows = W.fold_rows(panel, W.expanding_folds(panel, 5, 3))
    return rows.where("part = 'train'").groupBy("fold").agg(F.max("date").alias("effective"))


@query("wf_5_cutoff_ladder", "WITH b AS (SELECT min(o_orderdate)::DATE AS b FROM orders), s AS (SELECT DISTINCT date_diff('day', b, o_orderdate::DATE) // 90 AS step FROM orders, b), c AS (SELECT (b + (step * 90)::INT)::DATE AS cutoff FROM s, b UNION ALL SELECT (b + 400)::DATE FROM b UNION ALL SELECT (b + 180)::DATE FROM b), g AS (SELECT cutoff, (cutoff - lag(cutoff) OVER (ORDER BY cutoff))::INT AS gap FROM c) SELECT cutoff, gap, CASE WHEN gap = 0 THEN 'duplicate' WHEN gap <> 90 THEN 'uneven' END AS problem FROM g")
def wf_5(spark, d):
    """A ladder of every 90 days with an order, with one cutoff twice and one out of step."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    begin = days.agg(F.min("date").alias("b"))
    steps = days.join(F.broadcast(begin)).select(F.expr("date_add(b, cast(floor(datediff(date, b) / 90) * 90 as int))").alias("cutoff")).distinct()
    return W.ladder_checks(steps.union(begin.select(F.date_add("b", 400))).union(begin.select(F.date_add("b", 180))))


@query("wf_5_backward", "WITH f AS (SELECT min(o_orderdate)::DATE AS t, min(o_orderdate) FILTER (year(o_orderdate) >= 1997)::DATE AS first FROM orders) SELECT (first - (k * 90)::INT)::DATE AS cutoff FROM f, LATERAL (SELECT unnest(range(1, (first - t)::BIGINT // 90 + 1)) AS k)")
def wf_5_back(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    late = days.where(F.year("date") >= 1997).select(F.col("date").alias("cutoff"))
    return W.extend_ladder(late, days.agg(F.min("date").alias("target")), 90)


@query("wf_6_three_way", f"WITH {SM} SELECT CASE WHEN date < DATE '1999-06-01' - 180 THEN 'train' WHEN date < DATE '1999-06-01' THEN 'val' ELSE 'test' END AS split, count(*)::BIGINT AS n, count(DISTINCT key)::BIGINT AS keys FROM sm GROUP BY 1")
def wf_6(spark, d):
    end = F.lit("1999-06-01").cast("date")
    split = F.when(F.col("date") < F.date_sub(end, 180), "train").when(F.col("date") < end, "val").otherwise("test")
    return supplier_month(spark, d).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("wf_7_purged_folds", """WITH e AS (SELECT o_orderkey, o_orderdate::DATE AS date FROM orders), f AS (SELECT date, (ntile(5) OVER (ORDER BY date) - 1)::INT AS fold FROM (SELECT DISTINCT date FROM e)), s AS (SELECT fold, min(date) AS a, max(date) AS b FROM f GROUP BY 1)
SELECT s.fold, CASE WHEN f.fold = s.fold THEN 'val' ELSE 'train' END AS part, count(*)::BIGINT AS n FROM e JOIN f USING (date) JOIN s ON f.fold = s.fold OR date + 20 < s.a OR date > s.b + 25 GROUP BY 1, 2""")
def wf_7(spark, d):
    events = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return W.purged_folds(events, 5, 20, 5).groupBy("fold", "part").agg(F.count("*").alias("n"))
