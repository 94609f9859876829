"""Queries of metrics over scores and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import avg_rank, correlation, tidy
from ..operators import cross_section as X
from ..operators import metrics as M
from .join_queries import MODELS, models, orders
from .panels import BW, SM, UD, R, avg_rank_sql, brand_bars, corr_sql, supplier_month, table, user_day
from .registry import query

WITH = "WITH " + SM
IC = f"""{SM}, rk AS (SELECT date, {avg_rank_sql('x2', 'date')} AS a, {avg_rank_sql('y', 'date')} AS b FROM sm WHERE y IS NOT NULL),
ics AS (SELECT date, count(*)::BIGINT AS n, CASE WHEN count(*) >= 5 THEN {corr_sql('a', 'b')} END AS ic FROM rk GROUP BY date)"""


def ics(spark, d):
    return M.rank_ic(supplier_month(spark, d), "x2", "y", min_names=5)


@query("agg_1_rank_ic", f"WITH {IC} SELECT date, n, {R('ic')} AS ic FROM ics")
def agg_1(spark, d):
    return ics(spark, d).select("date", "n", tidy("ic").alias("ic"))


@query("agg_2_moment_ic", f"WITH {IC} SELECT date, {R('ic', 8)} AS ic FROM ics")
def agg_2(spark, d):
    panel = supplier_month(spark, d).where("y is not null")
    ranked = panel.select("date", (avg_rank("x2", "date") / F.count("*").over(Window.partitionBy("date"))).alias("a"), (avg_rank("y", "date") / F.count("*").over(Window.partitionBy("date"))).alias("b"))
    n, s = F.count("*"), F.sum
    top = n * s(F.col("a") * F.col("b")) - s("a") * s("b")
    low = F.sqrt((n * s(F.col("a") * F.col("a")) - s("a") * s("a")) * (n * s(F.col("b") * F.col("b")) - s("b") * s("b")))
    return ranked.groupBy("date").agg(F.when(n >= 5, tidy(top / F.nullif(low, F.lit(0.0)), 8)).alias("ic"))


SPREAD = """tp AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key) AS dn, row_number() OVER (PARTITION BY date ORDER BY x2, key DESC) AS up, greatest(1, round_even(0.1 * count(*) OVER (PARTITION BY date), 0)) AS k FROM sm WHERE y IS NOT NULL)"""


@query("agg_3_top_spread", f"{WITH}, {SPREAD} SELECT date, {R('avg(y) FILTER (dn <= k) - avg(y) FILTER (dn > k)')} AS rest, {R('avg(y) FILTER (dn <= k) - avg(y) FILTER (up <= k)')} AS bottom FROM tp GROUP BY date")
def agg_3(spark, d):
    panel = supplier_month(spark, d)
    rest = M.top_spread(panel, "x2", "y").select("date", tidy("spread").alias("rest"))
    return rest.join(M.top_spread(panel, "x2", "y", versus="bottom").select("date", tidy("spread").alias("bottom")), "date")


@query("agg_4_top_n_excess", f"{WITH}, t AS (SELECT *, least(greatest(y, -0.5), 0.5) AS c, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key) AS dn FROM sm WHERE y IS NOT NULL) SELECT date, {R('avg(c) FILTER (dn <= 5) - avg(c)')} AS excess FROM t GROUP BY date")
def agg_4(spark, d):
    clipped = supplier_month(spark, d).where("y is not null").withColumn("c", F.least(F.greatest("y", F.lit(-0.5)), F.lit(0.5)))
    placed = clipped.withColumn("p", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("x2"), "key")))
    return placed.groupBy("date").agg(tidy(F.avg(F.when(F.col("p") <= 5, F.col("c"))) - F.avg("c")).alias("excess"))


@query("agg_5_hit_rate", f"{WITH}, {SPREAD} SELECT date, {R('avg((y > 0)::INT) FILTER (dn <= k)')} AS hit_rate FROM tp GROUP BY date")
def agg_5(spark, d):
    return M.top_spread(supplier_month(spark, d), "x2", "y").select("date", tidy("hit_rate").alias("hit_rate"))


@query("agg_6_ic_summary", f"WITH {IC} SELECT count(*)::BIGINT AS n, {R('avg(ic)', 8)} AS mean, {R('stddev_samp(ic)', 8)} AS std, {R('median(ic)', 8)} AS median, {R('avg((ic > 0)::INT)')} AS positive, {R('min(ic)', 8)} AS worst FROM ics WHERE ic IS NOT NULL")
def agg_6(spark, d):
    out = M.series_summary(ics(spark, d), "ic")
    return out.select("n", *[tidy(c, 8).alias(c) for c in ("mean", "std", "median")], tidy("positive").alias("positive"), tidy("worst", 8).alias("worst"))


@query("agg_7_ic_by_regime", f"""WITH {IC}, g AS (SELECT CASE WHEN month(date) <= 6 THEN 'CALM' ELSE 'VOLATILE' END AS regime, ic FROM ics WHERE ic IS NOT NULL)
SELECT coalesce(regime, 'ALL') AS regime, count(*)::BIGINT AS n, {R('avg(ic)', 8)} AS mean FROM g GROUP BY GROUPING SETS ((regime), ())""")
def agg_7(spark, d):
    series = ics(spark, d).where("ic is not null").withColumn("regime", F.when(F.month("date") <= 6, "CALM").otherwise("VOLATILE"))
    return series.rollup("regime").agg(F.count("*").alias("n"), tidy(F.avg("ic"), 8).alias("mean")).withColumn("regime", F.coalesce("regime", F.lit("ALL")))


CONF = "cf AS (SELECT (key % 5)::BIGINT AS config, (key % 3)::BIGINT AS cut, avg(x2) - 25 AS m FROM sm GROUP BY 1, 2)"


@query("agg_8_by_config", f"""{WITH}, {CONF}, a AS (SELECT config, count(*)::BIGINT AS n, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS se, count(*) FILTER (m > 0)::BIGINT AS positive, min(m) AS worst FROM cf GROUP BY 1)
SELECT config, n, {R('mean', 8)} AS mean, {R('se', 8)} AS se, positive, {R('worst', 8)} AS worst, {R('mean - (SELECT mean FROM a WHERE config = 0)', 8)} AS delta FROM a""")
def agg_8(spark, d):
    cells = supplier_month(spark, d).groupBy((F.col("key") % 5).alias("config"), (F.col("key") % 3).alias("cut")).agg((F.avg("x2") - 25).alias("m"))
    by_config = cells.groupBy("config").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"), F.count(F.when(F.col("m") > 0, 1)).alias("positive"), F.min("m").alias("worst"))
    base = by_config.where("config = 0").select(F.col("mean").alias("_base"))
    return by_config.join(F.broadcast(base)).select("config", "n", tidy("mean", 8).alias("mean"), tidy("se", 8).alias("se"), "positive", tidy("worst", 8).alias("worst"), tidy(F.col("mean") - F.col("_base"), 8).alias("delta"))


@query("agg_9_completeness", """WITH r AS (SELECT DISTINCT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'completed' ELSE 'failed' END AS status FROM orders GROUP BY 1), j AS (SELECT status FROM customer LEFT JOIN r ON c_custkey = o_custkey)
SELECT count(*)::BIGINT AS planned, count(*) FILTER (status = 'completed')::BIGINT AS completed, count(*) FILTER (status = 'failed')::BIGINT AS failed, count(*) FILTER (status IS NULL)::BIGINT AS missing, round(count(*) FILTER (status = 'failed') / count(*)::DOUBLE, 9) AS failure_ratio FROM j""")
def agg_9(spark, d):
    done = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "F"), "completed").otherwise("failed").alias("status"))
    return M.completeness(table(spark, d, "customer"), done, ["c_custkey"]).withColumn("failure_ratio", F.round("failure_ratio", 9))


@query("agg_10_pooled_rank", """WITH c AS (SELECT value, (event_id * 7919 % 1000)::DOUBLE AS z FROM events WHERE value IS NOT NULL),
k AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS b FROM c)
SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 8) AS rho, count(*)::BIGINT AS n FROM k""")
def agg_10(spark, d):
    events = table(spark, d, "events").where("value is not null").select("value", (F.col("event_id") * 7919 % 1000).cast("double").alias("z"))
    return M.pooled_rank_correlation(events, "value", "z").select(F.round("rho", 8).alias("rho"), "n")


@query("agg_11_label_scale", f"""{WITH}, b AS (SELECT date, stddev_samp(y) AS sd FROM sm WHERE y IS NOT NULL GROUP BY 1), s AS (SELECT avg(sd) AS mean_sd, median(sd) AS median_sd FROM b)
SELECT count(*)::BIGINT AS n, {R('avg(y)', 8)} AS mean, {R('stddev_samp(y)', 8)} AS std, {R('min(y)')} AS low, {R('max(y)')} AS high, {R('avg((abs(y) > 0.2)::INT)')} AS share_large,
{R('any_value(mean_sd)', 8)} AS mean_sd, {R('any_value(median_sd)', 8)} AS median_sd, any_value(median_sd BETWEEN 0.8 AND 1.2) AS standardised FROM sm, s WHERE y IS NOT NULL""")
def agg_11(spark, d):
    out = M.scale_diagnostics(supplier_month(spark, d), "y")
    return out.select("n", *[tidy(c, 8).alias(c) for c in ("mean", "std", "mean_sd", "median_sd")], *[tidy(c).alias(c) for c in ("low", "high", "share_large")], "standardised")


@query("agg_12_z_contract", f"""{WITH}, z AS (SELECT date, x2 - 25 AS v FROM sm), b AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM z GROUP BY date HAVING stddev_samp(v) IS NOT NULL)
SELECT count(*)::BIGINT AS dates, count(*) FILTER (abs(m) <= 0.5)::BIGINT AS mean_ok, count(*) FILTER (abs(s - 1) <= 0.5)::BIGINT AS std_ok, {R('max(abs(m))', 8)} AS worst_mean, {R('max(abs(s - 1))', 8)} AS worst_std FROM b""")
def agg_12(spark, d):
    out = M.z_contract(supplier_month(spark, d).withColumn("v", F.col("x2") - 25), "v", 0.5)
    return out.select("dates", "mean_ok", "std_ok", tidy("worst_mean", 8).alias("worst_mean"), tidy("worst_std", 8).alias("worst_std"))


@query("agg_13_daily_sentiment", """WITH a AS (SELECT event_type AS symbol, ts::DATE AS date, round(value / 25 - 1, 4) AS s FROM events)
SELECT symbol, date, round(avg(s), 8) + 0.0 AS mean, round(coalesce(stddev_samp(s), 0), 8) + 0.0 AS dispersion, count(*)::BIGINT AS n, round(avg((s > 0.2)::INT), 9) AS positive, round(avg((s < -0.2)::INT), 9) AS negative FROM a GROUP BY 1, 2""")
def agg_13(spark, d):
    articles = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.round(F.col("value") / 25 - 1, 4).alias("sentiment"))
    out = M.daily_sentiment(articles)
    return out.select("symbol", "date", tidy("mean", 8).alias("mean"), tidy("dispersion", 8).alias("dispersion"), "n", F.round("positive", 9).alias("positive"), F.round("negative", 9).alias("negative"))


@query("agg_14_score_sanity", "SELECT count(*)::BIGINT AS n, round(avg((s = 0)::INT), 9) AS zero, round(avg((abs(s) >= 1)::INT), 9) AS saturated, 'ok' AS verdict FROM (SELECT greatest(-1, least(1, value / 25 - 1)) AS s FROM events) WHERE s IS NOT NULL")
def agg_14(spark, d):
    out = M.score_sanity(table(spark, d, "events").select(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 25 - 1)).alias("s")), "s")
    return out.select("n", F.round("zero", 9).alias("zero"), F.round("saturated", 9).alias("saturated"), "verdict")


@query("agg_15_split_statistics", f"""{WITH} SELECT CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split, count(*)::BIGINT AS n, count(DISTINCT date)::BIGINT AS days, min(date) AS first, max(date) AS last FROM sm GROUP BY 1""")
def agg_15(spark, d):
    split = F.when(F.col("date") < "1999-01-01", "train").when(F.col("date") < "2000-01-01", "val").otherwise("test")
    return supplier_month(spark, d).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("agg_16_winsor_bounds", f"{WITH} SELECT {R('quantile_cont(y, 0.005)')} AS low, {R('quantile_cont(y, 0.995)')} AS high FROM sm WHERE y IS NOT NULL AND date < DATE '1999-01-01'")
def agg_16(spark, d):
    train = supplier_month(spark, d).where("y is not null and date < date'1999-01-01'")
    return M.quantile_row(train, "y", {"low": 0.005, "high": 0.995}).select(tidy("low").alias("low"), tidy("high").alias("high"))


@query("agg_17_decision_window", """WITH t AS (SELECT value > 25 AS a, event_id % 3 = 0 AS b FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15')
SELECT count(*)::BIGINT AS n, round(avg((a = b)::INT), 9) AS agreement, count(*) FILTER (a AND NOT b)::BIGINT AS only_a, count(*) FILTER (b AND NOT a)::BIGINT AS only_b FROM t""")
def agg_17(spark, d):
    t = table(spark, d, "events").where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-15'").select((F.col("value") > 25).alias("a"), (F.col("event_id") % 3 == 0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.agg(F.count("*").alias("n"), F.round(F.avg((a == b).cast("int")), 9).alias("agreement"), F.count(F.when(a & ~b, 1)).alias("only_a"), F.count(F.when(b & ~a, 1)).alias("only_b"))


LADDER = f"""{SM}, lp AS (SELECT names, rep, date, x2, y FROM (SELECT *, row_number() OVER (PARTITION BY date, names, rep ORDER BY md5(date || '|' || key || '|' || names || '|' || rep), key) AS k FROM sm, (SELECT unnest([5, 10, 20]) AS names), (SELECT unnest(range(0, 4)) AS rep) WHERE y IS NOT NULL) WHERE k <= names),
lk AS (SELECT names, rep, date, rank() OVER (PARTITION BY names, rep, date ORDER BY x2) + (count(*) OVER (PARTITION BY names, rep, date, x2) - 1) / 2.0 AS a, rank() OVER (PARTITION BY names, rep, date ORDER BY y) + (count(*) OVER (PARTITION BY names, rep, date, y) - 1) / 2.0 AS b FROM lp),
lc AS (SELECT names, rep, date, CASE WHEN count(*) >= 2 THEN {corr_sql('a', 'b')} END AS ic FROM lk GROUP BY 1, 2, 3), la AS (SELECT names, avg(v) AS variance FROM (SELECT names, rep, var_samp(ic) AS v FROM lc GROUP BY 1, 2) GROUP BY 1)"""


def ladder(spark, d):
    return M.breadth_ladder(supplier_month(spark, d).where("y is not null"), "x2", "y", [5, 10, 20], 4)


@query("agg_18_breadth_ladder", f"WITH {LADDER} SELECT names::INT AS names, {R('variance', 8)} AS variance FROM la")
def agg_18(spark, d):
    return ladder(spark, d).select("names", tidy("variance", 8).alias("variance"))


@query("agg_18_breadth_fit", f"WITH {LADDER} SELECT {R('regr_intercept(variance, 1.0 / names)', 6)} AS a, {R('regr_slope(variance, 1.0 / names)', 6)} AS b FROM la")
def agg_18_fit(spark, d):
    return M.breadth_fit(ladder(spark, d)).select(tidy("a", 6).alias("a"), tidy("b", 6).alias("b"))


VOTES = f"""{SM}, {MODELS}, k AS (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY score DESC, key) AS rn, greatest(1, round_even(0.1 * count(*) OVER (PARTITION BY model, date), 0)) AS k FROM ms),
v AS (SELECT date, key, count(*)::BIGINT AS votes FROM k WHERE rn <= k GROUP BY 1, 2)"""


@query("agg_19_votes", f"WITH {VOTES} SELECT votes, count(*)::BIGINT AS names, sum(votes)::BIGINT AS slots FROM v GROUP BY 1")
def agg_19(spark, d):
    return M.votes(models(spark, d)).groupBy("votes").agg(F.count("*").alias("names"), F.sum("votes").alias("slots"))


DIV = f"""{SM}, {MODELS}, k AS (SELECT date, key, model, {avg_rank_sql('score', 'model, date')} AS r, (row_number() OVER (PARTITION BY model, date ORDER BY score DESC, key) <= 10)::INT AS t FROM ms),
p AS (SELECT a.model AS a, b.model AS b, a.date, {corr_sql('a.r', 'b.r')} AS rho, sum(a.t * b.t) / 10.0 AS overlap, avg((abs(a.r - b.r) >= 5)::INT) AS differ FROM k a JOIN k b ON a.date = b.date AND a.key = b.key AND a.model < b.model GROUP BY 1, 2, 3)"""


@query("agg_20_pair_divergence", f"WITH {DIV} SELECT a, b, {R('median(rho)', 8)} AS median_rho, {R('median(overlap)')} AS median_overlap, {R('min(overlap)')} AS least_overlap FROM p GROUP BY 1, 2")
def agg_20(spark, d):
    return M.pair_divergence(models(spark, d)).select("a", "b", tidy("median_rho", 8).alias("median_rho"), tidy("median_overlap").alias("median_overlap"), tidy("least_overlap").alias("least_overlap"))


@query("agg_21_complementarity", f"WITH {DIV} SELECT a, b, {R('avg(differ)', 8)} AS differ, CASE WHEN avg(rho) > 0.9 THEN 'REDUNDANT' ELSE 'DISTINCT' END AS verdict FROM p GROUP BY 1, 2")
def agg_21(spark, d):
    return M.pair_divergence(models(spark, d)).select("a", "b", tidy("differ", 8).alias("differ"), F.when(F.col("mean_rho") > 0.9, "REDUNDANT").otherwise("DISTINCT").alias("verdict"))


@query("agg_22_redundancy", f"WITH {DIV} SELECT a, b, {R('avg(rho)', 8)} AS mean_rho, {R('quantile_cont(rho, 0.05)', 8)} AS p5, {R('quantile_cont(rho, 0.95)', 8)} AS p95 FROM p GROUP BY 1, 2")
def agg_22(spark, d):
    return M.pair_divergence(models(spark, d)).select("a", "b", *[tidy(c, 8).alias(c) for c in ("mean_rho", "p5", "p95")])


@query("agg_26_field_variation", """WITH p AS (SELECT unnest(['event_type', 'k', 'user']) AS field, unnest([event_type, props::JSON->>'k', (user_id % 4)::VARCHAR]) AS v FROM events)
SELECT field, count(DISTINCT v)::BIGINT AS distinct_values, count(v)::BIGINT AS n, CASE WHEN count(DISTINCT v) <= 1 THEN 'constant' ELSE 'varying' END AS kind FROM p GROUP BY 1""")
def agg_26(spark, d):
    from ..operators.textjson import field_variation

    e = table(spark, d, "events").select(F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").alias("k"), (F.col("user_id") % 4).cast("string").alias("user"))).alias("doc"))
    return field_variation(e, "doc")


@query("agg_28_event_census", f"""WITH {BW}, v AS (SELECT key, date, CASE WHEN volume % 7 = 0 THEN NULL WHEN volume % 5 = 0 THEN 0 ELSE volume - 400 END AS e FROM bw)
SELECT count(*) FILTER (e IS NULL)::BIGINT AS nulls, count(*) FILTER (e = 0)::BIGINT AS zeros, count(*) FILTER (e < 0)::BIGINT AS negative, count(*) FILTER (e > 0)::BIGINT AS positive, round(quantile_cont(e, 0.5) FILTER (e > 0)::DOUBLE, 6) AS mid, round(quantile_cont(e, 0.9) FILTER (e > 0)::DOUBLE, 6) AS high FROM v""")
def agg_28(spark, d):
    v = brand_bars(spark, d).withColumn("e", F.when(F.col("volume") % 7 == 0, None).when(F.col("volume") % 5 == 0, 0).otherwise(F.col("volume") - 400))
    e = F.col("e")
    out = v.agg(F.count(F.when(e.isNull(), 1)).alias("nulls"), F.count(F.when(e == 0, 1)).alias("zeros"), F.count(F.when(e < 0, 1)).alias("negative"), F.count(F.when(e > 0, 1)).alias("positive"))
    q = M.quantile_row(v.where("e > 0"), "e", {"mid": 0.5, "high": 0.9})
    return out.join(F.broadcast(q)).select("nulls", "zeros", "negative", "positive", F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"))


@query("agg_29_truncation_probe", f"{WITH}, c AS (SELECT close, x1, x2 > 30 AS dropped FROM sm) SELECT {R('median(close) FILTER (dropped)', 4)} AS dropped, {R('median(close) FILTER (NOT dropped)', 4)} AS kept, {R('median(close) FILTER (dropped) / median(close) FILTER (NOT dropped)')} AS ratio, {R('avg(dropped::INT)')} AS share FROM c")
def agg_29(spark, d):
    panel = supplier_month(spark, d).withColumn("drop", F.col("x2") > 30)
    middle = M.exact_quantiles(panel, "close", [0.5], ("drop",))
    gone, kept = (F.max(F.when(c, F.col("q"))) for c in (F.col("drop"), ~F.col("drop")))
    share = panel.agg(F.avg(F.col("drop").cast("int")).alias("share"))
    return middle.agg(gone.alias("g"), kept.alias("k")).join(F.broadcast(share)).select(tidy("g", 4).alias("dropped"), tidy("k", 4).alias("kept"), tidy(F.col("g") / F.col("k")).alias("ratio"), tidy("share").alias("share"))


@query("agg_30_survivorship", f"WITH {UD} SELECT min(date) AS first, max(date) AS last, count(DISTINCT date)::BIGINT AS dates, count(DISTINCT key)::BIGINT AS keys, (SELECT count(DISTINCT key) FROM ud WHERE date = (SELECT max(date) FROM ud))::BIGINT AS final_keys, (SELECT count(DISTINCT key) FROM ud WHERE key NOT IN (SELECT key FROM ud WHERE date = (SELECT max(date) FROM ud)))::BIGINT AS departed FROM ud")
def agg_30(spark, d):
    cells = user_day(spark, d)
    end = cells.agg(F.max("date").alias("_last"))
    by_key = cells.groupBy("key").agg(F.max("date").alias("_m"), F.min("date").alias("_f"))
    keys = by_key.join(F.broadcast(end)).agg(F.min("_f").alias("first"), F.max("_m").alias("last"), F.count("*").alias("keys"), F.count(F.when(F.col("_m") == F.col("_last"), 1)).alias("final_keys"), F.count(F.when(F.col("_m") < F.col("_last"), 1)).alias("departed"))
    return keys.join(F.broadcast(cells.agg(F.countDistinct("date").alias("dates")))).select("first", "last", "dates", "keys", "final_keys", "departed")


@query("agg_31_capacity", f"""{WITH}, a AS (SELECT date, count(*) FILTER (y IS NOT NULL) AS c FROM sm GROUP BY 1), f AS (SELECT unnest([5, 20, 95, 100]) AS floor)
SELECT floor::INT AS floor, count(*) FILTER (c >= floor)::BIGINT AS dates, max(date) FILTER (c >= floor) AS last, CASE WHEN count(*) FILTER (c >= floor) >= 24 THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS verdict FROM a, f GROUP BY 1""")
def agg_31(spark, d):
    counts = supplier_month(spark, d).groupBy("date").agg(F.count("y").alias("c"))
    grid = counts.select("date", "c", F.explode(F.array(*[F.lit(n) for n in (5, 20, 95, 100)])).alias("floor"))
    ok = F.col("c") >= F.col("floor")
    out = grid.groupBy("floor").agg(F.count(F.when(ok, 1)).alias("dates"), F.max(F.when(ok, F.col("date"))).alias("last"))
    return out.withColumn("verdict", F.when(F.col("dates") >= 24, "FEASIBLE").otherwise("INFEASIBLE"))


@query("agg_32_label_divergence", f"""{WITH}, j AS (SELECT date, abs(x1 - round(x1, 1)) AS e FROM sm) SELECT CASE WHEN e = 0 THEN 'equal' WHEN e <= 0.01 THEN 'small' WHEN e <= 0.04 THEN 'material' ELSE 'large' END AS bucket, count(*)::BIGINT AS n, min(date) AS first, max(date) AS last FROM j GROUP BY 1""")
def agg_32(spark, d):
    e = F.abs(F.col("x1") - F.round("x1", 1))
    bucket = F.when(e == 0, "equal").when(e <= 0.01, "small").when(e <= 0.04, "material").otherwise("large")
    return supplier_month(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("agg_33_coverage", f"""WITH {UD}, u AS (SELECT count(DISTINCT key) AS n FROM ud) SELECT date, count(*)::BIGINT AS scored, (any_value(u.n) - count(*))::BIGINT AS missing, (any_value(u.n) - count(*)) / any_value(u.n)::DOUBLE > 0.2 AS rejected FROM ud, u GROUP BY 1""")
def agg_33(spark, d):
    cells = user_day(spark, d)
    universe = cells.agg(F.countDistinct("key").alias("u"))
    by_date = cells.groupBy("date").agg(F.count("*").alias("scored")).join(F.broadcast(universe))
    return by_date.select("date", "scored", (F.col("u") - F.col("scored")).alias("missing"), ((F.col("u") - F.col("scored")) / F.col("u") > 0.2).alias("rejected"))


@query("agg_34_flat_region", """WITH c AS (SELECT p_brand, p_partkey AS x, p_size // 10 AS y FROM part), r AS (SELECT *, CASE WHEN y IS NOT DISTINCT FROM lag(y) OVER (PARTITION BY p_brand ORDER BY x) THEN 0 ELSE 1 END AS b FROM c),
s AS (SELECT *, sum(b) OVER (PARTITION BY p_brand ORDER BY x) AS run FROM r), g AS (SELECT p_brand, run, max(x) - min(x) AS span, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1, 2)
SELECT p_brand, round(max(span)::DOUBLE / nullif(max(hi) - min(lo), 0), 9) AS flat FROM g GROUP BY 1""")
def agg_34(spark, d):
    curve = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("x"), F.floor(F.col("p_size") / 10).alias("y"))
    return M.flat_run(curve, "x", "y", ("p_brand",)).select("p_brand", F.round("flat", 9).alias("flat"))


@query("agg_35_robustness", f"""WITH {IC}, o AS (SELECT ic, row_number() OVER (ORDER BY ic, date) AS u, row_number() OVER (ORDER BY ic DESC, date) AS d FROM ics WHERE ic IS NOT NULL)
SELECT {R('avg(ic)', 8)} AS mean, {R('avg(ic) FILTER (d > 10)', 8)} AS without_best, {R('avg(ic) FILTER (u > 10)', 8)} AS without_worst FROM o""")
def agg_35(spark, d):
    out = M.trimmed_mean(ics(spark, d).where("ic is not null"), "ic", 10)
    return out.select(*[tidy(c, 8).alias(c) for c in out.columns])


@query("agg_36_universe", f"{WITH} SELECT DISTINCT key FROM sm WHERE date = (SELECT max(date) FROM sm WHERE date <= DATE '1999-06-15')")
def agg_36(spark, d):
    panel = supplier_month(spark, d)
    last = panel.where("date <= date'1999-06-15'").agg(F.max("date").alias("date"))
    return panel.join(F.broadcast(last), "date", "left_semi").select("key").distinct()


@query("agg_39_threshold_sweep", """WITH s AS (SELECT value / 50 AS s, (event_type = 'error')::INT AS l FROM events), t AS (SELECT unnest([0.2, 0.4, 0.6]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (s >= threshold AND l = 1)::BIGINT AS tp, count(*) FILTER (s >= threshold AND l = 0)::BIGINT AS fp, count(*) FILTER (s < threshold AND l = 1)::BIGINT AS fn FROM s, t GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def agg_39(spark, d):
    scored = table(spark, d, "events").select((F.col("value") / 50).alias("s"), (F.col("event_type") == "error").cast("int").alias("l"))
    out = M.threshold_sweep(scored, "s", "l", [0.2, 0.4, 0.6])
    return out.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


AUC = """e AS (SELECT value / 50 AS s, (event_type = 'error')::INT AS l, (user_id % 4)::INT AS fold FROM events WHERE value IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS r FROM e)"""


@query("agg_39_auc_by_fold", f"WITH {AUC} SELECT fold, count(*)::BIGINT AS n, sum(l)::BIGINT AS positives, {R('(sum(r) FILTER (l = 1) - sum(l) * (sum(l) + 1) / 2.0) / nullif(sum(l) * (count(*) - sum(l)), 0)::DOUBLE', 8)} AS auc FROM k GROUP BY 1")
def agg_39_auc(spark, d):
    scored = table(spark, d, "events").where("value is not null").select((F.col("value") / 50).alias("s"), (F.col("event_type") == "error").cast("int").alias("l"), (F.col("user_id") % 4).cast("int").alias("fold"))
    return M.auc(scored, "s", "l").select("fold", "n", "positives", tidy("auc", 8).alias("auc"))


@query("agg_39_best_threshold", """WITH s AS (SELECT value / 50 AS s, (event_type = 'error')::INT AS l FROM events), t AS (SELECT unnest(range(6, 15)) / 20.0 AS threshold),
c AS (SELECT threshold, 2 * count(*) FILTER (s >= threshold AND l = 1) / nullif(2 * count(*) FILTER (s >= threshold AND l = 1) + count(*) FILTER (s >= threshold AND l = 0) + count(*) FILTER (s < threshold AND l = 1), 0)::DOUBLE AS f1 FROM s, t GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, round(f1, 9) AS f1 FROM c ORDER BY coalesce(f1, 0) DESC, threshold LIMIT 1""")
def agg_39_best(spark, d):
    scored = table(spark, d, "events").select((F.col("value") / 50).alias("s"), (F.col("event_type") == "error").cast("int").alias("l"))
    return M.best_threshold(M.threshold_sweep(scored, "s", "l", [k / 20 for k in range(6, 15)])).select("threshold", F.round("f1", 9).alias("f1"))


GAP = "sqrt(var_samp(v) FILTER (e) / count(v) FILTER (e) + var_samp(v) FILTER (NOT e) / count(v) FILTER (NOT e))"


@query("agg_40_event_gap", f"""{WITH}, q AS (SELECT key, n, y - avg(y) OVER (PARTITION BY date) AS q FROM sm WHERE y IS NOT NULL), g AS (SELECT q - avg(q) OVER (PARTITION BY key) AS v, n % 4 = 0 AS e FROM q)
SELECT count(v) FILTER (e)::BIGINT AS n_event, {R('avg(v) FILTER (e) - avg(v) FILTER (NOT e)', 8)} AS gap, {R(GAP, 8)} AS se, {R('(avg(v) FILTER (e) - avg(v) FILTER (NOT e)) / ' + GAP, 6)} AS t FROM g""")
def agg_40(spark, d):
    panel = supplier_month(spark, d).where("y is not null")
    out = M.welch_gap(M.two_way_demean(panel, "y"), "v", F.col("n") % 4 == 0)
    return out.select("n_event", tidy("gap", 8).alias("gap"), tidy("se", 8).alias("se"), tidy("t", 6).alias("t"))


@query("agg_41_cross_check", f"{WITH}, c AS (SELECT key, x1, round(x1, 1) AS v FROM sm) SELECT key, {R(corr_sql('x1', 'v'), 8)} AS rho, {R('avg(abs(x1 - v))', 8)} AS mean_diff, {R('max(abs(x1 - v))', 8)} AS max_diff FROM c GROUP BY 1")
def agg_41(spark, d):
    panel = supplier_month(spark, d).withColumn("v", F.round("x1", 1))
    gap = F.abs(F.col("x1") - F.col("v"))
    return panel.groupBy("key").agg(tidy(correlation("x1", "v"), 8).alias("rho"), tidy(F.avg(gap), 8).alias("mean_diff"), tidy(F.max(gap), 8).alias("max_diff"))


@query("agg_42_cagr", f"WITH {BW} SELECT key, {R('power(arg_max(close, date) / arg_min(close, date), 365.25 / date_diff(' + chr(39) + 'day' + chr(39) + ', min(date), max(date))) - 1', 8)} AS cagr FROM bw GROUP BY 1")
def agg_42(spark, d):
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    return brand_bars(spark, d).groupBy("key").agg(tidy(F.pow(F.max_by("close", "date") / F.min_by("close", "date"), 1 / years) - 1, 8).alias("cagr"))


@query("agg_43_regime_contract", f"""{WITH}, w AS (SELECT * FROM (VALUES ('w1', DATE '1996-01-01', DATE '1996-12-01', 'CALM'), ('w2', DATE '1997-07-01', DATE '1997-12-01', 'VOLATILE'), ('w3', DATE '1998-01-01', DATE '1998-08-01', 'VOLATILE')) v(name, a, b, want)),
r AS (SELECT DISTINCT date, CASE WHEN month(date) <= 6 THEN 'CALM' ELSE 'VOLATILE' END AS regime FROM sm), c AS (SELECT name, want, regime, count(*) AS n FROM w JOIN r ON date BETWEEN a AND b GROUP BY ALL)
SELECT name, arg_max(regime, (n, regime)) AS majority, arg_max(regime, (n, regime)) = any_value(want) AS ok FROM c GROUP BY 1""")
def agg_43(spark, d):
    named = spark.sql("select * from values ('w1', date'1996-01-01', date'1996-12-01', 'CALM'), ('w2', date'1997-07-01', date'1997-12-01', 'VOLATILE'), ('w3', date'1998-01-01', date'1998-08-01', 'VOLATILE') as v(name, a, b, want)")
    regimes = supplier_month(spark, d).select("date", F.when(F.month("date") <= 6, "CALM").otherwise("VOLATILE").alias("regime")).distinct()
    counts = regimes.join(F.broadcast(named), F.col("date").between(F.col("a"), F.col("b"))).groupBy("name", "want", "regime").agg(F.count("*").alias("n"))
    majority = F.max_by("regime", F.struct("n", "regime"))
    return counts.groupBy("name").agg(majority.alias("majority"), (majority == F.first("want")).alias("ok"))


@query("agg_44_series_check", f"WITH {IC}, s AS (SELECT date, avg(x1) AS v FROM sm WHERE month(date) <> 5 GROUP BY 1) SELECT count(*)::BIGINT AS n, {R('avg(ic)', 8)} AS mean_a, {R('avg(v)', 8)} AS mean_b, {R(corr_sql('ic', 'v'), 8)} AS rho FROM ics JOIN s USING (date) WHERE ic IS NOT NULL")
def agg_44(spark, d):
    other = supplier_month(spark, d).where(F.month("date") != 5).groupBy("date").agg(F.avg("x1").alias("v"))
    both = ics(spark, d).where("ic is not null").join(other, "date")
    return both.agg(F.count("*").alias("n"), tidy(F.avg("ic"), 8).alias("mean_a"), tidy(F.avg("v"), 8).alias("mean_b"), tidy(correlation("ic", "v"), 8).alias("rho"))


@query("agg_45_top_offenders", f"WITH {BW}, y AS (SELECT key, date, volume::DOUBLE / close AS yield FROM bw WHERE volume > 0) SELECT key, date, {R('yield')} AS yield FROM y ORDER BY yield DESC, key, date LIMIT 10")
def agg_45(spark, d):
    y = brand_bars(spark, d).where("volume > 0").withColumn("yield", F.col("volume") / F.col("close"))
    return y.orderBy(F.desc("yield"), "key", "date").limit(10).select("key", "date", tidy("yield").alias("yield"))


@query("agg_24_portfolio_return", f"""{WITH}, t AS (SELECT date, y, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key) AS rn FROM sm)
SELECT date, {R('CASE WHEN count(y) = count(*) THEN avg(y) END')} AS ret FROM t WHERE rn <= 5 GROUP BY 1""")
def agg_24(spark, d):
    top = X.top_n(supplier_month(spark, d), "x2", 5)
    return top.groupBy("date").agg(tidy(F.when(F.count("y") == F.count("*"), F.avg("y"))).alias("ret"))


@query("agg_23_portfolio_metrics", f"""{WITH}, t AS (SELECT date, y, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key) AS rn FROM sm), p AS (SELECT date, CASE WHEN count(y) = count(*) THEN avg(y) END AS r FROM t WHERE rn <= 5 GROUP BY 1)
SELECT count(r)::BIGINT AS n, (count(*) - count(r))::BIGINT AS excluded, {R('avg(r)', 8)} AS gross, {R('avg(r) - 0.001', 8)} AS net, {R('avg(r) / stddev_samp(r) * sqrt(12)', 8)} AS sharpe, {R('avg((r > 0)::INT)')} AS hit_rate FROM p""")
def agg_23(spark, d):
    r = F.col("r")
    series = X.top_n(supplier_month(spark, d), "x2", 5).groupBy("date").agg(F.when(F.count("y") == F.count("*"), F.avg("y")).alias("r"))
    return series.agg(F.count(r).alias("n"), (F.count("*") - F.count(r)).alias("excluded"), tidy(F.avg(r), 8).alias("gross"), tidy(F.avg(r) - 0.001, 8).alias("net"), tidy(F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(12)), 8).alias("sharpe"), tidy(F.avg((r > 0).cast("int"))).alias("hit_rate"))


@query("agg_23_mean_turnover", f"""{WITH}, t AS (SELECT date, key, y, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key) AS rn FROM sm), s AS (SELECT date, list(key) AS k FROM t WHERE rn <= 5 GROUP BY 1), g AS (SELECT date, k, lag(k) OVER (ORDER BY date) AS p FROM s),
u AS (SELECT (len(list_filter(k, lambda x: NOT list_contains(p, x))) + len(list_filter(p, lambda x: NOT list_contains(k, x)))) / 10.0::DOUBLE AS turnover FROM g WHERE p IS NOT NULL) SELECT count(*)::BIGINT AS pairs, {R('avg(turnover)', 8)} AS turnover, {R('max(turnover)', 8)} AS most FROM u""")
def agg_23_turnover(spark, d):
    """Mean and largest turnover between the top five of consecutive months."""
    from ..operators.rolling import turnover

    moved = turnover(X.top_n(supplier_month(spark, d), "x2", 5), 5).where("turnover is not null")
    return moved.agg(F.count("*").alias("pairs"), tidy(F.avg("turnover"), 8).alias("turnover"), tidy(F.max("turnover"), 8).alias("most"))


@query("agg_25_compound", f"{WITH} SELECT key, {R('product(1 + y) - 1', 8)} AS total FROM sm WHERE y IS NOT NULL GROUP BY 1")
def agg_25(spark, d):
    from ..functions.scalar import compound

    return supplier_month(spark, d).where("y is not null").groupBy("key").agg(tidy(compound("y"), 8).alias("total"))


@query("agg_27_recipe_match", """WITH c AS (SELECT p_partkey, p_brand = 'Brand#3' AS b, p_type = 'ECONOMY' AS t, p_size <= 25 AS s FROM part)
SELECT concat_ws(',', CASE WHEN NOT b THEN 'brand' END, CASE WHEN NOT t THEN 'type' END, CASE WHEN NOT s THEN 'size' END) AS differ, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def agg_27(spark, d):
    tests = {"brand": F.col("p_brand") == "Brand#3", "type": F.col("p_type") == "ECONOMY", "size": F.col("p_size") <= 25}
    differ = F.array_join(F.array_compact(F.array(*[F.when(~t, F.lit(k)) for k, t in tests.items()])), ",")
    return table(spark, d, "part").groupBy(differ.alias("differ")).agg(F.count("*").alias("n"))


@query("agg_37_feature_correlation", f"""{WITH} SELECT 'x1' AS a, 'x2' AS b, {R('corr(x1, x2)', 8)} AS rho FROM sm UNION ALL SELECT 'x1', 'close', {R('corr(x1, close)', 8)} FROM sm UNION ALL SELECT 'x2', 'close', {R('corr(x2, close)', 8)} FROM sm""")
def agg_37(spark, d):
    from ..operators.models import correlation_matrix

    return correlation_matrix(supplier_month(spark, d), ["x1", "x2", "close"]).select("a", "b", tidy("rho", 8).alias("rho"))


DEDUP = "x1 x2 close volume n spent".split()


@query("agg_37_deduplicated", f"""WITH RECURSIVE {SM}, v AS (SELECT x1, x2, close, volume::DOUBLE AS volume, n::DOUBLE AS n, close * volume AS spent FROM sm), c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for i, a in enumerate("x1 x2 close volume n spent".split()) for b in "x1 x2 close volume n spent".split()[i + 1:])}) t(a, b)),
m AS (SELECT unnest([{', '.join(f"abs(corr({a}, {b}))" for i, a in enumerate("x1 x2 close volume n spent".split()) for b in "x1 x2 close volume n spent".split()[i + 1:])}]) AS r, unnest([{', '.join(f"'{a}'" for i, a in enumerate("x1 x2 close volume n spent".split()) for b in "x1 x2 close volume n spent".split()[i + 1:])}]) AS a, unnest([{', '.join(f"'{b}'" for i, a in enumerate("x1 x2 close volume n spent".split()) for b in "x1 x2 close volume n spent".split()[i + 1:])}]) AS b FROM v),
e AS (SELECT a, b, r FROM m UNION ALL SELECT b, a, r FROM m), o AS (SELECT a, row_number() OVER (ORDER BY sum(r) DESC, a) AS place FROM e GROUP BY 1),
k AS (SELECT 1::BIGINT AS place, [a] AS kept FROM o WHERE place = 1 UNION ALL SELECT o.place, CASE WHEN (SELECT count(*) FROM e WHERE e.a = o.a AND e.r > 0.7 AND list_contains(k.kept, e.b)) = 0 THEN list_append(k.kept, o.a) ELSE k.kept END FROM k JOIN o ON o.place = k.place + 1)
SELECT a AS feature, place::INT AS place, list_contains((SELECT kept FROM k ORDER BY place DESC LIMIT 1), a) AS kept FROM o""")
def agg_37_dedup(spark, d):
    from ..operators.models import correlation_matrix, deduplicated

    panel = supplier_month(spark, d).withColumn("spent", F.col("close") * F.col("volume"))
    return deduplicated(correlation_matrix(panel, DEDUP), 0.7)
