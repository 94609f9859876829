"""Queries of projections, ranks and top-k over the supplier-by-month panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import avg_rank, clip, normal_cdf, pct_rank, quantile_bucket, tidy, z_score
from ..operators import cross_section as X
from .panels import SM, R, avg_rank_sql, supplier_month, table
from .registry import query

WITH = "WITH " + SM


@query("prj_1_feature_transform", f"{WITH} SELECT date, key, {R('least(greatest((x1 - 5) / 2, -5), 5)')} AS x1, {R('least(greatest((least(greatest(x2, 10), 40) - 25) / 3, -5), 5)')} AS x2 FROM sm")
def prj_1(spark, d):
    moments = [("x1", 5.0, 2.0, "z", None, None), ("x2", 25.0, 3.0, "z", 10.0, 40.0)]
    out = X.transform_features(supplier_month(spark, d), moments)
    return out.select("date", "key", tidy("x1").alias("x1"), tidy("x2").alias("x2"))


@query("prj_2_robust_moments", f"""{WITH}, l AS (SELECT 'x1' AS feature, x1 AS x FROM sm UNION ALL SELECT 'x2', x2 FROM sm UNION ALL SELECT 'close', close FROM sm),
m AS (SELECT feature, median(x) AS mean FROM l GROUP BY 1)
SELECT feature, {R('mean', 6)} AS mean, {R('median(abs(x - mean)) * 1.4826', 6)} AS std FROM l JOIN m USING (feature) GROUP BY feature, mean""")
def prj_2(spark, d):
    return X.fit_robust(supplier_month(spark, d), ["x1", "x2", "close"]).select("feature", tidy("mean", 6).alias("mean"), tidy("std", 6).alias("std"))


@query("prj_3_moments", f"""{WITH}, l AS (SELECT 'x1' AS feature, x1 AS x FROM sm UNION ALL SELECT 'x2', x2 FROM sm UNION ALL SELECT 'one', 1.0 FROM sm)
SELECT feature, {R('avg(x)')} AS mean, {R('CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END')} AS std FROM l GROUP BY 1""")
def prj_3(spark, d):
    return X.fit_moments(supplier_month(spark, d).withColumn("one", F.lit(1.0)), ["x1", "x2", "one"]).select("feature", tidy("mean").alias("mean"), tidy("std").alias("std"))


@query("prj_4_pair_slug", """SELECT p_partkey, CASE WHEN regexp_full_match(s, '[A-Z0-9#]+[/_-][A-Z0-9#]+') THEN regexp_replace(s, '[/_]', '-', 'g') END AS slug
FROM (SELECT p_partkey, upper(trim(CASE p_size % 3 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN ' ' || p_brand || '_' || p_type ELSE p_name END)) AS s FROM part)""")
def prj_4(spark, d):
    size = F.col("p_size") % 3
    name = F.when(size == 0, F.concat_ws("/", "p_brand", "p_type")).when(size == 1, F.concat(F.lit(" "), "p_brand", F.lit("_"), "p_type")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.pair_slug(name).alias("slug"))


@query("prj_5_horizon", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS days FROM part""")
def prj_5(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.format_string("fwd_%dd_excess", "p_size")).otherwise(F.lit("close"))
    return table(spark, d, "part").select("p_partkey", X.horizon_days(name).alias("days"))


@query("prj_6_feature_columns", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, (SELECT count(*) FROM lineitem)::BIGINT AS n")
def prj_6(spark, d):
    lines = table(spark, d, "lineitem")
    names = X.feature_columns(lines, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    counts = lines.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n")


@query("prj_7_normalised_predictions", """WITH p AS (SELECT o_orderdate::DATE AS date, o_custkey AS key, o_totalprice AS model_score FROM orders)
SELECT date, key, model_score, 'base' AS model, coalesce(r.regime, 'UNKNOWN') AS regime FROM p
LEFT JOIN (SELECT DISTINCT o_orderdate::DATE AS date, CASE WHEN month(o_orderdate) <= 6 THEN 'CALM' ELSE 'VOLATILE' END AS regime FROM orders WHERE month(o_orderdate) <> 12) r USING (date)""")
def prj_7(spark, d):
    orders = table(spark, d, "orders")
    regimes = orders.where(F.month("o_orderdate") != 12).select(F.to_date("o_orderdate").alias("date"), F.when(F.month("o_orderdate") <= 6, "CALM").otherwise("VOLATILE").alias("regime")).distinct()
    raw = orders.select(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("ticker"), F.col("o_totalprice").alias("pred"), F.lit("?").alias("regime"))
    from ..operators.joins import normalise_predictions

    return normalise_predictions(raw, regimes, {"ticker": "key", "pred": "model_score"}, {"model": "base"})


@query("prj_8_date_window", f"{WITH} SELECT date, key, {R('close', 4)} AS close FROM sm WHERE date >= DATE '1997-01-01' - INTERVAL 100 DAY AND date < DATE '1998-01-01'")
def prj_8(spark, d):
    start = F.date_sub(F.lit("1997-01-01").cast("date"), 20 * 5)
    return supplier_month(spark, d).where((F.col("date") >= start) & (F.col("date") < "1998-01-01")).select("date", "key", tidy("close", 4).alias("close"))


@query("prj_9_event_filter", "SELECT event_id, event_type, value FROM events WHERE (event_type = 'error' OR value > 40) AND value IS NOT NULL")
def prj_9(spark, d):
    flags = [(F.col("event_type") == "error").cast("int"), (F.col("value") > 40).cast("int")]
    any_flag = F.greatest(*[F.coalesce(f, F.lit(0)) for f in flags]) == 1
    return table(spark, d, "events").where(any_flag & F.col("value").isNotNull()).select("event_id", "event_type", "value")


@query("prj_10_minimum_breadth", f"{WITH} SELECT date, key, n FROM (SELECT *, count(*) OVER (PARTITION BY date) AS c, max(count_all) OVER () AS m FROM (SELECT *, count(*) OVER (PARTITION BY date) AS count_all FROM sm)) WHERE c >= 10")
def prj_10(spark, d):
    return X.at_least_names(supplier_month(spark, d), 10).select("date", "key", "n")


@query("prj_11_position_split", f"""{WITH}, a AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT date FROM sm))
SELECT date, key, CASE WHEN pos <= floor(total * 0.6) THEN 'screen' WHEN pos <= floor(total * 0.6) + 5 THEN 'embargo' ELSE 'holdout' END AS split FROM sm JOIN a USING (date)""")
def prj_11(spark, d):
    return X.position_split(supplier_month(spark, d)).select("date", "key", "split")


@query("prj_12_top_decile_label", f"{WITH} SELECT date, key, ({avg_rank_sql('y', 'date')} / count(*) OVER (PARTITION BY date) >= 0.9)::INT AS top FROM sm WHERE y IS NOT NULL")
def prj_12(spark, d):
    return X.top_decile_label(supplier_month(spark, d).where("y is not null"), "y").select("date", "key", "top")


@query("prj_13_label_clip", f"""{WITH}, w AS (SELECT date, key, y, avg(y) OVER p AS m, stddev_samp(y) OVER p AS s FROM sm WHERE y IS NOT NULL WINDOW p AS (PARTITION BY date))
SELECT date, key, {R('least(greatest(y, -0.2), 0.2)')} AS fixed, {R('CASE WHEN s IS NULL THEN y ELSE least(greatest(y, m - s), m + s) END')} AS by_date FROM w""")
def prj_13(spark, d):
    panel = supplier_month(spark, d).where("y is not null").withColumn("fixed", clip("y", -0.2, 0.2))
    return X.clip_to_spread(panel, "y").select("date", "key", tidy("fixed").alias("fixed"), tidy("y").alias("by_date"))


@query("prj_14_collapsed_mode", """WITH r AS (SELECT event_id, user_id, round(floor(value), 8) AS v FROM events), c AS (SELECT v, count(*) AS n FROM r GROUP BY v),
w AS (SELECT v FROM c WHERE n > 0.01 * (SELECT count(*) FROM r) ORDER BY n DESC, v LIMIT 1), m AS (SELECT v FROM c ORDER BY n DESC, v LIMIT 1)
SELECT event_id, user_id FROM r WHERE v IS NULL OR NOT EXISTS (SELECT 1 FROM w JOIN m USING (v) WHERE w.v = r.v)""")
def prj_14(spark, d):
    events = table(spark, d, "events").withColumn("s", F.floor("value").cast("double"))
    return X.drop_collapsed_mode(events, "s").select("event_id", "user_id")


@query("prj_15_pivot", """WITH c AS (SELECT o_orderdate::DATE AS date, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT date, sum(n) FILTER (WHERE k = '1-URGENT')::BIGINT AS urgent, sum(n) FILTER (WHERE k = '2-HIGH')::BIGINT AS high, sum(n) FILTER (WHERE k = '5-LOW')::BIGINT AS low FROM c GROUP BY date""")
def prj_15(spark, d):
    wide = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).count()
    return wide.toDF("date", "urgent", "high", "low")


@query("win_1_average_rank", f"{WITH} SELECT date, key, {avg_rank_sql('x1', 'date')}::DOUBLE AS r FROM sm")
def win_1(spark, d):
    return supplier_month(spark, d).select("date", "key", avg_rank("x1", "date").alias("r"))


@query("win_2_percentile_rank", f"""{WITH}, v AS (SELECT date, key, x1 FROM sm WHERE n % 3 <> 0)
SELECT date, key, {R(avg_rank_sql('x1', 'date') + ' / count(*) OVER (PARTITION BY date) - 0.5')} AS r FROM v UNION ALL SELECT date, key, 0.0 FROM sm WHERE n % 3 = 0""")
def win_2(spark, d):
    panel = supplier_month(spark, d).withColumn("x1", F.when(F.col("n") % 3 != 0, F.col("x1")))
    return panel.select("date", "key", F.coalesce(tidy(pct_rank("x1", "date") - 0.5), F.lit(0.0)).alias("r"))


@query("win_3_z_score", f"""{WITH} SELECT date, key, {R('(x2 - avg(x2) OVER p) / nullif(stddev_samp(x2) OVER p, 0)')} AS z, {R('coalesce((x2 - avg(x2) OVER q) / nullif(stddev_pop(x2) OVER q, 0), 0)', 8)} AS z_region
FROM sm WINDOW p AS (PARTITION BY date), q AS (PARTITION BY date, key % 5)""")
def win_3(spark, d):
    panel = supplier_month(spark, d).withColumn("part", F.col("key") % 5)
    return panel.select("date", "key", tidy(z_score("x2", "date")).alias("z"), tidy(F.coalesce(z_score("x2", "date", "part", ddof=0), F.lit(0.0)), 8).alias("z_region"))


@query("win_4_quantile_bucket", f"""{WITH}, p AS (SELECT date, key, row_number() OVER (PARTITION BY date ORDER BY x1, key) AS rn, count(*) OVER (PARTITION BY date) AS c FROM sm)
SELECT date, key, greatest(0, ceil((rn - 1) * 10::DOUBLE / nullif(c - 1, 0)) - 1)::INT AS decile, greatest(0, ceil((rn - 1) * 5::DOUBLE / nullif(c - 1, 0)) - 1)::INT AS quintile FROM p""")
def win_4(spark, d):
    return supplier_month(spark, d).select("date", "key", quantile_bucket("x1", "key", 10, "date").alias("decile"), quantile_bucket("x1", "key", 5, "date").alias("quintile"))


@query("win_5_median_gate", f"{WITH} SELECT date, key FROM (SELECT *, median(x2) OVER (PARTITION BY date) AS m FROM sm) WHERE x2 > m")
def win_5(spark, d):
    return X.median_gate(supplier_month(spark, d), "x2").select("date", "key")


@query("win_6_positions", f"""{WITH}, a AS (SELECT date, row_number() OVER (ORDER BY date)::INT AS pos FROM (SELECT DISTINCT date FROM sm))
SELECT date, key, pos, row_number() OVER (PARTITION BY key ORDER BY date)::INT AS key_pos FROM sm JOIN a USING (date)""")
def win_6(spark, d):
    from pyspark.sql import Window

    panel = supplier_month(spark, d)
    axis = X.date_axis(panel).select("date", "pos")
    return panel.join(F.broadcast(axis), "date").select("date", "key", "pos", F.row_number().over(Window.partitionBy("key").orderBy("date")).alias("key_pos"))


@query("win_7_equal_folds", f"{WITH} SELECT date, (ntile(7) OVER (ORDER BY date) - 1)::INT AS fold FROM (SELECT DISTINCT date FROM sm)")
def win_7(spark, d):
    return X.array_split_folds(supplier_month(spark, d), 7)


@query("win_8_bars_available", f"{WITH} SELECT date, key, row_number() OVER (PARTITION BY key ORDER BY date)::INT AS bars FROM sm")
def win_8(spark, d):
    from pyspark.sql import Window

    return supplier_month(spark, d).select("date", "key", F.row_number().over(Window.partitionBy("key").orderBy("date")).alias("bars"))


@query("win_9_rank_normal", f"""{WITH}, p AS (SELECT date, key, (row_number() OVER (PARTITION BY date ORDER BY x1, key) - 0.5) / count(*) OVER (PARTITION BY date) AS p FROM sm)
SELECT date, key, (round(p, 9) + 0.0)::DOUBLE AS share, p > 0.5 AS above FROM p""")
def win_9(spark, d):
    """The share below each rank's normal score, which has to be the rank's own share."""
    ranked = X.rank_normal(supplier_month(spark, d), "x1")
    return ranked.select("date", "key", tidy(normal_cdf("normal"), 9).alias("share"), (F.col("normal") > 0).alias("above"))


@query("lbl_12_ensemble", f"""{WITH}, l AS (SELECT date, key, 'a' AS model, x1 AS s FROM sm UNION ALL SELECT date, key, 'b', x2 FROM sm UNION ALL SELECT date, key, 'c', close FROM sm),
z AS (SELECT date, key, (s - avg(s) OVER p) / nullif(stddev_samp(s) OVER p, 0) AS z FROM l WINDOW p AS (PARTITION BY date, model))
SELECT date, key, {R('avg(z)', 8)} AS score, count(z)::BIGINT AS members FROM z GROUP BY 1, 2""")
def lbl_12(spark, d):
    long = supplier_month(spark, d).select("date", "key", F.col("x1").alias("a"), F.col("x2").alias("b"), F.col("close").alias("c")).unpivot(["date", "key"], ["a", "b", "c"], "model", "score")
    return X.ensemble(long).select("date", "key", tidy("score", 8).alias("score"), "members")


@query("top_1_top_n", f"{WITH} SELECT date, key, place FROM (SELECT date, key, row_number() OVER (PARTITION BY date ORDER BY x2 DESC, key)::INT AS place FROM sm) WHERE place <= 5")
def top_1(spark, d):
    return X.top_n(supplier_month(spark, d), "x2", 5).select("date", "key", "place")


@query("top_2_latest", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def top_2(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", F.to_date("o_orderdate").alias("date"))


@query("top_3_panel_sort", f"{WITH} SELECT date, key, volume FROM sm ORDER BY date, key")
def top_3(spark, d):
    return supplier_month(spark, d).select("date", "key", "volume").orderBy("date", "key")


@query("top_4_best_config", f"{WITH} SELECT arg_max(c, (m, -c)) AS best FROM (SELECT (key % 7)::BIGINT AS c, {R('avg(x2)')} AS m FROM sm GROUP BY 1)")
def top_4(spark, d):
    means = supplier_month(spark, d).groupBy((F.col("key") % 7).alias("c")).agg(tidy(F.avg("x2")).alias("m"))
    return means.agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("best"))


@query("top_5_most_common", "SELECT floor(value)::BIGINT AS v, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 1")
def top_5(spark, d):
    return table(spark, d, "events").groupBy(F.floor("value").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1)


@query("set_1_union", f"{WITH} SELECT date, key, 'x1' AS arm, {R('x1')} AS score, NULL::BIGINT AS volume FROM sm UNION ALL SELECT date, key, 'x2', {R('x2')}, volume FROM sm")
def set_1(spark, d):
    panel = supplier_month(spark, d)
    one = panel.select("date", "key", F.lit("x1").alias("arm"), tidy("x1").alias("score"))
    return one.unionByName(panel.select("date", "key", F.lit("x2").alias("arm"), tidy("x2").alias("score"), "volume"), allowMissingColumns=True)


@query("set_2_intersection", "SELECT l_shipdate::DATE AS date FROM lineitem INTERSECT SELECT o_orderdate::DATE FROM orders")
def set_2(spark, d):
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).intersect(table(spark, d, "orders").select(F.to_date("o_orderdate")))


@query("set_3_difference", "SELECT l_shipdate::DATE AS date FROM lineitem EXCEPT SELECT o_orderdate::DATE FROM orders")
def set_3(spark, d):
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).subtract(table(spark, d, "orders").select(F.to_date("o_orderdate")))


@query("set_4_keep_last", "SELECT user_id, ts::DATE AS date, arg_max(event_id, event_id)::BIGINT AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def set_4(spark, d):
    from ..operators.joins import keep_last

    return keep_last(table(spark, d, "events").withColumn("date", F.to_date("ts")), ["user_id", "date"], "event_id").select("user_id", "date", "event_id", "value")


@query("set_5_spaced_dates", """WITH RECURSIVE a AS (SELECT row_number() OVER (ORDER BY date)::INT AS pos FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)),
m AS (SELECT max(pos) AS m FROM a), r AS (SELECT 1 AS pos UNION ALL SELECT pos + 60 FROM r, m WHERE pos + 60 <= m) SELECT pos::INT AS pos FROM r""")
def set_5(spark, d):
    axis = X.date_axis(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))
    return X.spaced_dates(axis, 60)
