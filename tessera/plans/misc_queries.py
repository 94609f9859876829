"""Queries of models, text and digests, data quality, sources and sinks, streams, and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import correlation, pct_rank, tidy
from ..operators import cross_section as X
from ..operators import models as ML
from ..operators import quality as Q
from ..operators import splits as SP
from ..operators import textjson as J
from ..operators import udfs as U
from ..operators import walkforward as WF
from ..sources import files as R_
from ..sources import sinks as K_
from ..sources.scratch import full_waves, scratch, written
from ..streaming import state as ST
from .join_queries import orders
from .panels import SM, UD, R, corr_sql, supplier_month, table, user_day
from .registry import query

WITH = "WITH " + SM
FEATURES = ["x1", "x2"]


def labelled(spark, d):
    return supplier_month(spark, d).where("y is not null")


# Models

NORMAL = """m AS (SELECT sum((x1 - 5) * (x1 - 5)) + {p} AS a, sum((x1 - 5) * (x2 - 25)) AS b, sum((x2 - 25) * (x2 - 25)) + {p} AS c, sum((x1 - 5) * y) AS u, sum((x2 - 25) * y) AS v FROM sm WHERE y IS NOT NULL),
w AS (SELECT (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM m)"""


def centred(spark, d):
    return labelled(spark, d).withColumns({"x1": F.col("x1") - 5, "x2": F.col("x2") - 25})


@query("ml_1_linear", f"{WITH}, {NORMAL.format(p=0)} SELECT 'x1' AS feature, {R('w1', 6)} AS weight FROM w UNION ALL SELECT 'x2', {R('w2', 6)} FROM w")
def ml_1(spark, d):
    model = ML.fit_linear(centred(spark, d), FEATURES, "y")
    return ML.coefficients(model, FEATURES, spark).select("feature", tidy("weight", 6).alias("weight"))


@query("ml_1_ridge", f"{WITH}, {NORMAL.format(p=1000)} SELECT 'x1' AS feature, {R('w1', 6)} AS weight FROM w UNION ALL SELECT 'x2', {R('w2', 6)} FROM w")
def ml_1_ridge(spark, d):
    weights = ML.ridge_weights(centred(spark, d), FEATURES, "y", 1000.0)
    pairs = F.explode(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]))
    return spark.range(1).select(pairs.alias("feature", "weight")).select("feature", tidy("weight", 6).alias("weight"))


@query("ml_2_linear_score", f"{WITH} SELECT date, key, {R('least(greatest((x1 - 5) / 2, -5), 5) * 0.3 + least(greatest((x2 - 25) / 3, -5), 5) * 0.7')} AS score FROM sm")
def ml_2(spark, d):
    z = X.transform_features(supplier_month(spark, d), [("x1", 5.0, 2.0, "z", None, None), ("x2", 25.0, 3.0, "z", None, None)])
    return z.select("date", "key", tidy(ML.linear_score({"x1": 0.3, "x2": 0.7})).alias("score"))


#: Five folds over the months, three of them embargoed, as (fold, part, date, key, ...) in wl.
FOLDS = f"""{SM}, ax AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, (ntile(6) OVER (ORDER BY date)) - 1 AS fold FROM (SELECT DISTINCT date FROM sm WHERE y IS NOT NULL)),
fo AS (SELECT fold, min(pos) AS first, max(pos) AS last, min(pos) - 4 AS train_last FROM ax WHERE fold > 0 GROUP BY 1),
wl AS (SELECT fo.fold, CASE WHEN pos <= train_last THEN 'train' ELSE 'val' END AS part, sm.*, CASE WHEN x1 < 4.5 THEN 0 WHEN x1 < 5.5 THEN 1 ELSE 2 END AS level FROM sm JOIN ax USING (date) JOIN fo ON pos <= train_last OR pos BETWEEN first AND last WHERE train_last >= 20 AND y IS NOT NULL)"""
LEVEL = "case when x1 < 4.5 then 0.0D when x1 < 5.5 then 1.0D else 2.0D end"


def walk_forward_rows(panel):
    """The long form of five expanding folds; the panel, a written table, is read for its dates and for its rows, and joined with folds and dates only."""
    return SP.fold_rows(panel, SP.expanding_folds(panel, 5, 3))


@query("ml_3_walk_forward", f"""WITH {FOLDS}, mo AS (SELECT fold, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM wl WHERE part = 'train' GROUP BY 1),
z AS (SELECT wl.fold, part, date, key, y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM wl JOIN mo USING (fold)),
g AS (SELECT fold, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z1 * y) AS u, sum(z2 * y) AS v FROM z WHERE part = 'train' GROUP BY 1),
w AS (SELECT fold, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM g)
SELECT fold::INT AS fold, part, date, key, {R('w1 * z1 + w2 * z2', 7)} AS score FROM z JOIN w USING (fold)""")
def ml_3_linear(spark, d):
    scored = expanding(spark, d, 5, with_train=True)
    return scored.select("fold", "part", "date", "key", tidy("score", 7).alias("score"))


def expanding(spark, d, k, with_train=False):
    """Scores of k expanding folds, three months embargoed, fitted from running sums of one scan."""
    panel = written(labelled(spark, d).select("date", "key", "x1", "x2", "y"))
    fits = WF.fit_from_sums(WF.train_sums(panel, SP.expanding_folds(panel, k, 3), FEATURES, "y"), FEATURES)
    return WF.linear_scores(panel, fits, FEATURES, with_train=with_train)


LINEAR_SQL = f"""mo AS (SELECT fold, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM wl WHERE part = 'train' GROUP BY 1),
z AS (SELECT wl.fold, part, date, key, y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM wl JOIN mo USING (fold)),
g AS (SELECT fold, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z1 * y) AS u, sum(z2 * y) AS v FROM z WHERE part = 'train' GROUP BY 1),
w AS (SELECT fold, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM g)"""


@query("ml_3_expanding_43", f"""WITH {FOLDS.replace('ntile(6)', 'ntile(44)')}, {LINEAR_SQL}
SELECT fold::INT AS fold, date, key, {R('w1 * z1 + w2 * z2', 7)} AS score FROM z JOIN w USING (fold) WHERE part = 'val'""")
def ml_3_expanding(spark, d):
    """Out-of-sample scores of 43 expanding folds."""
    return expanding(spark, d, 43).select("fold", "date", "key", tidy("score", 7).alias("score"))


TREE_FEATURES = ["x1", "x2", "close", "volume", "n"]


def tree_panel(spark, d):
    """The panel with its percentile rank, a written table; its dates are dealt over all files, so that every task of a fold's fit has its share of train rows."""
    ranked = labelled(spark, d).withColumn("target", pct_rank("y", "date"))
    # Some lines make up a row of the panel.
    return written(ranked.repartition(full_waves(table(spark, d, "lineitem"), most=2_000_000), "date", "key"))


@query("ml_3_boosted_ranker")
def ml_3_boosted(spark, d):
    """Out-of-sample scores of ten rounds of trees of depth three on all features, on the percentile rank within the date, by fold."""
    panel = tree_panel(spark, d)
    fit = lambda train: ML.fit_trees(train, TREE_FEATURES, "target")
    return WF.boosted_scores(panel, SP.expanding_folds(panel, 5, 3), TREE_FEATURES, "target", fit).select("fold", "date", "key", "target", "score")


@query("ml_4_boosted_classifier")
def ml_4_boosted(spark, d):
    """Out-of-sample probabilities of the top decile, ten rounds of trees of depth three on all features, by fold."""
    panel = tree_panel(spark, d).withColumn("top", (F.col("target") >= 0.9).cast("int"))
    fit = lambda train: ML.fit_trees(train, TREE_FEATURES, "top", classify=True)
    return WF.boosted_scores(panel, SP.expanding_folds(panel, 5, 3), TREE_FEATURES, "top", fit, classify=True).select("fold", "date", "key", "top", "score")


@query("ml_3_tree_ranker", f"""WITH {FOLDS}, rk AS (SELECT date, key, (rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS target FROM sm WHERE y IS NOT NULL),
t AS (SELECT wl.fold, part, wl.date, key, level, target FROM wl JOIN rk USING (date, key)), l AS (SELECT fold, level, avg(target) AS score FROM t WHERE part = 'train' GROUP BY 1, 2),
s AS (SELECT t.fold, part, date, target, score, rank() OVER (PARTITION BY t.fold, date ORDER BY score) + (count(*) OVER (PARTITION BY t.fold, date, score) - 1) / 2.0 AS r FROM t JOIN l USING (fold, level)),
i AS (SELECT fold, part, date, count(*) AS n, sum(score) AS total, {corr_sql('r', 'target')} AS ic FROM s GROUP BY 1, 2, 3)
SELECT fold::INT AS fold, part, sum(n)::BIGINT AS n, {R('sum(total) / sum(n)', 7)} AS score, {R('avg(ic)', 6)} AS ic FROM i GROUP BY 1, 2""")
def ml_3(spark, d):
    """One tree of three levels on the percentile rank within the date: in-sample and out-of-sample rank correlation by fold."""
    from ..operators.metrics import rank_ic

    panel = written(labelled(spark, d).select("date", "key", F.expr(LEVEL).alias("level"), pct_rank("y", "date").alias("target")))
    scored = ML.fit_by_fold(walk_forward_rows(panel), ["level"], lambda train: ML.fit_trees(train, ["level"], "target", rounds=1, least=1, share=1.0))
    scored = written(scored.select("fold", "part", "date", "target", F.round("score", 12).alias("score")))
    ics = rank_ic(scored, "score", "target", by=("fold", "part", "date")).groupBy("fold", "part").agg(F.avg("ic").alias("ic"))
    means = scored.groupBy("fold", "part").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
    return means.join(ics, ["fold", "part"], "left").select(F.col("fold").cast("int").alias("fold"), "part", "n", tidy("score", 7).alias("score"), tidy("ic", 6).alias("ic"))


@query("ml_4_top_decile_classifier", f"""WITH {FOLDS}, tp AS (SELECT date, key, ((rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0) / count(*) OVER (PARTITION BY date) >= 0.9)::INT AS top FROM sm WHERE y IS NOT NULL),
t AS (SELECT wl.fold, part, wl.date, key, level, top FROM wl JOIN tp USING (date, key)), l AS (SELECT fold, level, 1 / (1 + exp(-2 * (2 * avg(top) - 1))) AS score FROM t WHERE part = 'train' GROUP BY 1, 2)
SELECT t.fold::INT AS fold, date, key, top, {R('score', 7)} AS score FROM t JOIN l USING (fold, level) WHERE part = 'val'""")
def ml_4(spark, d):
    """The out-of-sample probabilities of one tree of three levels by fold."""
    panel = written(X.top_decile_label(labelled(spark, d), "y").select("date", "key", F.expr(LEVEL).alias("level"), F.col("top").cast("int").alias("top")))
    scored = ML.fit_by_fold(walk_forward_rows(panel), ["level"], lambda train: ML.fit_trees(train, ["level"], "top", classify=True, rounds=1, least=1, share=1.0))
    return scored.where("part = 'val'").select(F.col("fold").cast("int").alias("fold"), "date", "key", "top", tidy("score", 7).alias("score"))


@query("ml_5_meta_label", """WITH e AS (SELECT event_id, ts::DATE AS date, least(2, floor(value / 20))::INT AS level, ((event_id * 31) % 50 < value)::INT AS label FROM events WHERE value IS NOT NULL), f AS (SELECT date, (ntile(5) OVER (ORDER BY date) - 1)::INT AS fold FROM (SELECT DISTINCT date FROM e)), s AS (SELECT fold, min(date) AS a, max(date) AS b FROM f GROUP BY 1),
p AS (SELECT s.fold, CASE WHEN f.fold = s.fold THEN 'val' ELSE 'train' END AS part, level, label FROM e JOIN f USING (date) JOIN s ON f.fold = s.fold OR date + 2 < s.a OR date > s.b + 3), l AS (SELECT fold, level, 1 / (1 + exp(-2 * (2 * avg(label) - 1))) AS score FROM p WHERE part = 'train' GROUP BY 1, 2),
o AS (SELECT label, round(score, 9) AS score FROM p JOIN l USING (fold, level) WHERE part = 'val'), g AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1)::BIGINT AS tp, count(*) FILTER (score >= threshold AND label = 0)::BIGINT AS fp, count(*) FILTER (score < threshold AND label = 1)::BIGINT AS fn FROM o, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold) GROUP BY 1)
SELECT threshold, tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS f1 FROM g""")
def ml_5(spark, d):
    """The sweep over scores that purged folds give out of fold."""
    from ..operators.metrics import threshold_sweep
    from ..operators.splits import purged_folds

    level = F.least(F.lit(2.0), F.floor(F.col("value") / 20).cast("double"))
    label = (F.pmod(F.col("event_id") * 31, F.lit(50)) < F.col("value")).cast("int")
    e = table(spark, d, "events").where("value is not null").select("event_id", F.to_date("ts").alias("date"), level.alias("level"), label.alias("label"))
    scored = ML.fit_by_fold(purged_folds(e, 5, 2, 1), ["level"], lambda train: ML.fit_trees(train, ["level"], "label", classify=True, rounds=1, least=1, share=1.0))
    sweep = threshold_sweep(scored.where("part = 'val'").withColumn("score", F.round("score", 9)), "score", "label", [0.3, 0.4, 0.5, 0.6, 0.7])
    return sweep.select("threshold", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


HITS = "h AS (SELECT floor(value / 3)::DOUBLE AS x, ((event_id * 31) % 50 < value)::DOUBLE AS y FROM events WHERE value IS NOT NULL)"


def hits(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.floor(F.col("value") / 3).cast("double").alias("x"), (F.pmod(F.col("event_id") * 31, F.lit(50)) < F.col("value")).cast("double").alias("y"))


@query("ml_5_boosted_exit")
def ml_5_boosted(spark, d):
    """Areas under the curve, by purged fold, of ten rounds of trees of depth three that tell a user's errors from the value and time of events and what came before."""
    from ..operators.metrics import auc

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = events.repartition(full_waves(events), "user_id").select(F.to_date("ts").alias("date"), F.coalesce("value", F.lit(0.0)).alias("value"), F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("weekday"), F.coalesce(F.lag("value").over(w), F.lit(0.0)).alias("before"), (F.row_number().over(w) - 1).cast("double").alias("so_far"), (F.col("event_type") == "error").cast("int").alias("label"))
    features = ["value", "hour", "weekday", "before", "so_far"]
    scored = WF.purged_boosted_scores(written(e), 5, 2, 1, features, lambda train: ML.fit_trees(train, features, "label", classify=True), classify=True)
    return auc(scored, "score", "label")


@query("ml_6_calibration", f"""WITH {HITS}, b AS (SELECT x, sum(y) AS s, count(*) AS n FROM h GROUP BY 1), r AS (SELECT i.x AS i, k.x AS k, sum(m.s) / sum(m.n) AS mean FROM b i JOIN b k ON k.x >= i.x JOIN b m ON m.x BETWEEN i.x AND k.x GROUP BY 1, 2),
q AS (SELECT b.x, r.i, min(r.mean) AS low FROM b JOIN r ON r.i <= b.x AND r.k >= b.x GROUP BY 1, 2) SELECT x, {R('max(low)', 8)} AS p FROM q GROUP BY 1""")
def ml_6(spark, d):
    """The isotonic head at every score; the SQL has it as the largest of the least means."""
    h = hits(spark, d)
    points = ML.fit_calibration(h, "x", "y", spark)
    return ML.calibrated(h.select("x").distinct(), "x", points).select("x", tidy("calibrated", 8).alias("p"))


@query("ml_6_logistic_head", f"""WITH RECURSIVE {HITS}, g AS (SELECT avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM h), b AS (SELECT (x - m) / s AS z, sum(y) AS k, count(*) AS n FROM h, g GROUP BY x, m, s),
it AS (SELECT 0 AS step, 0::DOUBLE AS w, 0::DOUBLE AS c UNION ALL SELECT step + 1, w - (hcc * gw - hwc * gc) / (hww * hcc - hwc * hwc), c - (hww * gc - hwc * gw) / (hww * hcc - hwc * hwc)
  FROM (SELECT step, w, c, sum(z * (n * p - k)) + w AS gw, sum(n * p - k) AS gc, sum(n * p * (1 - p) * z * z) + 1 AS hww, sum(n * p * (1 - p) * z) AS hwc, sum(n * p * (1 - p)) AS hcc FROM (SELECT step, w, c, z, n, k, 1 / (1 + exp(-(w * z + c))) AS p FROM it, b WHERE step < 15) GROUP BY step, w, c)),
p AS (SELECT lo + i * (hi - lo) / 99 AS x FROM g, (SELECT unnest(range(0, 100)) AS i)) SELECT {R('x', 8)} AS x, {R('1 / (1 + exp(-(w * (x - m) / s + c)))', 5)} AS p FROM p, g, it WHERE step = 15""")
def ml_6_logistic(spark, d):
    return ML.logistic_curve(hits(spark, d), "x", "y").select(tidy("x", 8).alias("x"), tidy("y", 5).alias("p"))


@query("ml_6_median_label", f"WITH {SM}, m AS (SELECT date, median(y) AS m FROM sm WHERE y IS NOT NULL GROUP BY 1) SELECT date, key, (y >= m)::INT::DOUBLE AS hit FROM sm JOIN m USING (date) WHERE y IS NOT NULL")
def ml_6_label(spark, d):
    return ML.hit_label(labelled(spark, d).select("date", "key", "y"), "y", None).select("date", "key", "hit")


@query("ml_6_huber_head")
def ml_6_huber(spark, d):
    """Expected return from x2 by a bounded Huber curve; tested against its first-order conditions."""
    return ML.huber_curve(labelled(spark, d), "x2", "y", 0.5).select(tidy("x", 8).alias("x"), tidy("y", 5).alias("y"))


@query("ml_6_gates", f"""WITH {HITS}, b AS (SELECT x, round(avg(y), 1) AS y FROM h GROUP BY 1), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM b)
SELECT count(DISTINCT y)::BIGINT AS "distinct", {R('sum(CASE WHEN abs(y1 - y) < 1e-9 THEN x1 - x ELSE 0 END) / nullif(max(x) - min(x), 0)')} AS flat, CASE WHEN count(DISTINCT y) < 5 THEN 'collapsed' ELSE 'ok' END AS verdict FROM s""")
def ml_6_gates(spark, d):
    points = hits(spark, d).groupBy("x").agg(F.round(F.avg("y"), 1).alias("y"))
    return ML.curve_gates(points).select("distinct", tidy("flat").alias("flat"), "verdict")


@query("ml_7_calibrated_lookup", "WITH p AS (SELECT * FROM (VALUES (5.0, 0.1), (20.0, 0.3), (40.0, 0.9)) v(x, y)) SELECT event_id, round(CASE WHEN value <= 5 THEN 0.1 WHEN value >= 40 THEN 0.9 WHEN value < 20 THEN 0.1 + (value - 5) / 15 * 0.2 ELSE 0.3 + (value - 20) / 20 * 0.6 END, 9)::DOUBLE AS p, round(CASE WHEN value <= 5 THEN 0.1 WHEN value >= 40 THEN 0.9 WHEN value < 20 THEN 0.1 + (value - 5) / 15 * 0.2 ELSE 0.3 + (value - 20) / 20 * 0.6 END * 2, 8)::DOUBLE AS twenty FROM events")
def ml_7(spark, d):
    points = spark.sql("select cast(x as double) x, cast(y as double) y from values (5, 0.1), (20, 0.3), (40, 0.9) as v(x, y)")
    return ML.calibrated(table(spark, d, "events").select("event_id", "value"), "value", points).select("event_id", F.round("calibrated", 9).alias("p"), F.round(ML.to_horizon("calibrated", 20, 10), 8).alias("twenty"))


@query("ml_7_calibrated_curve", f"""{WITH}, p AS (SELECT x2 AS x, avg(x1) AS y FROM sm GROUP BY 1), g AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM p), e AS (SELECT min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM p)
SELECT event_id, {R('CASE WHEN value <= lo THEN ylo WHEN value >= hi THEN yhi ELSE y0 + (value - x0) / (x1 - x0) * (y1 - y0) END', 7)} AS y FROM e CROSS JOIN events ASOF LEFT JOIN g ON value >= x0""")
def ml_7_curve(spark, d):
    """All events looked up on a curve with a breakpoint for each average quantity of the panel."""
    curve = supplier_month(spark, d).groupBy(F.col("x2").alias("x")).agg(F.avg("x1").alias("y"))
    return ML.calibrated(table(spark, d, "events").select("event_id", "value"), "value", curve).select("event_id", tidy("calibrated", 7).alias("y"))


@query("ml_8_parameter_contract", "SELECT * FROM (VALUES ('p_size', 'no spread'), ('p_type', 'missing'), ('p_name', 'unexpected')) v(feature, problem)")
def ml_8(spark, d):
    sizes = table(spark, d, "part").agg(F.avg("p_size").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    params = sizes.select(F.explode(F.expr("array(struct('p_size' as feature, m as mean, 0.0D as std, 'z' as kind), struct('p_retailprice' as feature, m as mean, s as std, 'z' as kind), struct('p_name' as feature, m as mean, 1.0D as std, 'z' as kind))")).alias("p")).select("p.*")
    wanted = spark.sql("select feature from values ('p_size'), ('p_retailprice'), ('p_type') as v(feature)")
    return ML.parameter_problems(params, wanted, ("z", "identity"))


@query("ml_8_type_parameters", """WITH p AS (SELECT p_type AS feature, stddev_samp(p_retailprice) AS std, CASE WHEN min(p_partkey) % 4 = 0 THEN 'log' ELSE 'z' END AS kind FROM part WHERE p_size > 10 GROUP BY 1), w AS (SELECT DISTINCT p_type AS feature FROM part WHERE p_size <= 40)
SELECT * FROM (SELECT feature, CASE WHEN kind IS NULL THEN 'missing' WHEN w.feature IS NULL THEN 'unexpected' WHEN kind = 'log' THEN 'unknown kind' WHEN coalesce(std, 0) <= 0 THEN 'no spread' END AS problem FROM p FULL JOIN w USING (feature)) WHERE problem IS NOT NULL""")
def ml_8_types(spark, d):
    """Moments of prices by part type, from parts over one size, against the types of parts under another."""
    part = table(spark, d, "part")
    kind = F.when(F.min("p_partkey") % 4 == 0, "log").otherwise("z")
    params = part.where("p_size > 10").groupBy(F.col("p_type").alias("feature")).agg(F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("std"), kind.alias("kind"))
    wanted = part.where("p_size <= 40").select(F.col("p_type").alias("feature")).distinct()
    return ML.parameter_problems(params, wanted, ("z", "identity"))


PLAIN = NORMAL.replace("x1 - 5", "x1").replace("x2 - 25", "x2").format(p=0)


@query("ml_9_batch_score", f"{WITH}, {PLAIN} SELECT date, key, {R('w1 * x1 + w2 * x2', 6)} AS score FROM sm, w")
def ml_9(spark, d):
    panel = supplier_month(spark, d).select("date", "key", "x1", "x2", "y")
    model = ML.fit_linear(panel.where("y is not null"), FEATURES, "y")
    return ML.score(model, panel, FEATURES).select("date", "key", tidy("score", 6).alias("score"))


@query("ml_10_marginal_effects", "SELECT * FROM (VALUES ('x1', 0.6, 0.0, 1.0), ('x2', -0.4, 0.0, 0.0)) v(feature, mean, sd, positive)".replace("0.6, 0.0, 1.0", "0.6::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE").replace("-0.4, 0.0, 0.0", "-0.4::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"))
def ml_10(spark, d):
    panel = supplier_month(spark, d).withColumn("t", 0.3 * F.col("x1") - 0.2 * F.col("x2"))
    model = ML.fit_linear(panel, FEATURES, "t")
    return ML.marginal_effects(model, panel, FEATURES).select("feature", *[tidy(c, 6).alias(c) for c in ("mean", "sd", "positive")])


@query("ml_11_regime_specialists", WITH + """, g AS (SELECT date, key, CASE month(date) WHEN 1 THEN 'NEW' ELSE CASE WHEN month(date) <= 6 THEN 'CALM' ELSE 'VOLATILE' END END AS regime, x1, x2, y FROM sm),
m AS (SELECT regime, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS u, sum(x2 * y) AS v FROM (SELECT * FROM g WHERE regime <> 'NEW' UNION ALL SELECT date, key, 'NEW', x1, x2, y FROM g) WHERE y IS NOT NULL GROUP BY 1),
w AS (SELECT regime, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM m) SELECT date, key, regime, CASE WHEN regime = 'NEW' THEN 'global' ELSE 'specialist' END AS model, """ + R("w1 * x1 + w2 * x2", 6) + " AS score FROM g JOIN w USING (regime)")
def ml_11(spark, d):
    regime = F.when(F.month("date") == 1, "NEW").when(F.month("date") <= 6, "CALM").otherwise("VOLATILE")
    # Read for the weights and for the scores, made once.
    panel = written(supplier_month(spark, d).select("date", "key", "x1", "x2", "y").withColumn("regime", regime))
    weights = ML.weights_by(panel, "regime", FEATURES, "y")
    of = lambda regime, f: F.lit(weights.get(regime, {}).get(f)).cast("double")
    weight = lambda f: F.when(F.col("regime") == "CALM", of("CALM", f)).when(F.col("regime") == "VOLATILE", of("VOLATILE", f)).otherwise(of(None, f))
    scored = panel.withColumn("score", sum((weight(f) * F.col(f) for f in FEATURES), F.lit(0.0))).where("score is not null")
    return scored.select("date", "key", "regime", F.when(F.col("regime") == "NEW", "global").otherwise("specialist").alias("model"), tidy("score", 6).alias("score"))


@query("agg_38_importance", """WITH v AS (SELECT l_quantity AS y, unnest([l_linenumber::DOUBLE, l_discount * 100, l_tax * 100]) AS x, unnest(['line', 'discount', 'tax']) AS feature FROM lineitem),
c AS (SELECT feature, round(x) AS x, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM v GROUP BY 1, 2), t AS (SELECT feature, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM c GROUP BY 1),
l AS (SELECT feature, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
g AS (SELECT feature, (t.q - t.s * t.s / t.n - (l.q - l.s * l.s / l.n) - (t.q - l.q - (t.s - l.s) * (t.s - l.s) / (t.n - l.n))) / t.n AS gain FROM l JOIN t USING (feature) WHERE l.n < t.n),
b AS (SELECT feature, gain FROM g ORDER BY gain DESC LIMIT 1), f AS (SELECT unnest(['line', 'discount', 'tax', 'flat']) AS feature)
SELECT f.feature, (b.feature IS NOT NULL)::BIGINT AS splits, round(coalesce(gain, 0), 7) + 0.0 AS gain, (b.feature IS NOT NULL)::INT::DOUBLE AS share, 1.0::DOUBLE AS cumulative, 3::BIGINT AS never_used FROM f LEFT JOIN b ON f.feature = b.feature""")
def agg_38(spark, d):
    """The gain of the best split of quantity by a line's number, discount or tax; a feature without spread is never used."""
    lines = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("line"), F.round(F.col("l_discount") * 100).cast("double").alias("discount"), F.round(F.col("l_tax") * 100).cast("double").alias("tax"), F.lit(1.0).alias("flat"))
    features = ["line", "discount", "tax", "flat"]
    found = WF.gain_table(WF.node_table(ML.fit_trees(lines, features, "y", rounds=1, depth=1, least=1, share=1.0)), features)
    return found.select("feature", "splits", tidy("gain", 7).alias("gain"), "share", tidy("cumulative").alias("cumulative"), "never_used")


@query("agg_38_gain_table")
def agg_38_gain(spark, d):
    """Gains of ten rounds of trees on the whole panel, by feature."""
    panel = tree_panel(spark, d).withColumn("flat", F.lit(1.0))
    features = [*TREE_FEATURES, "flat"]
    return WF.gain_table(WF.node_table(ML.fit_trees(panel, features, "target")), features)


# Text, JSON, digests, scalars


@query("str_1_checks", "SELECT c_custkey, regexp_full_match(substr(sha256(c_name), 1, 16), '[0-9a-f]{16}') AS hex, split_part(c_name, '#', 2) AS number, regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g') AS slug FROM customer")
def str_1(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 16).rlike("^[0-9a-f]{16}$").alias("hex"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"), F.regexp_replace("c_name", "[^A-Za-z0-9]+", "_").alias("slug"))


ROWTEXT = "strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderkey || '|' || printf('%.10f', o_totalprice) || '|' || o_orderstatus"


@query("str_2_canonical_row", f"SELECT o_orderkey, {ROWTEXT} AS line FROM orders")
def str_2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", J.canonical_row([("o_orderdate", "date"), ("o_orderkey", "text"), ("o_totalprice", "float"), ("o_orderstatus", "text")]).alias("line"))


@query("json_1_canonical", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS doc FROM nation""")
def json_1(spark, d):
    n = table(spark, d, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")))
    return n.select("n_nationkey", J.canonical_json(["n_regionkey", "n_nationkey", "n_name"]).alias("doc"))


@query("json_2_lookup", "SELECT event_id, (props::JSON->>'k')::INT AS k, coalesce(props::JSON->>'missing', 'none') AS other FROM events")
def json_2(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("arr_1_required", "WITH t AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS seen FROM events GROUP BY 1) SELECT user_id, array_to_string(list_filter(['click', 'error', 'purchase', 'view'], lambda x: NOT list_contains(seen, x)), ',') AS missing, list_contains(seen, 'error') AS has_error FROM t")
def arr_1(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    need = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "view")])
    return seen.select("user_id", F.array_join(F.array_except(need, "seen"), ",").alias("missing"), F.array_contains("seen", "error").alias("has_error"))


@query("map_1_scores", f"WITH {UD} SELECT date, key, value FROM ud WHERE value IS NOT NULL")
def map_1(spark, d):
    maps = user_day(spark, d).where("value is not null").groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return maps.select("date", F.explode("m").alias("key", "value"))


@query("hash_1_digests", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS digest, substr(sha256(c_name), 1, 12) AS prefix FROM customer")
def hash_1(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest"), F.substring(F.sha2("c_name", 256), 1, 12).alias("prefix"))


ROLL = f"WITH r AS (SELECT o_orderstatus AS k, sha256({ROWTEXT}) AS h FROM orders), b AS (SELECT k, substr(h, 1, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1, 2), g AS (SELECT k, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS d, sum(n) AS n FROM b GROUP BY 1) SELECT sha256(string_agg(k || ':' || d, chr(10) ORDER BY k)) AS digest, sum(n)::BIGINT AS n FROM g"


def digest(spark, d):
    row = J.canonical_row([("o_orderdate", "date"), ("o_orderkey", "text"), ("o_totalprice", "float"), ("o_orderstatus", "text")])
    return J.table_digest(table(spark, d, "orders"), row, "o_orderstatus")


query("hash_2_rollup", ROLL)(digest)
query("dq_6_table_digest", ROLL)(lambda spark, d: digest(spark, d))


@query("fn_1_tanh_bound", "SELECT event_id, round(10 * tanh(value / 10), 9) AS b FROM events")
def fn_1(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.tanh_bound("value", 10.0), 9).alias("b"))


@query("fn_2_signed_probability", "SELECT event_id, round(value / 100 - (event_id % 10) / 20.0, 9)::DOUBLE + 0.0 AS s, length(trim(event_type)) = 0 AS blank FROM events")
def fn_2(spark, d):
    return table(spark, d, "events").select("event_id", tidy(S.signed_probability(F.col("value") / 100, (F.col("event_id") % 10) / 20)).alias("s"), (F.length(F.trim("event_type")) == 0).alias("blank"))


@query("fn_3_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT || ',' || (o_orderstatus = 'O')::INT AS hot FROM orders")
def fn_3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(S.one_hot("o_orderstatus", ["F", "O"]), lambda x: x.cast("string")), ",").alias("hot"))


@query("fn_4_inverse_normal", """SELECT event_id, (round((event_id * 7919 % 100003 + 0.5) / 100003, 9) + 0.0)::DOUBLE AS share, ((event_id * 7919 % 100003 + 0.5) / 100003 > 0.9750021048517795) AS beyond FROM events""")
def fn_4(spark, d):
    """Each event's share of the normal distribution below the quantile of that share, and whether the quantile is beyond 1.96."""
    p = ((F.col("event_id") * 7919 % 100003 + 0.5) / 100003).alias("p")
    z = table(spark, d, "events").select("event_id", p).select("event_id", S.inverse_normal("p", refined=True).alias("z"))
    return z.select("event_id", tidy(S.normal_cdf("z"), 9).alias("share"), (F.col("z") > 1.96).alias("beyond"))


@query("fn_5_student_tail", f"""{WITH}, t AS (SELECT key, count(y) - 1 AS df, avg(y) / (stddev_samp(y) / sqrt(count(y))) AS t FROM sm WHERE y IS NOT NULL GROUP BY 1 HAVING count(y) > 1),
g AS (SELECT key, df, t, k, CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * k / 1000, 2) / df, -(df + 1) / 2.0) AS f FROM t, (SELECT unnest(range(1001)) AS k))
SELECT key, df::BIGINT AS df, {R('0.5 - exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * sum(f) * t / 3000', 8)} AS p FROM g GROUP BY key, df, t""")
def fn_5_tail(spark, d):
    """One-sided probability of each supplier's mean change under no change."""
    y = labelled(spark, d).groupBy("key").agg((F.count("y") - 1).alias("df"), (F.avg("y") / (F.stddev_samp("y") / F.sqrt(F.count("y")))).alias("t")).where("df > 0")
    return y.select("key", "df", tidy(S.student_tail("t", "df"), 8).alias("p"))


@query("fn_5_student_bar", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 12.7062 WHEN 1 THEN 4.3027 WHEN 2 THEN 3.1824 WHEN 3 THEN 2.7764 WHEN 4 THEN 2.5706 END::DOUBLE AS bar FROM region")
def fn_5(spark, d):
    bars = F.create_map(*[x for df in range(1, 6) for x in (F.lit(df - 1), F.lit(S.t_quantile(0.975, df)))])
    return table(spark, d, "region").select("r_regionkey", F.round(bars[F.col("r_regionkey")], 4).alias("bar"))


@query("fn_6_spearman_pearson", f"{WITH} SELECT date, {R('2 * sin(pi() * corr(x1, x2) / 6)', 8)} AS rho FROM sm GROUP BY 1")
def fn_6(spark, d):
    rho = supplier_month(spark, d).groupBy("date").agg(correlation("x1", "x2").alias("r"))
    return rho.select("date", tidy(S.spearman_to_pearson("r"), 8).alias("rho"))


@query("fn_7_inverse_ratio", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 1000 / c_acctbal - 1 END, 9) + 0.0 AS r FROM customer")
def fn_7(spark, d):
    return table(spark, d, "customer").select("c_custkey", tidy(S.inverse_ratio_return(F.col("c_acctbal") / 1000)).alias("r"))


# Data quality


@query("dq_1_admissibility", """WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN k = 1 THEN 'trained_after_watermark' END, CASE WHEN k = 2 THEN 'watermark_after_features' END, CASE WHEN k = 3 THEN 'bad_digest' END, CASE WHEN k = 4 THEN 'labels_too_short' END) AS reasons, k = 0 AS admitted FROM r""")
def dq_1(spark, d):
    k, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    records = table(spark, d, "orders").select(
        "o_orderkey", F.when(k == 1, day).otherwise(F.date_sub(day, 30)).alias("trained"), F.when(k == 2, F.date_add(day, 0)).otherwise(F.date_sub(day, 5)).alias("watermark"), F.when(k == 2, F.date_sub(day, 1)).otherwise(F.date_sub(day, 2)).alias("features"),
        day.alias("scored"), day.alias("decision"), F.when(k == 4, F.date_add(day, 3)).otherwise(F.date_add(day, 60)).alias("labels_end"), F.when(k == 3, F.lit("xyz")).otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("digest"),
    )
    return Q.admissibility(records, 20).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "admitted")


@query("dq_2_envelopes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'missing:value' WHEN 2 THEN 'unknown:extra' ELSE '' END AS problems FROM events")
def dq_2(spark, d):
    k = F.col("event_id") % 4
    doc = F.when(k == 0, F.lit("{oops")).when(k == 1, F.to_json(F.struct("event_type"))).when(k == 2, F.to_json(F.struct("event_type", "value", F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct("event_type", "value")))
    return Q.envelope_problems(table(spark, d, "events").select("event_id", doc.alias("doc")), "doc", ("event_type", "value")).select("event_id", F.array_join("problems", ",").alias("problems"))


@query("dq_2_signal_envelopes", """SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'missing:universe_hash' WHEN 2 THEN 'unknown:extra' WHEN 3 THEN 'version,digest' WHEN 4 THEN 'hex:model_content_digest,digest' WHEN 5 THEN 'time:data_watermark,digest' WHEN 6 THEN 'after_decision' WHEN 7 THEN 'session' WHEN 8 THEN 'signals,digest' WHEN 9 THEN 'pair:btc/USD' WHEN 10 THEN 'digest' WHEN 11 THEN 'calendar,digest' ELSE '' END AS problems FROM events""")
def dq_2_signals(spark, d):
    """Envelopes made of all events, one planted fault for each remainder; digests cover what stood there before or, for some, with the fault."""
    k, ts = F.col("event_id") % 13, F.col("ts")
    when = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    hexed = lambda c: F.sha2(F.col(c).cast("string"), 256)
    fields = {
        "asset_class": F.lit("crypto"), "calibrator_content_digest": hexed("event_type"), "data_watermark": stamp(when(6, F.expr("ts + interval 1 hour"), ts)), "decision_timestamp": stamp(ts),
        "model_content_digest": hexed("user_id"), "producer_run_id": F.concat(F.lit("run-"), F.col("event_id").cast("string")), "schema_version": F.lit(1), "session_calendar": F.lit("UTC"),
        "session_date": when(7, F.date_add(F.to_date("ts"), 1), F.to_date("ts")).cast("string"), "universe_hash": F.lit("u"),
        "signals": F.create_map(when(9, F.lit("btc/USD"), F.lit("BTC/USD")), F.coalesce("value", F.lit(0.0)), F.lit("ETH/USD"), F.lit(1.5)),
    }
    names = [part.split(" ")[0] for part in Q.ENVELOPE.split(", ")]
    made = table(spark, d, "events").select("event_id", "ts", F.struct(*[fields.get(c, F.lit(None).cast("string")).alias(c) for c in names]).alias("doc"))
    made = made.withColumn("doc", F.col("doc").withField("signal_snapshot_digest", Q.envelope_digest(F.col("doc"))))
    doc = F.col("doc")
    faults = {"schema_version": (3, F.lit(2)), "model_content_digest": (4, F.lit("XYZ")), "data_watermark": (5, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "signals": (8, F.create_map(F.lit("BTC/USD"), F.lit(None).cast("double"))), "producer_run_id": (10, F.lit("another")), "session_calendar": (11, F.lit("NYSE"))}
    for c, (n, bad) in faults.items():
        doc = doc.withField(c, when(n, bad, doc[c]))
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    text = F.when(k == 0, F.lit("{oops")).when(k == 1, F.to_json(doc.dropFields("universe_hash"))).when(k == 2, F.to_json(doc.withField("extra", F.lit(1)))).otherwise(text)
    return Q.signal_envelope_problems(made.select("event_id", text.alias("doc")), "doc").select("event_id", F.array_join("problems", ",").alias("problems"))


@query("dq_3_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey)::BIGINT AS contents, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def dq_3(spark, d):
    return Q.content_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("dq_4_source_consistency", "SELECT count(DISTINCT o_orderstatus)::BIGINT AS digests, 1::BIGINT AS ends, count(*) FILTER (date_diff('day', o_orderdate::DATE, DATE '2001-12-31') < 500)::BIGINT AS short, false AS ok FROM orders")
def dq_4(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("decision"), F.lit("2001-12-31").cast("date").alias("end"))
    return Q.source_consistency(rows, "o_orderstatus", "end", "decision", 500)


@query("dq_5_axis_audit", """WITH a AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-06-01')), o AS (SELECT o_orderdate::DATE AS date, DATE '1997-01-01' AS cutoff FROM orders)
SELECT count(*)::BIGINT AS rows, count(*) FILTER (o.date <= cutoff)::BIGINT AS at_or_before_cutoff, count(*) FILTER (pos IS NULL OR pos + 60 > (SELECT max(pos) FROM a))::BIGINT AS unverifiable, round(avg((pos IS NULL OR pos + 60 > (SELECT max(pos) FROM a))::INT), 9) AS share FROM o LEFT JOIN a USING (date)""")
def dq_5(spark, d):
    axis = X.date_axis(table(spark, d, "lineitem").where("l_shipdate < timestamp'2001-06-01'").select(F.to_date("l_shipdate").alias("date"))).select("date", "pos")
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.lit("1997-01-01").cast("date").alias("cutoff"))
    return Q.axis_audit(rows, axis, 60).withColumn("share", F.round("share", 9))


@query("dq_7_hash_chain", """WITH r AS (SELECT o_custkey % 8 AS chain, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT chain::BIGINT AS chain, i::INT AS row_index, 'altered' AS problem FROM r WHERE i = 5 UNION ALL SELECT chain::BIGINT, i::INT, 'gap' FROM r WHERE i = 10 UNION ALL SELECT chain::BIGINT, i::INT, 'broken_link' FROM r WHERE i = 10 UNION ALL SELECT chain::BIGINT, i::INT, 'altered' FROM r WHERE i = 16 UNION ALL SELECT chain::BIGINT, max(i)::INT, 'altered' FROM r GROUP BY 1""")
def dq_7(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("chain"), "o_orderkey", F.col("o_totalprice").cast("string").alias("text"))
    rows = o.withColumn("row_index", F.row_number().over(Window.partitionBy("chain").orderBy("o_orderkey")) - 1)
    # Written, since the hashes are made in sequence and what follows is not.
    ledger = written(Q.chain_hashes(rows, "row_index", "text"))
    tampered = ledger.withColumn("text", F.when(F.col("row_index") == 5, F.lit("0")).otherwise(F.col("text"))).where("row_index <> 9")
    # Row 15 is replaced with a fresh hash and the link behind it patched: row 16 no longer matches its own.
    forged = F.sha2(F.concat_ws("|", F.lit("15"), F.lit("forged"), F.coalesce("prev_row_sha", F.lit("-"))), 256)
    tampered = tampered.withColumns({"text": F.when(F.col("row_index") == 15, F.lit("forged")).otherwise(F.col("text")), "row_sha": F.when(F.col("row_index") == 15, forged).otherwise(F.col("row_sha"))})
    # One row per chain: the hash of row 15, and the last row.
    ends = tampered.groupBy(F.col("chain").alias("_chain")).agg(F.max(F.when(F.col("row_index") == 15, F.col("row_sha"))).alias("_link"), F.max("row_index").alias("_end"))
    tampered = tampered.join(F.broadcast(ends), F.col("chain").eqNullSafe(F.col("_chain")))
    tampered = tampered.withColumn("prev_row_sha", F.when(F.col("row_index") == 16, F.col("_link")).otherwise(F.col("prev_row_sha")))
    # The last row of each chain is changed and its hash taken away: no link follows that could tell.
    last = F.col("row_index") == F.col("_end")
    tampered = tampered.withColumns({"text": F.when(last, F.lit("forged")).otherwise(F.col("text")), "row_sha": F.when(~last, F.col("row_sha"))}).drop("_chain", "_link", "_end")
    return Q.chain_violations(tampered, "row_index", "text", "o_orderkey")


@query("dq_8_series_problems", """WITH s AS (SELECT l_shipdate::DATE AS date, sum(l_quantity) AS v FROM lineitem WHERE day(l_shipdate) <> 13 GROUP BY 1), a AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)
SELECT date, 'missing' AS problem FROM a WHERE day(date) = 13 AND date BETWEEN (SELECT min(date) FROM s) AND (SELECT max(date) FROM s) UNION ALL SELECT date, 'not finite' FROM s WHERE day(date) = 20 UNION ALL SELECT date, 'repeated' FROM s WHERE day(date) = 25""")
def dq_8(spark, d):
    days = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    s = days.where(F.day("date") != 13).groupBy("date").agg(F.sum("l_quantity").alias("v")).withColumn("v", F.when(F.day("date") == 20, float("nan")).otherwise(F.col("v")))
    return Q.series_problems(s.union(s.where(F.day("date") == 25)), "v", days.select("date").distinct())


@query("dq_9_moments_gate", f"{WITH}, z AS (SELECT (x1 - 5) / 2 AS a, (x2 - (SELECT avg(x2) FROM sm)) / (SELECT stddev_samp(x2) FROM sm) AS b FROM sm), s AS (SELECT avg(a) AS m, stddev_samp(a) AS s FROM z UNION ALL SELECT avg(b), stddev_samp(b) FROM z) SELECT round(avg((abs(m) <= 0.1 AND s BETWEEN 0.9 AND 1.1)::INT), 9) AS share, count(*)::BIGINT AS n FROM s")
def dq_9(spark, d):
    panel = supplier_month(spark, d)
    stats = panel.agg(F.avg("x2").alias("_m"), F.stddev_samp("x2").alias("_s"))
    z = panel.join(F.broadcast(stats)).select(((F.col("x1") - 5) / 2).alias("a"), ((F.col("x2") - F.col("_m")) / F.col("_s")).alias("b"))
    return Q.moments_gate(z, ["a", "b"])


@query("dq_10_table_stats", f"{WITH} SELECT count(*)::BIGINT AS rows, count(DISTINCT date)::BIGINT AS dates, count(DISTINCT key)::BIGINT AS keys, min(date) AS first, max(date) AS last FROM sm")
def dq_10(spark, d):
    return Q.table_stats(supplier_month(spark, d), "date", "key")


@query("dq_11_field_parity", "SELECT event_id AS id, 'k' AS field, 'type' AS problem FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'name', 'missing' FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'z', 'unexpected' FROM events WHERE event_id % 3 = 2")
def dq_11(spark, d):
    k = F.col("event_id") % 3
    doc = F.when(k == 1, F.lit('{"k":"a"}')).when(k == 2, F.lit('{"k":1,"name":"n","z":2}')).otherwise(F.lit('{"k":5}'))
    return Q.field_parity(table(spark, d, "events").select(F.col("event_id").alias("id"), doc.alias("doc")), "doc", '{"k":1,"name":"x"}')


# Sources and sinks


@query("src_1_panel_scan", f"{WITH} SELECT date, key, {R('y')} AS y FROM sm WHERE y IS NOT NULL AND key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND date < DATE '1999-12-03'")
def src_1(spark, d):
    keys = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"))
    return R_.panel(supplier_month(spark, d), "y", keys=keys, cutoff="1999-12-31", embargo=20).select("date", "key", tidy("y").alias("y"))


@query("src_2_per_key_files", "SELECT l_returnflag AS key, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1")
def src_2(spark, d):
    path = scratch(spark)
    K_.write_panel(table(spark, d, "lineitem").withColumn("key", F.col("l_returnflag")), path, ["key"])
    return R_.per_key_files(spark, path).groupBy("key").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("src_3_daily_last", "SELECT ts::DATE AS day, user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def src_3(spark, d):
    e = table(spark, d, "events").withColumnRenamed("ts", "Timestamp")
    return R_.utc_daily_last(e, ("date", "timestamp"), "user_id", "event_id").select("day", "user_id", "value")


@query("src_4_raw_bars", "SELECT 'a' AS part, count(*)::BIGINT AS n, 0::BIGINT AS dividends FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'b', count(*)::BIGINT, count(*) FILTER (o_custkey % 3 = 0)::BIGINT FROM orders WHERE o_custkey % 2 = 1")
def src_4(spark, d):
    path, o = scratch(spark), table(spark, d, "orders")
    o.where("o_custkey % 2 = 0").select("o_orderkey", F.lit("a").alias("part")).write.parquet(f"{path}/a")
    o.where("o_custkey % 2 = 1").select("o_orderkey", F.lit("b").alias("part"), F.when(F.col("o_custkey") % 3 == 0, 1.0).alias("dividend")).write.parquet(f"{path}/b")
    merged = spark.read.option("mergeSchema", True).parquet(f"{path}/a", f"{path}/b")
    return merged.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce("dividend", F.lit(0.0)) > 0, 1)).alias("dividends"))


@query("src_5_semi_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AND l_shipdate::DATE IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'P')")
def src_5(spark, d):
    keys = table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    dates = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("date"))
    lines = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return lines.join(keys, "l_suppkey", "left_semi").join(dates, "date", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("src_6_news_scan", "SELECT event_type AS symbol, ts::DATE AS day, count(*)::BIGINT AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2")
def src_6(spark, d):
    path = scratch(spark)
    table(spark, d, "events").withColumn("symbol", F.col("event_type")).write.partitionBy("symbol").parquet(path)
    return spark.read.parquet(path).where(F.col("symbol").isin("click", "error")).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("src_7_csv_returns", "SELECT o_orderdate::DATE AS date, o_custkey::VARCHAR AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 4 <> 0")
def src_7(spark, d):
    path = scratch(spark)
    bad = F.when(F.col("o_orderkey") % 4 == 0, F.when(F.col("o_orderkey") % 8 == 0, "n/a").otherwise("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    table(spark, d, "orders").select(F.to_date("o_orderdate").alias("prediction_date"), F.col("o_custkey").alias("symbol"), bad.alias("Forward_Return")).write.option("header", True).csv(path)
    return R_.csv_returns(spark, path)


@query("src_8_json_scores", f"WITH {UD} SELECT date, key::VARCHAR AS key, value AS score FROM ud WHERE value IS NOT NULL")
def src_8(spark, d):
    path = scratch(spark)
    cells = user_day(spark, d).where("value is not null").select("date", F.col("key").cast("string").alias("key"), F.col("value").alias("score"))
    K_.write_score_files(cells, path)
    return R_.json_scores(spark, path).select("date", "key", "score")


@query("src_9_json_corpus", "SELECT count(*) FILTER (n_nationkey % 5 <> 0)::BIGINT AS readable, count(*) FILTER (n_nationkey % 5 = 0)::BIGINT AS unreadable FROM nation")
def src_9(spark, d):
    path = scratch(spark)
    doc = F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("n_name", "n_regionkey")))
    table(spark, d, "nation").repartition(25, "n_nationkey").select(doc.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    read = R_.json_objects(spark, path, "n_name string, n_regionkey int")
    bad = F.col("_corrupt_record").isNotNull() | F.col("n_name").isNull()
    return read.agg(F.count(F.when(~bad, 1)).alias("readable"), F.count(F.when(bad, 1)).alias("unreadable"))


@query("src_10_json_lines", "SELECT event_type, count(*) FILTER (event_id % 50 <> 0)::BIGINT AS good FROM events GROUP BY 1 UNION ALL SELECT 'bad', count(*) FILTER (event_id % 50 = 0)::BIGINT FROM events")
def src_10(spark, d):
    path = scratch(spark)
    line = F.when(F.col("event_id") % 50 == 0, F.lit("{x")).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    read = R_.json_lines(spark, path, "event_id long, event_type string, value double")
    return read.groupBy(F.when(F.col("bad"), "bad").otherwise(F.col("event_type")).alias("event_type")).agg(F.count("*").alias("good"))


@query("src_11_relational_read", "SELECT DISTINCT ts::DATE AS date, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10' AND nullif(event_type, 'view') IS NOT DISTINCT FROM NULL")
def src_11(spark, d):
    e = table(spark, d, "events").where(F.col("ts").between(F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")))
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return e.where(kind.eqNullSafe(F.lit(None))).select(F.to_date("ts").alias("date"), "event_type").distinct()


@query("src_12_file_tree", "SELECT count(DISTINCT n_regionkey)::BIGINT AS files, count(DISTINCT n_regionkey)::BIGINT AS digests FROM nation")
def src_12(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").repartition("n_regionkey").write.partitionBy("n_regionkey").json(path)
    tree = R_.file_tree(spark, path).where(~F.col("name").startswith("_") & ~F.col("name").startswith(".") & F.col("name").endswith(".json"))
    return tree.agg(F.count("*").alias("files"), F.countDistinct("sha256").alias("digests"))


@query("src_13_file_null_rates", "SELECT 2::BIGINT AS files, count(*)::BIGINT AS n, 0.5::DOUBLE AS null_rate FROM region")
def src_13(spark, d):
    path, r = scratch(spark), table(spark, d, "region")
    r.select("r_regionkey").coalesce(1).write.parquet(f"{path}/a")
    r.select("r_regionkey", "r_name").coalesce(1).write.parquet(f"{path}/b")
    rates = R_.file_null_rates(spark.builder.getOrCreate(), f"{path}/*", ["r_name"])
    return rates.agg(F.count("*").alias("files"), F.max("n").alias("n"), F.avg("r_name").alias("null_rate"))


@query("src_13_footer_columns", """WITH e AS (SELECT *, event_id % 3 AS part FROM events) SELECT CASE part WHEN 0 THEN 'event_id,value' WHEN 1 THEN 'event_id,user_id,value' ELSE 'event_id,event_type' END AS columns, count(*)::BIGINT AS n, CASE WHEN part < 2 THEN count(*) FILTER (value IS NULL OR value > 40)::BIGINT END AS nulls FROM e GROUP BY part""")
def src_13_footers(spark, d):
    """Column tuples over a tree of files that differ in columns, with rows and nulls, none of which is read but the footers."""
    path, e = scratch(spark), table(spark, d, "events").withColumn("value", F.when(F.col("value") <= 40, F.col("value")))
    for part, names in enumerate((["event_id", "value"], ["event_id", "user_id", "value"], ["event_id", "event_type"])):
        e.where(F.col("event_id") % 3 == part).select(*names).write.parquet(f"{path}/{part}")
    found = R_.footers(spark, path)
    return found.groupBy(F.array_join("columns", ",").alias("columns")).agg(F.sum("n").alias("n"), F.sum(F.try_element_at("nulls", F.lit("value"))).alias("nulls"))


@query("src_14_label_fallback", f"{WITH} SELECT date, key, {R('y')} AS y FROM sm")
def src_14(spark, d):
    panel = supplier_month(spark, d)
    return R_.label_source(panel.drop("y"), panel, ["date", "key"], "y").select("date", "key", tidy("y").alias("y"))


@query("src_15_map_dimension", "SELECT n_name AS key, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_15(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    doc = n.groupBy("r_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("r_name").alias("sector")))))).alias("doc"))
    return R_.map_dimension(doc, "doc", "sector")


@query("snk_1_panel", f"{WITH} SELECT year(date)::INT AS year, count(*)::BIGINT AS n, sum(volume)::BIGINT AS volume FROM sm GROUP BY 1")
def snk_1(spark, d):
    path = scratch(spark)
    K_.write_panel(supplier_month(spark, d).withColumn("year", F.year("date")), path, ["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("snk_2_series", "WITH a AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'P') SELECT (SELECT count(*) FROM (SELECT date FROM a UNION SELECT date FROM b))::BIGINT AS rows, (SELECT count(*) FROM a JOIN b USING (date))::BIGINT AS paired, (SELECT min(date) FROM (SELECT date FROM a UNION SELECT date FROM b)) AS first, (SELECT max(date) FROM (SELECT date FROM a UNION SELECT date FROM b)) AS last")
def snk_2(spark, d):
    o = orders(spark, d)
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("date").agg(F.sum("o_totalprice").alias("v"))
    return K_.write_series({"f": side("F"), "p": side("P")}, "v", scratch(spark))


@query("snk_3_score_files", f"WITH {UD} SELECT date, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM ud GROUP BY 1")
def snk_3(spark, d):
    path = scratch(spark)
    K_.write_score_files(user_day(spark, d).select("date", F.col("key").cast("string").alias("key"), F.col("value").alias("score")), path)
    return R_.json_scores(spark, path).groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("snk_4_append", "SELECT event_type, 2 * count(*)::BIGINT AS n FROM events GROUP BY 1")
def snk_4(spark, d):
    path, e = scratch(spark), table(spark, d, "events").select("event_id", "event_type")
    K_.append(e, path)
    K_.append(e, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk_5_parameters", f"{WITH} SELECT 'x1' AS feature, {R('avg(x1)')} AS mean FROM sm UNION ALL SELECT 'x2', {R('avg(x2)')} FROM sm")
def snk_5(spark, d):
    path = scratch(spark)
    K_.write_parameters(X.fit_moments(supplier_month(spark, d), FEATURES), path)
    return spark.read.parquet(path).select("feature", tidy("mean").alias("mean"))


@query("snk_5_saved_scorer", f"{WITH}, {PLAIN} SELECT date, key, {R('w1 * x1 + w2 * x2', 6)} AS score FROM sm, w")
def snk_5_scorer(spark, d):
    """A fitted line's coefficients are stored as a table, read back, and score the panel."""
    path, model = scratch(spark), ML.fit_linear(labelled(spark, d), FEATURES, "y")
    K_.write_parameters(ML.coefficients(model, FEATURES, spark), path)
    weights = {r["feature"]: r["weight"] for r in spark.read.parquet(path).collect()}
    return supplier_month(spark, d).select("date", "key", tidy(sum(F.col(f) * w for f, w in sorted(weights.items())), 6).alias("score"))


@query("snk_5_saved_ensemble")
def snk_5_ensemble(spark, d):
    """A boosted ensemble is saved, its nodes are read back as a table, and score the panel."""
    panel, path = tree_panel(spark, d), scratch(spark)
    ML.fit_trees(panel, TREE_FEATURES, "target", rounds=5).write().save(path)
    return panel.select("date", "key", WF.ensemble_score(WF.stored_nodes(spark, path), TREE_FEATURES).alias("score"))


# Streams


def arriving(rows, out, path, mode="append"):
    """Runs a stream's sink over all that has arrived, and stops; called again, it goes on from its checkpoint with what is new."""
    q = out(rows).writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck")
    q.trigger(availableNow=True).start().awaitTermination()


def streamed(spark, source, build, mode="append", files=2, parts=()):
    """Runs a query over a table's files as a stream to its end and gives what it wrote.

    parts: predicates that cut the table into pieces which arrive one after the other, a batch each, in any number of files.
    """
    path = scratch(spark)
    reader = spark.readStream.schema(source.schema)
    if not parts:
        reader = reader.option("maxFilesPerTrigger", files)
    for piece in [source.where(p) for p in parts] or [source]:
        piece.write.mode("append").parquet(f"{path}/in")
        arriving(reader.parquet(f"{path}/in"), build, path, mode)
    return spark.read.parquet(f"{path}/out")


@query("stm_1_rolling_buffer", "WITH e AS (SELECT user_id::VARCHAR AS key, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT key, (count(*) - 4)::BIGINT AS full_buffers, (round(sum(coalesce(value, 0)) FILTER (rn > n - 5), 6) + 0.0) AS newest FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM e) GROUP BY 1 HAVING count(*) > 4")
def stm_1(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), F.coalesce("value", F.lit(0.0)).alias("value"), "event_id")
    order = F.concat_ws("#", "date", F.lpad(F.col("event_id").cast("string"), 20, "0"))
    # Three pieces in order of time, so that buffers are carried from batch to batch.
    cuts = ["date < '2024-01-11'", "date >= '2024-01-11' and date < '2024-01-21'", "date >= '2024-01-21'"]
    out = streamed(spark, e, lambda rows: ST.rolling_buffer(rows.select("key", order.alias("date"), "value"), 5), parts=cuts)
    newest = F.aggregate(F.max_by("values", "date"), F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("key").agg(F.count("*").alias("full_buffers"), tidy(newest, 6).alias("newest"))


@query("stm_2_warm_up", "SELECT user_id::VARCHAR AS key, least(count(*), 4)::INT AS n FROM events GROUP BY 1")
def stm_2(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("date"), "value")
    return ST.warm_up(e, 5).select("key", F.size("values").alias("n"))


def ordered_events(spark, d):
    """key, date (time and id, in order as text), value of all events."""
    order = F.concat_ws("#", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), order.alias("date"), F.coalesce("value", F.lit(0.0)).alias("value"))


CONTINUED = """e AS (SELECT user_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '#' || lpad(event_id::VARCHAR, 20, '0') AS date, coalesce(value, 0) AS value FROM events),
w AS (SELECT key, date, sum(value) OVER b AS total, first_value(value) OVER b AS oldest, count(*) OVER b AS n FROM e WINDOW b AS (PARTITION BY key ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
CUT = "2024-01-11"


def continued(spark, d):
    """The folder of a stream over events from CUT on, in two batches, that goes on from the buffers of those before."""
    ST.stateful(spark)
    path, e = scratch(spark), ordered_events(spark, d)
    first = written(ST.warm_up(e.where(F.col("date") < CUT), 5))
    # Pieces arrive in order of their time, each as one batch.
    for piece in (e.where(F.col("date").between(CUT, "2024-01-21")), e.where(F.col("date") > "2024-01-21")):
        piece.write.mode("append").parquet(f"{path}/in")
        arriving(spark.readStream.schema(e.schema).parquet(f"{path}/in"), lambda rows: ST.continued_buffer(rows, 5, first), path)
    return path


@query("stm_2_continued_buffer", f"WITH {CONTINUED} SELECT key, date, (round(total, 6) + 0.0) AS total, oldest FROM w WHERE n = 5 AND date >= '{CUT}'")
def stm_2_continued(spark, d):
    """All full windows of a stream that was started from its history's state."""
    out = spark.read.parquet(f"{continued(spark, d)}/out")
    return out.select("key", "date", tidy(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.col("values")[0].alias("oldest"))


@query("stm_2_stored_state", f"WITH {CONTINUED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS k FROM e) SELECT key, count(*)::INT AS n, (round(sum(value), 6) + 0.0) AS total, max(value) AS highest FROM r WHERE k < 5 GROUP BY 1")
def stm_2_state(spark, d):
    """The buffers that the stream has left in its state store, read back as a table."""
    values = ST.stored_buffers(spark, f"{continued(spark, d)}/ck")
    return values.select("key", F.size("values").alias("n"), tidy(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.array_max("values").alias("highest"))


@query("stm_1_ranked_windows", f"""WITH {UD}, k AS (SELECT key::VARCHAR AS key, date::VARCHAR AS date, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY date) - 0.5 AS value FROM ud WHERE value IS NOT NULL),
w AS (SELECT key, date, sum(value) OVER b AS total, count(*) OVER b AS n FROM k WINDOW b AS (PARTITION BY key ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT key, date, {R('total', 8)} AS total FROM w WHERE n = 3""")
def stm_1_ranked(spark, d):
    """Days arrive in batches, are ranked across keys, and a second stream makes windows of each key's ranks."""
    ST.stateful(spark)
    path, days = scratch(spark), written(user_day(spark, d).where("value is not null").select(F.col("key").cast("string").alias("key"), F.col("date").cast("string").alias("date"), "value"))
    # Each piece is a batch of the first stream, whose ranks are a batch of the second, in any number of files.
    for piece in (days.where(F.col("date") < CUT), days.where(F.col("date") >= CUT)):
        piece.write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(days.schema).parquet(f"{path}/in")
        rows.writeStream.foreachBatch(ST.ranked_sink("value", f"{path}/ranked")).option("checkpointLocation", f"{path}/ck1").trigger(availableNow=True).start().awaitTermination()
        ranked = spark.readStream.schema("key string, date string, value double, ranked double").parquet(f"{path}/ranked/*")
        arriving(ranked, lambda r: ST.continued_buffer(r.select("key", "date", F.col("ranked").alias("value")), 3), path)
    return spark.read.parquet(f"{path}/out").select("key", "date", tidy(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 8).alias("total"))


@query("stm_3_immature_rows", "SELECT CASE WHEN ts::DATE <= DATE '2024-01-15' THEN 'accepted' ELSE 'refused' END AS sink, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stm_3(spark, d):
    path = scratch(spark)
    table(spark, d, "events").withColumn("date", F.to_date("ts")).write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    rows = spark.readStream.schema(schema).parquet(f"{path}/in")
    write = ST.split_sinks(rows, ST.mature(F.col("date"), "2024-01-29", 8, 2), f"{path}/good", f"{path}/late")
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    both = spark.read.parquet(f"{path}/good").select(F.lit("accepted").alias("sink")).union(spark.read.parquet(f"{path}/late").select(F.lit("refused")))
    return both.groupBy("sink").agg(F.count("*").alias("n"))


@query("stm_4_causal_rule", "SELECT coalesce(CASE WHEN event_id % 9 = 0 THEN 'watermark_after_decision' WHEN event_id % 9 = 1 THEN 'no_watermark' END, 'ok') AS reason, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stm_4(spark, d):
    k = F.col("event_id") % 9
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("decision"), F.when(k == 0, F.col("ts") + F.expr("interval 1 hour")).when(k != 1, F.col("ts")).alias("watermark"))
    out = streamed(spark, e, lambda rows: rows.select("event_id", F.coalesce(ST.causal("watermark", "decision"), F.lit("ok")).alias("reason")))
    return out.groupBy("reason").agg(F.count("*").alias("n"))


@query("stm_5_append_once", "SELECT 'appended' AS state, count(*) FILTER (event_id % 2 = 1)::BIGINT AS n FROM events UNION ALL SELECT 'conflict', count(*) FILTER (event_id % 10 = 0)::BIGINT FROM events")
def stm_5(spark, d):
    e = table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("value").cast("string")), 256).alias("content"))
    target = e.where("event_id % 2 = 0").withColumn("content", F.when(F.col("event_id") % 10 == 0, F.lit("other")).otherwise(F.col("content")))
    return ST.append_once(e.union(e.where("event_id % 3 = 0 and event_id % 2 = 1")), target, ["event_id"], "content").groupBy("state").agg(F.count("*").alias("n"))


@query("stm_6_daily_log", "SELECT ts::DATE AS day, count(*)::BIGINT AS n, round(avg((value > 25)::INT), 9) AS agreement FROM events GROUP BY 1 HAVING ts::DATE < (SELECT max(ts)::DATE FROM events)")
def stm_6(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 25).alias("agree"))
    out = streamed(spark, e, lambda rows: ST.daily_log(rows, "ts"), files=1000)
    last = table(spark, d, "events").agg(F.to_date(F.max("ts")).alias("_m"))
    return out.join(F.broadcast(last)).where(F.col("day") < F.col("_m")).select("day", "n", F.round("agreement", 9).alias("agreement"))


# User functions


@query("udf_1_text_scorer", "SELECT item_id, CASE WHEN length(trim(text)) > 0 THEN (length(text) % 7)::DOUBLE END AS sentiment FROM benchmark")
def udf_1(spark, d):
    return U.score_texts(table(spark, d, "benchmark"), "text", lambda texts: [float(len(t) % 7) for t in texts]).select("item_id", "sentiment")


@query("udf_2_readers", "SELECT r_name, count(*)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def udf_2(spark, d):
    build = lambda nations, regions: nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return U.with_readers(build, nations=lambda: table(spark, d, "nation"), regions=lambda: table(spark, d, "region"))


@query("udf_3_pipeline", f"{WITH} SELECT date, count(*)::BIGINT AS n FROM sm WHERE y IS NOT NULL AND volume > 100 GROUP BY 1")
def udf_3(spark, d):
    return U.pipeline(supplier_month(spark, d), lambda t: t.where("y is not null"), lambda t: t.where("volume > 100"), lambda t: t.groupBy("date").agg(F.count("*").alias("n")))


@query("udf_4_per_date", f"{WITH} SELECT date, {R('median(x2)', 8)} AS mid FROM sm GROUP BY 1")
def udf_4(spark, d):
    def middle(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"date": [rows["date"].iloc[0]], "mid": [rows["x2"].median()]})

    return U.per_date(supplier_month(spark, d).select("date", "x2"), middle, "date date, mid double").select("date", tidy("mid", 8).alias("mid"))


@query("udf_5_aggregates", f"{WITH} SELECT key, {R('covar_pop(x2, y) / nullif(stddev_pop(x2) * stddev_pop(y), 0)', 7)} AS ic, {R('avg(y) / (stddev_samp(y) / sqrt(count(y)))', 6)} AS t FROM sm WHERE y IS NOT NULL GROUP BY 1")
def udf_5(spark, d):
    return labelled(spark, d).groupBy("key").agg(tidy(S.correlation("x2", "y"), 7).alias("ic"), tidy(S.t_statistic("y"), 6).alias("t"))
