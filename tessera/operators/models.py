"""Model fitting and scoring on Spark ML, and what reads fitted parameters as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, rho for each pair of features, over rows that have them all; the matrix is as large as the number of features squared."""
    from pyspark.ml.stat import Correlation

    found = Correlation.corr(_vectors(df, features).select("features"), "features").first()[0].toArray()
    rows = [(a, b, float(found[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, rho double")


def deduplicated(pairs: DataFrame, threshold: float) -> DataFrame:
    """feature, place, kept: the greedy choice of features that no label enters; pairs is a matrix (a, b, rho) with each pair once.

    Features are looked at by the sum of their absolute correlations, largest first (then by name),
    and kept if none kept before correlates with them beyond the threshold. A feature whose earlier
    neighbours are all decided is decided itself, so the driver's rounds are as many as the longest
    chain of neighbours; the table is as small as the matrix.
    """
    both = pairs.select("a", "b", F.coalesce(F.abs("rho"), F.lit(0.0)).alias("r"))
    both = both.union(both.select("b", "a", "r"))
    order = Window.orderBy(F.desc("_w"), "a")
    places = {row["a"]: row["place"] for row in both.groupBy("a").agg(F.round(F.sum("r"), 12).alias("_w")).select("a", F.row_number().over(order).alias("place")).collect()}
    earlier: dict[str, list[str]] = {f: [] for f in places}
    for row in both.where(F.col("r") > threshold).collect():
        if places[row["b"]] < places[row["a"]]:
            earlier[row["a"]].append(row["b"])
    kept: dict[str, bool] = {}
    while len(kept) < len(places):
        ready = [f for f in places if f not in kept and all(e in kept for e in earlier[f])]
        kept |= {f: not any(kept[e] for e in earlier[f]) for f in ready}
    return pairs.sparkSession.createDataFrame([(f, places[f], kept[f]) for f in places], "feature string, place int, kept boolean")


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def missing_columns(df: DataFrame, features: list[str]) -> None:
    """Refuses a table that lacks a feature."""
    lacking = [f for f in features if f not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")


def fit_linear(df: DataFrame, features: list[str], label: str):
    """Least squares through the origin."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol=label, fitIntercept=False, standardization=False, solver="normal").fit(_vectors(df, features))


def _product_sums(features: list[str], label: str) -> dict:
    return {f"{a}|{b}": F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for i, a in enumerate(features) for b in [*features[i:], label]}


def _solved(got, features: list[str], label: str, penalty: float) -> dict[str, float]:
    import numpy as np

    pair = lambda a, b: got[f"{a}|{b}"] if f"{a}|{b}" in got else got[f"{b}|{a}"]
    gram = np.array([[pair(a, b) for b in features] for a in features])
    weights = np.linalg.lstsq(gram + penalty * np.eye(len(features)), np.array([got[f"{a}|{label}"] for a in features]), rcond=None)[0]
    return dict(zip(features, weights.tolist()))


def ridge_weights(df: DataFrame, features: list[str], label: str, penalty: float) -> dict[str, float]:
    """Weights of least squares through the origin with a penalty on the sum of their squares.

    One aggregate of all products, as large as the number of features squared; the small system is solved on the driver.
    """
    return _solved(df.agg(*[v.alias(k) for k, v in _product_sums(features, label).items()]).collect()[0].asDict(), features, label, penalty)


def weights_by(df: DataFrame, by: str, features: list[str], label: str) -> dict:
    """Weights of least squares through the origin for each value of by (of which there are few), and for all rows under None.

    Rows without a label or a feature do not count. One aggregate of all products by group, which add
    up to those of all rows; the small systems are solved on the driver.
    """
    whole = df.where(F.col(by).isNotNull()).na.drop(subset=[*features, label])
    sums = {r[by]: r.asDict() for r in whole.groupBy(by).agg(*[v.alias(k) for k, v in _product_sums(features, label).items()]).collect()}
    names = list(_product_sums(features, label))
    groups = {**sums, None: {k: sum(s[k] for s in sums.values()) for k in names}} if sums else {}
    return {g: _solved(s, features, label, 0.0) for g, s in groups.items()}


def coefficients(model, features: list[str], spark) -> DataFrame:
    """feature, weight of a linear model as a table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("weight")) for f, w in zip(features, model.coefficients)]))
    return spark.range(1).select(pairs.alias("p")).select("p.*")


def linear_score(weights: dict[str, float], bound: float = 5.0):
    """The score as one column expression: clipped features times weights; null and NaN count as 0."""
    out = F.lit(0.0)
    for f, w in weights.items():
        x = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
        out = out + F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)) * w
    return out


def fit_trees(df: DataFrame, features: list[str], label: str, *, classify: bool = False, rounds: int = 10, depth: int = 3, seed: int = 1, least: int = 20, share: float = 0.7):
    """Gradient-boosted trees on a label (for ranking: its percentile rank within the date)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    kind = GBTClassifier if classify else GBTRegressor
    return kind(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, minInstancesPerNode=least, subsamplingRate=share, seed=seed).fit(_vectors(df, features))


def score(model, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """Adds the model's score: the probability of 1 for classifiers, else the prediction."""
    from pyspark.ml.functions import vector_to_array

    missing_columns(df, features)
    out = model.transform(_vectors(df, features))
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn(name, value).select(*df.columns, name)


def importance(model, features: list[str], spark) -> DataFrame:
    """feature, gain, cumulative share, by gain."""
    from pyspark.sql import Window

    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("gain")) for f, w in zip(features, model.featureImportances.toArray())]))
    table = spark.range(1).select(pairs.alias("p")).select("p.*")
    w = Window.orderBy(F.desc("gain"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cumulative", F.sum("gain").over(w))


def fit_by_fold(rows: DataFrame, features: list[str], fit, *, normalise: bool = True) -> DataFrame:
    """All columns of rows (fold, part, ...) and score: each fold's model, fitted on its part 'train', scores both of its parts.

    rows is the long form of all folds. With normalise, features become z-scores by the moments of the
    fold's own train rows. fit takes the fold's train rows and gives a model. Folds are as many as there
    are models to fit; their number and each fold's moments are all that the driver sees. rows is written
    once, since every fold reads it several times.
    """
    from ..sources.scratch import written
    from .cross_section import fit_moments

    rows, out = written(rows), None
    for (fold,) in rows.select("fold").distinct().orderBy("fold").collect():
        own = rows.where(F.col("fold") == fold)
        scaled = own
        if normalise:
            moments = {r["feature"]: (r["mean"], r["std"]) for r in fit_moments(own.where("part = 'train'").select(*[F.col(f).cast("double") for f in features]), features).collect()}
            scaled = own.withColumns({f: (F.col(f) - moments[f][0]) / moments[f][1] for f in features})
        scored = score(fit(scaled.where("part = 'train'")), scaled, features)
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.withColumn("score", F.lit(None).cast("double"))


def hit_label(df: DataFrame, value: str, threshold: float | None, name: str = "hit") -> DataFrame:
    """Adds 1.0 where the value reaches the threshold, or its date's median where that is None, else 0.0; null stays null."""
    if threshold is not None:
        return df.withColumn(name, (F.col(value) >= threshold).cast("double"))
    medians = df.groupBy("date").agg(F.median(value).alias("_m"))
    return df.join(medians, "date").withColumn(name, (F.col(value) >= F.col("_m")).cast("double")).drop("_m")


def fit_calibration(df: DataFrame, x: str, y: str, spark) -> DataFrame:
    """x, y: breakpoints of an isotonic fit of y on x."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=x, labelCol=y).fit(df)
    points = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(model.boundaries, model.predictions)]))
    return spark.range(1).select(points.alias("p")).select("p.*")


def _curve(df: DataFrame, x: str, estimator, link, n_points: int) -> DataFrame:
    """x, y: a fitted curve over the standardised x at evenly spaced points between its least and largest value."""
    found = df.where(F.col(x).isNotNull()).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")).first()
    if not found["n"]:
        return df.sparkSession.createDataFrame([], "x double, y double")
    sd = found["s"] if found["s"] > 1e-12 else 1.0
    lo, hi = (found["lo"], found["hi"]) if found["hi"] - found["lo"] > 1e-12 else (found["lo"] - 1.0, found["hi"] + 1.0)
    model = estimator(found["n"]).fit(_vectors(df.withColumn("_z", (F.col(x) - found["m"]) / sd), ["_z"]))
    points = df.sparkSession.range(n_points).select((F.lit(float(lo)) + F.col("id") * ((hi - lo) / (n_points - 1))).alias("x"))
    return points.withColumn("y", link(F.lit(float(model.intercept)) + F.lit(float(model.coefficients[0])) * (F.col("x") - found["m"]) / sd))


def logistic_curve(df: DataFrame, x: str, y: str, n_points: int = 100, penalty: float = 1.0) -> DataFrame:
    """x, y: probability breakpoints of a logistic fit of a 0/1 label, with half the penalty times the squared weight added to the loss."""
    from pyspark.ml.classification import LogisticRegression

    fit = lambda n: LogisticRegression(featuresCol="features", labelCol=y, regParam=penalty / n, standardization=False, maxIter=1000, tol=1e-12)
    return _curve(df, x, fit, lambda t: 1 / (1 + F.exp(-t)), n_points)


def huber_curve(df: DataFrame, x: str, y: str, bound: float, n_points: int = 100) -> DataFrame:
    """x, y: breakpoints of a Huber fit of y, drawn into the bound by a hyperbolic tangent."""
    from pyspark.ml.regression import LinearRegression

    fit = lambda n: LinearRegression(featuresCol="features", labelCol=y, loss="huber", epsilon=1.35, standardization=False, maxIter=1000, tol=1e-10)
    return _curve(df, x, fit, lambda t: bound * F.tanh(t / bound), n_points)


def curve_gates(points: DataFrame, least: int = 5) -> DataFrame:
    """distinct, flat, verdict of breakpoints (x, y): values apart at 8 digits, and the share of the x range over which y stands still."""
    from pyspark.sql import Window

    w = Window.orderBy("x")
    steps = points.select("x", "y", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"))
    still = F.sum(F.when(F.abs(F.col("_y") - F.col("y")) < 1e-9, F.col("_x") - F.col("x")).otherwise(0.0))
    found = steps.agg(F.countDistinct(F.round("y", 8)).alias("distinct"), (still / F.nullif(F.max("x") - F.min("x"), F.lit(0.0))).alias("flat"))
    return found.withColumn("verdict", F.when(F.col("distinct") < least, "collapsed").otherwise("ok"))


def to_horizon(value, horizon: int, native: int):
    """An expected return over `native` days brought to a horizon in proportion."""
    return F.col(value) * (horizon / native)


#: Breakpoints that are sent to all tasks; 16 bytes each.
MOST_POINTS = 1_000_000


def calibrated(df: DataFrame, value: str, points: DataFrame, name: str = "calibrated", *, most: int = MOST_POINTS) -> DataFrame:
    """Adds the piecewise linear value of a breakpoint table (x, y), flat beyond its ends; null for null and without breakpoints.

    Of breakpoints with one x the first by y counts from the left, the last from the right. Up to
    `most` breakpoints (counted) are put in order once and searched by halving in each batch of rows;
    beyond that rows and segments meet by an equal slice of the x range.
    """
    points = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    if points.count() > most:
        return _by_slices(df, value, points, name)
    import numpy as np
    import pandas as pd

    got = points.orderBy("x", "y").toPandas()
    shared = df.sparkSession.sparkContext.broadcast((got["x"].to_numpy(), got["y"].to_numpy()))

    def look(batches):
        x, y = shared.value
        for v in batches:
            own = v.to_numpy(dtype="float64")
            if not len(x):
                yield pd.Series(np.full(len(own), np.nan))
                continue
            at = np.clip(np.searchsorted(x, own, "right") - 1, 0, max(0, len(x) - 2))
            after = np.minimum(at + 1, len(x) - 1)
            wide = x[after] - x[at]
            inside = y[at] + (own - x[at]) / np.where(wide > 0, wide, 1.0) * (y[after] - y[at])
            out = np.where(own <= x[0], y[0], np.where(own >= x[-1], y[-1], inside))
            yield pd.Series(np.where(np.isnan(own), np.nan, out))

    from collections.abc import Iterator

    look.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = F.pandas_udf(look, "double")(F.col(value).cast("double"))
    return df.withColumn(name, F.when(~F.isnan(found), found))


def _by_slices(df: DataFrame, value: str, points: DataFrame, name: str, slices: int = 1 << 16) -> DataFrame:
    """calibrated for breakpoints in any number: a segment stands in each slice of the x range that it reaches."""
    ends = points.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.min_by("y", F.struct("x", "y")).alias("_ylo"), F.max_by("y", F.struct("x", "y")).alias("_yhi"))
    slice_of = lambda v: F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices)
    placed = points.join(F.broadcast(ends)).withColumn("_p", F.least(slice_of(F.col("x")), F.lit(slices - 1)))
    # Within a slice breakpoints are ordered by a window; the last one before a slice is carried into it.
    last = placed.groupBy("_p").agg(F.max(F.struct("x", "y")).alias("_l"), F.min(F.struct("x", "y")).alias("_f"))
    between = Window.orderBy("_p")
    firsts = last.select("_p", F.lead("_f").over(between).alias("_next"))
    own = Window.partitionBy("_p").orderBy("x", "y")
    spans = placed.join(firsts, "_p").withColumn("_n", F.coalesce(F.lead(F.struct("x", "y")).over(own), F.col("_next"))).where("_n.x > x")
    spans = spans.select(F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.col("_n.x").alias("_x1"), F.col("_n.y").alias("_y1"), F.explode(F.sequence("_p", F.least(slice_of(F.col("_n.x")), F.lit(slices - 1)))).alias("_s"))
    v = F.col(value).cast("double")
    rows = df.join(F.broadcast(ends)).withColumn("_s", F.when((v > F.col("_lo")) & (v < F.col("_hi")), slice_of(v)))
    inside = rows.join(spans, (rows["_s"] == spans["_s"]) & (v >= F.col("_x0")) & (v < F.col("_x1")), "left")
    line = F.col("_y0") + (v - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    return inside.withColumn(name, F.when(v <= F.col("_lo"), F.col("_ylo")).when(v >= F.col("_hi"), F.col("_yhi")).otherwise(line)).select(*[rows[c] for c in df.columns], name)


def parameter_problems(parameters: DataFrame, features: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """feature, problem of a parameter table (feature, mean, std, kind) that must cover exactly the feature list."""
    both = parameters.join(features.withColumn("_f", F.lit(1)), "feature", "full")
    problem = F.when(F.col("kind").isNull(), "missing").when(F.col("_f").isNull(), "unexpected").when(~F.col("kind").isin(*kinds), "unknown kind").when(~F.coalesce(F.col("std") > 0, F.lit(False)), "no spread")
    return both.select("feature", problem.alias("problem")).where("problem is not null")


def marginal_effects(model, baselines: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean, sd, positive of the score at +1 less the score at -1 of each feature, other features as in the baselines."""
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for f in features for s in (-1.0, 1.0)]))
    rows = baselines.withColumn("_id", F.monotonically_increasing_id()).select("_id", *features, grid.alias("g"))
    rows = rows.select("_id", "g.f", "g.s", *[F.when(F.col("g.f") == f, F.col("g.s")).otherwise(F.col(f)).alias(f) for f in features])
    scored = score(model, rows, features).groupBy("_id", "f").agg((F.max(F.when(F.col("s") > 0, F.col("score"))) - F.max(F.when(F.col("s") < 0, F.col("score")))).alias("e"))
    return scored.groupBy(F.col("f").alias("feature")).agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.avg((F.col("e") > 0).cast("double")).alias("positive"))
