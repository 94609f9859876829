"""Operators within a date: transforms, filters, labels, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import avg_rank, clip, col, pct_rank, z_score


def transform_features(df: DataFrame, moments: list[tuple], *, bound: float = 5.0) -> DataFrame:
    """Standardised features in the given order. moments: (name, mean, std, kind, low, high) per feature.

    Null is 0 before scaling, raw values are clipped to [low, high] where given, kind "identity" is not scaled.
    """
    out = []
    for name, mean, std, kind, low, high in moments:
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        if low is not None:
            x = clip(x, low, high)
        if kind != "identity":
            x = (x - F.lit(mean)) / F.lit(std)
        out.append(clip(x, -bound, bound).alias(name))
    others = [c for c in df.columns if c not in {m[0] for m in moments}]
    return df.select(*others, *out)


def fit_robust(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean (the median), std (1.4826 times the median absolute deviation)."""
    long = df.unpivot([], features, "feature", "x").where(F.col("x").isNotNull())
    from .metrics import exact_quantiles

    median = lambda t, name: exact_quantiles(t, "x", [0.5], ("feature",)).select("feature", F.col("q").alias(name))
    centre = median(long, "mean")
    off = long.join(F.broadcast(centre), "feature").select("feature", F.abs(F.col("x") - F.col("mean")).alias("x"))
    return centre.join(median(off, "_mad"), "feature").select("feature", "mean", (F.col("_mad") * 1.4826).alias("std"))


def fit_moments(df: DataFrame, features: list[str], floor: float = 1e-9) -> DataFrame:
    """feature, mean, std (population; 1 where under the floor), in one pass."""
    long = df.unpivot([], features, "feature", "x")
    std = F.stddev_pop("x")
    return long.groupBy("feature").agg(F.avg("x").alias("mean"), F.when(std < floor, 1.0).otherwise(std).alias("std"))


def pair_slug(symbol) -> Column:
    """BASE-QUOTE of a pair written with a slash, dash or underscore; null for anything else."""
    s = F.upper(F.trim(col(symbol)))
    return F.when(s.rlike("^[A-Z0-9#]+[/_-][A-Z0-9#]+$"), F.regexp_replace(s, "[/_]", "-"))


def horizon_days(name) -> Column:
    """Days in a label name such as fwd_60d_excess; null without."""
    found = F.regexp_extract(col(name), r"^fwd_(\d+)d(_|$)", 1)
    return F.when(found != "", found.cast("int"))


def feature_columns(df: DataFrame, reserved: tuple[str, ...]) -> list[str]:
    """Numeric columns that are not reserved, from the schema alone."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in reserved]


def at_least_names(df: DataFrame, n: int, by: str = "date") -> DataFrame:
    """Rows of dates with at least n keys."""
    return df.withColumn("_names", F.count("*").over(Window.partitionBy(by))).where(F.col("_names") >= n).drop("_names")


def date_axis(df: DataFrame, date: str = "date") -> DataFrame:
    """date, pos (from 1), total: one row per distinct date, so the single window is small."""
    axis = df.select(date).distinct()
    return axis.select(date, F.row_number().over(Window.orderBy(date)).alias("pos"), F.count("*").over(Window.partitionBy()).alias("total"))


def position_split(df: DataFrame, screen: float = 0.6, embargo: int = 5) -> DataFrame:
    """Adds split: screen, embargo or holdout, by place on the date axis."""
    axis = date_axis(df)
    cut = F.floor(F.col("total") * screen)
    split = F.when(F.col("pos") <= cut, "screen").when(F.col("pos") <= cut + embargo, "embargo").otherwise("holdout")
    return df.join(F.broadcast(axis.select("date", split.alias("split"))), "date")


def top_decile_label(df: DataFrame, label: str) -> DataFrame:
    """Adds top: 1 where the label's percentile rank on its date is at least 0.9."""
    return df.withColumn("top", (pct_rank(label, "date") >= 0.9).cast("int"))


def clip_to_spread(df: DataFrame, label: str, width: float = 1.0) -> DataFrame:
    """Clips a label to its date's mean plus and minus width standard deviations."""
    w = Window.partitionBy("date")
    mean, sd = F.avg(label).over(w), F.stddev_samp(label).over(w)
    return df.withColumn(label, F.least(F.greatest(F.col(label), mean - width * sd), mean + width * sd))


def drop_collapsed_mode(df: DataFrame, score: str, share: float = 0.01, digits: int = 8) -> DataFrame:
    """Without the most frequent rounded score, if over `share` of all rows have it."""
    rounded = F.round(score, digits)
    counts = df.groupBy(rounded.alias("_mode")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    worst = counts.orderBy(F.desc("_n"), "_mode").limit(1).join(total).where(F.col("_n") > share * F.col("_all")).select("_mode")
    return df.join(F.broadcast(worst), rounded == F.col("_mode"), "left_anti")


def median_gate(df: DataFrame, value: str, by: str = "date") -> DataFrame:
    """Rows above their date's median."""
    return df.withColumn("_m", F.median(value).over(Window.partitionBy(by))).where(F.col(value) > F.col("_m")).drop("_m")


def top_n(df: DataFrame, score: str, n: int, *, by: str = "date", key: str = "key") -> DataFrame:
    """The n best keys of each date: score descending, then key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))).where(F.col("place") <= n)


def array_split_folds(df: DataFrame, k: int) -> DataFrame:
    """date, fold (0 to k-1): equal-count runs of the date axis."""
    return date_axis(df).select("date", (F.ntile(k).over(Window.orderBy("date")) - 1).alias("fold"))


def rank_normal(df: DataFrame, value: str, key: str = "key") -> DataFrame:
    """Adds normal: the normal quantile of (place - 1/2) / n within the date, by (value, key)."""
    from ..functions.scalar import inverse_normal

    w = Window.partitionBy("date")
    share = df.withColumn("_p", (F.row_number().over(w.orderBy(value, key)) - 0.5) / F.count("*").over(w))
    return share.withColumn("normal", inverse_normal("_p", refined=True)).drop("_p")


def ensemble(scores: DataFrame, how: str = "z") -> DataFrame:
    """date, key, score, members from (date, key, model, score): the mean of each model's z-scores or ranks."""
    part = z_score("score", "date", "model") if how == "z" else avg_rank("score", "date", "model")
    return scores.withColumn("_s", part).groupBy("date", "key").agg(F.avg("_s").alias("score"), F.count("_s").alias("members"))


def spaced_dates(axis: DataFrame, gap: int) -> DataFrame:
    """pos of the dates chosen greedily at least gap places apart, from (pos)."""
    positions = axis.agg(F.sort_array(F.collect_set("pos")).alias("p"))
    far = lambda out, p: F.when((F.size(out) == 0) | (p - F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) >= gap), F.concat(out, F.array(p))).otherwise(out)
    return positions.select(F.explode(F.aggregate("p", F.array().cast("array<int>"), far)).alias("pos"))
