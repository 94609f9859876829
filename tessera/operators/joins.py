"""Joins in time: as-of, offsets, intervals, pairings, differences between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order for each combination of keys."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_r"))
    return best.select("_r.*")


def normalise_predictions(raw: DataFrame, regimes: DataFrame, names: dict[str, str], tags: dict[str, str]) -> DataFrame:
    """Predictions with standard names, constant tags, and the regime of their date (UNKNOWN without one).

    regimes has one row per date; it is broadcast by its size in the plan, if that is small.
    """
    out = raw.drop("regime").withColumnsRenamed(names)
    return out.withColumns({k: F.lit(v) for k, v in tags.items()}).join(regimes, "date", "left").withColumn("regime", F.coalesce("regime", F.lit("UNKNOWN")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails where the right side has a key twice and refuses to overwrite columns."""
    clash = set(left.columns) & set(right.columns) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    values = [c for c in right.columns if c not in keys]
    n = F.count("*")
    once = right.groupBy(*keys).agg(F.when(n == 1, F.first(F.struct(*values))).otherwise(F.raise_error(F.lit("a key occurs twice on the right side"))).alias("_v"))
    return left.join(once, keys, "left").select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def replace_label(panel: DataFrame, labels: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Inner join that takes a column from labels in place of the panel's own."""
    return panel.drop(column).join(labels.select(*keys, column), keys)


def as_of(left: DataFrame, right: DataFrame, key: str, date: str, values: list[str], *, strict: bool = False) -> DataFrame:
    """Left rows with the latest right values of the same key on or before (strict: before) their date.

    One union, one shuffle by key and one running window: no pair of rows is built. Null values on
    the right are passed over.
    """
    side = 0 if strict else 2
    tagged = left.select(key, date, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    other = right.select(key, date, F.lit(2 - side).alias("_side"), F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), *values)
    order = Window.partitionBy(key).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.unionByName(other).select("_side", "_l", *[F.last(v, ignorenulls=True).over(order).alias(v) for v in values])
    return filled.where("_side = 1").select("_l.*", *values)


def offset_join(df: DataFrame, key: str, date: str, value: str, days: int, name: str) -> DataFrame:
    """Adds the key's value exactly so many calendar days later; null where that day is missing."""
    later = df.select(F.col(key), F.date_sub(date, days).alias(date), F.col(value).alias(name))
    return df.join(later, [key, date], "left")


def lag_join(df: DataFrame, axis: DataFrame, key: str, date: str, value: str, lag: int, name: str) -> DataFrame:
    """Adds the key's value `lag` dates later on the axis (date, pos); rows without one go."""
    target = axis.select(F.col(date).alias("_t"), (F.col("pos") - lag).alias("pos"))
    to = axis.select(date, "pos").join(target, "pos").select(date, "_t")
    later = df.select(F.col(key), F.col(date).alias("_t"), F.col(value).alias(name))
    return df.join(F.broadcast(to), date).join(later, [key, "_t"]).drop("_t")


def interval_of(dates: DataFrame, cutoffs: DataFrame, last: int) -> DataFrame:
    """date, fold: the cutoff interval (cutoff, next cutoff] that each date lies in; the last one holds `last` dates at most.

    dates has one row per date and cutoffs one row per fold; both are dimensions.
    """
    folds = cutoffs.withColumn("_next", F.lead("cutoff").over(Window.orderBy("cutoff")))
    found = dates.select("date").distinct().join(F.broadcast(folds), (F.col("date") > F.col("cutoff")) & (F.col("_next").isNull() | (F.col("date") <= F.col("_next"))))
    place = F.row_number().over(Window.partitionBy("fold").orderBy("date"))
    return found.withColumn("_p", place).where(F.col("_next").isNotNull() | (F.col("_p") <= last)).select("date", "fold")


def fifo_pairs(trades: DataFrame, key: str, side: str, order: list[str]) -> DataFrame:
    """The i-th buy of each key with its i-th sell: columns of both as b_ and s_."""
    numbered = trades.withColumn("rn", F.row_number().over(Window.partitionBy(key, side).orderBy(*order)))
    own = lambda s, p: numbered.where(F.col(side) == s).select(key, "rn", *[F.col(c).alias(f"{p}_{c}") for c in trades.columns if c not in (key, side)])
    return own("buy", "b").join(own("sell", "s"), [key, "rn"])


def full_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing with a reason: paired, only_first or only_second."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full")
    return both.withColumn("reason", F.when(F.col("_a").isNull(), "only_second").when(F.col("_b").isNull(), "only_first").otherwise("paired")).drop("_a", "_b")


def index_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, state (missing, unexpected or changed) of what differs between two indexes."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ha")), after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_hb"))
    state = F.when(F.col("_hb").isNull(), "missing").when(F.col("_ha").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state is not null")


def model_pairs(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Each two models' scores of the same keys, a before b."""
    a = scores.select(*keys, F.col("model").alias("a"), F.col("score").alias("sa"))
    b = scores.select(*keys, F.col("model").alias("b"), F.col("score").alias("sb"))
    return a.join(b, keys).where("a < b")
