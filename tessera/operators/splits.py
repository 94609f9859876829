"""Walk-forward folds, purging, embargo, and checks that no label reaches into a later split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import business_day_add, business_days_between
from .cross_section import array_split_folds, date_axis


def expanding_folds(df: DataFrame, k: int, embargo: int, least: int = 20) -> DataFrame:
    """fold, first, last, train_last: validation runs and the last train position of each; folds with fewer than `least` train dates go."""
    folds = array_split_folds(df, k + 1).join(date_axis(df).select("date", "pos"), "date")
    spans = folds.where("fold > 0").groupBy("fold").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.withColumn("train_last", F.col("first") - 1 - embargo).where(F.col("train_last") >= least)


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """All columns of df (date, ...), fold, part (train or val): the long form of all folds; the fold table is a dimension."""
    placed = df.join(F.broadcast(date_axis(df).select("date", "pos")), "date")
    inside = (F.col("pos") <= F.col("train_last")) | F.col("pos").between(F.col("first"), F.col("last"))
    part = F.when(F.col("pos") <= F.col("train_last"), "train").otherwise("val")
    return placed.join(F.broadcast(folds), inside).select(*df.columns, "fold", part.alias("part"))


def cut_label(date: Column, train_end: str, val_end: str, embargo: int) -> Column:
    """train, embargo, val or test by a cut; the embargo is so many business days behind the train end."""
    end, val = F.lit(train_end).cast("date"), F.lit(val_end).cast("date")
    return F.when(date <= end, "train").when(date <= business_day_add(end, embargo), "embargo").when(date <= val, "val").otherwise("test")


def leakage(splits: DataFrame, horizon: int) -> DataFrame:
    """cut, train_end, val_start, margin, violation: whether labels of the last train date end before validation begins."""
    ends = splits.groupBy("cut").agg(F.max(F.when(F.col("split") == "train", F.col("date"))).alias("train_end"), F.min(F.when(F.col("split") == "val", F.col("date"))).alias("val_start"))
    margin = business_days_between("train_end", "val_start")
    return ends.select("cut", "train_end", "val_start", margin.alias("margin"), (margin <= horizon).alias("violation"))


def ladder_checks(cutoffs: DataFrame) -> DataFrame:
    """cutoff, gap, problem: duplicates and steps unlike the most common one."""
    gap = F.datediff("cutoff", F.lag("cutoff").over(Window.orderBy("cutoff")))
    steps = cutoffs.select("cutoff", gap.alias("gap"))
    usual = steps.agg(F.mode("gap").alias("usual"))
    problem = F.when(F.col("gap") == 0, "duplicate").when(F.col("gap") != F.col("usual"), "uneven")
    return steps.join(F.broadcast(usual)).select("cutoff", "gap", problem.alias("problem"))


def extend_ladder(cutoffs: DataFrame, target: DataFrame, interval: int) -> DataFrame:
    """cutoff: the cutoffs that go on backwards from the earliest in steps of `interval` days, none before the target (one row, target)."""
    begin = cutoffs.agg(F.min("cutoff").alias("_first")).join(F.broadcast(target))
    steps = F.floor(F.datediff("_first", "target") / interval).cast("int")
    return begin.where(steps >= 1).select(F.explode(F.sequence(F.lit(1), steps)).alias("_k"), "_first").select(F.date_sub("_first", (F.col("_k") * interval).cast("int")).alias("cutoff"))


def clear_of(first: Column, last: Column, horizon: int, embargo: int) -> Column:
    """Whether the label span of a row's date ends before a validation span, or the date lies behind that span, its labels and the embargo."""
    return (F.date_add("date", horizon) < first) | (F.col("date") > F.date_add(last, horizon + embargo))


def purged_folds(events: DataFrame, k: int, horizon: int, embargo: int) -> DataFrame:
    """fold, part, and all columns of events (date, ...): train events whose label span meets the validation span go."""
    folds = array_split_folds(events, k)
    spans = folds.groupBy("fold").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    own = events.join(F.broadcast(folds.withColumnRenamed("fold", "_own")), "date")
    val = F.col("_own") == F.col("fold")
    return own.join(F.broadcast(spans), val | clear_of(F.col("_a"), F.col("_b"), horizon, embargo)).select("fold", F.when(val, "val").otherwise("train").alias("part"), *events.columns)
