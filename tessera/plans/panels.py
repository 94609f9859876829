"""Panels (one row per date and key) derived from the star-schema tables, and the same as SQL.

Sums are taken over whole cents and units, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def whole(c: str, times: int = 100):
    return F.round(F.col(c) * times).cast("long")


def supplier_month(spark: SparkSession, d: str) -> DataFrame:
    """date, key, volume, n, close, x1, x2, y: months by suppliers; y is the next month's relative change of close."""
    cells = table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("key"))
    cells = cells.agg(F.sum(whole("l_extendedprice")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("volume"), F.sum(whole("l_discount")).alias("disc"), F.count("*").alias("n"))
    close = F.col("cents") / F.col("volume")
    following = F.lead(close).over(Window.partitionBy("key").orderBy("date"))
    return cells.select("date", "key", "volume", "n", close.alias("close"), (F.col("disc") / F.col("n")).alias("x1"), (F.col("volume") / F.col("n")).alias("x2"), (following / close - 1).alias("y"))


SM = """
sm0 AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, l_suppkey AS key, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents,
  sum(l_quantity::BIGINT)::BIGINT AS volume, sum(round(l_discount * 100)::BIGINT)::BIGINT AS disc, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2),
sm AS (SELECT date, key, volume, n, cents::DOUBLE / volume AS close, disc::DOUBLE / n AS x1, volume::DOUBLE / n AS x2,
  lead(cents::DOUBLE / volume) OVER (PARTITION BY key ORDER BY date) / (cents::DOUBLE / volume) - 1 AS y FROM sm0)"""


def brand_bars(spark: SparkSession, d: str, unit: str = "week") -> DataFrame:
    """date, key, close, volume: weekly or daily bars of part brands."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    bars = lines.groupBy(F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"), F.col("p_brand").alias("key"))
    bars = bars.agg(F.sum(whole("l_extendedprice")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))
    return bars.select("date", "key", (F.col("cents") / F.col("volume") / 100).alias("close"), "volume")


def market_bars(bars: DataFrame) -> DataFrame:
    """date, close: volume-weighted close over all keys."""
    return bars.groupBy("date").agg((F.sum(F.round(F.col("close") * F.col("volume") * 100).cast("long")) / F.sum("volume") / 100).alias("close"))


def _bars(unit: str) -> str:
    return f"""
bw AS (SELECT date_trunc('{unit}', l_shipdate)::DATE AS date, p_brand AS key, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT::DOUBLE / sum(l_quantity::BIGINT)::BIGINT / 100 AS close,
  sum(l_quantity::BIGINT)::BIGINT AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
mk AS (SELECT date, sum(round(close * volume * 100)::BIGINT)::BIGINT::DOUBLE / sum(volume)::BIGINT / 100 AS close FROM bw GROUP BY 1)"""


BW, BD = _bars("week"), _bars("day")


def user_day(spark: SparkSession, d: str) -> DataFrame:
    """date, key, value, n: days by users of the events table."""
    cells = table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("key"))
    return cells.agg((F.sum(whole("value")) / 100).alias("value"), F.count("*").alias("n"))


UD = """
ud AS (SELECT ts::DATE AS date, user_id AS key, sum(round(value * 100)::BIGINT)::BIGINT::DOUBLE / 100 AS value, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)"""


def R(x: str, digits: int = 9) -> str:  # noqa: N802
    """SQL of functions.scalar.tidy."""
    return f"(round({x}, {digits}) + 0.0)"


def avg_rank_sql(value: str, by: str) -> str:
    """SQL of functions.scalar.avg_rank for a value without nulls."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"
