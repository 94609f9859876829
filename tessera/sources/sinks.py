"""Sinks: Parquet, CSV and JSON layouts that the sources read back, appends, and parameters as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet with zstd, partitioned where asked for."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def join_series(series: dict[str, DataFrame], value: str) -> DataFrame:
    """Several per-date series side by side by a full join on date."""
    named = [df.select("date", F.col(value).alias(name)) for name, df in series.items()]
    return reduce(lambda a, b: a.join(b, "date", "full"), named)


def write_series(series: dict[str, DataFrame], value: str, path: str) -> DataFrame:
    """Writes the series as CSV; returns the sidecar row: rows, paired, first, last."""
    wide = join_series(series, value)
    wide.write.option("header", True).csv(path)
    both = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in series])
    return wide.agg(F.count("*").alias("rows"), F.count(F.when(both, 1)).alias("paired"), F.min("date").alias("first"), F.max("date").alias("last"))


def write_score_files(scores: DataFrame, path: str) -> None:
    """One folder per date with a JSON object {"scores": {key: value}}: scores is (date, key, score)."""
    docs = scores.groupBy("date").agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "score")))).alias("scores"))).alias("value"))
    docs.write.partitionBy("date").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_parameters(parameters: DataFrame, path: str) -> None:
    """A parameter table (breakpoints, coefficients, moments) as one Parquet file; such tables have few rows."""
    parameters.coalesce(1).write.mode("overwrite").parquet(path)
