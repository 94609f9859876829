"""A place for intermediate tables that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below the warehouse where that is unset, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new scratch folder, for what is read several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(*tables: DataFrame, most: int = 250_000) -> int:
    """How many parts hold at most some `most` rows of all tables together, and at least as many as the cluster has cores.

    Rows are counted, so that a task's share does not grow with the tables whatever the session's number of shuffle parts.
    """
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // most))


def full_waves(*tables: DataFrame, most: int = 250_000) -> int:
    """parts_for rounded up to a multiple of the cluster's cores: files that are alike are read again by so many tasks that no wave is left half empty."""
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    return -(-parts_for(*tables, most=most) // cores) * cores
