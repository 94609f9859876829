"""What the text operators share: folders all executors see, word rules, table hand-offs."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (the class that bytes.split() uses too).
WORD = r"[^\x20\x09-\x0D]+"


#: A key that more than one in so many rows have is hot, while that is at most ONE_TASK rows.
HOT_SHARE = 1000
#: Rows that one task joins without harm, whatever their keys.
ONE_TASK = 10_000
#: There are fewer hot keys than this, however many rows there are.
MOST_HOT = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver can reach.

    The setting is read from the session. Where it is unset, a session on one machine (tests) uses a
    folder below its warehouse; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage at a table that outlives the executors that made it.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        path = vars(df).get("_stash")
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hot_from(total: int) -> float:
    """Rows of one key, of so many in all, beyond which it is hot.

    A thousandth of small tables, the rows that one task joins without harm of larger ones, and of
    very large ones what leaves fewer than MOST_HOT hot keys.
    """
    return max(min(ONE_TASK, total / HOT_SHARE), total / MOST_HOT)


def hot_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has at most one row for a key; how is inner or left.

    Rows of hot keys, and those without a key, stay where they are: the rows of one for hot keys,
    fewer than MOST_HOT, are broadcast, so they have to be narrow. All others meet by a shuffle, in which no key is hot.
    many is read twice, so it should be a stashed table. Up to ONE_TASK rows are joined plainly.
    """
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if total <= ONE_TASK:
        return many.join(one, key, how)
    hot = counts.where(F.col("_n") > F.lit(hot_from(total))).select(key)
    flagged = many.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    still = flagged.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    moved = flagged.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot")
    few = one.join(F.broadcast(hot), key, "left_semi")
    return still.join(F.broadcast(few), key, how).unionByName(moved.join(one, key, how))


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """many joined with one, which has at most one row for a key, of any width.

    The rows of a key that has more than ONE_TASK of them (of very many rows: than a MOST_HOT-th of
    all) are dealt into parts by the column by, and the row of one is repeated for each part. Only
    those keys and their numbers of parts are broadcast, fewer than MOST_HOT. many is read twice, so
    it should be a stashed table; rows without a key are dropped.
    """
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if (most or 0) <= ONE_TASK:
        return many.join(one, key)
    size = max(ONE_TASK, total / MOST_HOT)
    parts = F.broadcast(counts.where(F.col("_n") > size).select(key, F.ceil(F.col("_n") / size).alias("_parts")))
    dealt = many.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), "_parts"), F.lit(0))).drop("_parts")
    copies = one.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def scan_splits(df: DataFrame) -> int:
    """How many tasks a scan of df takes: a measure of its size that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Hand texts to Python tasks in batches of so many rows and bytes at most.

    Texts are long, and a batch lies in the memory of the JVM and of the worker at the same time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_kept: dict = {}


def kept(name, make=lambda: None):
    """What this worker keeps from task to task under a name; a task that asks for another name drops it.

    Every Python task of an operator asks at its start, so that one operator's memory is not held
    while another one runs in the same worker.
    """
    if name not in _kept:
        import ctypes
        import gc

        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:
            pass  # only some C libraries have it, and it only gives memory back sooner
        _kept[name] = make()
    return _kept[name]


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def put_file(uri: str, data: bytes) -> None:
    """Write one file from within a task, through the file system that the URI names.

    The file appears under its name only when it is whole. Callers give the same bytes for the same
    name on every attempt, so a retried or speculative task changes nothing.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    try:
        system.move(part, path)
    except OSError:
        # Some file systems refuse to replace a file; an earlier attempt has written the same bytes.
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(part)
