"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled order and with it a virtual finish time:
the source's words up to and including the document, divided by the source's target. A source whose
target exceeds its size goes round again, at most `epochs` times; the copies of a document are
ordinary entries of the queue. All entries are range-partitioned by virtual time and sorted; each
gets the words in front of it from the sums of the ranges before and the running sum in its own
range, and the queue is cut off where the total budget is used.

Nothing is ordered in one task. Places within a source are running sums inside hash buckets plus
the sums of the buckets before, so a source that holds a third of all rows is still spread over
all buckets, and ranges of virtual time mix all sources.

Defined results: null texts and texts without words have size 0 and take nothing; a null source
is a source of its own, last in the order; equal virtual times go by shuffle key, doc_id, epoch and
place; repeated rows are separate entries; rows without a doc_id are entries like others, first
among equal times; an empty table gives an empty result; extra columns are ignored. Of a text of
any length only the number of its words is kept; one that does not fit into what is left of the
budget is not taken, nor is what stands behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, n_words, scan_splits, stash

#: Hex digits of the shuffle key that name a bucket within a source.
BUCKET_DIGITS = 3


def source_targets(sized: DataFrame, weights=(1, 2, 3), epochs: int = 3) -> DataFrame:
    """source, source_size, target from (source, size).

    Shares of the total by weight, each limited to epochs * size; what exceeds a limit is shared
    out again by weight. That has a closed form: with the sources in order of limit / weight, the
    limited ones are a prefix, and all others get level * weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = by_source.withColumn("weight", F.element_at(cycle, F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("_capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_budget", F.sum("source_size").over(everything))
    )
    # The level if all sources before this one are at their limit; it holds from the first one whose limit is not below it.
    level = (F.col("_budget") - F.col("_capped")) / F.col("_rest")
    ranked = ranked.withColumn("_level", F.when(F.col("cap") / F.col("weight") >= level, level))
    ranked = ranked.withColumn("_level", F.first("_level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def _shuffled_positions(sized: DataFrame) -> DataFrame:
    """Adds _before: words of the same source in front of each row, in order of (key, doc_id)."""
    bucketed = sized.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    in_source = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(in_source), F.lit(0)).alias("_offset"))
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("_here", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_before", F.col("_offset") + F.col("_here")).drop("_bucket", "_b", "_s", "_offset", "_here")


def truncated(queue: DataFrame, order: list[str], budget: int, parts: int) -> DataFrame:
    """The rows of queue whose sizes, summed up in the given order over all rows, stay within the budget."""
    ranges = stash(queue.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy("_range").agg(F.sum("size").alias("_sum"))
    # One row per range.
    front = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("_range", F.coalesce(F.sum("_sum").over(front), F.lit(0)).alias("_ahead")).where(F.col("_ahead") < budget)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.join(F.broadcast(ahead), "_range").withColumn("_upto", F.col("_ahead") + F.sum("size").over(inside))
    return summed.where(F.col("_upto") <= budget).drop("_range", "_ahead", "_upto")


def mix(documents: DataFrame, *, weights=(1, 2, 3), epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies."""
    # Rows without an id are shuffled by their text; those without words too, which take nothing, are only spread.
    text = F.nullif(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(""))
    spread = F.concat(F.lit("#"), F.monotonically_increasing_id())
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.when(text.isNotNull(), F.concat(F.lit("-"), F.md5("text"))), spread)))
    sized = stash(documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key")))
    targets = source_targets(sized, weights, epochs)
    joined = _shuffled_positions(sized).withColumnRenamed("source", "_src")
    joined = joined.join(targets, F.col("_src").eqNullSafe(F.col("source"))).drop("_src")
    placed = stash(joined)

    start = lambda e: F.lit(e) * F.col("source_size") + F.col("_before")
    finish = lambda e: (start(e) + F.col("size")) / F.col("target")
    queued = lambda e: (F.col("size") > 0) & (start(e) < F.col("target"))

    budget = placed.agg(F.sum("size")).collect()[0][0] or 0
    entries = F.filter(F.array(*[F.when(queued(e), F.struct(F.lit(e).alias("_epoch"), finish(e).alias("_v"))) for e in range(epochs)]), lambda x: x.isNotNull())
    queue = placed.select("source", "doc_id", "_key", "_before", "size", F.explode(entries).alias("_c")).select("source", "doc_id", "_key", "_before", "size", "_c._epoch", "_c._v")
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), scan_splits(documents))
    taken = truncated(queue, ["_v", "_key", "doc_id", "_epoch", "_before"], budget, parts)
    # A row of size 1 or more is known by its source and the words in front of it there.
    counts = taken.groupBy("source", "_before").agg(F.count("*").alias("copies")).withColumnRenamed("source", "_s").withColumnRenamed("_before", "_b")
    joined = placed.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_before") == F.col("_b")) & (F.col("size") > 0), "left")
    count = F.coalesce("copies", F.lit(0)).cast("long")
    result = joined.select("doc_id", "source", "size", "source_size", "target", (count * F.col("size")).alias("taken"), count.alias("copies"))
    discard(sized)
    return result


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || doc_id) AS k
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER r)::DOUBLE AS lvl
  FROM ranked
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
chosen AS (SELECT min(lvl) AS lvl FROM (
  SELECT lvl FROM levels WHERE cap::DOUBLE / weight >= lvl ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT lvl FROM chosen) * weight) AS target FROM ranked),
placed AS (
  SELECT s.doc_id, s.size, s.k, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, k, size, e, ((e * source_size + before + size)::DOUBLE / target) AS v
  FROM placed, (VALUES (0), (1), (2)) AS x(e)
  WHERE size > 0 AND e * source_size + before < target),
queue AS (SELECT doc_id, size, sum(size) OVER (ORDER BY v, k, doc_id, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies),
taken AS (SELECT doc_id, count(*)::BIGINT AS copies FROM queue WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.copies, 0) * p.size AS taken, coalesce(t.copies, 0) AS copies
FROM placed p LEFT JOIN taken t USING (doc_id)
"""
