"""Streams: per-key buffers, immature and non-causal rows set aside, idempotent appends, windowed logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import business_day_add, pct_rank
from ..sources.scratch import parts_for


#: Buckets of keys that share a state. A call from the engine serves a bucket: calls do not grow with keys.
BUCKETS = 2048


def _bucketed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"), "key", *columns)


def _windows(before: pd.DataFrame, new: pd.DataFrame, length: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """key, date, n, values of all full windows that end in new rows, and key, value of each key's last length - 1 rows in order.

    before: key, value held, in order; new: key, date, value. All keys at once, in arrays.
    """
    new = new.sort_values("date", kind="stable")
    keys = pd.Series([*before["key"], *new["key"]], dtype="object")
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    order = np.argsort(codes, kind="stable")
    codes, keys = codes[order], keys.to_numpy()[order]
    values = np.array([*before["value"], *new["value"]], dtype="float64")[order]
    dates = np.array([None] * len(before) + new["date"].tolist(), dtype="object")[order]
    first = np.searchsorted(codes, codes, "left")
    ends = np.flatnonzero((order >= len(before)) & (np.arange(len(codes)) - first >= length - 1))
    kept = np.searchsorted(codes, codes, "right") - np.arange(len(codes)) < length
    full = list(np.lib.stride_tricks.sliding_window_view(values, length)[ends - (length - 1)]) if len(ends) else []
    return pd.DataFrame({"key": keys[ends], "date": dates[ends], "n": length, "values": full}), pd.DataFrame({"key": keys[kept], "value": values[kept]})


def rolling_buffer(rows: DataFrame, length: int) -> DataFrame:
    """key, date, n, values: the last `length` values of each key, whenever a row arrives and the buffer is full.

    rows: key string, date string, value double, a stream. The state is the last length - 1 values of the
    keys of one bucket.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        out, kept = _windows(pd.DataFrame({"key": list(held[0]), "value": list(held[1])}), pd.concat(list(batches)), length)
        state.update((kept["key"].tolist(), kept["value"].tolist()))
        if len(out):
            yield out

    return _bucketed(rows, "date", "value").groupBy("bucket").applyInPandasWithState(update, "key string, date string, n int, values array<double>", "keys array<string>, values array<double>", "append", GroupStateTimeout.NoTimeout)


def warm_up(history: DataFrame, length: int) -> DataFrame:
    """key, values: the last `length` - 1 values of each key, to start buffers from."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("date"), F.desc("value")))
    last = history.withColumn("_n", newest).where(F.col("_n") < length)
    return last.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "value"))), lambda s: s["value"]).alias("values"))


def stateful(spark) -> None:
    """Keeps stream state in the store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def continued_buffer(rows: DataFrame, length: int, initial: DataFrame | None = None) -> DataFrame:
    """key, date, n, values: the last `length` values of each key, whenever a row arrives and the buffer is full.

    rows: key string, date string, value double, a stream. The state is a list of each key's last
    length - 1 values, kept by a stateful processor for a bucket of keys at a time; it begins with those
    of initial (key, values, as warm_up gives them), so that a stream goes on where its history ends. A
    key's rows of one batch are put in order of date; rows of later batches follow them. Keys without
    history begin empty.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Buffer(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getListState("buffer", "key string, value double")

        def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
            values = [(k, float(v)) for k, own in zip(initialState["key"], initialState["values"]) for v in own[max(0, len(own) - (length - 1)) :]]
            if values:
                self.held.appendList(values)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            before = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=["key", "value"])
            out, kept = _windows(before, pd.concat(list(rows)), length)
            if len(kept):
                self.held.put(list(zip(kept["key"].tolist(), kept["value"].tolist())))
            if len(out):
                yield out

        def close(self) -> None:
            pass

    own = _bucketed(initial, "values").groupBy("bucket") if initial is not None else None
    return _bucketed(rows, "date", "value").groupBy("bucket").transformWithStateInPandas(Buffer(), "key string, date string, n int, values array<double>", "Append", "None", initialState=own)


def stored_buffers(spark, checkpoint: str) -> DataFrame:
    """key, values of the state that a stream of continued_buffer has left in its checkpoint, as a table; values are not in order."""
    read = spark.read.format("statestore").option("stateVarName", "buffer").option("flattenCollectionTypes", "true").load(checkpoint)
    return read.groupBy(F.col("list_element.key").alias("key")).agg(F.collect_list("list_element.value").alias("values"))


def mature(date: Column, asof: str, horizon: int, settle: int) -> Column:
    """Whether a date lies at least horizon + settle business days before asof."""
    return date <= business_day_add(F.lit(asof).cast("date"), -(horizon + settle))


def split_sinks(rows: DataFrame, good: Column, accepted: str, refused: str):
    """A foreachBatch function that sends rows to two Parquet tables by a predicate; nothing is cut or dropped.

    Each batch has a partition of its own, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        for rows, place in ((batch.where(good), accepted), (batch.where(~F.coalesce(good, F.lit(False))), refused)):
            rows.write.mode("overwrite").parquet(f"{place}/_batch={number}")

    return write


def causal(watermark: str, decision: str) -> Column:
    """The reason to reject a row whose data are newer than its decision; null for good rows."""
    return F.when(F.col(watermark) > F.col(decision), "watermark_after_decision").when(F.col(watermark).isNull(), "no_watermark")


def append_once(batch: DataFrame, target: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The batch's rows whose keys are not in the target yet, once each; equal content of a known key is accepted silently, other content is refused.

    Both tables are dealt by key into parts of some 250,000 rows and meet in one join; what repeats
    within the batch is told in the same parts.
    """
    rows, have = batch.select(*keys, F.col(content).alias("_new")), target.select(*keys, F.col(content).alias("_have"), F.lit(True).alias("_known"))
    parts = parts_for(batch, target)
    met = rows.repartition(parts, *keys).join(have.repartition(parts, *keys), keys, "left")
    state = F.when(F.col("_known").isNull(), "appended").when(F.col("_new") != F.col("_have"), "conflict")
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    told = met.select(*keys, state.alias("state"), again.alias("_n"))
    return told.where((F.col("state") == "conflict") | ((F.col("state") == "appended") & (F.col("_n") == 1))).drop("_n")


def daily_log(rows: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """day, n, agreement of a decision log in tumbling windows of a day with a watermark."""
    window = F.window(F.col(time), "1 day")
    counted = rows.withWatermark(time, late).groupBy(window).agg(F.count("*").alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement"))
    return counted.select(F.to_date("window.start").alias("day"), "n", "agreement")


def ranked_batch(batch: DataFrame, value: str) -> DataFrame:
    """Adds ranked: the percentile rank within the date less a half, 0 for null; the batch holds whole dates."""
    return batch.withColumn("ranked", F.coalesce(pct_rank(value, "date") - 0.5, F.lit(0.0)))


def ranked_sink(value: str, place: str):
    """A foreachBatch function that ranks each arriving batch across its keys and writes it; a repeated batch overwrites its own rows.

    Ranks cross keys, which state by key cannot; a second stream reads what this one writes. A key's
    rows of a batch are one file, so that they never reach the second stream after later ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        ranked_batch(batch, value).repartition("key").sortWithinPartitions("key", "date").write.mode("overwrite").parquet(f"{place}/_batch={number}")

    return write
