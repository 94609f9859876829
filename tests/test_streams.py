"""Buffers that go on: from a history's state, over batches, and after a restart from the checkpoint."""

import random

import pytest

from tessera.streaming import state as ST

SCHEMA = "key string, date string, value double"


def windows(rows, length):
    out = set()
    for key in {k for k, _, _ in rows}:
        own = sorted((d, v) for k, d, v in rows if k == key)
        out |= {(key, own[i][0], tuple(v for _, v in own[i + 1 - length : i + 1])) for i in range(length - 1, len(own))}
    return out


def run(spark, path, schema, length, first=None):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = ST.continued_buffer(rows, length, first).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck")
    q.trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("length", [1, 4])
def test_stream_goes_on_from_history_and_after_a_restart(spark, tmp_path, length):
    ST.stateful(spark)
    r = random.Random(length)
    rows = [(f"k{k}", f"2020-01-{d:02d}", r.random()) for k in range(6) for d in range(1, 25) if r.random() < (0.8 if k else 0.1)] + [("late", f"2020-01-{d}", float(d)) for d in (20, 21, 22)]
    history = [v for v in rows if v[1] < "2020-01-09"]
    later = [v for v in rows if v[1] >= "2020-01-09"]
    first = ST.warm_up(spark.createDataFrame(history, SCHEMA), length) if length > 1 else None
    path = str(tmp_path)
    for a, b in (("09", "14"), ("15", "19")):
        spark.createDataFrame([v for v in later if a <= v[1][-2:] <= b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run(spark, path, SCHEMA, length, first)
    spark.createDataFrame([v for v in later if v[1][-2:] > "19"], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run(spark, path, SCHEMA, length, first)
    found = spark.read.parquet(f"{path}/out").collect()
    assert len(found) == len({(x["key"], x["date"]) for x in found})
    assert {(x["key"], x["date"], tuple(x["values"])) for x in found} == {w for w in windows(rows, length) if w[1] >= "2020-01-09"}
    if length > 1:
        kept = {x["key"]: sorted(x["values"]) for x in ST.stored_buffers(spark, f"{path}/ck").collect()}
        for key in {k for k, _, _ in rows}:
            assert kept[key] == sorted(v for _, v in sorted((d, v) for k, d, v in rows if k == key)[-(length - 1) :])


def test_ranks_of_a_batch(spark):
    found = ST.ranked_batch(spark.createDataFrame([("a", "d", 1.0), ("b", "d", 3.0), ("c", "d", 3.0), ("e", "d", None)], SCHEMA), "value").collect()
    assert {x["key"]: round(x["ranked"], 6) for x in found} == {"a": -0.166667, "b": 0.333333, "c": 0.333333, "e": 0.0}
