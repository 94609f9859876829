"""The book against a day-by-day replay, with gaps, expiring decisions and several windows; event gaps and hash chains."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import portfolio as P
from tessera.operators import quality as Q

DAY = dt.date(2020, 1, 1)


def replay(scores, closes, k, every, delay):
    """(gross, traded) by day, None where the book's worth is not known, and the decisions' states."""
    dates = sorted({d for d, _, _ in scores})
    weights, pending, out, states, lost = {}, {}, {}, {}, False
    for j, d in enumerate(dates):
        gross = 0.0
        if weights:
            grown = {}
            for key, w in weights.items():
                a, b = closes.get((dates[j - 1], key)), closes.get((d, key))
                lost = lost or a is None or b is None
                grown[key] = 0 if lost else w * b / a
            gross = None if lost else sum(grown.values()) - 1
            weights = weights if lost else {x: w / sum(grown.values()) for x, w in grown.items()}
        traded = 0.0
        if j in pending:
            target = pending.pop(j)
            traded = None if lost else sum(abs(target.get(x, 0) - weights.get(x, 0)) for x in {*target, *weights})
            weights, lost = target, False
        if j % every == 0:
            best = sorted((-s, x) for e, x, s in scores if e == d and s is not None)[:k]
            states[d] = "filled" if j + delay < len(dates) else "expired"
            if j + delay < len(dates):
                pending[j + delay] = {x: 1 / len(best) for _, x in best}
        out[d] = gross, traded
    return out, states


def case(seed, gaps):
    r = random.Random(seed)
    days, keys = [DAY + dt.timedelta(i) for i in range(22)], "abcdefg"
    scores = [(d, x, None if r.random() < 0.1 else r.choice((0.1, 0.2, r.random()))) for d in days for x in keys]
    closes = {(d, x): 10 * (1 + r.random()) for d in days for x in keys if not (gaps and r.random() < 0.03)}
    return scores, closes


@pytest.mark.parametrize(("seed", "gaps"), [(1, False), (2, True), (3, True)])
def test_book_as_by_replay(spark, seed, gaps):
    rows, prices, wanted, states = [], [], {}, {}
    for fold in (0, 1):
        scores, closes = case(10 * seed + fold, gaps)
        shift = dt.timedelta(100 * fold)
        rows += [(fold, d + shift, x, s) for d, x, s in scores]
        prices += [(d + shift, x, c) for (d, x), c in closes.items()]
        got, made = replay(scores, closes, 3, 4, 2)
        wanted |= {(fold, d + shift): v for d, v in got.items()}
        states |= {(fold, d + shift): v for d, v in made.items()}
    s = spark.createDataFrame(rows, "fold int, date date, key string, score double")
    c = spark.createDataFrame(prices, "date date, key string, close double")
    book = P.topk_book(s, c, k=3, every=4, delay=2, cost=0.01, by=("fold",), strict=False).collect()
    assert len(book) == len(wanted)
    for x in book:
        gross, traded = wanted[x["fold"], x["date"]]
        assert x["gross"] == pytest.approx(gross) and x["traded"] == pytest.approx(traded)
        assert (x["problem"] == "missing close") == (gross is None or traded is None)
    assert gaps == any(x["problem"] for x in book)
    ledger = P.decision_ledger(s, k=3, every=4, delay=2, by=("fold",)).collect()
    assert {(x["fold"], x["date"]): x["status"] for x in ledger} == states and "expired" in states.values()
    if gaps:
        with pytest.raises(Exception, match="lacks a close"):
            P.topk_book(s, c, k=3, every=4, delay=2, cost=0.01, by=("fold",)).collect()


def test_book_without_fills_or_rows(spark):
    s = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", None)], "date date, key string, score double")
    c = spark.createDataFrame([(DAY, "a", 1.0)], "date date, key string, close double")
    assert [(x["gross"], x["traded"], x["problem"]) for x in P.topk_book(s, c, k=1, every=1, delay=1, cost=0.0).collect()] == [(0.0, 0.0, None)]
    assert P.topk_book(s.where("false"), c, k=1, every=1, delay=1, cost=0.0).count() == 0


def test_demeaning_goes_by_date_first(spark):
    rows = [(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0), (3, "a", 2.0), (3, "b", 8.0)]
    found = M.two_way_demean(spark.createDataFrame(rows, "date int, key string, y double"), "y").collect()
    first = {1: 2.0, 2: 5.0, 3: 5.0}
    left = [(d, k, y - first[d]) for d, k, y in rows]
    mean = {k: sum(v for _, x, v in left if x == k) / sum(x == k for _, x, _ in left) for k in "ab"}
    assert {(x["date"], x["key"]): x["v"] for x in found} == pytest.approx({(d, k): v - mean[k] for d, k, v in left})


def test_chain_tells_a_hash_that_is_gone(spark):
    rows = spark.createDataFrame([(0, i, t, i) for i, t in enumerate(("a", None, "c", "d"))], "chain int, i int, text string, business int")
    ledger = Q.chain_hashes(rows, "i", "text")
    assert Q.chain_violations(ledger, "i", "text", "business").count() == 0
    bad = ledger.withColumns({"text": F.when(F.col("i") == 3, F.lit("x")).otherwise(F.col("text")), "row_sha": F.when(F.col("i") < 3, F.col("row_sha"))})
    assert [(x["i"], x["problem"]) for x in Q.chain_violations(bad, "i", "text", "business").collect()] == [(3, "altered")]
    blank = ledger.withColumn("text", F.coalesce("text", F.lit("")))
    assert [x["i"] for x in Q.chain_violations(blank, "i", "text", "business").collect()] == [1]
