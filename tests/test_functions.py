"""Distribution functions, sorted lookups and envelope checks against independent numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import models as ML
from tessera.operators import quality as Q


def test_normal_distribution_and_its_inverse(spark):
    rows = [(float(x),) for x in np.linspace(-7.5, 7.5, 61)]
    for x, p in spark.createDataFrame(rows, "x double").select("x", S.normal_cdf("x")).collect():
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)
    ps = [(p,) for p in (1e-6, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.999, 1 - 1e-7)]
    for p, z in spark.createDataFrame(ps, "p double").select("p", S.inverse_normal("p", refined=True)).collect():
        assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, abs=1e-13)


def test_student_tail(spark):
    #: Two-sided 5 percent points of tables, by degrees (fixed values).
    points = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 10: 2.228139, 29: 2.045230, 120: 1.979930}
    df = spark.createDataFrame([(n, t) for n, t in points.items()], "n int, t double")
    for n, t, up, down, none in df.select("n", "t", S.student_tail("t", "n"), S.student_tail(-F.col("t"), "n"), S.student_tail("t", 0)).collect():
        assert up == pytest.approx(0.025, abs=1e-7) and down == pytest.approx(0.975, abs=1e-7) and none is None


@pytest.mark.parametrize("most", [1000, 0])
def test_lookup_on_a_curve(spark, most):
    r = random.Random(1)
    x = sorted([r.random() ** 4 * 100 for _ in range(200)] + [5.0, 5.0, 5.0])
    points = [(a, r.random()) for a in x] + [(None, 1.0)]
    values = [None, float("nan"), -1.0, 101.0, x[0], x[-1], *x[3:60:7], *(r.random() * 100 for _ in range(300))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = ML.calibrated(df, "v", spark.createDataFrame(points, "x double, y double"), most=most).collect()
    own = sorted(p for p in points if p[0] is not None)
    assert len(found) == len(values)
    for row in found:
        v = row["v"]
        if v is None or v != v:
            assert row["calibrated"] is None or v is not None
        elif v <= own[0][0] or v >= own[-1][0]:
            assert row["calibrated"] == pytest.approx(own[0][1] if v <= own[0][0] else own[-1][1])
        else:
            at = max(i for i, p in enumerate(own) if p[0] <= v)
            (a, y), (b, z) = own[at], own[at + 1]
            assert row["calibrated"] == pytest.approx(y + (v - a) / (b - a) * (z - y))


def test_lookup_of_many_breakpoints_has_no_nested_loop(spark, capsys):
    points = spark.range(1_000_000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    df = spark.createDataFrame([(0.5,), (123_456.25,), (2e6,)], "v double")
    assert [round(r["calibrated"], 6) for r in ML.calibrated(df, "v", points).collect()] == [1.0, 246912.5, 1999998.0]
    for most in (1_000_000, 10):
        ML.calibrated(df, "v", points.limit(1000), most=most).explain()
        assert "NestedLoopJoin" not in capsys.readouterr().out.replace("BroadcastNestedLoopJoin BuildRight, Cross", "").replace("BroadcastNestedLoopJoin BuildRight, Inner", "")


def test_envelopes_that_are_no_envelopes(spark):
    docs = [None, "", "[]", "3", "{}", '{"signals": 3}']
    found = Q.signal_envelope_problems(spark.createDataFrame(list(enumerate(docs)), "i int, doc string"), "doc").collect()
    assert len(found) == len(docs) and all(x["problems"] for x in found)
