"""Tasks whose share does not grow with the tables, and work that is done once."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import models as ML
from tessera.operators import quality as Q
from tessera.sources import scratch as SC
from tessera.streaming import state as ST

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def small_parts(monkeypatch, module):
    monkeypatch.setattr(module, "parts_for", lambda *t: SC.parts_for(*t, most=100))


def test_appends_meet_in_parts_that_follow_their_rows(spark, monkeypatch):
    small_parts(monkeypatch, ST)
    target = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "other").otherwise("same").alias("c"))
    batch = spark.createDataFrame([(1, "same"), (3, "same"), (3, "same"), (5, None), (1000, "a"), (1000, "b"), (None, "x"), (None, "y")], "id long, c string")
    found = ST.append_once(batch, target, ["id"], "c")
    assert sorted((r["id"] or -1, r["state"]) for r in found.collect()) == [(-1, "appended"), (3, "conflict"), (3, "conflict"), (1000, "appended")]
    assert plan(found).count("hashpartitioning(id#") == 2 and ", 10), REPARTITION_BY_NUM" in plan(found)


def test_conflicts_are_counted_in_parts_that_follow_their_rows(spark, monkeypatch):
    small_parts(monkeypatch, Q)
    rows = spark.range(1000).select((F.col("id") % 400).alias("a"), F.when(F.col("id") % 400 == 7, F.col("id")).when(F.col("id") % 400 != 8, 1).alias("c"))
    found = Q.content_conflicts(rows, ["a"], "c")
    assert [tuple(r) for r in found.collect()] == [(7, 3, 3)]
    assert plan(found).count(", 10), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan(found)


def test_weights_by_group_come_from_one_aggregate(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(a), float(b), float(2 * a - b * (g == "u") + e)) for g in "uv" for a, b, e in r.normal(size=(40, 3))] + [("u", None, 1.0, 1.0), ("v", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    got = ML.weights_by(df, "g", ["a", "b"], "y")
    for g in ("u", "v", None):
        own = df.where("y is not null").where(F.lit(True) if g is None else F.col("g") == g)
        assert [got[g]["a"], got[g]["b"]] == pytest.approx(list(ML.fit_linear(own, ["a", "b"], "y").coefficients), abs=1e-9)
    assert ML.weights_by(df.limit(0), "g", ["a", "b"], "y") == {}


@tables
def test_regimes_score_a_panel_made_once(spark):
    from tessera.plans import QUERIES

    assert "lineitem" not in plan(QUERIES["ml_11_regime_specialists"](spark, SF))


def test_normal_share_takes_no_loop_per_row(spark):
    df = spark.createDataFrame([(-9.0,), (-7.2,), (0.0,), (7.2,)], "x double").select(S.normal_cdf("x").alias("p"), S.inverse_normal(F.lit(0.3), refined=True).alias("z"))
    assert "sequence(" not in df._jdf.queryExecution().analyzed().toString()
    got = [r["p"] for r in df.collect()]
    assert got[0] == pytest.approx(6.22e-16, rel=1e-2) and got[1] == pytest.approx(3.0106e-13, rel=1e-3) and got[2:] == pytest.approx([0.5, 1.0], abs=1e-12)


def test_windows_of_many_keys_in_one_call():
    before = pd.DataFrame({"key": ["a", "a", "b", None], "value": [1.0, 2.0, 3.0, 4.0]})
    new = pd.DataFrame({"key": ["b", "a", "b", "c", None], "date": ["2", "2", "1", "1", "1"], "value": [5.0, 6.0, 7.0, 8.0, 9.0]})
    out, kept = ST._windows(before, new, 3)
    assert sorted((k, d, n, tuple(v)) for k, d, n, v in out.itertuples(index=False)) == [("a", "2", 3, (1.0, 2.0, 6.0)), ("b", "2", 3, (3.0, 7.0, 5.0))]
    assert [(k or "", v) for k, v in kept.itertuples(index=False)] == [("a", 2.0), ("a", 6.0), ("b", 7.0), ("b", 5.0), ("", 4.0), ("", 9.0), ("c", 8.0)]
    out, kept = ST._windows(before.iloc[:0], new, 1)
    assert len(out) == 5 and not len(kept)


@tables
@pytest.mark.parametrize("name, states", [("stm_1_ranked_windows", 2), ("stm_2_continued_buffer", 2), ("stm_1_rolling_buffer", 3)])
def test_a_piece_is_one_batch_in_any_number_of_files(spark, name, states):
    from tessera.plans import QUERIES, misc_queries

    made = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(misc_queries, "scratch", lambda s: made.append(SC.scratch(s)) or made[-1])
        QUERIES[name](spark, SF)
    stores = [p for p in made if os.path.isdir(f"{p.removeprefix('file:')}/ck/commits")]
    assert [len([f for f in os.listdir(f"{p.removeprefix('file:')}/ck/commits") if f.isdigit()]) for p in stores] == [states]


@tables
def test_folds_of_trees_read_a_panel_made_once(spark):
    from tessera.plans import QUERIES

    # Panel, long form and scores are written; the answer itself has no table of lines and no model in it.
    found = plan(QUERIES["ml_3_tree_ranker"](spark, SF))
    assert "lineitem" not in found and "UDF(" not in found
    from tessera.operators import splits as SP

    panel = spark.createDataFrame([(i, "k", i * 1.0) for i in range(1, 61)], "date int, key string, x double")
    rows = SP.fold_rows(panel, SP.expanding_folds(panel, 2, 3))
    assert rows.columns == ["date", "key", "x", "fold", "part"] and rows.where("x <> date").count() == 0


def test_chains_are_checked_by_slices(spark, monkeypatch):
    monkeypatch.setattr(Q, "SLICE", 4)
    small_parts(monkeypatch, Q)
    rows = spark.createDataFrame([(c, i, f"t{i}", f"{c}-{min(i, 17)}") for c in (1, None) for i in range(19)], "chain long, i int, text string, k string")
    ledger = SC.written(Q.chain_hashes(rows, "i", "text"))
    twice = {(c, i, "repeated_key") for c in (1, None) for i in (17, 18)}
    assert {tuple(r) for r in Q.chain_violations(ledger, "i", "text", "k").collect()} == twice
    # Rows 4 to 8 go, a whole slice among them; row 11 ends a slice and changes.
    bad = ledger.where("i not between 4 and 8").withColumn("row_sha", F.when(F.col("i") == 11, F.lit("x")).otherwise(F.col("row_sha")))
    wanted = {(c, i, p) for c in (1, None) for i, p in ((9, "gap"), (9, "broken_link"), (11, "altered"), (12, "broken_link"))}
    assert {tuple(r) for r in Q.chain_violations(bad, "i", "text", "k").collect()} == twice | wanted


def test_files_fill_whole_waves(spark):
    assert [SC.full_waves(spark.range(n), most=100) for n in (0, 399, 401, 900)] == [4, 4, 8, 12]


@tables
def test_boosted_exit_reads_events_and_scores_once(spark):
    from tessera.plans import QUERIES

    # Counts per score are written: the answer has no model, tree or long form in it.
    found = QUERIES["ml_5_boosted_exit"](spark, SF)
    assert not any(word in plan(found) for word in ("UDF(", "ArrowEvalPython", "so_far", "part#"))


@tables
def test_dates_of_the_tree_panel_are_dealt_over_files(spark):
    from tessera.plans import misc_queries

    files = misc_queries.tree_panel(spark, SF).select("date", F.input_file_name().alias("file")).groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).where("n >= 8").collect()
    assert files and np.mean([r["files"] for r in files]) > 2


def test_expanding_folds_fit_rows_of_the_panel_joined_with_nothing(spark):
    from tessera.operators import splits as SP
    from tessera.operators import walkforward as WF

    r = np.random.default_rng(2)
    panel = spark.createDataFrame([(d, k, float(x), float(x + e)) for d in range(1, 61) for k, (x, e) in enumerate(r.normal(size=(9, 2)))], "date int, key int, x double, y double").cache()
    trains = []
    found = WF.boosted_scores(panel, SP.expanding_folds(panel, 2, 2), ["x"], "y", lambda t: trains.append(t) or ML.fit_trees(t, ["x"], "y", rounds=2))
    assert sorted((t.agg(F.max("date")).first()[0], t.count()) for t in trains) == [(38, 38 * 9)]
    assert not any("Join" in t._jdf.queryExecution().optimizedPlan().toString() for t in trains)
    assert found.columns == ["date", "key", "x", "y", "fold", "score"] and found.where("score is null").count() == 0
