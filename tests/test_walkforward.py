"""Fits from running sums, trees as tables, correlations without a key, areas under curves, and de-duplication against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import models as ML
from tessera.operators import resample as S
from tessera.operators import splits as SP
from tessera.operators import walkforward as WF


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(5)
    rows = [(f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", k, *(float(v) for v in r.normal(10, 3, 3))) for i in range(60) for k in range(12) if r.random() < 0.9]
    df = spark.createDataFrame([(d, k, a, b, c, 0.2 * a - 0.1 * b * (c > 10) + float(r.normal())) for d, k, a, b, c in rows], "date string, key int, a double, b double, c double, y double")
    return df.withColumn("date", F.to_date("date")).cache()


def test_fits_of_all_folds_from_one_scan(spark, panel):
    features = ["a", "b", "c"]
    folds = SP.expanding_folds(panel, 9, 2)
    fits = WF.fit_from_sums(WF.train_sums(panel, folds, features, "y"), features)
    scores = WF.linear_scores(panel, fits, features).toPandas()
    df = panel.toPandas()
    dates = sorted(df["date"].unique())
    got = fits.toPandas()
    assert len(got) == folds.count() > 4
    for _, f in got.iterrows():
        train = df[df["date"].isin(dates[: f["train_last"]])]
        z = (train[features] - train[features].mean()) / train[features].std(ddof=0)
        weights = np.linalg.lstsq(z.to_numpy(), train["y"].to_numpy(), rcond=None)[0]
        assert f["n"] == len(train) and np.allclose(f["weights"], weights)
        val = df[df["date"].isin(dates[f["first"] - 1 : f["last"]])]
        wanted = ((val[features] - train[features].mean()) / train[features].std(ddof=0)).to_numpy() @ weights
        own = scores[scores["fold"] == f["fold"]].sort_values(["date", "key"])
        assert np.allclose(own["score"], pd.Series(wanted, index=val.index).loc[val.sort_values(["date", "key"]).index])


@pytest.mark.parametrize("classify", [False, True])
def test_ensemble_table_gives_the_models_scores(spark, panel, classify):
    features = ["a", "b", "c", "flat"]
    train = panel.withColumns({"flat": F.lit(2.0), "t": (F.col("y") > 1).cast("double") if classify else F.col("y")})
    model = ML.fit_trees(train, features, "t", classify=classify)
    nodes = WF.node_table(model)
    both = ML.score(model, train, features).withColumn("own", WF.ensemble_score(nodes, features, classify=classify)).collect()
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n["tree"], {})[n["node"]] = n
    assert len(trees) == 10 and max(n["feature"] or 0 for t in trees.values() for n in t.values()) == 2
    for x in both:
        total = 0.0
        for t in trees.values():
            n = t[0]
            while n["feature"] is not None:
                n = t[n["left"] if x[features[n["feature"]]] <= n["threshold"] else n["right"]]
            total += n["leaf"] * n["weight"]
        wanted = 1 / (1 + np.exp(-2 * total)) if classify else total
        assert x["score"] == pytest.approx(wanted, abs=1e-12) and x["own"] == pytest.approx(wanted, abs=1e-12)
    gains = {x["feature"]: x for x in WF.gain_table(nodes, features).collect()}
    inner = [n for t in trees.values() for n in t.values() if n["feature"] is not None]
    for i, f in enumerate(features):
        own = [n["gain"] for n in inner if n["feature"] == i]
        assert gains[f]["splits"] == len(own) and gains[f]["gain"] == pytest.approx(np.mean(own) if own else 0)
        assert gains[f]["share"] == pytest.approx(sum(own) / sum(n["gain"] for n in inner))
    assert gains["flat"]["never_used"] == sum(x["splits"] == 0 for x in gains.values()) >= 1


def test_boosted_folds_are_scored_by_their_own_model(spark, panel):
    features = ["a", "b", "c"]
    folds = SP.expanding_folds(panel, 2, 2)
    found = WF.boosted_scores(panel, folds, features, "y", lambda t: ML.fit_trees(t, features, "y", rounds=3)).toPandas()
    dates = sorted(panel.select("date").distinct().toPandas()["date"])
    for f in folds.collect():
        model = ML.fit_trees(panel.where(F.col("date") <= F.lit(dates[f["train_last"] - 1])), features, "y", rounds=3)
        val = ML.score(model, panel.where(F.col("date").between(F.lit(dates[f["first"] - 1]), F.lit(dates[f["last"] - 1]))), features).toPandas()
        own = found[found["fold"] == f["fold"]]
        joined = own.merge(val, on=["date", "key"], suffixes=("", "_w"))
        assert len(own) == len(val) == len(joined) and np.allclose(joined["score"], joined["score_w"])


def brute_ic(rows):
    x, y = pd.Series([r[0] for r in rows]).rank(), pd.Series([r[1] for r in rows]).rank()
    return None if len(rows) < 2 or x.nunique() < 2 or y.nunique() < 2 else float(np.corrcoef(x, y)[0, 1])


def test_correlations_without_each_key(spark):
    r = random.Random(8)
    rows = [(d, k, r.choice((1.0, 2.0, 3.0, r.random())), r.choice((1.0, 2.0, r.random()))) for d, n in enumerate((1, 2, 3, 7, 8, 31, 64, 65)) for k in range(n)]
    rows += [(20, k, 1.0, float(k)) for k in range(5)] + [(21, 0, None, 1.0), (21, 1, 2.0, None), (21, 2, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "date int, key int, x double, y double")
    good = [v for v in rows if v[2] is not None and v[3] is not None and v[2] == v[2]]
    found = S.without_each_key(df, "x", "y").collect()
    assert len(found) == len(good)
    for v in found:
        day = [g for g in good if g[0] == v["date"]]
        for name, wanted in (("ic", brute_ic([g[2:] for g in day])), ("without", brute_ic([g[2:] for g in day if g[1] != v["key"]]))):
            assert (v[name] is None) == (wanted is None) and (wanted is None or v[name] == pytest.approx(wanted, abs=1e-9)), (v, name, wanted)
    keys = spark.createDataFrame([(k,) for k in (0, 5, 64, 99)], "held int")
    for v in S.hold_out_keys(df, "x", "y", keys).collect():
        own = [brute_ic([g[2:] for g in good if g[0] == d and g[1] != v["held"]]) for d in {g[0] for g in good}]
        assert v["mean"] == pytest.approx(np.mean([o for o in own if o is not None]))


def test_area_under_the_curve_with_ties(spark):
    r = random.Random(3)
    rows = [(f, r.choice((0.1, 0.5, r.random(), 1e6 * r.random() ** 9)), r.randint(0, 1)) for f in range(3) for _ in range(200)] + [(9, 0.5, 1), (9, 0.7, 1), (9, None, 0)]
    found = {x["fold"]: x for x in M.auc(spark.createDataFrame(rows, "fold int, s double, l int"), "s", "l").collect()}
    for f in range(3):
        up, down = ([s for g, s, c in rows if g == f and c == want] for want in (1, 0))
        assert found[f]["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in up for b in down) / len(up) / len(down))
    assert found[9]["auc"] is None and found[9]["n"] == 2


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_greedy_choice_of_features(spark, threshold):
    r = np.random.default_rng(1)
    corr = np.corrcoef(r.normal(size=(14, 6)) @ r.normal(size=(6, 12)), rowvar=False)
    names = [f"f{i:02d}" for i in range(12)]
    pairs = spark.createDataFrame([(names[i], names[j], float(corr[i, j])) for i in range(12) for j in range(i + 1, 12)], "a string, b string, rho double")
    kept = []
    for i in np.argsort(-np.abs(corr).sum(axis=0), kind="stable"):
        if all(abs(corr[i, j]) <= threshold for j in kept):
            kept.append(int(i))
    found = ML.deduplicated(pairs, threshold).orderBy("place").collect()
    assert [x["feature"] for x in found if x["kept"]] == [names[i] for i in kept] and len(found) == 12


def test_spread_under_permutations_as_by_rows(spark, panel):
    marked = panel.select("date", "key", "y", (F.col("a") > 11).alias("top"))
    dealt = S.permute_within(marked, "y", 4, carry=("top",))
    wanted = dealt.groupBy("seed", "date").agg((F.avg(F.when(F.col("top"), F.col("permuted"))) - F.avg(F.when(~F.col("top"), F.col("permuted")))).alias("spread")).toPandas()
    found = S.permuted_spread(marked, "y", "top", 4).toPandas()
    both = wanted.merge(found, on=["seed", "date"], suffixes=("", "_w"))
    assert len(both) == len(wanted) == len(found) == 240 and np.allclose(both["spread"], both["spread_w"], equal_nan=True)


def test_purged_folds_grow_as_in_long_form(spark, panel, monkeypatch):
    """Trees of all rows give the scores of the long form; each fit reads the panel's own rows under a condition on dates, joined with nothing."""
    features = ["a", "b", "c"]
    marked = panel.withColumns({"up": (F.col("y") > 1).cast("int"), "a": F.when(F.col("key") != 3, F.col("a"))}).cache()
    trains, fit = [], lambda t: trains.append(t) or ML.fit_trees(t, features, "up", classify=True, rounds=3, share=1.0)
    wanted = ML.fit_by_fold(SP.purged_folds(marked, 3, 2, 1), features, fit, normalise=False).where("part = 'val'").toPandas()
    for at_once in (WF.ROWS_AT_ONCE, 1):
        trains.clear()
        monkeypatch.setattr(WF, "ROWS_AT_ONCE", at_once)
        found = WF.purged_boosted_scores(marked, 3, 2, 1, features, fit, classify=True)
        assert len(trains) == 3 and not any("Join" in t._jdf.queryExecution().optimizedPlan().toString() for t in trains)
        both = wanted.merge(found.toPandas(), on=["date", "key", "fold"], suffixes=("_w", ""))
        assert len(both) == len(wanted) == found.count() and np.allclose(both["score"], both["score_w"], atol=1e-12)


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_rows_walk_the_trees_of_their_own_ensemble(spark, panel, share):
    features = ["a", "b", "c"]
    gaps = panel.withColumns({"fold": F.col("key") % 3, "b": F.when(F.col("key") != 4, F.col("b")), "c": F.when(F.col("key") != 5, F.col("c")).otherwise(float("nan"))})
    nodes = {k: WF.node_table(ML.fit_trees(panel.where(F.col("key") % 2 == k), features, "y", rounds=4, share=share)) for k in (0, 1)}
    one = F.when(F.col("fold") == 0, WF.ensemble_score(nodes[0], features)).when(F.col("fold") == 1, WF.ensemble_score(nodes[1], features))
    got = gaps.select("fold", one.alias("w"), WF.trees_by({k: n.collect() for k, n in nodes.items()}, features, F.col("fold")).alias("s")).collect()
    assert {r["fold"] for r in got} == {0, 1, 2}
    assert all(r["s"] == r["w"] or (r["fold"] == 2 and (r["s"] is None or r["s"] != r["s"]) and r["w"] is None) for r in got)
