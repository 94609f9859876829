"""Walk-forward models without a copy of the panel per fold: linear fits from running sums, tree ensembles as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .cross_section import array_split_folds, date_axis
from .splits import clear_of


def _sum_names(features: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    return [*(f"_x{i}" for i in range(len(features))), "_y", *(f"_xx{i}_{j}" for i, j in pairs), *(f"_xy{i}" for i in range(len(features)))], pairs


def train_sums(panel: DataFrame, folds: DataFrame, features: list[str], label: str) -> DataFrame:
    """All columns of folds (fold, first, last, train_last), n, and the sums of features, label and their products over each fold's train rows.

    The panel is read once: sums per date, and running sums over the date axis (one row per date), of
    which each expanding fold takes the row of its last train date.
    """
    names, pairs = _sum_names(features)
    x, y = [F.col(f).cast("double") for f in features], F.col(label).cast("double")
    values = [*x, y, *(x[i] * x[j] for i, j in pairs), *(v * y for v in x)]
    daily = panel.groupBy("date").agg(F.count("*").alias("n"), *[F.sum(v).alias(c) for v, c in zip(values, names)])
    axis = Window.orderBy("date")
    so_far = axis.rowsBetween(Window.unboundedPreceding, 0)
    running = daily.select(F.row_number().over(axis).alias("train_last"), *[F.sum(c).over(so_far).alias(c) for c in ("n", *names)])
    return folds.join(running, "train_last")


def fit_from_sums(sums: DataFrame, features: list[str], penalty: float = 0.0, floor: float = 1e-9) -> DataFrame:
    """fold, first, last, train_last, n, means, stds, weights: least squares through the origin of the label on the train rows' z-scores.

    One small system of equations per fold, solved in the task that holds the fold's row. A spread
    under the floor counts as 1.
    """
    names, pairs = _sum_names(features)
    k = len(features)

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n, s = row["n"], np.array([row[f"_x{i}"] for i in range(k)])
                mean, gram = s / n, np.zeros((k, k))
                for i, j in pairs:
                    gram[i, j] = gram[j, i] = row[f"_xx{i}_{j}"] - n * mean[i] * mean[j]
                std = np.sqrt(np.maximum(np.diag(gram), 0) / n)
                std = np.where(std < floor, 1.0, std)
                right = (np.array([row[f"_xy{i}"] for i in range(k)]) - mean * row["_y"]) / std
                weights = np.linalg.lstsq(gram / np.outer(std, std) + penalty * np.eye(k), right, rcond=None)[0]
                out.append((row["fold"], row["first"], row["last"], row["train_last"], n, mean.tolist(), std.tolist(), weights.tolist()))
            yield pd.DataFrame(out, columns=["fold", "first", "last", "train_last", "n", "means", "stds", "weights"])

    return sums.mapInPandas(run, "fold int, first int, last int, train_last int, n long, means array<double>, stds array<double>, weights array<double>")


def linear_scores(panel: DataFrame, fits: DataFrame, features: list[str], *, with_train: bool = False) -> DataFrame:
    """All columns of the panel, fold, part, score: each row under the fold that validates on its date; with_train also under each fold that trains on it."""
    placed = panel.join(F.broadcast(date_axis(panel).select("date", "pos")), "date")
    # Folds, and the dates that they validate on, are as few as dates.
    val = fits.withColumn("pos", F.explode(F.sequence("first", "last"))).withColumn("part", F.lit("val"))
    out = placed.join(F.broadcast(val), "pos")
    if with_train:
        train = fits.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("train_last")))).withColumn("part", F.lit("train"))
        out = out.unionByName(placed.join(F.broadcast(train), "pos"))
    score = sum((F.col("weights")[i] * (F.col(f) - F.col("means")[i]) / F.col("stds")[i] for i, f in enumerate(features)), F.lit(0.0))
    return out.select(*panel.columns, "fold", "part", score.alias("score"))


def node_table(model) -> DataFrame:
    """tree, node, feature, threshold, left, right, leaf, weight, gain, n: the nodes of a fitted ensemble of trees on continuous features.

    feature is an index and null in leaves; rows go left up to the threshold. The model is saved and
    its node rows are read back as the table they are stored as.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch(spark)
    model.write().save(path)
    return stored_nodes(spark, path)


def stored_nodes(spark, path: str) -> DataFrame:
    """node_table of a model that was saved under a path."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    inner = F.col("leftChild") >= 0
    return nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"), F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), F.col("prediction").alias("leaf"), "weight", F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("n"),
    )


def ensemble_score(nodes: DataFrame, features: list[str], *, classify: bool = False) -> Column:
    """The ensemble's score as one expression over the features: the weighted sum of leaves, or the probability of 1.

    Nodes are as many as the model has; they are read once, to write the expression.
    """
    trees: dict[int, dict] = {}
    for row in nodes.collect():
        trees.setdefault(row["tree"], {})[row["node"]] = row

    def branch(tree: dict, node: int) -> Column:
        row = tree[node]
        if row["feature"] is None:
            return F.lit(row["leaf"])
        return F.when(F.col(features[row["feature"]]) <= F.lit(row["threshold"]), branch(tree, row["left"])).otherwise(branch(tree, row["right"]))

    total = sum((branch(t, 0) * F.lit(t[0]["weight"]) for _, t in sorted(trees.items())), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * total)) if classify else total


def trees_by(node_rows: dict, features: list[str], by: Column) -> Column:
    """The weighted sum of leaves of one of several ensembles, by its name: node_rows has the node_table rows of each name.

    Rows walk all trees of their ensemble a batch at a time. One expression with the nodes of several
    ensembles makes a method that the JVM does not compile. A missing feature goes right, as in ensemble_score.
    """
    import numpy as np
    import pandas as pd

    shared = {}
    for name, rows in node_rows.items():
        trees: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
            trees.setdefault(r["tree"], []).append(r)
        shared[name] = []
        for _, own in sorted(trees.items()):
            place = {r["node"]: i for i, r in enumerate(own)}
            inner = np.array([r["feature"] is not None for r in own])
            column = lambda f, fill, own=own, inner=inner: np.array([f(r) if i else fill for r, i in zip(own, inner)])
            children = [column(lambda r, side=side, place=place: place[r[side]], 0) for side in ("left", "right")]
            shared[name].append((inner, column(lambda r: r["feature"], 0), column(lambda r: r["threshold"], 0.0), *children, np.array([r["leaf"] * r["weight"] for r in own])))

    def run(rows):
        names, values, out = rows["_by"].to_numpy(), rows.drop(columns="_by").to_numpy(dtype="float64"), np.full(len(rows), np.nan)
        for name, trees in shared.items():
            own = np.flatnonzero(names == name)
            x, total, each = values[own], np.zeros(len(own)), np.arange(len(own))
            for inner, feature, threshold, left, right, leaf in trees:
                at = np.zeros(len(own), dtype=int)
                while inner[at].any():
                    at = np.where(inner[at], np.where(x[each, feature[at]] <= threshold[at], left[at], right[at]), at)
                total += leaf[at]
            out[own] = total
        return pd.Series(out)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "double")(F.struct(by.alias("_by"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]))


def gain_table(nodes: DataFrame, features: list[str]) -> DataFrame:
    """feature, splits, gain (mean over its splits), share (of all gains), cumulative (by share), never_used (how many features no split uses)."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    sums = nodes.where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.avg("gain").alias("gain"), F.sum("gain").alias("_sum"))
    # One row per feature.
    every = F.broadcast(names).join(sums, "feature", "left").na.fill(0, ["splits", "gain", "_sum"])
    share = F.col("_sum") / F.nullif(F.sum("_sum").over(Window.partitionBy()), F.lit(0.0))
    w = Window.orderBy(F.desc("share"), "name").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("share", share)
    return every.select(F.col("name").alias("feature"), "splits", "gain", "share", F.sum("share").over(w).alias("cumulative"), F.count(F.when(F.col("splits") == 0, 1)).over(Window.partitionBy()).alias("never_used"))


def boosted_scores(panel: DataFrame, folds: DataFrame, features: list[str], label: str, fit, *, classify: bool = False) -> DataFrame:
    """All columns of the panel, fold, score: rows under the fold that validates on their date, by an ensemble grown on the fold's train dates.

    fit takes train rows and gives a model. The driver loops over folds, which are as many as models;
    all folds are scored in one pass over the panel. panel should be a written table: each fit reads it.
    """
    # One row per date.
    dates = {r["pos"]: r["date"] for r in date_axis(panel).collect()}
    date, at = F.col("date"), lambda pos: F.lit(dates.get(pos))
    cuts = [(r["fold"], date <= at(r["train_last"]), date.between(at(r["first"]), at(r["last"]))) for r in folds.orderBy("fold").collect()]
    return _boosted(panel, cuts, features, fit, classify)


def purged_boosted_scores(panel: DataFrame, k: int, horizon: int, embargo: int, features: list[str], fit, *, classify: bool = False) -> DataFrame:
    """boosted_scores under splits.purged_folds, without their long form; rows that lack a feature go."""
    spans = array_split_folds(panel, k).groupBy("fold").agg(F.min("date").alias("first"), F.max("date").alias("last")).orderBy("fold").collect()
    ends = [(r["fold"], F.lit(r["first"]), F.lit(r["last"])) for r in spans]
    cuts = [(fold, clear_of(first, last, horizon, embargo), F.col("date").between(first, last)) for fold, first, last in ends]
    return _boosted(panel, cuts, features, fit, classify).na.drop(subset=features)


#: Rows of the panel times fits at once; a fit keeps some 250 bytes a row in the executors' memory.
ROWS_AT_ONCE = 30_000_000


def _boosted(panel: DataFrame, cuts: list[tuple[int, Column, Column]], features: list[str], fit, classify: bool) -> DataFrame:
    """The panel with fold and score by cuts (fold, whether a row trains it, whether it validates it).

    A cut is a condition on the panel's own columns, so fits join nothing. A fit is a chain of short
    jobs; folds of a small panel grow at once, and fill each other's gaps, those of a large one in turn.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target

    def grown(train: Column) -> list:
        return node_table(fit(panel.where(train))).collect()

    with ThreadPool(max(1, min(len(cuts), ROWS_AT_ONCE // max(1, panel.count())))) as pool:
        found = pool.map(inheritable_thread_target(panel.sparkSession)(grown), [train for _, train, _ in cuts], chunksize=1)
    fold = F.lit(None).cast("int")
    for number, _, val in cuts:
        fold = F.when(val, F.lit(number)).otherwise(fold)
    placed = panel.withColumn("fold", fold.cast("int")).where("fold is not null")
    total = trees_by({number: rows for (number, _, _), rows in zip(cuts, found)}, features, F.col("fold"))
    return placed.withColumn("score", 1 / (1 + F.exp(-2 * total)) if classify else total)
