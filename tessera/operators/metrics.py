"""Evaluation of scores: per-date statistics, summaries, agreement, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import avg_rank, col, correlation
from ..sources.scratch import written


def rank_ic(df: DataFrame, score: str, label: str, *, by: tuple[str, ...] = ("date",), min_names: int = 2) -> DataFrame:
    """by, n, ic: rank correlation of score and label on each date, over rows with both.

    Null where fewer than min_names rows are there or a side does not vary.
    """
    both = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.isnan(F.col(label).cast("double")))
    ranked = both.select(*by, avg_rank(score, *by).alias("_s"), avg_rank(label, *by).alias("_l"))
    n = F.count("*")
    return ranked.groupBy(*by).agg(n.alias("n"), F.when(n >= min_names, correlation("_s", "_l")).alias("ic"))


def top_spread(df: DataFrame, score: str, label: str, *, by: tuple[str, ...] = ("date",), key: str = "key", share: float = 0.1, versus: str = "rest") -> DataFrame:
    """by, n, spread: mean label of the top share by score less that of the rest, all, or the bottom share.

    The top has max(1, share of n rounded half to even) rows; ties go by key.
    """
    w = Window.partitionBy(*by)
    k = F.greatest(F.lit(1), F.bround(share * F.count("*").over(w)))
    down, up = F.row_number().over(w.orderBy(F.desc(score), key)), F.row_number().over(w.orderBy(score, F.desc(key)))
    ranked = df.where(F.col(label).isNotNull()).select(*by, F.col(label).alias("_y"), (down <= k).alias("_top"), (up <= k).alias("_low"))
    y = F.col("_y")
    base = {"rest": F.avg(F.when(~F.col("_top"), y)), "all": F.avg(y), "bottom": F.avg(F.when(F.col("_low"), y))}[versus]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(F.when(F.col("_top"), y)) - base).alias("spread"), F.avg(F.when(F.col("_top"), (y > 0).cast("double"))).alias("hit_rate"))


def series_summary(series: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, std, median, positive (share), worst of a per-date series."""
    v = F.col(value)
    return series.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.avg((v > 0).cast("double")).alias("positive"), F.min(v).alias("worst"))


def pooled_rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, rho: rank correlation over all rows together.

    Ranks come from counts per value: a range-partitioned running sum with per-partition offsets, so no task holds all rows.
    """
    # Pairs of values are counted first, so that a value that very many rows have is a few rows in the joins.
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_c"))
    total = lambda e: F.sum(F.col("_c") * e)
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c, r in ((x, "_rx"), (y, "_ry")):
        pairs = pairs.join(global_ranks(whole, c, r), c)
    # Ranks lie around their middle, which keeps the sums small.
    middle = pairs.agg((F.sum("_c") / 2).alias("_m"))
    a, b = F.col("_rx") - F.col("_m"), F.col("_ry") - F.col("_m")
    sums = pairs.join(F.broadcast(middle)).agg(F.sum("_c").alias("n"), total(a).alias("a"), total(b).alias("b"), total(a * b).alias("ab"), total(a * a).alias("aa"), total(b * b).alias("bb"))
    n = F.col("n")
    spread = F.sqrt((F.col("aa") - F.col("a") * F.col("a") / n) * (F.col("bb") - F.col("b") * F.col("b") / n))
    return sums.select(((F.col("ab") - F.col("a") * F.col("b") / n) / F.nullif(spread, F.lit(0.0))).alias("rho"), F.coalesce(n, F.lit(0)).alias("n"))


def ranged(counts: DataFrame, *order: str) -> DataFrame:
    """counts with _r, the number of a row's range in order of the given columns; written, so that all uses see the same ranges.

    One exchange by ranges, whose partition number is the range; the session's settings size it.
    """
    from ..sources.scratch import written

    return written(counts.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()))


def global_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """value, name: the average rank of each distinct value over the whole table.

    Equal values are counted together and dealt into ordered ranges; each range ranks its own values and adds the rows before it.
    """
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), value)
    sums = counts.groupBy("_r").agg(F.sum("_n").alias("_t"))
    # One row per range.
    offsets = sums.select("_r", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(F.broadcast(offsets), "_r").select(value, (F.col("_o") + inside + (F.col("_n") + 1) / 2).alias(name))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, share, q: quantiles over all rows of each by (of which there are few), linear between neighbours; nulls do not count.

    Equal values are counted together and dealt into ordered ranges. The counts of the ranges tell
    which of them hold a wanted place; only those are put in order.
    """
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), *by, "_v")
    key = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    renamed = lambda t: t.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[c for c in t.columns if c not in by])
    sums = counts.groupBy(*by, "_r").agg(F.sum("_n").alias("_t"))
    # One row per range.
    group = Window.partitionBy(*by)
    offsets = sums.withColumns({"_o": F.coalesce(F.sum("_t").over(group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_t").over(group)})
    wanted = offsets.select(*by, "_r", "_o", "_t", "_all", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    place = F.col("share") * (F.col("_all") - 1)
    ends = F.explode(F.array(F.floor(place), F.ceil(place)))
    wanted = wanted.select(*by, "_r", "_o", "_t", "share", place.alias("_place"), ends.alias("_p")).where((F.col("_p") >= F.col("_o")) & (F.col("_p") < F.col("_o") + F.col("_t"))).distinct()
    wanted = wanted.withColumnRenamed("_r", "_w")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = F.broadcast(renamed(wanted.select(*by, "_w").distinct()))
    chosen = counts.join(few, [*key, F.col("_r") == F.col("_w")], "left_semi").withColumn("_i", inside)
    joined = chosen.join(F.broadcast(renamed(wanted)), [*key, F.col("_r") == F.col("_w")])
    hit = joined.where((F.col("_p") >= F.col("_o") + F.col("_i")) & (F.col("_p") < F.col("_o") + F.col("_i") + F.col("_n")))
    low, high = F.min_by("_v", "_p"), F.max_by("_v", "_p")
    return hit.groupBy(*by, "share").agg((low + (high - low) * (F.first("_place") - F.floor(F.first("_place")))).alias("q"))


def quantile_row(df: DataFrame, value: str, names: dict[str, float]) -> DataFrame:
    """One row with exact quantiles under the given names (null without values)."""
    found = exact_quantiles(df, value, list(names.values()))
    return found.agg(*[F.max(F.when(F.col("share") == s, F.col("q"))).alias(n) for n, s in names.items()])


def ranges_of(df: DataFrame) -> int:
    """Into how many ranges a table is dealt by hashes: as many as a shuffle has parts, which the session sets by the size of its data."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scale_diagnostics(df: DataFrame, label: str) -> DataFrame:
    """n, mean, std, low, high, share_large (over 0.2), mean and median of the per-date spread, standardised flag."""
    y = F.col(label)
    by_date = df.where(y.isNotNull()).groupBy("date").agg(F.stddev_samp(y).alias("sd"))
    whole = df.where(y.isNotNull()).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("low"), F.max(y).alias("high"), F.avg((F.abs(y) > 0.2).cast("double")).alias("share_large"))
    spread = by_date.agg(F.avg("sd").alias("mean_sd"), F.median("sd").alias("median_sd"))
    return whole.join(F.broadcast(spread)).withColumn("standardised", F.col("median_sd").between(0.8, 1.2))


def z_contract(df: DataFrame, label: str, tolerance: float = 1e-6) -> DataFrame:
    """dates, mean_ok, std_ok, worst_mean, worst_std: whether each date's label has mean 0 and spread 1."""
    by_date = df.groupBy("date").agg(F.avg(label).alias("m"), F.stddev_samp(label).alias("s")).where("s is not null")
    off_m, off_s = F.abs("m"), F.abs(F.col("s") - 1)
    return by_date.agg(F.count("*").alias("dates"), F.count(F.when(off_m <= tolerance, 1)).alias("mean_ok"), F.count(F.when(off_s <= tolerance, 1)).alias("std_ok"), F.max(off_m).alias("worst_mean"), F.max(off_s).alias("worst_std"))


def daily_sentiment(articles: DataFrame) -> DataFrame:
    """symbol, date, mean, dispersion, n, positive, negative of (symbol, date, sentiment)."""
    s = F.col("sentiment")
    return articles.groupBy("symbol", "date").agg(F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("dispersion"), F.count("*").alias("n"), F.avg((s > 0.2).cast("double")).alias("positive"), F.avg((s < -0.2).cast("double")).alias("negative"))


def score_sanity(df: DataFrame, score: str) -> DataFrame:
    """n, zero, saturated, verdict of a table of scores in [-1, 1]."""
    s = F.col(score)
    stats = df.where(s.isNotNull()).agg(F.count("*").alias("n"), F.avg((s == 0).cast("double")).alias("zero"), F.avg((F.abs(s) >= 1).cast("double")).alias("saturated"), F.stddev_pop(s).alias("_sd"))
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("zero") > 0.95, "mostly zero").when(F.col("saturated") > 0.95, "saturated").when(F.col("_sd") == 0, "constant").otherwise("ok")
    return stats.withColumn("verdict", verdict).drop("_sd")


def breadth_ladder(df: DataFrame, score: str, label: str, names: list[int], reps: int) -> DataFrame:
    """names, variance of the per-date rank correlation over hashed subsamples of so many keys, over reps."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("names"), F.lit(r).alias("rep")) for n in names for r in range(reps)]))
    long = df.select("date", "key", score, label, grid.alias("g")).select("date", "key", score, label, "g.names", "g.rep")
    number = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("date", "key", "names", "rep")]))
    place = F.row_number().over(Window.partitionBy("date", "names", "rep").orderBy(number, "key"))
    picked = long.withColumn("_p", place).where("_p <= names")
    return rank_ic(picked, score, label, by=("date", "names", "rep")).groupBy("names", "rep").agg(F.var_samp("ic").alias("v")).groupBy("names").agg(F.avg("v").alias("variance"))


def breadth_fit(ladder: DataFrame) -> DataFrame:
    """a, b of variance = a + b / names, by least squares over a ladder (names, variance)."""
    inverse = 1 / F.col("names")
    return ladder.agg(F.regr_intercept("variance", inverse).alias("a"), F.regr_slope("variance", inverse).alias("b"))


def votes(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """date, key, votes: how many models have the key in their top share; scores are (date, key, model, score)."""
    w = Window.partitionBy("model", "date")
    k = F.greatest(F.lit(1), F.bround(share * F.count("*").over(w)))
    return scores.withColumn("_top", F.row_number().over(w.orderBy(F.desc("score"), "key")) <= k).where("_top").groupBy("date", "key").agg(F.count("*").alias("votes"))


def pair_divergence(scores: DataFrame, k: int = 10) -> DataFrame:
    """a, b, median and least rank correlation, median and least overlap of the top k, over dates."""
    w = Window.partitionBy("model", "date")
    ranked = scores.withColumns({"_r": avg_rank("score", "model", "date"), "_t": (F.row_number().over(w.orderBy(F.desc("score"), "key")) <= k).cast("int")})
    side = lambda m: ranked.select("date", "key", F.col("model").alias(m), F.col("_r").alias(f"_r{m}"), F.col("_t").alias(f"_t{m}"))
    by_date = side("a").join(side("b"), ["date", "key"]).where("a < b").groupBy("a", "b", "date").agg(correlation("_ra", "_rb").alias("rho"), (F.sum(F.col("_ta") * F.col("_tb")) / k).alias("overlap"), F.avg((F.abs(F.col("_ra") - F.col("_rb")) >= 5).cast("double")).alias("differ"))
    return by_date.groupBy("a", "b").agg(F.median("rho").alias("median_rho"), F.min("rho").alias("least_rho"), F.median("overlap").alias("median_overlap"), F.min("overlap").alias("least_overlap"), F.avg("differ").alias("differ"), F.percentile("rho", F.array(F.lit(0.05), F.lit(0.95))).alias("_p"), F.avg("rho").alias("mean_rho")).withColumns({"p5": F.col("_p")[0], "p95": F.col("_p")[1]}).drop("_p")


def flat_run(curve: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, flat: the longest run of equal y as a share of the x range."""
    w = Window.partitionBy(*by).orderBy(x)
    run = F.sum(F.when(F.col(y).eqNullSafe(F.lag(y).over(w)), 0).otherwise(1)).over(w)
    spans = curve.withColumn("_run", run).groupBy(*by, "_run").agg((F.max(x) - F.min(x)).alias("_span"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return spans.groupBy(*by).agg((F.max("_span") / F.nullif(F.max("_hi") - F.min("_lo"), F.lit(0))).alias("flat"))


def trimmed_mean(series: DataFrame, value: str, n: int) -> DataFrame:
    """mean, without_best, without_worst: without the n largest, or smallest, values of a per-date series."""
    # A per-date series has one row per date, so one ordered window is small.
    up, down = Window.orderBy(F.col(value), "date"), Window.orderBy(F.desc(value), "date")
    ranked = series.select(F.col(value).alias("v"), F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d"))
    return ranked.agg(F.avg("v").alias("mean"), F.avg(F.when(F.col("d") > n, F.col("v"))).alias("without_best"), F.avg(F.when(F.col("u") > n, F.col("v"))).alias("without_worst"))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 from scores and 0/1 labels."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hit = F.col(score) >= F.col("threshold")
    counted = df.select(score, label, grid.alias("threshold")).groupBy("threshold").agg(
        F.count(F.when(hit & (F.col(label) == 1), 1)).alias("tp"), F.count(F.when(hit & (F.col(label) == 0), 1)).alias("fp"), F.count(F.when(~hit & (F.col(label) == 1), 1)).alias("fn")
    )
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return counted.withColumns({"precision": p, "recall": r, "f1": 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """One row, the threshold with the highest f1 of a sweep; the lowest one of equals."""
    return sweep.agg(F.max_by("threshold", F.struct(F.coalesce("f1", F.lit(0.0)), -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ("fold",), slices: int = 1024) -> DataFrame:
    """by, n, positives, auc of 0/1 labels: the rank sum of positives with tie-averaged ranks; null without both classes.

    Rows are counted per value first, and the counts written, since three steps read them. The values of all by are put in order within slices of an even
    cut of each by's range of scores, and slices add what lies below them; no task orders a whole by.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*by, F.col(score).cast("double").alias("_v")).agg(F.count("*").alias("_n"), F.count(F.when(F.col(label) == 1, 1)).alias("_p"))
    counts = written(counts)
    ends = counts.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    cut = counts.join(F.broadcast(ends), list(by)).withColumn("_s", F.coalesce(F.floor(share * slices), F.lit(0)))
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_s").agg(F.sum("_n").alias("_t")).select(*by, "_s", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_below"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("_in", inside).join(F.broadcast(sums), [*by, "_s"])
    rank = F.col("_below") + F.col("_in") + (F.col("_n") + 1) / 2
    total = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_p").alias("positives"), F.sum(F.col("_p") * rank).alias("_r"))
    p = F.col("positives")
    return total.select(*by, "n", "positives", ((F.col("_r") - p * (p + 1) / 2) / F.nullif(p * (F.col("n") - p), F.lit(0))).alias("auc"))


def welch_gap(df: DataFrame, value: str, event: Column) -> DataFrame:
    """One row: mean on event rows less mean on others, its Welch standard error, and t."""
    v = col(value)
    on, off = F.when(event, v), F.when(~event, v)
    se = F.sqrt(F.var_samp(on) / F.count(on) + F.var_samp(off) / F.count(off))
    return df.agg(F.count(on).alias("n_event"), (F.avg(on) - F.avg(off)).alias("gap"), se.alias("se"), ((F.avg(on) - F.avg(off)) / F.nullif(se, F.lit(0.0))).alias("t"))


def two_way_demean(df: DataFrame, value: str, name: str = "v") -> DataFrame:
    """Adds a value less its date's mean, and of what is left less its key's mean: in this order, which matters where dates differ in keys."""
    left = df.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy("date")))
    return left.withColumn(name, F.col(name) - F.avg(name).over(Window.partitionBy("key")))


def completeness(planned: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """planned, completed, failed, missing, failure_ratio of trials; results has status."""
    joined = planned.select(*keys).join(results.select(*keys, "status"), keys, "left")
    s = F.col("status")
    out = joined.agg(F.count("*").alias("planned"), F.count(F.when(s == "completed", 1)).alias("completed"), F.count(F.when(s == "failed", 1)).alias("failed"), F.count(F.when(s.isNull(), 1)).alias("missing"))
    return out.withColumn("failure_ratio", F.col("failed") / F.nullif(F.col("planned"), F.lit(0)))
