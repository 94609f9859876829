"""Permutations, bootstraps, blocks and dependence-aware statistics as distributed jobs.

Random choices come from a hash of the row's own identity and a seed. They do not depend on
partitions or on the order of rows, and repeat on every run; seeds are rows, not a driver loop.
Draws of blocks use MD5, which SQL engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import avg_rank, col, correlation, t_statistic


#: Numbers of permutations are drawn below this prime; their squares fit into 64 bits.
PRIME = (1 << 31) - 1


def uniform(*columns) -> Column:
    """A number in [0, 1) from the MD5 of the columns, joined by bars."""
    digest = F.md5(F.concat_ws("|", *[col(c).cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))


def normal(*columns) -> Column:
    """A standard normal number from two hashes of the columns (Box and Muller)."""
    u, v = uniform(*columns, F.lit(1)), uniform(*columns, F.lit(2))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(3.141592653589793) * v)


def seeds(n: int) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(n)]))


def permute_within(df: DataFrame, value: str, n_seeds: int, *, date: str = "date", key: str = "key", carry: tuple[str, ...] = ()) -> DataFrame:
    """seed, date, key, value, carry, permuted: each seed deals a date's values anew to its keys; every date keeps its values.

    The i-th key of a date gets the value of the key with the i-th number, which is drawn for seed and
    key from the MD5 of key and date. A date's cross-section is one array, put in both orders where it
    lies: one shuffle for all seeds.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(date).cast("string"))), 1, 7), 16, 10).cast("long")
    # The seeds multiply the rows behind the shuffle, so its parts must not be joined for being small.
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), date)
    own = spread.groupBy(date).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("_k"), F.col(value).alias("_v"), number.alias("_h"), *carry))).alias("_a"))
    seeded = own.select(date, "_a", seeds(n_seeds).alias("seed")).withColumn("_m", F.pmod((F.col("seed").cast("long") + 1) * F.lit(1103515245) + 12345, F.lit(PRIME - 1).cast("long")) + 1)
    once = lambda r: F.pmod(r["_h"] * F.col("_m"), F.lit(PRIME))
    hashed = F.transform(F.transform("_a", lambda r: F.struct(once(r).alias("h"), r["_v"].alias("v"))), lambda r: F.struct(F.pmod(r["h"] * r["h"] + F.col("_m"), F.lit(PRIME)).alias("h"), r["v"].alias("v")))
    # Equal numbers, which are rare, go by value.
    dealt = F.transform(F.sort_array(hashed), lambda r: r["v"])
    rows = seeded.select("seed", date, F.explode(F.arrays_zip(F.col("_a").alias("a"), dealt.alias("p"))).alias("_r"))
    return rows.select("seed", date, F.col("_r.a._k").alias(key), F.col("_r.a._v").alias(value), *[F.col(f"_r.a.{c}").alias(c) for c in carry], F.col("_r.p").alias("permuted"))


def permuted_spread(df: DataFrame, value: str, top: str, n_seeds: int, *, date: str = "date", key: str = "key") -> DataFrame:
    """seed, date, spread: mean value of the rows marked by `top` less that of the others, under permute_within's values of each seed.

    A date's rows lie in one task as arrays; all seeds are drawn there, some at a time, and give one
    row each, so that no row is made for each seed and key. Values are not null.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(date).cast("string"))), 1, 7), 16, 10).cast("long")
    rows = df.select(F.col(date).alias("_date"), F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"), number.alias("_h"), F.col(top).cast("boolean").alias("_t"))

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, sort_keys=[("_k", "ascending")]))
        marked = table.column("_t").to_numpy(zero_copy_only=False).astype(bool)
        v, h = table.column("_v").to_numpy(), table.column("_h").to_numpy()
        by_value = np.argsort(v, kind="stable")
        v, h, high = v[by_value], h[by_value], np.empty(n_seeds)
        step = max(1, 2_000_000 // len(v))
        for first in range(0, n_seeds, step):
            m = (np.arange(first, min(n_seeds, first + step), dtype=np.int64)[:, None] + 1) * 1103515245 + 12345
            m = m % (PRIME - 1) + 1
            x = h * m % PRIME
            # Equal numbers go by value.
            place = np.argsort((x * x + m) % PRIME, axis=1, kind="stable")
            high[first : first + len(m)] = v[place][:, marked].sum(1)
        many, rest = marked.sum(), (~marked).sum()
        spread = high / many - (v.sum() - high) / rest if many and rest else np.full(n_seeds, np.nan)
        return pa.table({"seed": pa.array(np.arange(n_seeds, dtype=np.int32)), date: pa.concat_arrays([table.column("_date").combine_chunks().take(pa.array(np.zeros(n_seeds, np.int64)))]), "spread": pa.array(spread, mask=np.isnan(spread))})

    return rows.groupBy("_date").applyInArrow(run, f"seed int, `{date}` {df.schema[date].dataType.simpleString()}, spread double")


def permute_pooled(df: DataFrame, value: str, seed: int, key: list[str], parts: int | None = None) -> DataFrame:
    """key columns, value, permuted: all values dealt anew over the whole table.

    Rows are dealt into hashed ranges twice, ordered inside them, and numbered with the counts of the
    ranges before, so no task orders all rows. parts: how many ranges; as many as a shuffle has, by default.
    """
    from .metrics import ranges_of

    parts = parts or ranges_of(df)

    def numbered(source: DataFrame, name: str, salt: int) -> DataFrame:
        h = F.xxhash64(*key, F.lit(seed), F.lit(salt))
        ranged = source.withColumns({"_h": h, "_r": F.floor(F.shiftrightunsigned(h, 1) / F.lit((1 << 63) / parts)).cast("int")})
        sums = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
        offsets = sums.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *key))
        return ranged.withColumn("_p", place).join(F.broadcast(offsets), "_r").withColumn(name, F.col("_o") + F.col("_p")).drop("_h", "_r", "_o", "_p")

    own = numbered(df.select(*key, value), "_k", 1)
    other = numbered(df.select(*key, value), "_k", 2).select("_k", F.col(value).alias("permuted"))
    return own.join(other, "_k").drop("_k")


def positions(series: DataFrame, date: str = "date") -> DataFrame:
    """A per-date series (one row per date) with pos from 0."""
    return series.withColumn("pos", F.row_number().over(Window.orderBy(date)) - 1)


def blocks(series: DataFrame, value: str, length: int, *, keep_rest: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """by, block, mean, n of runs of so many positions."""
    out = series.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col("pos") / length).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out if keep_rest else out.where(F.col("n") == length)


def gapped_blocks(series: DataFrame, value: str, h: int, gap: int, least: int) -> DataFrame:
    """block, mean, n of runs of h positions with gap positions between; runs with fewer than `least` values go."""
    inside = series.where((F.pmod("pos", F.lit(h + gap)) < h) & F.col(value).isNotNull())
    return inside.groupBy(F.floor(F.col("pos") / (h + gap)).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def block_t(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, blocks, mean, t over block means."""
    return found.groupBy(*by).agg(F.count("*").alias("blocks"), F.avg("mean").alias("mean"), t_statistic("mean").alias("t"))


def leave_one_out(found: DataFrame) -> DataFrame:
    """low, high: the mean without each block, at its least and largest."""
    total = found.agg(F.sum("mean").alias("_s"), F.count("*").alias("_n"))
    out = found.join(F.broadcast(total)).select(((F.col("_s") - F.col("mean")) / F.nullif(F.col("_n") - 1, F.lit(0))).alias("m"))
    return out.agg(F.min("m").alias("low"), F.max("m").alias("high"))


def _drawn_blocks(series: DataFrame, value: str, length: int, n_boot: int, seed: int, circular: bool) -> tuple[DataFrame, DataFrame]:
    """The numbered series (i from 1, v; twice if circular), and rep, draw, a, b: blocks of the numbers above a up to b."""
    series = series.where(F.col(value).isNotNull()).select(F.row_number().over(Window.orderBy("pos")).alias("i"), F.col(value).alias("v"))
    n = series.agg(F.count("*").alias("n"))
    if circular:
        series = series.union(series.join(F.broadcast(n)).select((F.col("i") + F.col("n")).alias("i"), "v"))
    count = F.ceil(F.col("n") / length)
    draws = series.sparkSession.range(n_boot).withColumnRenamed("id", "rep").join(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(1), count)))
    starts = F.col("n") if circular else F.greatest(F.lit(1), F.col("n") - length + 1)
    draws = draws.withColumn("a", F.floor(uniform("rep", "draw", F.lit(seed)) * starts))
    size = F.least(F.lit(length), F.col("n") - (F.col("draw") - 1) * length, F.when(F.lit(circular), F.lit(length)).otherwise(F.col("n") - F.col("a")))
    return series, draws.select("rep", "draw", "a", (F.col("a") + size).alias("b"))


def block_bootstrap(series: DataFrame, value: str, length: int, n_boot: int, seed: int, *, circular: bool = False) -> DataFrame:
    """rep, mean of replicates that string together hashed blocks of `length` positions.

    Prefix sums over the series make each drawn block two lookups; the series has one row per date.
    """
    series, draws = _drawn_blocks(series, value, length, n_boot, seed, circular)
    sums = series.select("i", F.sum("v").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    upper, lower = (sums.select(F.col("i").alias(k), F.col("s").alias(f"s{k}")) for k in ("b", "a"))
    picked = draws.join(F.broadcast(upper), "b").join(F.broadcast(lower), "a", "left")
    return picked.groupBy("rep").agg((F.sum(F.col("sb") - F.coalesce("sa", F.lit(0.0))) / F.sum(F.col("b") - F.col("a"))).alias("mean"))


def bootstrap_difference(one: DataFrame, other: DataFrame, value: str, length: int, n_boot: int, seed: int) -> DataFrame:
    """rep, mean: the mean of one series less that of another, each drawn anew on its own."""
    a, b = (block_bootstrap(s, value, length, n_boot, seed + k) for k, s in enumerate((one, other)))
    return a.withColumnRenamed("mean", "_a").join(b.withColumnRenamed("mean", "_b"), "rep").select("rep", (F.col("_a") - F.col("_b")).alias("mean"))


def exceedance(series: DataFrame, value: str, donor: int, length: int, bar: float, n_boot: int, seed: int, least: int) -> DataFrame:
    """replicates, donors, share: how often the block t of a centred series, strung together from circular blocks, exceeds the bar.

    Blocks of `donor` positions are drawn, and t is taken over blocks of `length`; the share is null
    with fewer than `least` whole blocks to draw from. A replicate's series has one row per date.
    """
    own = series.where(F.col(value).isNotNull())
    centred = own.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy()))
    numbered, draws = _drawn_blocks(centred, "_x", donor, n_boot, seed, True)
    long = draws.select("rep", "draw", F.posexplode(F.sequence(F.col("a") + 1, F.col("b"))).alias("k", "i"))
    strung = long.join(F.broadcast(numbered), "i").select("rep", ((F.col("draw") - 1) * donor + F.col("k")).alias("pos"), "v")
    t = block_t(blocks(strung, "v", length, by=("rep",)), ("rep",))
    donors = own.agg(F.floor(F.count("*") / donor).alias("donors"))
    share = F.avg((F.abs("t") > bar).cast("double"))
    return t.agg(F.count("*").alias("replicates"), share.alias("_share")).join(F.broadcast(donors)).select("replicates", "donors", F.when(F.col("donors") >= least, F.col("_share")).alias("share"))


def bootstrap_interval(replicates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """low, high, p (two-sided, of zero) from replicate means."""
    q = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    below = F.avg((F.col("mean") <= 0).cast("double"))
    return replicates.agg(q.alias("q"), (2 * F.least(below, 1 - below)).alias("p")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p")


def lagged_products(series: DataFrame, value: str, max_lag: int) -> DataFrame:
    """lag, s: sums of products of the centred series with itself so many positions before, over its n; n."""
    own = series.where(F.col(value).isNotNull()).select("pos", F.col(value).alias("v"))
    mean = own.agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    centred = own.join(F.broadcast(mean)).select("pos", (F.col("v") - F.col("m")).alias("x"), "n")
    ahead = centred.select("x", "n", F.col("pos").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("pos", F.col("_p") - F.col("lag"))
    return ahead.join(centred.select("pos", F.col("x").alias("y")), "pos").groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.first("n")).alias("s"), F.first("n").alias("n"))


def autocorrelation(series: DataFrame, value: str, max_lag: int) -> DataFrame:
    """lag, rho from lag 1 on."""
    products = lagged_products(series, value, max_lag)
    base = products.where("lag = 0").select(F.col("s").alias("_s"))
    return products.where("lag > 0").join(F.broadcast(base)).select("lag", (F.col("s") / F.nullif(F.col("_s"), F.lit(0.0))).alias("rho"))


def newey_west(series: DataFrame, value: str, max_lag: int) -> DataFrame:
    """mean, se, t of a per-date series with Bartlett weights."""
    weighted = F.col("s") * F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (max_lag + 1)))
    variance = lagged_products(series, value, max_lag).agg((F.sum(weighted) / F.first("n")).alias("_v"))
    mean = series.agg(F.avg(value).alias("mean"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("_v")))
    return mean.join(F.broadcast(variance)).select("mean", se.alias("se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds passed: Holm's step-down over a family of p values (name, p); a family has few rows."""
    w = Window.orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy())
    ok = F.col("p") <= alpha / (m - F.row_number().over(w) + 1)
    return tests.withColumn("_ok", ok).withColumn("passed", F.bool_and("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok")


def control_verdict(draws: DataFrame, bar: float) -> DataFrame:
    """control, n, t, verdict of (control, x): UNPROVEN under 5 draws or without spread, NOT_NULL beyond the bar, else CLEAN."""
    stats = draws.groupBy("control").agg(F.count("x").alias("n"), t_statistic("x").alias("t"))
    verdict = F.when((F.col("n") < 5) | F.col("t").isNull(), "UNPROVEN").when(F.abs("t") > bar, "NOT_NULL").otherwise("CLEAN")
    return stats.withColumn("verdict", verdict)


def control_rates(df: DataFrame, score: str, label: str, n_seeds: int, length: int, bar: float) -> DataFrame:
    """seeds, false_positives, power: how often |t| exceeds the bar for a score against dealt labels, and for labels mixed evenly with dealt ones.

    Both controls come from the same within-date permutations of the label's ranks; t is that of block means.
    """
    both = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranked = both.select("date", "key", avg_rank(score, "date").alias("_s"), avg_rank(label, "date").alias("_l"))
    dealt = permute_within(ranked, "_l", n_seeds, carry=("_s",))
    ics = dealt.groupBy("seed", "date").agg(correlation("_s", "permuted").alias("none"), correlation("_l", F.col("_l") + F.col("permuted")).alias("mixed"))
    placed = ics.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy("date")) - 1)
    t = lambda c: block_t(blocks(placed, c, length, by=("seed",)), ("seed",)).select("seed", F.col("t").alias(c))
    rate = lambda c: F.avg((F.abs(c) > bar).cast("double"))
    return t("none").join(t("mixed"), "seed").agg(F.count("*").alias("seeds"), rate("none").alias("false_positives"), rate("mixed").alias("power"))


def permutation_null(df: DataFrame, score: str, label: str, n_seeds: int, length: int) -> DataFrame:
    """seed, t: the block t of the rank correlation under each within-date permutation of the label."""
    # Dealing values anew deals their ranks: both sides are ranked once for all seeds.
    both = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranked = both.select("date", "key", avg_rank(score, "date").alias("_s"), avg_rank(label, "date").alias("_l"))
    dealt = permute_within(ranked, "_l", n_seeds, carry=("_s",))
    ics = dealt.groupBy("seed", "date").agg(F.when(F.count("*") >= 2, correlation("_s", "permuted")).alias("ic"))
    placed = ics.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy("date")) - 1)
    return block_t(blocks(placed, "ic", length, by=("seed",)), ("seed",)).select("seed", "t")


def critical_value(null: DataFrame, df: int, level: float = 0.95) -> DataFrame:
    """bar: the larger of Student's quantile and the permutations' quantile of |t|; null_quantile."""
    from ..functions.scalar import t_quantile

    q = F.percentile(F.abs("t"), level)
    return null.agg(q.alias("null_quantile"), F.greatest(q, F.lit(t_quantile(1 - (1 - level) / 2, df))).alias("bar"))


def without_each_key(df: DataFrame, score: str, label: str) -> DataFrame:
    """date, key, ic, without: each date's rank correlation, and what it is without each of its keys.

    Without a row, ranks above its value fall by one and those of equal values by a half. So all
    correlations of a date follow from its sums, from running sums of the ranks above each row, and from
    one count per row, of the rows above it on both sides, which comes from merging ordered runs of
    doubled length. The work is linear in the panel, with the square of the logarithm of a date's keys;
    a date's rows lie in one task. A key is on a date once; rows without score or label do not count.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.isnan(F.col(label).cast("double")))
    rows = rows.select("date", "key", F.col(score).cast("double").alias("_x"), F.col(label).cast("double").alias("_y"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(table):
        import numpy as np
        import pyarrow as pa

        x, y = (table.column(c).to_numpy() for c in ("_x", "_y"))
        n = len(x)
        level_x, level_y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
        ic, without = _without_each(level_x, level_y)
        return pa.table({"date": table.column("date"), "key": table.column("key"), "ic": pa.array([ic] * n, pa.float64()), "without": pa.array(without, mask=np.isnan(without))})

    return rows.groupBy("date").applyInArrow(run, f"date {kinds['date']}, key {kinds['key']}, ic double, without double")


def _above_both(x, y, from_x, from_y):
    """For each pair of bounds, how many points have at least both of them; all are levels from 0."""
    import numpy as np

    n = len(x)
    order = np.argsort(-x, kind="stable")
    ys, length = y[order], np.searchsorted(-x[order], -from_x, "right")
    wide, out, start = int(max(y.max(), from_y.max())) + 2, np.zeros(len(from_x), np.int64), np.zeros(len(from_x), np.int64)
    # The points from a bound of x on are a prefix: a run of each power of two that its length has.
    for k in reversed(range(n.bit_length())):
        use = np.flatnonzero(length >> k & 1)
        if not len(use):
            continue
        runs = np.sort((np.arange(n) >> k) * wide + ys)
        at = start[use] >> k
        out[use] += np.searchsorted(runs, (at + 1) * wide) - np.searchsorted(runs, at * wide + from_y[use])
        start[use] += 1 << k
    return out


def _without_each(x, y):
    """The rank correlation of two columns of levels, and that without each row; None or NaN where a side does not vary."""
    import numpy as np

    n = len(x)
    sides = []
    for v in (x, y):
        count = np.bincount(v)
        rank = (np.cumsum(count) - count + (count + 1) / 2)[v]
        ties = (count.astype(np.float64) ** 3 - count).sum()
        # Squares of ranks follow from the ties, also without a row of a tie.
        t = count[v].astype(np.float64)
        sides.append((rank, ties, ties - (t**3 - t) + ((t - 1) ** 3 - (t - 1))))
    (a, ties_a, less_a), (b, ties_b, less_b) = sides

    def correlation(m, products, ta, tb):
        square = lambda t: m * (m * m - 1) / 12 - t / 12
        spread = square(ta) * square(tb)
        return np.where(spread > 1e-9, (products - m * (m + 1) ** 2 / 4) / np.sqrt(np.maximum(spread, 1e-300)), np.nan)

    whole = float(correlation(n, (a * b).sum(), ties_a, ties_b))
    if n < 3:
        return (None if np.isnan(whole) else whole), np.full(n, np.nan)

    def ranks_above(v, ranks):
        """Sum of the ranks of rows above each row by v, and half of those beside it."""
        per = np.bincount(v, ranks)
        return ((per.sum() - np.cumsum(per)) + per / 2)[v] - ranks / 2

    both = sum(_above_both(x, y, x + i, y + j) for i in (0, 1) for j in (0, 1)) / 4 - 0.25
    products = (a * b).sum() - a * b - ranks_above(y, a) - ranks_above(x, b) + both
    return (None if np.isnan(whole) else whole), correlation(n - 1, products, less_a, less_b)


def hold_out_keys(df: DataFrame, score: str, label: str, keys: DataFrame) -> DataFrame:
    """held, mean: the mean rank correlation over dates without each held-out key; keys has one row per key (held)."""
    rows = without_each_key(df, score, label)
    dates = rows.groupBy("date").agg(F.first("ic").alias("ic")).agg(F.coalesce(F.sum("ic"), F.lit(0.0)).alias("_s"), F.count("ic").alias("_c"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = rows.groupBy(F.col("key").alias("held")).agg(F.sum(zero("without") - zero("ic")).alias("_ds"), (F.count("without") - F.count("ic")).alias("_dc"))
    both = keys.join(own, "held", "left").join(F.broadcast(dates))
    return both.select("held", ((F.col("_s") + zero("_ds")) / F.nullif(F.col("_c") + F.coalesce("_dc", F.lit(0)), F.lit(0))).alias("mean"))


def halves_agree(series: DataFrame, value: str) -> DataFrame:
    """One row: n, first, second (means of the two halves of the dates, the odd one in the second), whole, agree (all three have one sign)."""
    w = Window.orderBy("date")
    v = F.col(value)
    placed = series.where(v.isNotNull()).select(v.alias("v"), (2 * F.row_number().over(w) <= F.count("*").over(Window.partitionBy())).alias("early"))
    found = placed.agg(F.count("*").alias("n"), F.avg(F.when(F.col("early"), F.col("v"))).alias("first"), F.avg(F.when(~F.col("early"), F.col("v"))).alias("second"), F.avg("v").alias("whole"))
    return found.withColumn("agree", (F.signum("first") == F.signum("whole")) & (F.signum("second") == F.signum("whole")))


def fresh_and_stale(df: DataFrame, score: str, label: str, lag: int) -> DataFrame:
    """date, fresh, stale, gain: rank correlation with the score of the row itself and of `lag` rows before, over rows with both."""
    from .metrics import rank_ic

    w = Window.partitionBy("key").orderBy("date")
    both = df.withColumn("_old", F.lag(score, lag).over(w)).where(F.col("_old").isNotNull() & F.col(label).isNotNull())
    fresh = rank_ic(both, score, label).select("date", F.col("ic").alias("fresh"))
    stale = rank_ic(both, "_old", label).select("date", F.col("ic").alias("stale"))
    return fresh.join(stale, "date").withColumn("gain", F.col("fresh") - F.col("stale"))


def placebo_threshold(real, floor: float = 0.01, ratio: float = 0.5) -> Column:
    return F.greatest(F.lit(floor), ratio * F.abs(col(real)))


def overfitting(table: DataFrame, groups: int = 6) -> DataFrame:
    """pbo, splits: probability of backtest overfitting by combinatorially symmetric cross-validation.

    table: (config, pos, value). Positions are cut into `groups` runs; for each half of the runs the
    best config by mean is looked up in the other half (Bailey, Borwein, Lopez de Prado and Zhu).
    """
    from itertools import combinations

    halves = [sum(1 << i for i in c) for c in combinations(range(groups), groups // 2)]
    n = table.agg((F.max("pos") + 1).alias("_n"))
    runs = table.join(F.broadcast(n)).withColumn("run", F.least(F.lit(groups - 1), F.floor(F.col("pos") * groups / F.col("_n"))).cast("int"))
    sums = runs.groupBy("config", "run").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    grid = sums.select("config", "run", "s", "c", F.explode(F.array(*[F.lit(h) for h in halves])).alias("half"))
    inside = F.expr("shiftright(half, run) & 1") == 1
    means = grid.groupBy("half", "config").agg((F.sum(F.when(inside, F.col("s"))) / F.sum(F.when(inside, F.col("c")))).alias("a"), (F.sum(F.when(~inside, F.col("s"))) / F.sum(F.when(~inside, F.col("c")))).alias("b"))
    w = Window.partitionBy("half")
    ranked = means.withColumns({"_r": F.rank().over(w.orderBy("b")), "_n": F.count("*").over(w), "_best": F.row_number().over(w.orderBy(F.desc("a"), "config"))})
    place = F.col("_r") / (F.col("_n") + 1)
    return ranked.where("_best = 1").agg(F.avg((place <= 0.5).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def deflated_sharpe(series: DataFrame, value: str, trials: int, sharpe_variance: float) -> DataFrame:
    """sharpe, expected (largest of so many trials), z: distance of the Sharpe ratio from it, with skew and kurtosis (Bailey and Lopez de Prado)."""
    from statistics import NormalDist

    gamma, inv = 0.5772156649015329, NormalDist().inv_cdf
    expected = sharpe_variance**0.5 * ((1 - gamma) * inv(1 - 1 / trials) + gamma * inv(1 - 1 / (trials * 2.718281828459045)))
    stats = series.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n"), F.skewness(value).alias("sk"), (F.kurtosis(value) + 3).alias("ku"))
    sr = F.col("m") / F.nullif(F.col("s"), F.lit(0.0))
    z = (sr - expected) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("sk") * sr + (F.col("ku") - 1) / 4 * sr * sr)
    return stats.select(sr.alias("sharpe"), F.lit(expected).alias("expected"), z.alias("z"))


def paired_difference(cells: DataFrame, a: str, b: str) -> DataFrame:
    """date, diff of two cells of (cell, date, value)."""
    wide = cells.where(F.col("cell").isin(a, b)).groupBy("date").pivot("cell", [a, b]).agg(F.first("value"))
    return wide.select("date", (F.col(a) - F.col(b)).alias("diff")).where("diff is not null")


def double_difference(cells: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """date, diff: (a1 - a0) - (b1 - b0) of cells (cell, date, value), on dates that have all four; a and b name (with, without)."""
    names = [*a, *b]
    wide = cells.where(F.col("cell").isin(*names)).groupBy("date").pivot("cell", names).agg(F.first("value"))
    return wide.select("date", ((F.col(a[0]) - F.col(a[1])) - (F.col(b[0]) - F.col(b[1]))).alias("diff")).where("diff is not null")


def stratum_difference(strata: DataFrame, a: str, b: str) -> DataFrame:
    """One row, diff, se, t: the difference of the means of two strata that share no date (stratum, date, value), with Welch's error."""
    of = lambda name: F.when(F.col("stratum") == name, F.col("value"))
    part = lambda name: F.var_samp(of(name)) / F.count(of(name))
    found = strata.agg((F.avg(of(a)) - F.avg(of(b))).alias("diff"), F.sqrt(part(a) + part(b)).alias("se"))
    return found.withColumn("t", F.col("diff") / F.nullif("se", F.lit(0.0)))


def sign_stability(series: DataFrame, value: str, blocks: int) -> DataFrame:
    """One row, blocks, same: the share of equal runs of dates whose mean has the sign of the whole mean."""
    w = Window.orderBy("date")
    means = series.where(F.col(value).isNotNull()).withColumn("_b", F.ntile(blocks).over(w)).groupBy("_b").agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"))
    whole = F.signum(F.sum("_s").over(Window.partitionBy()))
    return means.withColumn("_w", whole).agg(F.count("*").alias("blocks"), F.avg((F.signum("_m") == F.col("_w")).cast("double")).alias("same"))


def lag_profile(df: DataFrame, score: str, label: str, lags: list[int]) -> DataFrame:
    """lag, dates, stale (mean rank correlation of the score so many rows before), persistence (that of the score with itself): per date, then averaged.

    One window by key gives all lags; rows that lack a lag do not count for it.
    """
    from .metrics import rank_ic

    w = Window.partitionBy("key").orderBy("date")
    wide = df.select("date", "key", score, label, *[F.lag(score, k).over(w).alias(f"_old{k}") for k in lags])
    olds = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_old{k}").alias("old")) for k in lags]))
    long = wide.select("date", "key", score, label, olds.alias("o")).select("date", "key", score, label, "o.*").where("old is not null")
    stale = rank_ic(long, "old", label, by=("lag", "date")).groupBy("lag").agg(F.count("ic").alias("dates"), F.avg("ic").alias("stale"))
    kept = rank_ic(long, "old", score, by=("lag", "date")).groupBy("lag").agg(F.avg("ic").alias("persistence"))
    return stale.join(kept, "lag")
