"""Rolling windows over each key's own rows, and labels and features built from them.

All features of a call share one window specification, so a plan has one exchange and one sort by
key for them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import col


def by_key(key: str = "key", date: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def full(expression: Column, value: Column, w: WindowSpec, n: int) -> Column:
    """A window aggregate over the last n rows, null unless all n have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, expression.over(frame))


def change(value, n: int, w: WindowSpec) -> Column:
    """value over its value n rows before, less 1."""
    value = col(value)
    return value / F.nullif(F.lag(value, n).over(w), F.lit(0.0)) - 1


def skipped_momentum(value, far: int, near: int, w: WindowSpec) -> Column:
    """Change from far rows before to near rows before."""
    value = col(value)
    return F.lag(value, near).over(w) / F.nullif(F.lag(value, far).over(w), F.lit(0.0)) - 1


def price_features(bars: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Adds ret, mom_n, vol_n (spread of returns, per year), down_n (downside), high_n (distance to the highest), mean_n (to the mean), level_n (spread of the close over the close)."""
    w = by_key()
    close, r = F.col("close"), F.col("ret")
    out = bars.withColumn("ret", change("close", 1, w))
    features = {}
    for n in windows:
        features[f"mom_{n}"] = change("close", n, w)
        features[f"vol_{n}"] = full(F.stddev_samp(r), r, w, n) * math.sqrt(52)
        frame = w.rowsBetween(-(n - 1), 0)
        features[f"down_{n}"] = F.when(F.count(r).over(frame) == n, F.sqrt(F.sum(F.pow(F.least(r, F.lit(0.0)), 2)).over(frame) / (n - 1)))
        features[f"high_{n}"] = close / full(F.max(close), close, w, n) - 1
        features[f"mean_{n}"] = close / full(F.avg(close), close, w, n) - 1
        features[f"level_{n}"] = full(F.stddev_samp(close), close, w, n) / close
    return out.withColumns(features)


def residual_spread(bars: DataFrame, n: int) -> DataFrame:
    """Adds resid: spread of the close around its line over the last n rows, over the close."""
    w = by_key()
    frame = w.rowsBetween(-(n - 1), 0)
    bars = bars.withColumn("_i", F.row_number().over(w).cast("double"))
    y, x = F.col("close"), F.col("_i")
    syy, sxy, sxx = (f(y, x).over(frame) for f in (F.regr_syy, F.regr_sxy, F.regr_sxx))
    spread = F.sqrt(F.greatest(F.lit(0.0), syy - sxy * sxy / F.nullif(sxx, F.lit(0.0))) / (n - 2))
    return bars.withColumn("resid", F.when(F.count(y).over(frame) == n, spread / y)).drop("_i")


def rolling_beta(returns: DataFrame, n: int) -> DataFrame:
    """Adds beta of ret on market over the last n rows, all of which must have both."""
    w = by_key().rowsBetween(-(n - 1), 0)
    both = F.col("ret").isNotNull() & F.col("market").isNotNull()
    r, m = F.when(both, F.col("ret")), F.when(both, F.col("market"))
    beta = F.covar_samp(r, m).over(w) / F.nullif(F.var_samp(m).over(w), F.lit(0.0))
    return returns.withColumn("beta", F.when(F.count(r).over(w) == n, beta))


def rolling_drawdown(bars: DataFrame, n: int) -> DataFrame:
    """Adds drawdown: the deepest fall from a running highest close within the last n rows; n bounds the array."""
    frame = by_key().rowsBetween(-(n - 1), 0)
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("low"))
    step = lambda s, c: F.struct(F.greatest(s["top"], c).alias("top"), F.least(s["low"], c / F.greatest(s["top"], c) - 1).alias("low"))
    held = bars.withColumn("_c", F.collect_list("close").over(frame))
    return held.withColumn("drawdown", F.when(F.size("_c") == n, F.aggregate("_c", start, step, lambda s: s["low"]))).drop("_c")


def total_return(bars: DataFrame, dividend: str = "dividend") -> DataFrame:
    """Adds total: close over the product of 1 + dividend / close of all later rows."""
    later = by_key().rowsBetween(1, Window.unboundedFollowing)
    grown = F.log1p(F.coalesce(F.col(dividend), F.lit(0.0)) / F.col("close"))
    return bars.withColumn("total", F.col("close") / F.coalesce(F.exp(F.sum(grown).over(later)), F.lit(1.0)))


def trailing_yield(bars: DataFrame, n: int, dividend: str = "dividend") -> DataFrame:
    return bars.withColumn("yield", F.sum(F.coalesce(F.col(dividend), F.lit(0.0))).over(by_key().rowsBetween(-(n - 1), 0)) / F.col("close"))


def forward_excess(bars: DataFrame, market: DataFrame, h: int) -> DataFrame:
    """Adds fwd: change over the next h rows less the market's change between the same dates."""
    w = by_key()
    ahead = bars.withColumns({"_d": F.lead("date", h).over(w), "_r": F.lead("close", h).over(w) / F.col("close") - 1})
    m = lambda d, c: market.select(F.col("date").alias(d), F.col("close").alias(c))
    joined = ahead.join(m("date", "_m0"), "date", "left").join(m("_d", "_m1"), "_d", "left")
    return joined.withColumn("fwd", F.col("_r") - (F.col("_m1") / F.col("_m0") - 1)).drop("_d", "_r", "_m0", "_m1")


def trend(bars: DataFrame, k: int) -> DataFrame:
    """Adds trend and seasonal: centred mean of k rows (odd), the ends repeated, and what is left."""
    half = (k - 1) // 2
    w = by_key()
    whole = Window.partitionBy("key").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = w.rowsBetween(-half, half)
    place, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("key"))
    front, back = F.greatest(F.lit(0), half - (place - 1)), F.greatest(F.lit(0), half - (n - place))
    mean = (F.sum("close").over(frame) + front * F.first("close").over(whole) + back * F.last("close").over(whole)) / k
    return bars.withColumn("trend", mean).withColumn("seasonal", F.col("close") - F.col("trend"))


def sequences(panel: DataFrame, features: list[str], length: int, *, split: str | None = None, min_names: int = 1) -> DataFrame:
    """date, key, seq: the last `length` feature rows of each key as an array of arrays.

    Only full windows, only within one split where a split column is named, only dates with min_names of them.
    """
    frame = by_key().rowsBetween(-(length - 1), 0)
    seq = F.collect_list(F.array(*[F.col(f).cast("float") for f in features])).over(frame)
    out = panel.withColumn("seq", seq).where(F.size("seq") == length) if split is None else (
        panel.withColumns({"seq": seq, "_splits": F.size(F.collect_set(split).over(frame))}).where((F.size("seq") == length) & (F.col("_splits") == 1))
    )
    names = F.count("*").over(Window.partitionBy("date"))
    return out.withColumn("_names", names).where(F.col("_names") >= min_names).select("date", "key", "seq")


def last_normalised(seq) -> Column:
    """A sequence of numbers less its last one."""
    seq = col(seq)
    return F.transform(seq, lambda x: x - F.element_at(seq, -1))


def shifted_labels(panel: DataFrame, label: str, shifts: list[int], split: str | None = None) -> DataFrame:
    """Rows per shift with the label from so many rows later; rows whose source lies in another split go."""
    w = by_key()
    versions = [F.struct(F.lit(n).alias("shift"), F.lead(label, n).over(w).alias("shifted"), (F.lead(split, n).over(w) if split else F.lit(None).cast("string")).alias("_s")) for n in shifts]
    out = panel.withColumn("_v", F.array(*versions)).withColumn("_v", F.explode("_v")).select(*panel.columns, "_v.*")
    return (out.where(F.col("_s") == F.col(split)) if split else out).drop("_s")


def turnover(baskets: DataFrame, n: int) -> DataFrame:
    """date, turnover between consecutive top-n baskets (date, key): the symmetric difference over 2 n.

    A basket has n keys, so its set is small.
    """
    sets = baskets.groupBy("date").agg(F.collect_set("key").alias("_k"))
    before = F.lag("_k").over(Window.orderBy("date"))
    moved = F.size(F.array_except("_k", before)) + F.size(F.array_except(before, "_k"))
    return sets.select("date", (moved / (2 * n)).alias("turnover"))


def triple_barrier(bars: DataFrame, h: int, k_up: float, k_down: float, sigma: str, *, short_exit: bool = False) -> DataFrame:
    """Adds hit (up, down, time), days, outcome, weight: the first of the next h closes at or beyond close * (1 +- k sigma), else the h-th.

    Null where fewer than h rows follow, or where close or sigma is null, not finite or sigma is 0.
    Closes in between that are null or not finite are passed over and counted as days. short_exit
    (for events) lets rows near the end leave at the last row there is, and takes a sigma of 0. h
    bounds the array.
    """
    usable = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    ahead = F.transform(F.collect_list(F.struct("close")).over(by_key().rowsBetween(1, h)), lambda r: usable(r["close"]))
    held = bars.withColumn("_a", ahead)
    c, s = usable(F.col("close").cast("double")), usable(F.col(sigma))
    up, down = c * (1 + k_up * s), c * (1 - k_down * s)
    touched = F.array_position(F.transform("_a", lambda x: F.coalesce((x >= up) | (x <= down), F.lit(False)).cast("int")), 1)
    enough = F.size("_a") > 0 if short_exit else (F.size("_a") == h) & (s != 0)
    days = F.when(touched > 0, touched).otherwise(F.size("_a")).cast("int")
    held = held.withColumns({"_t": touched, "days": F.when(c.isNotNull() & s.isNotNull() & enough, days)})
    end = F.try_element_at("_a", F.col("days"))
    hit = F.when(F.col("_t") == 0, "time").when(end >= up, "up").otherwise("down")
    return held.withColumns({
        "hit": F.when(F.col("days").isNotNull(), hit), "outcome": F.when(F.col("days").isNotNull(), end / c - 1),
        "weight": F.when(F.col("days").isNotNull(), F.when(F.col("_t") == 0, 0.5).otherwise(1.0)),
    }).drop("_a", "_t")


def formation_features(joined: DataFrame, n: int, skip: int, least: int) -> DataFrame:
    """Momentum features of every row over the n rows that end `skip` rows before: joined has ret, market, volume.

    f1 market-model alpha t, f2 information discreteness, f4 signed volume agreement, f5 downside beta penalty, formation return.
    """
    frame = by_key().rowsBetween(-(n + skip - 1), -skip)
    r, m, v = F.col("ret"), F.col("market"), F.col("volume")
    both = r.isNotNull() & m.isNotNull()
    over = lambda e: e.over(frame)
    count, sxx = over(F.regr_count(r, m)), over(F.regr_sxx(r, m))
    rss = F.greatest(F.lit(0.0), over(F.regr_syy(r, m)) - over(F.regr_sxy(r, m)) * over(F.regr_sxy(r, m)) / F.nullif(sxx, F.lit(0.0)))
    mean = over(F.regr_avgx(r, m))
    se = F.sqrt(rss / F.nullif(count - 2, F.lit(0)) * (1 / F.nullif(count, F.lit(0)) + mean * mean / F.nullif(sxx, F.lit(0.0))))
    formation = F.exp(over(F.sum(F.log1p(r)))) - 1
    up, down = over(F.avg((r > 0).cast("double"))), over(F.avg((r < 0).cast("double")))
    signed = over(F.sum(F.when(r > 0, v).otherwise(0))) - over(F.sum(F.when(r < 0, v).otherwise(0)))
    side = lambda c: over(F.regr_slope(F.when(c & both, r), F.when(c & both, m)))
    enough = over(F.count(r)) >= least
    return joined.withColumns({
        "formation": F.when(enough, formation), "f1": F.when(enough, over(F.regr_intercept(r, m)) / F.nullif(se, F.lit(0.0))),
        "f2": F.when(enough, F.signum(formation) * (up - down)), "f4": F.when(enough, signed / F.nullif(over(F.sum(F.when(r.isNotNull(), v))), F.lit(0))),
        "f5": F.when(enough, -(side(m < 0) - side(m > 0))),
    })


def composite(df: DataFrame, features: list[str], least: int) -> DataFrame:
    """date, key, score, used: the mean of each feature's z-score (population) on its date, where at least `least` are there."""
    from ..functions.scalar import z_score

    z = df.select("date", "key", *[z_score(f, "date", ddof=0).alias(f) for f in features])
    long = z.unpivot(["date", "key"], features, "f", "z")
    out = long.groupBy("date", "key").agg(F.avg("z").alias("score"), F.count("z").alias("used"))
    return out.withColumn("score", F.when(F.col("used") >= least, F.col("score")))
