"""Column expressions without a plan of their own: business days, ranks, bounded and statistical functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(x, digits: int = 9) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


# Business days (Monday to Friday)


def business_day_add(day, n) -> Column:
    """The business day n steps away. A weekend day counts as the Friday before for n > 0, as the Monday after for n <= 0."""
    day, n = col(day), F.lit(n) if isinstance(n, int) else col(n)
    at = F.weekday(day)
    friday = F.date_sub(day, F.greatest(F.lit(0), at - 4))
    monday = F.date_add(day, F.when(at > 4, 7 - at).otherwise(0))
    move = lambda base, w: F.date_add(base, (7 * F.floor((w + n) / 5) + F.pmod(w + n, F.lit(5)) - w).cast("int"))
    return F.when(n > 0, move(friday, F.least(at, F.lit(4)))).otherwise(move(monday, F.when(at > 4, 0).otherwise(at)))


def business_days_between(start, end) -> Column:
    """Business days in [start, end), negative when end is first."""
    number = lambda d: 5 * F.floor((F.datediff(d, F.lit("1970-01-05").cast("date"))) / 7) + F.least(F.weekday(d), F.lit(5))
    return (number(col(end)) - number(col(start))).cast("long")


# Ranks within a cross-section


def avg_rank(value, *by) -> Column:
    """Rank within by; ties share the mean of their places; null stays null."""
    value = col(value)
    place = F.rank().over(Window.partitionBy(*by).orderBy(value.asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), place + (ties - 1) / 2)


def pct_rank(value, *by) -> Column:
    """avg_rank over the number of values."""
    return avg_rank(value, *by) / F.count(col(value)).over(Window.partitionBy(*by))


def z_score(value, *by, ddof: int = 1) -> Column:
    """Distance from the mean in standard deviations; null where these are zero."""
    w, value = Window.partitionBy(*by), col(value)
    spread = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    return (value - F.avg(value).over(w)) / F.nullif(spread.over(w), F.lit(0.0))


def quantile_bucket(value, tie, q: int, *by) -> Column:
    """0 to q-1: the quantile bin of the place in order of (value, tie)."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(col(value), col(tie)))
    n = F.count("*").over(w)
    return F.greatest(F.lit(0), F.ceil((place - 1) * q / F.nullif(n - 1, F.lit(0))) - 1).cast("int")


def clip(value, low, high) -> Column:
    return F.least(F.greatest(col(value), F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


# Aggregates that users compose


def correlation(x, y) -> Column:
    """Pearson correlation over rows with both; null without variance."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def t_statistic(x) -> Column:
    """Mean over its standard error; null for a single value or no variance."""
    x = col(x)
    return F.avg(x) / F.nullif(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def compound(r) -> Column:
    """Product of 1 + r, less 1."""
    return F.exp(F.sum(F.log1p(col(r)))) - 1


def alpha_t(r, m, least: int = 3) -> Column:
    """t of the intercept of r on m over rows with both."""
    r, m = col(r), col(m)
    n, sxx = F.regr_count(r, m), F.regr_sxx(r, m)
    rss = F.greatest(F.lit(0.0), F.regr_syy(r, m) - F.regr_sxy(r, m) * F.regr_sxy(r, m) / F.nullif(sxx, F.lit(0.0)))
    mean = F.regr_avgx(r, m)
    se = F.sqrt(rss / F.nullif(n - 2, F.lit(0)) * (1 / F.nullif(n, F.lit(0)) + mean * mean / F.nullif(sxx, F.lit(0.0))))
    return F.when((n >= least) & (se > 0), F.regr_intercept(r, m) / F.nullif(se, F.lit(0.0)))


# Bounded and distribution functions

#: Coefficients of Acklam's rational approximation of the inverse normal distribution (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p, refined: bool = False) -> Column:
    """The normal quantile of p in (0, 1); null elsewhere. Right to nine digits, or, refined by a step of Newton's, to all that a double has."""
    p = col(p)
    tail = lambda q: _poly(q, _C) / (_poly(q, _D) * q + 1)
    q = p - 0.5
    r = q * q
    middle = _poly(r, _A) * q / (_poly(r, _B) * r + 1)
    low = tail(F.sqrt(-2 * F.log(p)))
    high = -tail(F.sqrt(-2 * F.log(1 - p)))
    z = F.when((p > 0) & (p < 1), F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(middle))
    return _once(F.struct(z.alias("z"), p.alias("p")), lambda a: a["z"] - (_normal_share(a["z"]) - a["p"]) * math.sqrt(2 * math.pi) * F.exp(a["z"] * a["z"] / 2)) if refined else z


def normal_cdf(x) -> Column:
    """The normal distribution function to all that a double has, by Hart's rational function within 8 standard deviations of 0."""
    return _once(F.greatest(F.least(col(x).cast("double"), F.lit(8.0)), F.lit(-8.0)), _normal_share)


#: Hart's rational function 5666 of the normal tail, and its continued fraction beyond 7.07 (fixed values).
_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_M = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _normal_share(x: Column) -> Column:
    a = F.abs(x)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.exp(-x * x / 2) * F.when(a < 7.07106781186547, _poly(a, _N) / _poly(a, _M)).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _once(x: Column, f) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def student_tail(t, df) -> Column:
    """Probability that a Student's t of df degrees (a whole number, a column or not) is above t.

    The incomplete beta integral for whole degrees is a finite sum of powers of a cosine; null for
    degrees under 1. The sum has df / 2 terms.
    """
    t, df = col(t).cast("double"), F.lit(df) if isinstance(df, int) else col(df).cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2 = df / (df + t * t)
    odd = df % 2 == 1
    # Factors of the terms: (2 k) / (2 k + 1) for odd degrees, (2 k - 1) / (2 k) for even ones.
    factor = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k)) * c2
    step = lambda a, k: F.struct((a["t"] * factor(k)).alias("t"), (a["s"] + a["t"] * factor(k)).alias("s"))
    more = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    places = F.when(more >= 1, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(places, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])
    inside = F.when(odd, 2 / math.pi * (angle + F.when(df > 1, F.sin(angle) * F.cos(angle) * total).otherwise(0.0))).otherwise(F.sin(angle) * total)
    upper = (1 - inside) / 2
    return F.when(df >= 1, F.when(t >= 0, upper).otherwise(1 - upper))


def tanh_bound(x, c: float) -> Column:
    return c * F.tanh(col(x) / c)


def signed_probability(positive, negative) -> Column:
    return col(positive) - col(negative)


def one_hot(value, kinds) -> Column:
    """Array of 0 and 1; all 0 for a value that is not among kinds."""
    return F.array(*[F.coalesce((col(value) == k).cast("int"), F.lit(0)) for k in kinds])


def spearman_to_pearson(rho) -> Column:
    return 2 * F.sin(F.lit(math.pi) * col(rho) / 6)


def inverse_ratio_return(ratio) -> Column:
    """1 / ratio - 1; null unless the ratio is positive."""
    return F.when(col(ratio) > 0, 1 / col(ratio) - 1)


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile for one summary row, by bisection of the incomplete beta integral."""

    def cdf(t: float) -> float:
        n = 2000
        h = t / n
        density = lambda x: (1 + x * x / df) ** (-(df + 1) / 2)
        total = density(0) + density(t) + sum((4 if i % 2 else 2) * density(i * h) for i in range(1, n))
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        return 0.5 + scale * total * h / 3

    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2
