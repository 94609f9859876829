"""Portfolio replay as panel queries: decisions and their fills, holding epochs, drifted weights, costs, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _axis(scores: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, date, pos (from 0), last: the scored dates of each by."""
    w = Window.partitionBy(*by)
    return scores.select(*by, "date").distinct().withColumns({"pos": F.row_number().over(w.orderBy("date")) - 1, "last": F.count("*").over(w) - 1})


def _chosen(scores: DataFrame, k: int, every: int, by: tuple[str, ...]) -> DataFrame:
    """by, key, pos, last: the k best keys (score descending, then key) on every so-many-th scored date; null scores do not count."""
    decided = scores.where(F.col("score").isNotNull()).join(F.broadcast(_axis(scores, by)), [*by, "date"]).where(F.col("pos") % every == 0)
    place = F.row_number().over(Window.partitionBy(*by, "pos").orderBy(F.desc("score"), "key"))
    return decided.withColumn("_place", place).where(F.col("_place") <= k).select(*by, "key", "pos", "last")


def decision_ledger(scores: DataFrame, *, k: int, every: int, delay: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, fill_date, names, status of each decision: filled so many scored dates later, or expired where there are none."""
    axis = _axis(scores, by)
    made = _chosen(scores, k, every, by).groupBy(*by, "pos").agg(F.count("*").alias("names"))
    filled = axis.select(*by, F.col("date").alias("fill_date"), (F.col("pos") - delay).alias("pos"))
    out = made.join(F.broadcast(axis), [*by, "pos"]).join(F.broadcast(filled), [*by, "pos"], "left")
    return out.select(*by, "date", "fill_date", "names", F.when(F.col("fill_date").isNull(), "expired").otherwise("filled").alias("status"))


def topk_book(scores: DataFrame, closes: DataFrame, *, k: int, every: int, delay: int, cost: float, by: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """by, date, gross, traded, net, problem of an equal-weight book of the k best scores; one row for each scored date.

    Decisions fall on every so-many-th scored date, starting at the first, and are filled `delay` dates
    later; until then the book before earns the return, and a decision without such a date expires.
    Before the first fill gross is 0. Between fills the weights drift: the book is worth the mean of
    close over close at fill of its keys, so no day loop is needed. traded, on the date of the fill, is
    the sum of changes from the drifted to the new weights, 1 for the first. A held key without a close
    raises an error, or, if not strict, leaves gross and net null with a problem until the next fill has
    passed, since the book's worth is not known. scores: by, date, key, score; each by is a book of its own.
    """
    axis = _axis(scores, by)
    basket = _chosen(scores, k, every, by).withColumn("fill", F.col("pos") + delay).where("fill <= last").select(*by, "key", "fill", "last")
    epochs = basket.select(*by, "fill").distinct()
    epochs = epochs.withColumns({"until": F.lead("fill").over(Window.partitionBy(*by).orderBy("fill")), "first": F.min("fill").over(Window.partitionBy(*by))})
    held = basket.join(F.broadcast(epochs), [*by, "fill"])
    # A holding meets the prices of its own epoch alone.
    days = held.withColumn("pos", F.explode(F.sequence("fill", F.coalesce("until", "last"))))
    priced = closes.join(F.broadcast(axis), "date").select(*by, "key", "pos", F.when(~F.isnan(F.col("close").cast("double")), F.col("close")).alias("close"))
    own = Window.partitionBy(*by, "fill", "key")
    path = days.join(priced, [*by, "key", "pos"], "left").withColumn("_c0", F.max(F.when(F.col("pos") == F.col("fill"), F.col("close"))).over(own))
    path = path.withColumn("_rel", F.col("close") / F.nullif("_c0", F.lit(0)))
    value = path.groupBy(*by, "fill", "until", "first", "pos").agg(F.avg("_rel").alias("_v"), F.max(F.col("_rel").isNull()).alias("_bad"))
    w = Window.partitionBy(*by, "fill").orderBy("pos")
    value = value.withColumn("_v", F.when(~F.max("_bad").over(w), F.col("_v")))
    earned = value.withColumn("_g", F.col("_v") / F.lag("_v").over(w) - 1)
    # Weights just before a fill, against the new equal weights.
    drifted = path.where("pos = until").select(*by, "key", F.col("until").alias("fill"), (F.col("_rel") / F.sum("_rel").over(Window.partitionBy(*by, "fill"))).alias("_old"))
    target = held.select(*by, "key", "fill", (1.0 / F.count("*").over(Window.partitionBy(*by, "fill"))).alias("_new"))
    moves = target.join(drifted, [*by, "key", "fill"], "full").groupBy(*by, F.col("fill").alias("pos")).agg(F.sum(F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))).alias("_moved"))
    ends = earned.where("pos = until").select(*by, "pos", F.col("_v").isNotNull().alias("_known"))
    moves = moves.join(ends, [*by, "pos"], "left").select(*by, "pos", F.when(F.coalesce("_known", F.lit(True)), F.col("_moved")).alias("_moved"), F.lit(True).alias("_fill"))
    begun = epochs.select(*by, "first").distinct() if by else epochs.agg(F.min("first").alias("first"))
    rows = axis.join(F.broadcast(begun), list(by), "left") if by else axis.join(F.broadcast(begun))
    rows = rows.join(earned.where("pos > fill").select(*by, "pos", "_g"), [*by, "pos"], "left").join(moves, [*by, "pos"], "left")
    still = F.col("first").isNull() | (F.col("pos") <= F.col("first"))
    gap = F.raise_error(F.concat(F.lit("a held key lacks a close by "), F.col("date").cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    rows = rows.withColumns({"gross": F.when(still, 0.0).otherwise(F.coalesce("_g", gap)), "traded": F.when(F.col("_fill"), F.col("_moved")).otherwise(0.0)})
    problem = F.when(F.col("gross").isNull() | F.col("traded").isNull(), "missing close")
    return rows.select(*by, "date", "gross", "traded", (F.col("gross") - cost * F.col("traded")).alias("net"), problem.alias("problem"))


def buy_and_hold(closes: DataFrame, cost: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, gross, net of one holding with one entry cost on its first return."""
    w = Window.partitionBy(*by).orderBy("date")
    r = closes.withColumn("gross", F.col("close") / F.lag("close").over(w) - 1).where("gross is not null")
    return r.select(*by, "date", "gross", (F.col("gross") - F.when(F.row_number().over(w) == 1, cost).otherwise(0.0)).alias("net"))


def timing_rule(closes: DataFrame, days: int, delay: int, cost: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, position, gross, net: in the market while the close is above that of exactly so many days before, acted on `delay` rows later; each by knows its own rows alone."""
    past = closes.select(*by, F.date_add("date", days).alias("date"), F.col("close").alias("_past"))
    w = Window.partitionBy(*by).orderBy("date")
    signal = closes.join(past, [*by, "date"], "left").withColumn("_s", F.when(F.col("_past").isNotNull(), (F.col("close") > F.col("_past")).cast("int")).otherwise(0))
    held = signal.withColumns({"position": F.coalesce(F.lag("_s", delay).over(w), F.lit(0)), "_r": F.col("close") / F.lag("close").over(w) - 1})
    switched = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0)))
    gross = F.col("position") * F.coalesce("_r", F.lit(0.0))
    return held.withColumns({"gross": gross, "net": gross - cost * switched}).select(*by, "date", "position", "gross", "net")


def fold_totals(returns: DataFrame, name: str, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, {name}_gross, {name}_net: compound returns of each fold; null where a return is not known."""
    total = lambda c: F.when(F.count(c) == F.count("*"), F.exp(F.sum(F.log1p(c))) - 1)
    return returns.groupBy(*by).agg(total("gross").alias(f"{name}_gross"), total("net").alias(f"{name}_net"))


def net_by_fold(scores: DataFrame, closes: DataFrame, market: DataFrame, *, k: int, every: int, delay: int, cost: float, days: int) -> DataFrame:
    """fold, dates, decisions, filled, expired, cost, and the gross and net totals of book, hold and timing.

    scores: fold, date, key, score of the validation windows; market: date, close. Each fold replays the
    book and both baselines on its own window with the same delay and cost.
    """
    by = ("fold",)
    dates = scores.select("fold", "date").distinct()
    book = topk_book(scores, closes, k=k, every=every, delay=delay, cost=cost, by=by, strict=False)
    window = market.join(F.broadcast(dates), "date")
    ledger = decision_ledger(scores, k=k, every=every, delay=delay, by=by).groupBy("fold").agg(F.count("*").alias("decisions"), F.count(F.when(F.col("status") == "filled", 1)).alias("filled"), F.count(F.when(F.col("status") == "expired", 1)).alias("expired"))
    out = book.groupBy("fold").agg(F.count("*").alias("dates"), F.when(F.count("traded") == F.count("*"), cost * F.sum("traded")).alias("cost"))
    for part in (ledger, fold_totals(book, "book"), fold_totals(buy_and_hold(window, cost, by), "hold"), fold_totals(timing_rule(window, days, delay, cost, by), "timing")):
        out = out.join(part, "fold", "left")
    return out


def pooled(folds: DataFrame) -> DataFrame:
    """One row: folds, their totals compounded, and bar_met: the book's net total beats both baselines'."""
    total = lambda c: F.when(F.count(c) == F.count("*"), F.exp(F.sum(F.log1p(c))) - 1).alias(c)
    sums = folds.agg(F.count("*").alias("folds"), *[total(f"{n}_{k}") for n in ("book", "hold", "timing") for k in ("gross", "net")])
    return sums.withColumn("bar_met", (F.col("book_net") > F.col("hold_net")) & (F.col("book_net") > F.col("timing_net")))


def attested_verdict(attestations: DataFrame, total: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """All columns of attestations, status, grade, total, bar_met: a net verdict only with a well-formed measured attestation.

    attestations: source, measured_at, evidence_ref as text. All null: no attestation, the verdict is
    withheld and the gross total is a diagnostic. Malformed ones say what is wrong and give no figure.
    """
    absent = F.col("source").isNull() & F.col("measured_at").isNull() & F.col("evidence_ref").isNull()
    status = F.when(absent, "withheld").when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "bad source")
    status = status.when(F.expr("try_cast(measured_at AS date)").isNull(), "bad date").when(F.length(F.trim(F.coalesce("evidence_ref", F.lit("")))) == 0, "no evidence").otherwise("emitted")
    both = attestations.withColumn("status", status).join(F.broadcast(total.select("book_gross", "book_net", F.col("bar_met").alias("_met"))))
    emitted = F.col("status") == "emitted"
    grade = F.when(emitted, "net_of_cost").when(F.col("status") == "withheld", "gross_only_diagnostic")
    figure = F.when(emitted, F.col("book_net")).when(F.col("status") == "withheld", F.col("book_gross"))
    return both.select(*attestations.columns, "status", grade.alias("grade"), figure.alias("total"), F.when(emitted, F.col("_met")).alias("bar_met"))


def attestation_status(costs: DataFrame) -> DataFrame:
    """Adds status of (venue, taker, spread, as_of): ok, or what is wrong with it."""
    status = F.when(F.col("taker").isNull() | F.col("spread").isNull(), "missing").when((F.col("taker") < 0) | (F.col("spread") < 0), "negative").when(F.col("taker") + F.col("spread") > 0.1, "implausible").otherwise("ok")
    return costs.withColumn("status", status)
