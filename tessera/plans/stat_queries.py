"""Queries of dependence-aware statistics and portfolio replay.

Seeded operators have SQL for what must hold whatever the seed.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import t_quantile, tidy
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import resample as S
from ..operators.cross_section import array_split_folds
from ..sources.scratch import written
from .metric_queries import IC, ics
from .panels import BD, BW, SM, R, brand_bars, corr_sql, market_bars, supplier_month, table
from .registry import query

SERIES = f"{IC}, se AS (SELECT date, ic, row_number() OVER (ORDER BY date) - 1 AS pos FROM ics WHERE ic IS NOT NULL)"


def series(spark, d):
    return S.positions(ics(spark, d).where("ic is not null"))


def labelled(spark, d):
    return supplier_month(spark, d).where("y is not null")


@query("st_1_permutation", f"WITH {SM}, s AS (SELECT unnest([0, 1, 2])::INT AS seed) SELECT seed, date, count(*)::BIGINT AS n, {R('sum(y)', 7)} AS total, {R('max(y)')} AS high, true AS kept FROM sm, s WHERE y IS NOT NULL GROUP BY 1, 2")
def st_1(spark, d):
    p = S.permute_within(labelled(spark, d), "y", 3)
    same = F.sort_array(F.collect_list("y")) == F.sort_array(F.collect_list("permuted"))
    return p.groupBy("seed", "date").agg(F.count("*").alias("n"), tidy(F.sum("permuted"), 7).alias("total"), tidy(F.max("permuted")).alias("high"), same.alias("kept"))


@query("st_2_pooled_permutation", f"WITH {SM} SELECT count(*)::BIGINT AS n, {R('sum(y)', 6)} AS total, {R('min(y)')} AS low, {R('median(y)')} AS mid, true AS moved FROM sm WHERE y IS NOT NULL")
def st_2(spark, d):
    p = S.permute_pooled(labelled(spark, d), "y", 5, ["date", "key"])
    return p.agg(F.count("*").alias("n"), tidy(F.sum("permuted"), 6).alias("total"), tidy(F.min("permuted")).alias("low"), tidy(F.median("permuted")).alias("mid"), (F.avg((F.col("y") != F.col("permuted")).cast("int")) > 0.9).alias("moved"))


#: The within-date permutation of y under n seeds, its ranks and its rank correlation with x2.
DEALT = """dl AS (SELECT a.seed, a.date, a.key, a.x2, a.y, b.y AS p FROM (SELECT seed, date, key, x2, y, row_number() OVER (PARTITION BY seed, date ORDER BY key) AS i FROM sm, (SELECT unnest(range(0, {n})) AS seed) WHERE y IS NOT NULL) a
JOIN (SELECT seed, date, y, row_number() OVER (PARTITION BY seed, date ORDER BY (x * x + m) % 2147483647, y) AS i FROM (SELECT seed, date, y, m, h * m % 2147483647 AS x FROM (SELECT seed, date, y, 1 + ((seed + 1) * 1103515245 + 12345) % 2147483646 AS m, ('0x' || substr(md5(key || '|' || date), 1, 7))::BIGINT AS h FROM sm, (SELECT unnest(range(0, {n})) AS seed) WHERE y IS NOT NULL))) b ON a.seed = b.seed AND a.date = b.date AND a.i = b.i),
dk AS (SELECT seed, date, rank() OVER (PARTITION BY seed, date ORDER BY x2) + (count(*) OVER (PARTITION BY seed, date, x2) - 1) / 2.0 AS a, rank() OVER (PARTITION BY seed, date ORDER BY p) + (count(*) OVER (PARTITION BY seed, date, p) - 1) / 2.0 AS b, rank() OVER (PARTITION BY seed, date ORDER BY y) + (count(*) OVER (PARTITION BY seed, date, y) - 1) / 2.0 AS c FROM dl),
dc AS (SELECT seed, date, CASE WHEN count(*) >= 2 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic FROM dk GROUP BY 1, 2)"""


BLOCKS = f"{SERIES}, bl AS (SELECT pos // 12 AS block, avg(ic) AS mean, count(*) AS n FROM se GROUP BY 1)"


@query("st_3_blocks", f"WITH {BLOCKS} SELECT count(*)::BIGINT AS blocks, {R('avg(mean)', 8)} AS mean, {R('avg(mean) / (stddev_samp(mean) / sqrt(count(*)))', 6)} AS t FROM bl")
def st_3(spark, d):
    return S.block_t(S.blocks(series(spark, d), "ic", 12)).select("blocks", tidy("mean", 8).alias("mean"), tidy("t", 6).alias("t"))


@query("st_4_gapped_blocks", f"WITH {SERIES} SELECT (pos // 10)::BIGINT AS block, {R('avg(ic)', 8)} AS mean, count(*)::BIGINT AS n FROM se WHERE pos % 10 < 6 GROUP BY 1 HAVING count(*) >= 4")
def st_4(spark, d):
    return S.gapped_blocks(series(spark, d), "ic", 6, 4, 4).select("block", tidy("mean", 8).alias("mean"), "n")


@query("st_5_dependence_aware_mean", f"WITH {BLOCKS}, s AS (SELECT sum(mean) AS s, count(*) AS n FROM bl) SELECT {R('min((s - mean) / (s.n - 1))', 8)} AS low, {R('max((s - mean) / (s.n - 1))', 8)} AS high FROM bl, s")
def st_5(spark, d):
    return S.leave_one_out(S.blocks(series(spark, d), "ic", 12)).select(tidy("low", 8).alias("low"), tidy("high", 8).alias("high"))


def boot_sql(out: str, source: str, length: int, reps: int, seed: int, circular: bool = False) -> str:
    """CTEs {out}i (numbered series), {out}d (drawn blocks) and {out} (rep, mean) over a CTE (pos, ic)."""
    starts, size = ("n", length) if circular else (f"greatest(1, n - {length} + 1)", "n - a")
    twice = f"UNION ALL SELECT i + (SELECT count(*) FROM {out}o), v FROM {out}o" if circular else ""
    return f"""{out}o AS (SELECT row_number() OVER (ORDER BY pos) AS i, ic AS v FROM {source}), {out}i AS (SELECT i, v FROM {out}o {twice}), {out}s AS (SELECT i, sum(v) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM {out}i),
{out}d AS (SELECT rep, draw, a, a + least({length}, n - (draw - 1) * {length}, {size}) AS b FROM (SELECT rep, draw, n, floor(('0x' || substr(md5(rep || '|' || draw || '|{seed}'), 1, 10))::BIGINT / 1099511627776::DOUBLE * {starts})::BIGINT AS a
  FROM (SELECT unnest(range(0, {reps})) AS rep), (SELECT count(*) AS n FROM {out}o), LATERAL (SELECT unnest(range(1, (ceil(n / {length}::DOUBLE) + 1)::BIGINT)) AS draw))),
{out} AS (SELECT rep, sum(u.s - coalesce(l.s, 0)) / sum(b - a) AS mean FROM {out}d JOIN {out}s u ON u.i = b LEFT JOIN {out}s l ON l.i = a GROUP BY 1)"""


INTERVAL = f"SELECT count(*)::BIGINT AS replicates, {R('quantile_cont(mean, 0.025)', 8)} AS low, {R('quantile_cont(mean, 0.975)', 8)} AS high, {R('2 * least(avg((mean <= 0)::INT), 1 - avg((mean <= 0)::INT))')} AS p FROM bs"


def interval(reps):
    n = reps.agg(F.count("*").alias("replicates"))
    return S.bootstrap_interval(reps).join(F.broadcast(n)).select("replicates", tidy("low", 8).alias("low"), tidy("high", 8).alias("high"), tidy("p").alias("p"))


@query("st_6_block_bootstrap", f"WITH {SERIES}, {boot_sql('bs', 'se', 6, 1000, 3)} {INTERVAL}")
def st_6(spark, d):
    return interval(S.block_bootstrap(series(spark, d), "ic", 6, 1000, 3))


@query("st_6_circular", f"WITH {SERIES}, {boot_sql('bs', 'se', 6, 1000, 4, True)} {INTERVAL}")
def st_6_circular(spark, d):
    return interval(S.block_bootstrap(series(spark, d), "ic", 6, 1000, 4, circular=True))


@query("st_6_two_samples", f"WITH {SERIES}, sa AS (SELECT * FROM se WHERE pos % 2 = 0), sb AS (SELECT * FROM se WHERE pos % 2 = 1), {boot_sql('ba', 'sa', 6, 500, 5)}, {boot_sql('bb', 'sb', 6, 500, 6)}, bs AS (SELECT ba.mean - bb.mean AS mean FROM ba JOIN bb USING (rep)) {INTERVAL}")
def st_6_two(spark, d):
    s = series(spark, d)
    return interval(S.bootstrap_difference(s.where("pos % 2 = 0"), s.where("pos % 2 = 1"), "ic", 6, 500, 5))


@query("st_7_exceedance", f"""WITH {SERIES}, ce AS (SELECT pos, ic - avg(ic) OVER () AS ic FROM se), {boot_sql('bs', 'ce', 6, 400, 9, True)}, ln AS (SELECT rep, draw, a, unnest(range(a + 1, b + 1)) AS i FROM bsd), st AS (SELECT rep, ((draw - 1) * 6 + i - a - 1) // 12 AS block, v FROM ln JOIN bsi USING (i)),
sb AS (SELECT rep, block, avg(v) AS mean FROM st GROUP BY 1, 2), tt AS (SELECT rep, avg(mean) / nullif(stddev_samp(mean) / sqrt(count(*)), 0) AS t FROM sb GROUP BY 1)
SELECT count(*)::BIGINT AS replicates, (SELECT count(*) // 6 FROM se)::BIGINT AS donors, {R('avg((abs(t) > 1.96)::INT)')} AS share FROM tt""")
def st_7(spark, d):
    return S.exceedance(series(spark, d), "ic", 6, 12, 1.96, 400, 9, 5).select("replicates", "donors", tidy("share").alias("share"))


NW = "g AS (SELECT (SELECT avg(ic) FROM se) AS m, (SELECT count(*) FROM se) AS n), l AS (SELECT k.lag, sum((a.ic - m) * (b.ic - m)) / any_value(n) AS s FROM se a JOIN (SELECT unnest(range(0, 7)) AS lag) k ON true JOIN se b ON b.pos = a.pos - k.lag, g GROUP BY 1)"


@query("st_8_newey_west", f"WITH {SERIES}, {NW}, v AS (SELECT sum(CASE WHEN lag = 0 THEN s ELSE 2 * (1 - lag / 7.0::DOUBLE) * s END) / (SELECT n FROM g) AS v FROM l) SELECT {R('(SELECT m FROM g)', 8)} AS mean, {R('sqrt(v)', 8)} AS se, {R('(SELECT m FROM g) / sqrt(v)', 6)} AS t FROM v")
def st_8(spark, d):
    return S.newey_west(series(spark, d), "ic", 6).select(tidy("mean", 8).alias("mean"), tidy("se", 8).alias("se"), tidy("t", 6).alias("t"))


@query("st_9_autocorrelation", f"WITH {SERIES}, {NW} SELECT lag::INT AS lag, {R('s / (SELECT s FROM l WHERE lag = 0)', 7)} AS rho FROM l WHERE lag > 0")
def st_9(spark, d):
    return S.autocorrelation(series(spark, d), "ic", 6).select("lag", tidy("rho", 7).alias("rho"))


@query("st_10_control_verdict", f"""WITH {SM}, c AS (SELECT (key % 4)::VARCHAR AS control, avg(y) AS x FROM sm WHERE y IS NOT NULL GROUP BY date, 1), t AS (SELECT control, count(x)::BIGINT AS n, avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0) AS t FROM c GROUP BY 1)
SELECT control, n, {R('t', 6)} AS t, CASE WHEN n < 5 OR t IS NULL THEN 'UNPROVEN' WHEN abs(t) > 2 THEN 'NOT_NULL' ELSE 'CLEAN' END AS verdict FROM t""")
def st_10(spark, d):
    draws = labelled(spark, d).groupBy("date", (F.col("key") % 4).cast("string").alias("control")).agg(F.avg("y").alias("x"))
    return S.control_verdict(draws, 2.0).select("control", "n", tidy("t", 6).alias("t"), "verdict")


@query("st_11_critical_value", f"""WITH {SM}, {DEALT.format(n=20)}, pb AS (SELECT seed, ic, row_number() OVER (PARTITION BY seed ORDER BY date) - 1 AS pos FROM dc), nb AS (SELECT seed, pos // 12 AS block, avg(ic) AS mean FROM pb WHERE ic IS NOT NULL GROUP BY 1, 2),
nt AS (SELECT seed, avg(mean) / nullif(stddev_samp(mean) / sqrt(count(*)), 0) AS t FROM nb GROUP BY 1), q AS (SELECT count(*)::BIGINT AS seeds, quantile_cont(abs(t), 0.95) AS nq FROM nt)
SELECT seeds, {R('nq', 6)} AS null_quantile, {R('greatest(nq, 2.446911851)', 6)} AS bar, (SELECT {R('avg((abs(t) > 2.446911851)::INT)')} FROM nt) AS false_passes FROM q""")
def st_11(spark, d):
    null = S.permutation_null(labelled(spark, d), "x2", "y", 20, 12)
    bar = S.critical_value(null, 6)
    rate = F.avg((F.abs("t") > F.lit(t_quantile(0.975, 6))).cast("int"))
    return null.agg(F.count("*").alias("seeds"), tidy(rate).alias("false_passes")).join(F.broadcast(bar)).select("seeds", tidy("null_quantile", 6).alias("null_quantile"), tidy("bar", 6).alias("bar"), "false_passes")


@query("st_12_control_rates", f"""WITH {SM}, {DEALT.format(n=20)}, mi AS (SELECT seed, date, {corr_sql('c', 'c + b')} AS mixed FROM dk GROUP BY 1, 2), pb AS (SELECT seed, ic, mixed, row_number() OVER (PARTITION BY seed ORDER BY date) - 1 AS pos FROM dc JOIN mi USING (seed, date)),
bm AS (SELECT seed, pos // 12 AS block, avg(ic) AS x, avg(mixed) AS z FROM pb GROUP BY 1, 2), bt AS (SELECT seed, avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0) AS t0, avg(z) / nullif(stddev_samp(z) / sqrt(count(z)), 0) AS t1 FROM bm GROUP BY 1)
SELECT count(*)::BIGINT AS seeds, {R('avg((abs(t0) > 2)::INT)')} AS false_positives, {R('avg((abs(t1) > 2)::INT)')} AS power FROM bt""")
def st_12(spark, d):
    rates = S.control_rates(labelled(spark, d), "x2", "y", 20, 12, 2.0)
    return rates.select("seeds", tidy("false_positives").alias("false_positives"), tidy("power").alias("power"))


@query("st_13_holm", """WITH t AS (SELECT n_name AS name, (n_nationkey * 37 % 25)::DOUBLE / 4000 AS p FROM nation), o AS (SELECT *, p <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) AS ok FROM t)
SELECT name, p, bool_and(ok) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS passed FROM o""")
def st_13(spark, d):
    tests = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.pmod(F.col("n_nationkey") * 37, F.lit(25)).cast("double") / 4000).alias("p"))
    return S.holm(tests)


@query("st_14_placebo_gate", f"""WITH {SM}, l AS (SELECT *, lead(y, 4) OVER (PARTITION BY key ORDER BY date) AS y4 FROM sm), r AS (SELECT date, x2, y FROM l WHERE y IS NOT NULL), q AS (SELECT date, x2, y4 FROM l WHERE y4 IS NOT NULL),
a AS (SELECT avg(c) AS real FROM (SELECT {corr_sql('x2', 'y')} AS c FROM r GROUP BY date)), b AS (SELECT avg(c) AS placebo FROM (SELECT {corr_sql('x2', 'y4')} AS c FROM q GROUP BY date))
SELECT {R('real', 8)} AS real, {R('placebo', 8)} AS placebo, abs(placebo) <= greatest(0.01, 0.5 * abs(real)) AS passed FROM a, b""")
def st_14(spark, d):
    from ..functions.scalar import correlation

    shifted = supplier_month(spark, d).withColumn("y4", F.lead("y", 4).over(Window.partitionBy("key").orderBy("date")))
    mean = lambda c, n: shifted.where(F.col(c).isNotNull()).groupBy("date").agg(correlation("x2", c).alias("c")).agg(F.avg("c").alias(n))
    both = mean("y", "real").join(F.broadcast(mean("y4", "placebo")))
    return both.select(tidy("real", 8).alias("real"), tidy("placebo", 8).alias("placebo"), (F.abs("placebo") <= S.placebo_threshold("real")).alias("passed"))


STALE = f"""{SM}, o AS (SELECT *, lag(x2, 3) OVER (PARTITION BY key ORDER BY date) AS old FROM sm), v AS (SELECT * FROM o WHERE old IS NOT NULL AND y IS NOT NULL),
k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x2) + (count(*) OVER (PARTITION BY date, x2) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY old) + (count(*) OVER (PARTITION BY date, old) - 1) / 2.0 AS c, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS b FROM v)"""


@query("st_15_fresh_stale", f"WITH {STALE} SELECT date, {R(corr_sql('a', 'b'), 8)} AS fresh, {R(corr_sql('c', 'b'), 8)} AS stale, {R(corr_sql('a', 'b') + ' - ' + corr_sql('c', 'b'), 8)} AS gain FROM k GROUP BY 1")
def st_15(spark, d):
    return S.fresh_and_stale(supplier_month(spark, d), "x2", "y", 3).select("date", tidy("fresh", 8).alias("fresh"), tidy("stale", 8).alias("stale"), tidy("gain", 8).alias("gain"))


@query("st_16_leave_one_key", f"""WITH {SM}, h AS (SELECT DISTINCT key AS held FROM sm), v AS (SELECT h.held, date, x2, y FROM sm JOIN h ON key <> h.held WHERE y IS NOT NULL),
k AS (SELECT held, date, rank() OVER (PARTITION BY held, date ORDER BY x2) + (count(*) OVER (PARTITION BY held, date, x2) - 1) / 2.0 AS a, rank() OVER (PARTITION BY held, date ORDER BY y) + (count(*) OVER (PARTITION BY held, date, y) - 1) / 2.0 AS b FROM v),
c AS (SELECT held, {corr_sql('a', 'b')} AS ic FROM k GROUP BY held, date) SELECT held, {R('avg(ic)', 8)} AS mean FROM c GROUP BY 1""")
def st_16(spark, d):
    panel = written(supplier_month(spark, d).select("date", "key", "x2", "y"))
    held = panel.select(F.col("key").alias("held")).distinct()
    return S.hold_out_keys(panel, "x2", "y", held).select("held", tidy("mean", 8).alias("mean"))


@query("st_16_halves", f"""WITH {SERIES}, h AS (SELECT ic, 2 * row_number() OVER (ORDER BY date) <= count(*) OVER () AS early FROM se)
SELECT count(*)::BIGINT AS n, {R('avg(ic) FILTER (early)', 8)} AS first, {R('avg(ic) FILTER (NOT early)', 8)} AS second, {R('avg(ic)', 8)} AS whole, sign(avg(ic) FILTER (early)) = sign(avg(ic)) AND sign(avg(ic) FILTER (NOT early)) = sign(avg(ic)) AS agree FROM h""")
def st_16_halves(spark, d):
    found = S.halves_agree(series(spark, d), "ic")
    return found.select("n", *[tidy(c, 8).alias(c) for c in ("first", "second", "whole")], "agree")


@query("st_17_paired_difference", f"WITH {SM}, c AS (SELECT date, avg(y) FILTER (key % 2 = 0) - avg(y) FILTER (key % 2 = 1) AS diff FROM sm WHERE y IS NOT NULL GROUP BY 1) SELECT date, {R('diff', 8)} AS diff FROM c WHERE diff IS NOT NULL")
def st_17(spark, d):
    cells = labelled(spark, d).groupBy("date", F.when(F.col("key") % 2 == 0, "even").otherwise("odd").alias("cell")).agg(F.avg("y").alias("value"))
    return S.paired_difference(cells, "even", "odd").select("date", tidy("diff", 8).alias("diff"))


CELLS = f"WITH {SM}, c AS (SELECT date, avg(y) FILTER (key % 4 = 0) AS a, avg(y) FILTER (key % 4 = 1) AS b, avg(y) FILTER (key % 4 = 2) AS c, avg(y) FILTER (key % 4 = 3) AS d FROM sm WHERE y IS NOT NULL GROUP BY 1), q AS (SELECT date, (a - b) - (c - d) AS diff FROM c WHERE (a - b) - (c - d) IS NOT NULL)"


def quarters(spark, d):
    cell = F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("key") % 4 + 1).cast("int"))
    cells = labelled(spark, d).groupBy("date", cell.alias("cell")).agg(F.avg("y").alias("value"))
    return S.double_difference(cells, ("a", "b"), ("c", "d"))


@query("st_17_double_difference", f"{CELLS} SELECT date, {R('diff', 8)} AS diff FROM q")
def st_17_double(spark, d):
    return quarters(spark, d).select("date", tidy("diff", 8).alias("diff"))


@query("st_17_strata", f"{CELLS}, s AS (SELECT diff AS v, month(date) <= 6 AS e FROM q), g AS (SELECT avg(v) FILTER (e) - avg(v) FILTER (NOT e) AS diff, sqrt(var_samp(v) FILTER (e) / count(v) FILTER (e) + var_samp(v) FILTER (NOT e) / count(v) FILTER (NOT e)) AS se FROM s) SELECT {R('diff', 8)} AS diff, {R('se', 8)} AS se, {R('diff / se', 6)} AS t FROM g")
def st_17_strata(spark, d):
    strata = quarters(spark, d).select("date", F.col("diff").alias("value"), F.when(F.month("date") <= 6, "early").otherwise("late").alias("stratum"))
    return S.stratum_difference(strata, "early", "late").select(tidy("diff", 8).alias("diff"), tidy("se", 8).alias("se"), tidy("t", 6).alias("t"))


@query("st_17_sign_stability", f"{CELLS}, b AS (SELECT avg(diff) AS m FROM (SELECT *, ntile(8) OVER (ORDER BY date) AS b FROM q) GROUP BY b) SELECT count(*)::BIGINT AS blocks, avg((sign(m) = sign((SELECT avg(diff) FROM q)))::INT)::DOUBLE AS same FROM b")
def st_17_signs(spark, d):
    return S.sign_stability(quarters(spark, d), "diff", 8)


LAGS = f"""WITH {SM}, o AS (SELECT date, key, x2, y, k, lag(x2, k) OVER (PARTITION BY k, key ORDER BY date) AS old FROM sm, (SELECT unnest([1, 2, 4]) AS k)), v AS (SELECT * FROM o WHERE old IS NOT NULL),
p AS (SELECT k, date, {corr_sql('a', 'b')} AS ic FROM (SELECT k, date, rank() OVER (PARTITION BY k, date ORDER BY x2) + (count(*) OVER (PARTITION BY k, date, x2) - 1) / 2.0 AS b, rank() OVER (PARTITION BY k, date ORDER BY old) + (count(*) OVER (PARTITION BY k, date, old) - 1) / 2.0 AS a FROM v) GROUP BY 1, 2),
s AS (SELECT k, date, {corr_sql('a', 'b')} AS ic FROM (SELECT k, date, rank() OVER (PARTITION BY k, date ORDER BY y) + (count(*) OVER (PARTITION BY k, date, y) - 1) / 2.0 AS b, rank() OVER (PARTITION BY k, date ORDER BY old) + (count(*) OVER (PARTITION BY k, date, old) - 1) / 2.0 AS a FROM v WHERE y IS NOT NULL) GROUP BY 1, 2)"""


@query("st_15_lag_profile", f"{LAGS} SELECT k::INT AS lag, dates, {R('stale', 8)} AS stale, {R('persistence', 8)} AS persistence FROM (SELECT k, count(ic)::BIGINT AS dates, avg(ic) AS stale FROM s GROUP BY 1) JOIN (SELECT k, avg(ic) AS persistence FROM p GROUP BY 1) USING (k)")
def st_15_profile(spark, d):
    return S.lag_profile(supplier_month(spark, d), "x2", "y", [1, 2, 4]).select("lag", "dates", tidy("stale", 8).alias("stale"), tidy("persistence", 8).alias("persistence"))


@query("st_18_clean_ic", f"WITH {IC}, {DEALT.format(n=3)}, pl AS (SELECT date, avg(ic) AS placebo, count(*)::BIGINT AS seeds FROM dc GROUP BY 1) SELECT date, seeds, {R('ic - placebo', 8)} AS clean FROM ics JOIN pl USING (date)")
def st_18(spark, d):
    panel = labelled(spark, d)
    dealt = S.permute_within(panel, "y", 3, carry=("x2",))
    placebo = M.rank_ic(dealt, "x2", "permuted", by=("seed", "date")).groupBy("date").agg(F.avg("ic").alias("placebo"), F.count("*").alias("seeds"))
    return ics(spark, d).join(placebo, "date").select("date", "seeds", tidy(F.col("ic") - F.col("placebo"), 8).alias("clean"))


@query("st_19_maturity_gate", f"""WITH {BLOCKS} SELECT CASE WHEN (SELECT count(*) FROM se) < 24 THEN 'REFUSED_SHORT' WHEN count(*) < 5 THEN 'REFUSED_BLOCKS' WHEN stddev_samp(mean) = 0 THEN 'REFUSED_FLAT' ELSE 'EVALUATED' END AS status, count(*)::BIGINT AS blocks FROM bl""")
def st_19(spark, d):
    s = series(spark, d)
    found = S.blocks(s, "ic", 12).agg(F.count("*").alias("blocks"), F.stddev_samp("mean").alias("sd")).join(F.broadcast(s.agg(F.count("*").alias("n"))))
    status = F.when(F.col("n") < 24, "REFUSED_SHORT").when(F.col("blocks") < 5, "REFUSED_BLOCKS").when(F.col("sd") == 0, "REFUSED_FLAT").otherwise("EVALUATED")
    return found.select(status.alias("status"), "blocks")


@query("st_20_decision_map", f"""WITH {SM}, s AS (SELECT (key % 6)::BIGINT AS arm, avg(y) AS m, avg(y) / (stddev_samp(y) / sqrt(count(*))) AS t FROM sm WHERE y IS NOT NULL GROUP BY 1)
SELECT arm, CASE WHEN t > 2 AND m > 0 THEN 'PROMOTE' WHEN t < -2 THEN 'REJECT' WHEN abs(t) < 0.5 THEN 'NULL' ELSE 'HOLD' END AS verdict FROM s""")
def st_20(spark, d):
    s = labelled(spark, d).groupBy((F.col("key") % 6).alias("arm")).agg(F.avg("y").alias("m"), S.t_statistic("y").alias("t"))
    return s.select("arm", F.when((F.col("t") > 2) & (F.col("m") > 0), "PROMOTE").when(F.col("t") < -2, "REJECT").when(F.abs("t") < 0.5, "NULL").otherwise("HOLD").alias("verdict"))


@query("st_21_overfitting", f"""WITH {SM}, c AS (SELECT date, key % 7 AS config, avg(y) AS value FROM sm WHERE y IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, dense_rank() OVER (PARTITION BY config ORDER BY date) - 1 AS pos FROM c), n AS (SELECT max(pos) + 1 AS n FROM p),
r AS (SELECT config, least(5, floor(pos * 6 / n::DOUBLE))::INT AS run, sum(value) AS s, count(value) AS k FROM p, n GROUP BY 1, 2), m AS (SELECT half, config, sum(s) FILTER ((half >> run) & 1 = 1) / sum(k) FILTER ((half >> run) & 1 = 1) AS a, sum(s) FILTER ((half >> run) & 1 = 0) / sum(k) FILTER ((half >> run) & 1 = 0) AS b FROM r, (SELECT unnest(range(0, 64))::INT AS half) WHERE bit_count(half) = 3 GROUP BY 1, 2),
k AS (SELECT rank() OVER (PARTITION BY half ORDER BY b) AS r, count(*) OVER (PARTITION BY half) AS n, row_number() OVER (PARTITION BY half ORDER BY a DESC, config) AS best FROM m) SELECT {R('avg((r / (n + 1)::DOUBLE <= 0.5)::INT)')} AS pbo, count(*)::BIGINT AS splits FROM k WHERE best = 1""")
def st_21(spark, d):
    cells = labelled(spark, d).groupBy("date", (F.col("key") % 7).alias("config")).agg(F.avg("y").alias("value"))
    placed = cells.withColumn("pos", F.dense_rank().over(Window.partitionBy("config").orderBy("date")) - 1)
    return S.overfitting(placed).select(tidy("pbo").alias("pbo"), "splits")


@query("st_21_deflated_sharpe", f"""WITH {IC}, s AS (SELECT avg(ic) AS m, stddev_pop(ic) AS s, count(ic) AS n FROM ics WHERE ic IS NOT NULL), z AS (SELECT avg(((ic - m) / s) ** 3) AS sk, avg(((ic - m) / s) ** 4) AS ku FROM ics, s WHERE ic IS NOT NULL)
SELECT {R('m / s', 7)} AS sharpe, {R('(m / s - 0.15746296) * sqrt(n - 1) / sqrt(1 - sk * m / s + (ku - 1) / 4 * (m / s) ** 2)', 4)} AS z FROM s, z""")
def st_21b(spark, d):
    return S.deflated_sharpe(ics(spark, d).where("ic is not null"), "ic", 10, 0.01).select(tidy("sharpe", 7).alias("sharpe"), tidy("z", 4).alias("z"))


@query("st_22_ensemble_gain", f"""WITH {SM}, v AS (SELECT date, key, y, rank() OVER (PARTITION BY date ORDER BY x1) + (count(*) OVER (PARTITION BY date, x1) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY date ORDER BY x2) + (count(*) OVER (PARTITION BY date, x2) - 1) / 2.0 AS r2, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM sm WHERE y IS NOT NULL),
e AS (SELECT *, (r1 + r2) / 2 AS s FROM v), k AS (SELECT date, ry, r2, rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0 AS rs FROM e)
SELECT date, {R(corr_sql('rs', 'ry') + ' - ' + corr_sql('r2', 'ry'), 8)} AS gain FROM k GROUP BY 1""")
def st_22(spark, d):
    from ..operators.cross_section import ensemble

    panel = labelled(spark, d)
    mean = ensemble(panel.select("date", "key", F.col("x1").alias("a"), F.col("x2").alias("b")).unpivot(["date", "key"], ["a", "b"], "model", "score"), "rank")
    both = panel.join(mean.select("date", "key", "score"), ["date", "key"])
    gain = M.rank_ic(both, "score", "y").select("date", F.col("ic").alias("a")).join(M.rank_ic(both, "x2", "y").select("date", F.col("ic").alias("b")), "date")
    return gain.select("date", tidy(F.col("a") - F.col("b"), 8).alias("gain"))


def book_sql(source: str, by: str, every: int, k: int, delay: int) -> str:
    """SQL of the book's rows bk (by, date, gross, traded, problem) from source (by, date, key, score) and closes p (date, key, close)."""
    of = f"{by}, " if by else ""
    on, part = (f"USING ({by}, ", f"PARTITION BY {by}, ") if by else ("USING (", "PARTITION BY ")
    whole = f"PARTITION BY {by} " if by else ""
    return f"""ax AS (SELECT *, row_number() OVER ({whole}ORDER BY date) - 1 AS pos, count(*) OVER ({whole}) - 1 AS last FROM (SELECT DISTINCT {of}date FROM {source})),
ch AS (SELECT * FROM (SELECT {of}key, pos, last, row_number() OVER ({part}pos ORDER BY score DESC, key) AS rn FROM {source} JOIN ax {on}date) WHERE pos % {every} = 0 AND score IS NOT NULL) WHERE rn <= {k}),
de AS (SELECT {of}pos, last, count(*) AS names FROM ch GROUP BY ALL),
ba AS (SELECT {of}key, pos + {delay} AS fill, last FROM ch WHERE pos + {delay} <= last),
ep AS (SELECT *, lead(fill) OVER ({whole}ORDER BY fill) AS til, min(fill) OVER ({whole}) AS first FROM (SELECT DISTINCT {of}fill FROM ba)),
dy AS (SELECT {of}key, fill, til, unnest(range(fill, coalesce(til, last) + 1)) AS pos FROM ba JOIN ep {on}fill)),
pr AS (SELECT {of}p.key, pos, close FROM p JOIN ax USING (date)),
pa AS (SELECT dy.*, close / max(close) FILTER (dy.pos = fill) OVER ({part.replace(by, 'dy.' + by) if by else part}fill, dy.key) AS rel FROM dy LEFT JOIN pr {on}key, pos)),
va AS (SELECT {of}fill, til, pos, CASE WHEN bool_or(b) OVER ({part}fill ORDER BY pos) THEN NULL ELSE v END AS v FROM (SELECT {of}fill, til, pos, avg(rel) AS v, bool_or(rel IS NULL) AS b FROM pa GROUP BY ALL)),
ea AS (SELECT {of}fill, til, pos, v, v / lag(v) OVER ({part}fill ORDER BY pos) - 1 AS g FROM va),
dr AS (SELECT {of}key, til AS fill, rel / sum(rel) OVER ({part}fill) AS old FROM pa WHERE pos = til),
tg AS (SELECT {of}key, fill, 1.0 / count(*) OVER ({part}fill) AS new FROM ba),
mo AS (SELECT {of}fill AS pos, sum(abs(coalesce(new, 0) - coalesce(old, 0))) AS moved FROM tg FULL JOIN dr {on}key, fill) GROUP BY ALL),
mv AS (SELECT {('mo.' + by + ', ') if by else ''}mo.pos, CASE WHEN e.til IS NULL OR e.v IS NOT NULL THEN moved END AS moved FROM mo LEFT JOIN (SELECT * FROM ea WHERE pos = til) e {on}pos)),
bk AS (SELECT {('ax.' + by + ', ') if by else ''}ax.date, CASE WHEN first IS NULL OR ax.pos <= first THEN 0 ELSE g END AS gross, CASE WHEN mv.pos IS NOT NULL THEN moved ELSE 0 END AS traded
  FROM ax LEFT JOIN (SELECT DISTINCT {of}first FROM ep) f {'USING (' + by + ')' if by else 'ON true'} LEFT JOIN (SELECT {of}pos, g FROM ea WHERE pos > fill) e {on}pos) LEFT JOIN mv {on}pos))"""


@query("pf_1_topk_book", f"""WITH {SM}, s AS (SELECT date, key, x2 AS score FROM sm), p AS (SELECT date, key, close FROM sm), {book_sql('s', '', 6, 8, 1)}
SELECT date, {R('gross', 8)} AS gross, {R('traded', 8)} AS traded, {R('gross - 0.001 * traded', 8)} AS net, CASE WHEN gross IS NULL OR traded IS NULL THEN 'missing close' END AS problem FROM bk""")
def pf_1(spark, d):
    panel = written(supplier_month(spark, d).select("date", "key", "x2", "close"))
    book = P.topk_book(panel.select("date", "key", F.col("x2").alias("score")), panel.select("date", "key", "close"), k=8, every=6, delay=1, cost=0.001, strict=False)
    return book.select("date", *[tidy(c, 8).alias(c) for c in ("gross", "traded", "net")], "problem")


LEDGER_SQL = f"""WITH {SM}, fo AS (SELECT date, (ntile(4) OVER (ORDER BY date) - 1)::INT AS fold FROM (SELECT DISTINCT date FROM sm)), s AS (SELECT fold, date, key, x2 AS score FROM sm JOIN fo USING (date)), p AS (SELECT date, key, close FROM sm), {book_sql('s', 'fold', 4, 8, 2)}"""
FOLD_SQL = LEDGER_SQL + f""", mk AS (SELECT date, sum(close * volume) / sum(volume) AS close FROM (SELECT date, round(close * 100)::BIGINT AS close, volume FROM sm) GROUP BY 1), w AS (SELECT fold, date, close FROM mk JOIN fo USING (date)),
ho AS (SELECT fold, date, r AS gross, r - CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY date) = 1 THEN 0.002 ELSE 0 END AS net FROM (SELECT *, close / lag(close) OVER (PARTITION BY fold ORDER BY date) - 1 AS r FROM w) WHERE r IS NOT NULL),
ts AS (SELECT a.fold, a.date, a.close, CASE WHEN b.close IS NULL THEN 0 ELSE (a.close > b.close)::INT END AS s FROM w a LEFT JOIN w b ON b.fold = a.fold AND b.date = a.date - 31),
th AS (SELECT fold, date, coalesce(lag(s, 2) OVER (PARTITION BY fold ORDER BY date), 0) AS position, coalesce(close / lag(close) OVER (PARTITION BY fold ORDER BY date) - 1, 0) AS r FROM ts),
ti AS (SELECT fold, date, position * r AS gross, position * r - 0.002 * abs(position - coalesce(lag(position) OVER (PARTITION BY fold ORDER BY date), 0)) AS net FROM th),
tot AS (SELECT fold, max(g) FILTER (n = 'book') AS book_gross, max(t) FILTER (n = 'book') AS book_net, max(g) FILTER (n = 'hold') AS hold_gross, max(t) FILTER (n = 'hold') AS hold_net, max(g) FILTER (n = 'timing') AS timing_gross, max(t) FILTER (n = 'timing') AS timing_net FROM (
  SELECT n, fold, CASE WHEN count(gross) = count(*) THEN exp(sum(ln(1 + gross))) - 1 END AS g, CASE WHEN count(net) = count(*) THEN exp(sum(ln(1 + net))) - 1 END AS t
  FROM (SELECT 'book' AS n, fold, gross, gross - 0.002 * traded AS net FROM bk UNION ALL SELECT 'hold', fold, gross, net FROM ho UNION ALL SELECT 'timing', fold, gross, net FROM ti) GROUP BY 1, 2) GROUP BY 1),
cs AS (SELECT fold, count(*)::BIGINT AS dates, CASE WHEN count(traded) = count(*) THEN 0.002 * sum(traded) END AS cost FROM bk GROUP BY 1),
ld AS (SELECT fold, count(*)::BIGINT AS decisions, count(*) FILTER (pos + 2 <= last)::BIGINT AS filled, count(*) FILTER (pos + 2 > last)::BIGINT AS expired FROM de GROUP BY 1),
po AS (SELECT count(*)::BIGINT AS folds, {', '.join(f"CASE WHEN count({c}) = count(*) THEN exp(sum(ln(1 + {c}))) - 1 END AS {c}" for c in ('book_gross', 'book_net', 'hold_gross', 'hold_net', 'timing_gross', 'timing_net'))} FROM tot),
pd AS (SELECT *, book_net > hold_net AND book_net > timing_net AS bar_met FROM po)"""
TOTALS = ("book_gross", "book_net", "hold_gross", "hold_net", "timing_gross", "timing_net")


def fold_scores(spark, d):
    """fold, date, key, score over four windows of the months; close and volume go along."""
    panel = supplier_month(spark, d)
    return panel.join(F.broadcast(array_split_folds(panel.select("date"), 4)), "date").select("fold", "date", "key", F.col("x2").alias("score"), "close", "volume")


def folds_of(spark, d):
    panel = written(fold_scores(spark, d))
    market = panel.groupBy("date").agg((F.sum(F.round(F.col("close") * 100).cast("long") * F.col("volume")) / F.sum("volume")).alias("close"))
    return P.net_by_fold(panel.select("fold", "date", "key", "score"), panel.select("date", "key", "close"), market, k=8, every=4, delay=2, cost=0.002, days=31)


@query("pf_1_decision_ledger", LEDGER_SQL + " SELECT de.fold, a.date, b.date AS fill_date, names::BIGINT AS names, CASE WHEN b.date IS NULL THEN 'expired' ELSE 'filled' END AS status FROM de JOIN ax a USING (fold, pos) LEFT JOIN ax b ON b.fold = de.fold AND b.pos = de.pos + 2")
def pf_1_ledger(spark, d):
    return P.decision_ledger(fold_scores(spark, d).select("fold", "date", "key", "score"), k=8, every=4, delay=2, by=("fold",))


@query("pf_4_net_of_cost", FOLD_SQL + f" SELECT fold, dates, decisions, filled, expired, {R('cost', 8)} AS cost, {', '.join(R(c, 7) + ' AS ' + c for c in ('book_gross', 'book_net', 'hold_gross', 'hold_net', 'timing_gross', 'timing_net'))} FROM cs JOIN ld USING (fold) JOIN tot USING (fold)")
def pf_4_net_of_cost(spark, d):
    return folds_of(spark, d).select("fold", "dates", "decisions", "filled", "expired", tidy("cost", 8).alias("cost"), *[tidy(c, 7).alias(c) for c in TOTALS])


@query("pf_4_pooled", FOLD_SQL + f" SELECT folds, {', '.join(R(c, 7) + ' AS ' + c for c in ('book_gross', 'book_net', 'hold_gross', 'hold_net', 'timing_gross', 'timing_net'))}, bar_met FROM pd")
def pf_4_pooled(spark, d):
    return P.pooled(folds_of(spark, d)).select("folds", *[tidy(c, 7).alias(c) for c in TOTALS], "bar_met")


ATTESTED = """att AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'guess' ELSE 'battery' END AS source, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 2 THEN 'soon' ELSE '1998-08-02' END AS measured_at, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 3 THEN '  ' ELSE s_name END AS evidence_ref FROM supplier)"""


@query("pf_5_verdict", FOLD_SQL + f""", {ATTESTED}, st AS (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 'withheld' WHEN 1 THEN 'bad source' WHEN 2 THEN 'bad date' WHEN 3 THEN 'no evidence' ELSE 'emitted' END AS status FROM att)
SELECT s_suppkey, status, CASE status WHEN 'emitted' THEN 'net_of_cost' WHEN 'withheld' THEN 'gross_only_diagnostic' END AS grade, {R("CASE status WHEN 'emitted' THEN book_net WHEN 'withheld' THEN book_gross END", 7)} AS total, CASE WHEN status = 'emitted' THEN bar_met END AS bar_met FROM st, pd""")
def pf_5_verdict(spark, d):
    five = F.col("s_suppkey") % 5
    source = F.when(five == 1, "guess").when(five != 0, "battery")
    at = table(spark, d, "supplier").select("s_suppkey", source.alias("source"), F.when(five == 2, "soon").when(five != 0, "1998-08-02").alias("measured_at"), F.when(five == 3, "  ").when(five != 0, F.col("s_name")).alias("evidence_ref"))
    return P.attested_verdict(at, P.pooled(folds_of(spark, d)), ("battery", "canary")).select("s_suppkey", "status", "grade", tidy("total", 7).alias("total"), "bar_met")


@query("pf_2_buy_and_hold", f"WITH {BW}, r AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM mk) SELECT date, {R('r - CASE WHEN row_number() OVER (ORDER BY date) = 1 THEN 0.002 ELSE 0 END')} AS net FROM r WHERE r IS NOT NULL")
def pf_2(spark, d):
    return P.buy_and_hold(market_bars(brand_bars(spark, d)), 0.002).select("date", tidy("net").alias("net"))


@query("pf_3_timing_rule", f"""WITH {BD}, s AS (SELECT m.date, m.close, CASE WHEN p.close IS NULL THEN 0 ELSE (m.close > p.close)::INT END AS s FROM mk m LEFT JOIN mk p ON p.date = m.date - 28), h AS (SELECT date, coalesce(lag(s, 1) OVER (ORDER BY date), 0) AS position, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM s)
SELECT date, position, {R('position * coalesce(r, 0) - 0.001 * abs(position - coalesce(lag(position) OVER (ORDER BY date), 0))')} AS net FROM h""")
def pf_3(spark, d):
    return P.timing_rule(market_bars(brand_bars(spark, d, "day")), 28, 1, 0.001).select("date", "position", tidy("net").alias("net"))


@query("pf_4_net_by_fold", f"WITH {BW}, r AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM mk), f AS (SELECT *, ntile(5) OVER (ORDER BY date) - 1 AS fold FROM r WHERE r IS NOT NULL) SELECT fold::INT AS fold, {R('product(1 + r) - 1', 7)} AS total, {R('stddev_samp(r)', 8)} AS spread FROM f GROUP BY 1")
def pf_4(spark, d):
    from ..functions.scalar import compound

    net = P.buy_and_hold(market_bars(brand_bars(spark, d)), 0.0).withColumn("fold", F.ntile(5).over(Window.orderBy("date")) - 1)
    return net.groupBy("fold").agg(tidy(compound("net"), 7).alias("total"), tidy(F.stddev_samp("net"), 8).alias("spread"))


@query("pf_5_attestation", "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'missing' WHEN s_acctbal < 0 THEN 'negative' WHEN s_acctbal / 100000 + 0.02 > 0.1 THEN 'implausible' ELSE 'ok' END AS status FROM supplier")
def pf_5(spark, d):
    costs = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 11 != 0, F.col("s_acctbal") / 100000).alias("taker"), F.lit(0.02).alias("spread"))
    return P.attestation_status(costs).select("s_suppkey", "status")
