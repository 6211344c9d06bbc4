"""Queries over statistics, parameter matrices and walk-forward analysis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.safe import by_time, rnd
from ..operators import clean, matrix, metrics, stats, wfa
from ..sources.bars import event_bars, order_bars, ship_feature
from . import strategy
from .base import query
from .market import O, lag
from .reports import ACF, CURVE, path


def rounded(df, *names):
    return df.withColumns({n: rnd(F.col(n)) for n in names})


def named_acf(end: str = "11") -> str:
    """The autocorrelations as a table y, unrounded."""
    head, tail = ACF.replace("range(1, 11)", f"range(1, {end})").replace("round(s / v, 6) as acf", "s / v as acf").split("\nselect x.asset")
    return f"{head}, y as (select x.asset{tail})"


RET = f"h as (select *, coalesce(close / nullif({lag('close')}, 0) - 1, 0) as ret from bars)"
LAGGED = f"k as (select unnest({list(stats.LAGS)}) as lag)"
PAIRS = f"""{RET}, j as (select h.asset, h.ts, h.ret, s.qty, row_number() over (partition by h.asset order by h.ts) as i from h join ship s using (ts)), {LAGGED},
p as (select a.asset, a.ts, k.lag, a.qty as x, b.ret as y from j a join k on true join j b on b.asset = a.asset and b.i = a.i + k.lag),
q as (select *, rank() over (partition by asset, lag order by x) + (count(*) over (partition by asset, lag, x) - 1) / 2.0::double as rx, rank() over (partition by asset, lag order by y) + (count(*) over (partition by asset, lag, y) - 1) / 2.0::double as ry, count(*) over (partition by asset, lag) as n,
 count(*) over (partition by asset, lag order by y) as r1, count(*) over (partition by asset, lag order by y desc) as l1, count(*) over (partition by asset, lag order by x) as r2, count(*) over (partition by asset, lag order by x desc) as l2 from p),
d as (select *, abs(lead(r1) over (partition by asset, lag order by x, ts) - r1) as d1, abs(lead(r2) over (partition by asset, lag order by y, ts) - r2) as d2 from q),
c as (select asset, lag::int as lag, count(*) as n, corr(x, y) as pearson, corr(rx, ry) as spearman, greatest(1 - max(n) * sum(d1) / (2.0::double * sum(l1 * (n - l1))), 1 - max(n) * sum(d2) / (2.0::double * sum(l2 * (n - l2)))) as xi from d group by asset, lag having count(*) >= 30)"""


def lagged(spark, d, lags=stats.LAGS):
    rows = order_bars(spark, d)
    rows = rows.withColumn("ret", clean.simple_return(F.col("close"), by_time("asset"))).join(ship_feature(spark, d), "ts")
    return stats.lagged_correlation(rows, "qty", "ret", lags)


@query(f"with {{OB}}, {{SHIP}}, {PAIRS} select asset, lag, n, round(pearson, 6) as pearson, round(spearman, 6) as spearman, round(xi, 6) as xi from c")
def stats_lagged_correlation(spark, d):
    return rounded(lagged(spark, d), "pearson", "spearman", "xi")


@query(f"with {{OB}}, {{SHIP}}, {PAIRS} select asset, arg_max(lag, row(abs(spearman), -lag)) as spearman_lag, arg_max(lag, row(xi, -lag)) as xi_lag from c group by asset")
def stats_best_lag(spark, d):
    return stats.best_lag(lagged(spark, d))


@query(f"with {{EB}}, {CURVE} select asset, round(skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) as skew, round(kurtosis_pop(ret), 6) as excess_kurtosis, false as is_normal from d group by asset")
def stats_distribution(spark, d):
    return rounded(stats.distribution(path(spark, d), "ret").drop("ks", "anderson"), "skew", "excess_kurtosis")


def normal_sql(z: str) -> str:
    """The standard normal distribution function in SQL: its power series, with the odd factorials by lgamma."""
    size = f"abs({z})"
    series = f"list_sum(list_transform(range(0, 260), lambda k: exp((2 * k + 1) * ln({size}) - ((k + 1) * ln(2) + lgamma(k + 1.5::double) - 0.5 * ln(pi())) - {size} * {size} / 2)))"
    return f"case when {z} = 0 then 0.5::double when {size} > 12 then ({z} > 0)::int::double else 0.5::double + sign({z}) * {series} / sqrt(2 * pi()) end"


@query(
    f"""with {{EB}}, {CURVE}, g as (select asset, ret as x, row_number() over (partition by asset order by ret) as i, count(*) over (partition by asset) as n, (ret - avg(ret) over (partition by asset)) / stddev_samp(ret) over (partition by asset) as z from d),
nc as (select asset, i, n, {normal_sql('x')} as p, {normal_sql('z')} as q, {normal_sql('(-z)')} as u from g)
select asset, round(max(greatest(i / n::double - p, p - (i - 1) / n::double)), 6) as ks, round(-any_value(n) - sum(((2 * i - 1) * ln(q) + (2 * (n - i) + 1) * ln(u)) / n::double), 6) as anderson from nc group by asset"""
)
def stats_normality(spark, d):
    return rounded(stats.distribution(path(spark, d), "ret").select("asset", "ks", "anderson"), "ks", "anderson")


@query(
    f"""with {{EB}}, {CURVE}, {named_acf()},
m as (select asset, count(*) as n from d group by asset),
a as (select asset, max(acf) filter (lag = 1) * any_value(n) / (any_value(n) - 1) as a1, max(acf) filter (lag = 2) * any_value(n) / (any_value(n) - 2) as a2 from y join m using (asset) group by asset)
select asset, round(a1, 6) as pacf1, round((a2 - a1 * a1) / (1 - a1 * a1), 6) as pacf2 from a"""
)
def stats_partial_autocorrelation(spark, d):
    out = stats.partial_autocorrelation(metrics.autocorrelation(path(spark, d), "ret", 2, adjusted=True))
    return rounded(out.groupBy("asset").pivot("lag", [1, 2]).agg(F.first("pacf")).select("asset", F.col("1").alias("pacf1"), F.col("2").alias("pacf2")), "pacf1", "pacf2")


@query(
    f"""with {{EB}}, {CURVE}, {named_acf("(select least(60, max(k) // 2) + 1 from (select count(*) as k from d group by asset))")} select asset, lag, round(acf, 6) as acf from y"""
)
def stats_autocorrelation_all(spark, d):
    """Autocorrelations at all default lags: up to 60, and to half of the longest series."""
    rows = path(spark, d)
    return rounded(metrics.autocorrelation(rows, "ret", stats.default_lags(rows)).select("asset", "lag", "acf"), "acf")


ALL_LAGS = "(select least(60, max(k) // 2) + 1 from (select count(*) as k from d group by asset))"


@query(
    f"""with recursive {{EB}}, {CURVE}, {named_acf(ALL_LAGS)}, m as (select asset, count(*) as n from d group by asset),
l as (select asset, list(acf * n / (n - lag) order by lag) as r from y join m using (asset) group by asset),
rec as (select asset, 1 as k, [r[1]] as phi, r[1] as last, r from l union all
 select asset, k + 1, list_concat(list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - a * z[2]), [a]), a, r from
 (select *, (r[k + 1] - list_dot_product(phi, list_reverse(list_slice(r, 1, k)))) / (1 - list_dot_product(phi, list_slice(r, 1, k))) as a from rec where k < len(r)))
select asset, k as lag, round(last, 6) as pacf from rec"""
)
def stats_partial_autocorrelation_all(spark, d):
    rows = path(spark, d)
    return rounded(stats.partial_autocorrelation(metrics.autocorrelation(rows, "ret", stats.default_lags(rows), adjusted=True)), "pacf")


@query(
    f"""with {{EB}}, {CURVE}, x as (select asset, ts, ret as x, ret - lag(ret) over ({O}) as dx from d), z as (select asset, dx as y, lag(x) over ({O}) as x, lag(dx) over ({O}) as z from x),
s as (select asset, count(*) as n, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz, covar_pop(x, y) as xy, covar_pop(z, y) as zy, var_pop(y) as yy from z where x is not null and z is not null group by asset),
b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as b, (zy * xx - xy * xz) / (xx * zz - xz * xz) as c from s)
select asset, round(b / sqrt(n * (yy - b * xy - c * zy) / (n - 3) * zz / (n * (xx * zz - xz * xz))), 6) as adf from b"""
)
def stats_unit_root(spark, d):
    """The unit-root regression with one lag."""
    return rounded(stats.unit_root(path(spark, d), "ret", 1).drop("n"), "adf")


@query(
    f"""with {{EB}}, {CURVE}, e0 as (select asset, ts, ret - avg(ret) over (partition by asset) as e from d),
e as (select *, sum(e) over ({O} rows between unbounded preceding and current row) as c, row_number() over ({O}) as i from e0), m as (select asset, count(*) as n, sum(e * e) as v, sum(c * c) as cc from e group by asset),
g as (select a.asset, b.i - a.i as k, sum(a.e * b.e) as g from e a join e b on a.asset = b.asset and b.i > a.i group by all),
w as (select asset, n, v, cc, coalesce(sum(2 * g) filter (k <= floor(n ** (2 / 9.0::double))), 0) / n as s0, coalesce(sum(2 * k * g) filter (k <= floor(n ** (2 / 9.0::double))), 0) / n as s1 from m join g using (asset) group by asset, n, v, cc),
l as (select *, least(n - 1, floor(1.1447::double * ((s1 / (v / n + s0)) ** 2) ** (1 / 3.0::double) * n ** (1 / 3.0::double)))::bigint as lags from w)
select l.asset, lags, round(any_value(cc) / (any_value(n) * any_value(n) * (any_value(v) + 2 * coalesce(sum((1 - k / (lags + 1.0::double)) * g) filter (k <= lags), 0)) / any_value(n)), 6) as kpss from l join g using (asset) group by l.asset, lags"""
)
def stats_level_stationarity(spark, d):
    """The level-stationarity statistic with its automatic bandwidth."""
    return rounded(stats.level_stationarity(path(spark, d), "ret").select("asset", "lags", "kpss"), "kpss")


@query()
def stats_stationarity(spark, d):
    return rounded(stats.stationarity(path(spark, d), "ret"), "adf", "kpss", "adf_p", "kpss_p")


@query(
    f"""with {{OB}}, r as (select *, row_number() over ({O}) as i, avg(close) over ({O} rows between 2 preceding and 2 following) as t0, count(*) over ({O} rows between 2 preceding and 2 following) as k from bars),
t as (select *, close - case when k = 5 then t0 end as dv, i % 5 as ph from r), s as (select asset, ph, avg(dv) as s from t group by asset, ph), z as (select asset, ph, s - avg(s) over (partition by asset) as s from s)
select asset, count(*) as n, round(greatest(1 - var_samp(dv - s) / var_samp(dv), 0), 6) as strength, greatest(1 - var_samp(dv - s) / var_samp(dv), 0) > 0.1 and count(*) >= 100 as seasonal from t join z using (asset, ph) group by asset"""
)
def stats_seasonality(spark, d):
    return rounded(stats.seasonality(order_bars(spark, d), "close", 5), "strength")


@query(
    f"""with {{EB}}, {CURVE}, {named_acf()},
w as (select *, lag(acf) over (partition by asset order by lag) as pv, lead(acf) over (partition by asset order by lag) as nx from y) select asset, arg_max(lag, row(acf, -lag)) as period from w where acf > pv and acf > nx group by asset"""
)
def stats_dominant_period(spark, d):
    return stats.dominant_period(metrics.autocorrelation(path(spark, d), "ret", 10))


# Parameter matrix

FAST, SLOW = [2, 3, 4], [5, 6, 8]
DOMAINS = {"fast": {"type": "range", "start": 2, "stop": 4}, "slow": {"type": "set", "values": SLOW}}
SWEEP = f"""n as (select *, row_number() over ({O}) as i from bars), f as (select unnest([2, 3, 4]) as fast), s as (select unnest([5, 6, 8]) as slow), co as (select fast, slow, (row_number() over (order by fast, slow) - 1)::bigint as combo_id from f, s),
a as (select n.asset, n.ts, n.i, n.close, p.period, case when count(*) = p.period then avg(m.close) end as av from n join (select fast as period from f union all select slow from s) p on true join n m on m.asset = n.asset and m.i between n.i - p.period + 1 and n.i group by n.asset, n.ts, n.i, n.close, p.period),
g as (select co.combo_id, co.fast, co.slow, x.asset, x.ts, x.close, x.av > y.av as o from co join a x on x.period = co.fast join a y on y.period = co.slow and y.asset = x.asset and y.ts = x.ts),
r as (select *, coalesce(lag(o::int) over (partition by combo_id, asset order by ts), 0) * coalesce(close / lag(close) over (partition by combo_id, asset order by ts) - 1, 0) as r from g),
sw as (select combo_id, fast, slow, asset, product(1 + r) - 1 as total_return, avg(r) as mean, stddev_samp(r) as std from r group by all)"""


def sweep(spark, d):
    rows, _ = matrix.combos(DOMAINS)
    return matrix.sweep_average_cross(event_bars(spark, d), matrix.combo_frame(spark, rows), sorted({*FAST, *SLOW}))


def cells(spark, d):
    return matrix.cell_aggregate(sweep(spark, d), "fast", "slow", "mean")


@query(f"with {{EB}}, {SWEEP} select combo_id, fast::bigint as fast, slow::bigint as slow, asset, round(total_return, 5) as total_return, round(mean, 6) as mean, round(std, 6) as std from sw")
def matrix_sweep(spark, d):
    return rounded(sweep(spark, d), "mean", "std").withColumn("total_return", rnd(F.col("total_return"), 5))


CELLS = f"{SWEEP}, ce as (select fast, slow, count(*) as n, avg(mean) as mean, median(mean) as median, max(mean) as best, min(mean) as worst, stddev_pop(mean) as std from sw group by fast, slow)"


@query(f"with {{EB}}, {CELLS} select fast::bigint as fast, slow::bigint as slow, n, round(mean, 6) as mean, round(median, 6) as median, round(best, 6) as best, round(worst, 6) as worst, round(std, 6) as std from ce")
def matrix_cells(spark, d):
    return rounded(cells(spark, d), "mean", "median", "best", "worst", "std")


@query(f"with {{EB}}, {CELLS} select fast::bigint as fast, round(max(mean) filter (slow = 5), 6) as s5, round(max(mean) filter (slow = 6), 6) as s6, round(max(mean) filter (slow = 8), 6) as s8 from ce group by fast")
def matrix_pivot(spark, d):
    out = matrix.grid_pivot(cells(spark, d), "fast", "slow", "mean", SLOW)
    return out.select("fast", *[rnd(F.col(str(s))).alias(f"s{s}") for s in SLOW])


@query(f"with {{EB}}, {CELLS}, u as (select 'fast' as param, fast as v, mean from ce union all select 'slow', slow, mean from ce), m as (select param, stddev_pop(m) as s from (select param, v, avg(mean) as m from u group by param, v) group by param) select param, round(least(s / max(s) over (), 1), 6) as importance from m")
def matrix_importance(spark, d):
    return rounded(matrix.parameter_importance(cells(spark, d), ["fast", "slow"], "mean"), "importance")


PLATEAU = f"""{CELLS}, pr as (select a.fast, a.slow, a.mean, b.mean as v from ce a join ce b on abs(a.fast - b.fast) <= 2 and abs(a.slow - b.slow) <= 2 and not (a.fast = b.fast and a.slow = b.slow)),
ag as (select fast, slow, count(*) as neighbours, avg((v >= case when mean >= 0 then 0.9::double * mean else mean end)::int) as support, greatest(0, 1 - stddev_pop(v) / greatest(any_value(abs(mean)), 1)) as stability from pr group by fast, slow),
pl as (select *, 0.6::double * support + 0.4::double * stability as plateau_score from ag)"""


@query(
    f"""with {{EB}}, {PLATEAU} select fast::bigint as fast, slow::bigint as slow, neighbours, round(support, 6) as support, round(stability, 6) as stability, round(plateau_score, 6) as plateau_score from pl"""
)
def matrix_plateau(spark, d):
    return rounded(matrix.plateau(cells(spark, d), "fast", "slow", "mean", 2), "support", "stability", "plateau_score")


@query(f"with {{EB}}, {CELLS} select 3::bigint as fast, 6::bigint as slow, round(avg(mean), 6) as region_mean from ce")
def matrix_best_region(spark, d):
    return rounded(matrix.best_region(cells(spark, d), "fast", "slow", "mean"), "region_mean")


SCORED = f"""{PLATEAU}, sc as (select fast, slow, plateau_score, m.mean / nullif(m.std, 0) as sharpe, m.worst as max_drawdown, 100 * m.n / 9.0::double as exposure, m.n as trade_count, m.mean as total_return from ce m join pl using (fast, slow)),
rb as (select *, 0.45::double * plateau_score + 0.2::double * least(1, greatest(0, exposure / 100)) + 0.2::double * (1 - least(1, abs(max_drawdown))) + 0.15::double * least(1, trade_count / 30.0::double) as stability_score,
 sharpe + 0.35::double * plateau_score - 0.3::double * least(1, abs(max_drawdown)) as robust_score from sc)"""


def scored(spark, d):
    c = cells(spark, d)
    both = c.join(matrix.plateau(c, "fast", "slow", "mean", 2), ["fast", "slow"])
    rows = both.select("fast", "slow", "plateau_score", F.try_divide("mean", F.nullif(F.col("std"), F.lit(0.0))).alias("sharpe"), F.col("worst").alias("max_drawdown"), (100 * F.col("n") / 9.0).alias("exposure"), F.col("n").alias("trade_count"), F.col("mean").alias("total_return"))
    return matrix.with_scores(rows)


@query(
    f"""with {{EB}}, {SCORED} select fast::bigint as fast, slow::bigint as slow, round(stability_score, 6) as stability_score, round(robust_score, 6) as robust_score, case when sharpe > 2 then 'Pass' when plateau_score >= 0.45 or sharpe >= 0.75 then 'Review' else 'Fail' end as review,
row_number() over (order by robust_score desc nulls last, plateau_score desc nulls last, sharpe desc nulls last, fast, slow) as balanced, row_number() over (order by stability_score desc nulls last, plateau_score desc nulls last, robust_score desc nulls last, sharpe desc nulls last, fast, slow) as stable from rb"""
)
def matrix_ranking(spark, d):
    rows = matrix.ranked(scored(spark, d), "balanced", ["fast", "slow"]).withColumnRenamed("position", "balanced")
    rows = matrix.ranked(rows, "stability_first", ["fast", "slow"]).withColumnRenamed("position", "stable").withColumn("review", matrix.review(F.col("sharpe") > 2))
    return rounded(rows.select("fast", "slow", "stability_score", "robust_score", "review", "balanced", "stable"), "stability_score", "robust_score")


@query(
    f"""with {{EB}}, {SCORED} select fast::bigint as fast, slow::bigint as slow, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(plateau_score, 6) as plateau_score from rb a where sharpe is not null and max_drawdown is not null and plateau_score is not null and not exists
 (select 1 from rb b where b.sharpe >= a.sharpe and b.max_drawdown >= a.max_drawdown and b.plateau_score >= a.plateau_score and (b.sharpe > a.sharpe or b.max_drawdown > a.max_drawdown or b.plateau_score > a.plateau_score))"""
)
def matrix_front(spark, d):
    """Combinations that none dominates in three objectives."""
    out = matrix.front(scored(spark, d), {"sharpe": "max", "max_drawdown": "max", "plateau_score": "max"})
    return rounded(out.select(F.col("fast").cast("long").alias("fast"), F.col("slow").cast("long").alias("slow"), "sharpe", "max_drawdown", "plateau_score"), "sharpe", "max_drawdown", "plateau_score")


@query(
    f"""with {{EB}}, {SCORED} select representative_type, fast::bigint as fast, slow::bigint as slow from (select 'robust_score' as representative_type, * from (select fast, slow from rb order by robust_score desc, fast, slow limit 1)
 union all select 'plateau_score', * from (select fast, slow from rb order by plateau_score desc, fast, slow limit 1) union all select 'total_return', * from (select fast, slow from rb order by total_return desc, fast, slow limit 1))"""
)
def matrix_shortlist(spark, d):
    return matrix.shortlist(scored(spark, d), ["fast", "slow"]).select("representative_type", "fast", "slow")


@query()
def matrix_clusters(spark, d):
    return rounded(matrix.clusters(cells(spark, d).select("fast", "slow", "mean"), ["fast", "slow"], "mean"), "mean")


# Walk-forward analysis on the event bars; the SQL has the windows of 30 sessions, as many as the test tables have

PLAN = wfa.windows(30, 12, 6, 6)
WFA = f"""pl as (select * from (values {", ".join(f"({w}, '{p}', {a}, {z})" for w, a0, a1, b0, b1 in PLAN for p, a, z in (("train", a0, a1), ("test", b0, b1)))}) t(window_id, part, a, z)),
ps as (select ts, row_number() over (order by ts) - 1 as i from (select distinct ts from bars)),
sl as (select pl.window_id, pl.part, b.asset, b.ts, b.close from bars b join ps using (ts) join pl on ps.i >= pl.a and ps.i < pl.z),
f as (select unnest([2, 3]) as fast), s as (select unnest([4, 5]) as slow), co as (select fast, slow, (row_number() over (order by fast, slow) - 1)::bigint as combo_id from f, s),
m as (select *, {", ".join(f"case when count(*) over (w rows between {p - 1} preceding and current row) >= {p} then avg(close) over (w rows between {p - 1} preceding and current row) end as m{p}" for p in (2, 3, 4, 5))}, coalesce(close / lag(close) over w - 1, 0) as r from sl window w as (partition by window_id, part, asset order by ts)),
g as (select m.*, co.*, coalesce((case fast when 2 then m2 else m3 end > case slow when 4 then m4 else m5 end)::int, 0) as o from m, co),
h as (select *, coalesce(lag(o) over (partition by window_id, part, combo_id, asset order by ts), 0) * r as p from g),
ba as (select window_id, part, combo_id, fast, slow, ts, avg(p) as ret from h group by all),
pa as (select *, product(1 + ret) over w as equity, row_number() over w as i from ba window w as (partition by window_id, part, combo_id order by ts)),
pd as (select *, equity / greatest(max(equity) over (partition by window_id, part, combo_id order by ts), 1) - 1 as dd from pa),
sc as (select window_id, part, combo_id, fast, slow, count(*) as n, count(*) filter (abs(ret) > 1e-12) as active_bars, arg_max(equity, ts) - 1 as total_return, min(dd) as max_drawdown,
 coalesce(avg(ret) filter (i > 1) / nullif(stddev_pop(ret) filter (i > 1), 0) * sqrt(252), 0) as sharpe, coalesce((arg_max(equity, ts) - 1) / nullif(abs(min(dd)), 0), 0) as calmar from pd group by all)"""


def scores(spark, d):
    rows, _ = matrix.combos({"fast": {"type": "set", "values": [2, 3]}, "slow": {"type": "set", "values": [4, 5]}})
    panel = event_bars(spark, d).select("asset", "ts", "close")
    slices = wfa.sliced(spark, panel, wfa.windows(panel.select("ts").distinct().count(), 12, 6, 6))
    return wfa.evaluate(slices, matrix.combo_frame(spark, rows), [2, 3, 4, 5])


@query(f"with {{EB}}, {WFA} select window_id, part, combo_id, n, active_bars, round(total_return, 6) as total_return, round(max_drawdown, 6) as max_drawdown, round(sharpe, 6) as sharpe, round(calmar, 5) as calmar from sc")
def wfa_scores(spark, d):
    out = scores(spark, d).drop("fast", "slow", "active_rebalances", "exposure_ratio")
    return rounded(out, "total_return", "max_drawdown", "sharpe").withColumn("calmar", rnd(F.col("calmar"), 5))


@query(f"with {{EB}}, {WFA} select window_id, part, combo_id, n, active_bars, round(total_return, 6) as total_return, round(max_drawdown, 6) as max_drawdown, round(sharpe, 6) as sharpe, round(calmar, 5) as calmar from sc")
def wfa_document_scores(spark, d):
    """The same scores from a strategy document whose periods are bound to each combination."""
    panel = event_bars(spark, d)
    names = [r["asset"] for r in panel.select("asset").distinct().collect()]  # one row an asset of the document
    average = lambda k: {"op": "indicator.sma", "period": {"param_ref": k}}
    entry = {"op": "gt", "left": "fast", "right": "slow"}
    doc = {
        "features": {"fast": average("fast"), "slow": average("slow")}, "entry": entry, "exit": {"op": "not", "node": entry},
        "allocation": {"type": "fixed_weight", "weights": {n: 1 / len(names) for n in names}}, "rebalance": {"op": "calendar.every_session"},
    }
    rows, _ = matrix.combos({"fast": {"type": "set", "values": [2, 3]}, "slow": {"type": "set", "values": [4, 5]}})
    out = strategy.walk_forward(panel, doc, rows, wfa.windows(panel.select("ts").distinct().count(), 12, 6, 6))
    return rounded(out.drop("active_rebalances", "exposure_ratio"), "total_return", "max_drawdown", "sharpe").withColumn("calmar", rnd(F.col("calmar"), 5))


CHOSEN = f"""{WFA}, tr as (select *, max((active_bars >= n * 0.2::double)::int) over (partition by window_id) as any_ok from sc where part = 'train'), v as (select * from tr where active_bars >= n * 0.2::double or any_ok = 0),
ob as (select unnest(['sharpe', 'calmar', 'total_return']) as objective), rk as (select v.*, objective, row_number() over (partition by window_id, objective order by case objective when 'sharpe' then sharpe when 'calmar' then calmar else total_return end desc, combo_id) as k from v, ob),
ch as (select rk.window_id, rk.combo_id, objective, rk.fast, rk.slow, rk.sharpe as is_sharpe, t.sharpe as oos_sharpe, t.calmar as oos_calmar, t.total_return as oos_total_return, t.max_drawdown as oos_max_drawdown, case objective when 'sharpe' then rk.sharpe when 'calmar' then rk.calmar else rk.total_return end as im, case objective when 'sharpe' then t.sharpe when 'calmar' then t.calmar else t.total_return end as om, case when im > 0 and om > 0 then om / im end as ratio, rk.any_ok = 0 as fallback
 from rk join sc t on t.part = 'test' and t.window_id = rk.window_id and t.combo_id = rk.combo_id where k = 1)"""
OK = "(om > 0 and coalesce(ratio >= 0.7, true) and not fallback)"


def chosen(spark, d):
    return wfa.accepted(wfa.select(scores(spark, d), least_active=0.2))


@query(f"with {{EB}}, {CHOSEN} select window_id, combo_id, objective, round(is_sharpe, 6) as is_sharpe, round(oos_sharpe, 6) as oos_sharpe, round(oos_total_return, 6) as oos_total_return, round(ratio, 6) as oos_is_ratio, {OK} as accepted from ch")
def wfa_selection(spark, d):
    out = chosen(spark, d).select("window_id", "combo_id", "objective", "is_sharpe", "oos_sharpe", "oos_total_return", "oos_is_ratio", "accepted")
    return rounded(out, "is_sharpe", "oos_sharpe", "oos_total_return", "oos_is_ratio")


@query(
    f"""with {{EB}}, {CHOSEN} select window_id, combo_id, objective, {OK} as accepted, fallback,
coalesce(nullif(concat_ws('; ', case when objective = 'sharpe' and om <= 0 then 'OOS Sharpe <= 0' end, case when objective = 'calmar' and om <= 0 then 'OOS Calmar <= 0' end, case when objective = 'total_return' and om <= 0 then 'OOS metric <= 0' end,
 case when ratio < 0.7 then 'OOS/IS ratio < 0.7' end, case when fallback then 'selection_constraints_fallback requires explicit acceptance opt-in' end, case when not (im > 0 and om > 0) then 'OOS/IS ratio diagnostic only' end), ''), 'accepted') as reasons from ch"""
)
def wfa_accepted(spark, d):
    return chosen(spark, d).select("window_id", "combo_id", "objective", "accepted", "fallback", F.array_join("reasons", "; ").alias("reasons"))


@query(
    f"""with {{EB}}, {WFA.replace("avg(p) as ret from h group by all", "avg(p) as ret, avg(hd) as gross, avg(abs(o - hd)) as tu from h group by all").replace("* r as p from g", "* r as p, coalesce(lag(o) over (partition by window_id, part, combo_id, asset order by ts), 0)::double as hd from g").replace("as active_bars, arg_max", "as active_bars, count(*) filter (tu > 1e-12) as ar, avg((gross > 1e-12)::int) as er, arg_max")},
v as (select window_id, combo_id, ar, er, active_bars, slow as lb, concat_ws(',', case when ar < 2 then 'is_active_rebalances_below_2' end, case when er < 0.5 then 'is_exposure_ratio_below_0.5' end, case when active_bars < 4 then 'is_nonzero_return_days_below_4' end, case when slow / n::double > 0.35 then 'lookback_fraction_above_0.35' end) as why from sc where part = 'train')
select window_id, combo_id, ar as active_rebalances, round(er, 6) as exposure_ratio, active_bars, why = '' as viable, coalesce(nullif(why, ''), 'meets_selection_constraints') as viability, max((why = '')::int) over (partition by window_id) = 0 as fallback,
 case when max((why = '')::int) over (partition by window_id) = 0 then count(*) over (partition by window_id) else count(*) filter (why = '') over (partition by window_id) end as pool_count from v"""
)
def wfa_viability(spark, d):
    rows = scores(spark, d).where("part = 'train'").withColumn("max_lookback", F.greatest("fast", "slow"))
    out = wfa.viability(rows, wfa.Constraints(min_active_rebalances=2, min_exposure_ratio=0.5, min_nonzero_days=4, max_lookback_fraction=0.35))
    out = out.select("window_id", "combo_id", "active_rebalances", "exposure_ratio", "active_bars", "viable", F.array_join("viability", ",").alias("viability"), "fallback", "pool_count")
    return rounded(out, "exposure_ratio")


@query(
    f"""with {{EB}}, {CHOSEN}, mg as (select combo_id, avg(is_sharpe) as is_sharpe, avg(oos_sharpe) as oos_sharpe, stddev_pop(oos_sharpe) as oos_std, avg(oos_calmar) as oos_calmar, min(oos_max_drawdown) as mdd from ch group by combo_id),
mr as (select *, case when is_sharpe > 0 and oos_sharpe > 0 then oos_sharpe / is_sharpe end as ratio from mg)
select combo_id, round(oos_sharpe, 6) as oos_sharpe, round(ratio, 6) as oos_is_ratio, round(oos_sharpe + coalesce(ratio, 0) - 0.25 * oos_std - 0.25 * abs(least(mdd, 0)), 6) as robust_score,
concat_ws(',', case when oos_sharpe <= 0 then 'oos_sharpe_not_positive' end, case when ratio < 0.7 then 'oos_is_ratio_below_threshold' end, case when oos_calmar <= 0 then 'oos_calmar_not_positive' end, case when mdd < -0.9 then 'max_drawdown_floor_breached' end) as reasons from mr"""
)
def wfa_gates(spark, d):
    rows = wfa.select(scores(spark, d), least_active=0.2)
    means = rows.groupBy("combo_id").agg(
        F.avg("is_sharpe").alias("is_sharpe"), F.avg("oos_sharpe").alias("oos_sharpe"), F.stddev_pop("oos_sharpe").alias("oos_std"), F.avg("oos_calmar").alias("oos_calmar"), F.min("oos_max_drawdown").alias("max_drawdown")
    )
    out = wfa.gated(means, max_drawdown_floor=-0.9).withColumn("reasons", F.array_join("reasons", ","))
    return rounded(out.select("combo_id", "oos_sharpe", "oos_is_ratio", "robust_score", "reasons"), "oos_sharpe", "oos_is_ratio", "robust_score")


@query(f"with {{EB}}, {CHOSEN} select combo_id, fast::bigint as fast, slow::bigint as slow, round(avg(oos_sharpe), 6) as mean_score, count(distinct window_id) as windows, round(avg(oos_total_return), 6) as mean_return from ch group by all order by avg(oos_sharpe) desc, combo_id limit 20")
def wfa_ranking_report(spark, d):
    return rounded(wfa.ranking_report(chosen(spark, d)), "mean_score", "mean_return")


@query(f"with {{EB}}, {CHOSEN} select window_id, round(avg(is_sharpe), 6) as is_sharpe, round(avg(oos_sharpe), 6) as oos_sharpe, round(avg(oos_total_return), 6) as oos_total_return, count(*) filter ({OK}) as accepted, min(objective) as first_objective, arg_min(combo_id, objective) as first_combo_id, round(arg_min(oos_sharpe, objective), 6) as first_oos_sharpe from ch group by window_id")
def wfa_timeline(spark, d):
    return rounded(wfa.timeline(chosen(spark, d)), "is_sharpe", "oos_sharpe", "oos_total_return", "first_oos_sharpe")


@query(f"with {{OB}}, {{SHIP}}, {PAIRS} select asset, lag, n, round(pearson, 6) as pearson, round(spearman, 6) as spearman, round(xi, 6) as xi from c")
def stats_lagged_correlation_all(spark, d):
    """stats_lagged_correlation under its earlier name."""
    return stats_lagged_correlation(spark, d)


@query(f"with {{OB}}, {{SHIP}}, {PAIRS} select asset, arg_max(lag, row(abs(spearman), -lag)) as spearman_lag, arg_max(lag, row(xi, -lag)) as xi_lag from c group by asset")
def stats_best_lag_all(spark, d):
    return stats_best_lag(spark, d)


@query()
def stats_correlation_p_values(spark, d):
    """Two-sided p-values of both correlations by lag."""
    p = F.pandas_udf(lambda r, n: pd.Series(stats.correlation_p(r.to_numpy(float), n.to_numpy(float))), "double")
    out = lagged(spark, d)
    return rounded(out.select("asset", "lag", p("pearson", "n").alias("pearson_p"), p("spearman", "n").alias("spearman_p")), "pearson_p", "spearman_p")
