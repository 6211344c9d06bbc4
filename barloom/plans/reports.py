"""Queries over metrics, trades, drawdowns and factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import by_time, rnd
from ..operators import factors, metrics, simulate
from ..sources.bars import event_bars, order_bars
from .backtests import COST, LEDGER, LS, SLIP, UPDOWN, _both_sides, sim_sql
from .base import query
from .market import O, full, lag, roll

CURVE = f"c as (select asset, ts, 100 * close / first_value(close) over ({O}) as equity from bars), p as (select *, coalesce(equity / lag(equity) over ({O}) - 1, 0) as ret, max(equity) over ({O} rows between unbounded preceding and current row) as peak, row_number() over ({O}) as i from c), d as (select *, equity / peak - 1 as drawdown from p)"


def curve(spark, d):
    return metrics.buy_and_hold(event_bars(spark, d))


def path(spark, d):
    return metrics.with_path(curve(spark, d))


NUMBERS = ("total_return", "annualized_return", "mean_return", "std", "annualized_std", "downside_risk", "max_drawdown", "recovery_factor", "calmar", "sharpe", "sortino")
SUMMARY = """s as (select asset, count(*) as n, arg_max(equity, ts) / arg_min(equity, ts) - 1 as tr, avg(ret) as m, stddev_samp(ret) as s, coalesce(sqrt(avg(ret * ret) filter (ret < 0)), 0) as dr, min(drawdown) as mdd from d group by asset),
a as (select *, pow(1 + tr, 1 / {years}) - 1 as ar from s)
select asset, n, round(tr, 6) as total_return, round(ar, 6) as annualized_return, round(m, 6) as mean_return, round(s, 6) as std, round(s * sqrt(252), 6) as annualized_std, round(dr, 6) as downside_risk, round(mdd, 6) as max_drawdown,
round(coalesce(tr / nullif(abs(mdd), 0), 0), 6) as recovery_factor, round(coalesce((ar - 0.02::double) / nullif(abs(mdd), 0), 0), 6) as calmar, round((m - 0.02::double / 252) / s * sqrt(252), 6) as sharpe, round((m - 0.02::double / 252) / nullif(dr, 0) * sqrt(252), 6) as sortino from a"""


@query(f"with {{EB}}, {CURVE}, {SUMMARY.format(years='greatest(n / 252.0::double, 1)')}")
def metrics_summary(spark, d):
    out = metrics.summary(path(spark, d), rf=0.02)
    return out.select("asset", "n", *[rnd(F.col(c)).alias(c) for c in NUMBERS])


@query(f"with {{OB}}, {CURVE}, {SUMMARY.format(years='(n / 252.0::double)')}")
def metrics_summary_calculator(spark, d):
    out = metrics.summary(metrics.with_path(metrics.buy_and_hold(order_bars(spark, d))), rf=0.02, least_one_year=False)
    return out.select("asset", "n", *[rnd(F.col(c)).alias(c) for c in NUMBERS])


@query(f"with {{EB}}, {CURVE} select asset, ts, round(ret, 6) as ret, round(peak, 6) as peak, round(drawdown, 6) as drawdown from d")
def metrics_drawdown_path(spark, d):
    return path(spark, d).select("asset", "ts", *[rnd(F.col(c)).alias(c) for c in ("ret", "peak", "drawdown")])


@query(f"with {{EB}}, {CURVE} select asset, round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) as wfa_sharpe from d where i > 1 group by asset")
def metrics_walk_forward_sharpe(spark, d):
    return metrics.walk_forward_sharpe(path(spark, d)).withColumn("wfa_sharpe", rnd(F.col("wfa_sharpe")))


@query(
    f"""with {{EB}}, {CURVE}, b as (select ts, avg(ret) as bench_ret from d where i > 1 group by ts), j as (select d.*, bench_ret from d join b using (ts) where i > 1)
select asset, round(avg(ret - bench_ret) / stddev_samp(ret - bench_ret), 6) as information_ratio, round(covar_samp(ret, bench_ret) / var_samp(bench_ret), 6) as beta, round(avg(ret) - covar_samp(ret, bench_ret) / var_samp(bench_ret) * avg(bench_ret), 6) as alpha, round(corr(ret, bench_ret), 6) as correlation from j group by asset"""
)
def metrics_benchmark(spark, d):
    p = path(spark, d)
    bench = p.where("i > 1").groupBy("ts").agg(F.avg("ret").alias("bench_ret"))
    out = metrics.against_benchmark(p, bench)
    return out.select("asset", *[rnd(F.col(c)).alias(c) for c in ("information_ratio", "beta", "alpha", "correlation")])


@query(
    f"""with {{EB}}, {CURVE}, q as (select asset, quantile_cont(ret, 0.05) as v95, quantile_cont(ret, 0.01) as v99, skewness(ret) as skew, kurtosis(ret) as kurt, max(ret) as best, min(ret) as worst from d group by asset)
select q.asset, round(v95, 6) as var95, round(v99, 6) as var99, round(avg(ret) filter (ret <= v95), 6) as cvar95, round(avg(ret) filter (ret <= v99), 6) as cvar99, round(best, 6) as best, round(worst, 6) as worst, round(skew, 6) as skew, round(kurt, 6) as kurtosis
from q join d using (asset) group by all"""
)
def metrics_tail_risk(spark, d):
    out = metrics.tail_risk(path(spark, d))
    return out.select("asset", *[rnd(F.col(c)).alias(c) for c in ("var95", "var99", "cvar95", "cvar99", "best", "worst", "skew", "kurtosis")])


RUNS = f"f as (select *, drawdown < 0 as flag from d), g as (select *, coalesce((flag <> lag(flag) over ({O}))::int, 0) as turn from f), r as (select *, sum(turn) over ({O} rows between unbounded preceding and current row) as island from g)"


@query(
    f"""with {{EB}}, {CURVE}, {RUNS}, e as (select asset, island, min(drawdown) as low, count(*) as k, max(ts) - min(ts) as days from r where flag group by asset, island),
a as (select asset, avg(low) as a, max(k) as k, max(days) as days from e group by asset) select asset, round(coalesce(a, 0), 6) as average_drawdown, coalesce(k, 0)::bigint as longest_periods, coalesce(days, 0)::int as longest_days from (select distinct asset from d) left join a using (asset)"""
)
def metrics_drawdown_stats(spark, d):
    return metrics.drawdown_stats(path(spark, d)).withColumn("average_drawdown", rnd(F.col("average_drawdown")))


@query(
    f"""with {{OB}}, {CURVE}, e as (select *, sum((equity >= peak)::int) over ({O} rows between unbounded preceding and current row) as episode from d),
g as (select asset, episode, min(ts) as peak_ts, arg_min(ts, row(drawdown, ts)) as trough_ts, min(drawdown) as depth from e group by asset, episode), l as (select *, lead(peak_ts) over (partition by asset order by episode) as recovery_ts from g)
select asset, peak_ts, trough_ts, recovery_ts, round(depth, 6) as depth, (recovery_ts - trough_ts)::int as recovery_days from l where depth < 0"""
)
def metrics_drawdown_episodes(spark, d):
    out = metrics.drawdown_episodes(metrics.with_path(metrics.buy_and_hold(order_bars(spark, d))))
    return out.withColumn("depth", rnd(F.col("depth")))


@query(
    f"""with {{OB}}, {CURVE}, e as (select *, sum((equity >= peak)::int) over ({O} rows between unbounded preceding and current row) as episode from d),
g as (select asset, episode, min(ts) as peak_ts, arg_min(ts, row(drawdown, ts)) as trough_ts, min(drawdown) as depth from e group by asset, episode), l as (select *, lead(peak_ts) over (partition by asset order by episode) - trough_ts as days from g)
select asset, quantile_cont(days::double, 0.5) as p50, quantile_cont(days::double, 0.75) as p75, round(quantile_cont(days::double, 0.9), 6) as p90 from l where depth < 0 and days is not null group by asset"""
)
def metrics_recovery_percentiles(spark, d):
    eps = metrics.drawdown_episodes(metrics.with_path(metrics.buy_and_hold(order_bars(spark, d))))
    return metrics.recovery_percentiles(eps).withColumn("p90", rnd(F.col("p90")))


@query(
    f"""with {{EB}}, {CURVE}, f as (select *, ret > 0 as up, ret < 0 as low from d where i > 1), g as (select *, row_number() over ({O}) - row_number() over (partition by asset, up order by ts) as iu, row_number() over ({O}) - row_number() over (partition by asset, low order by ts) as il from f),
u as (select asset, max(k) as wins from (select asset, iu, count(*) as k from g where up group by asset, iu) group by asset), l as (select asset, max(k) as losses from (select asset, il, count(*) as k from g where low group by asset, il) group by asset)
select asset, wins, losses from u full join l using (asset)"""
)
def metrics_streaks(spark, d):
    p = path(spark, d).where("i > 1")
    return metrics.longest_run(p, F.col("ret") > 0, "wins").join(metrics.longest_run(p, F.col("ret") < 0, "losses"), "asset")


def _period_sql(unit: str) -> str:
    return f"""with {{OB}}, {CURVE}, g as (select asset, date_trunc('{unit}', ts)::date as period, arg_max(equity, ts) as last, arg_min(equity, ts) as first, count(*) as k from c group by 1, 2),
b as (select asset, min(period) as a, max(period) as z from g group by asset), s as (select asset, unnest(generate_series(a, z, interval 1 {unit}))::date as period from b),
f as (select s.asset, s.period, k, first, last_value(last ignore nulls) over (partition by s.asset order by s.period rows between unbounded preceding and current row) as last, row_number() over (partition by s.asset order by s.period) as i from s left join g on g.asset = s.asset and g.period = s.period),
r as (select *, last / case when i = 1 then (case when k >= 2 then first end) else lag(last) over (partition by asset order by period) end - 1 as ret from f) select asset, period, round(ret, 6) as ret from r where ret is not null"""


@query(_period_sql("month"))
def metrics_monthly_returns(spark, d):
    return metrics.period_returns(metrics.buy_and_hold(order_bars(spark, d)), "month").withColumn("ret", rnd(F.col("ret")))


@query(
    f"""with {{EB}}, {CURVE}, s as (select asset, avg(drawdown) as ad, avg((ret > 0)::int) filter (i > 1 and ret <> 0) as wr, coalesce(sum(ret) filter (i > 1 and ret > 0), 0) as gp, coalesce(sum(ret) filter (i > 1 and ret < 0), 0) as gl,
 abs(avg(ret) filter (i > 1 and ret > 0) / avg(ret) filter (i > 1 and ret < 0)) as glr, arg_max(equity, ts) / arg_min(equity, ts) - 1 as m from d group by asset)
select asset, round(ad, 6) as average_drawdown, round(wr, 6) as win_rate, round(gp, 6) as gross_profit, round(gl, 6) as gross_loss, round(glr, 6) as gain_loss_ratio, round(gp / abs(gl), 6) as profit_factor,
round(m, 6) as best_month, round(m, 6) as worst_month, (m > 0)::int::double as positive_month_ratio from s"""
)
def metrics_page(spark, d):
    """The events span one month, so its return is best and worst at once."""
    out = metrics.page_metrics(path(spark, d))
    return out.withColumns({c: rnd(F.col(c)) for c in out.columns if c != "asset"})


@query(_period_sql("year"))
def metrics_yearly_returns(spark, d):
    return metrics.period_returns(metrics.buy_and_hold(order_bars(spark, d)), "year").withColumn("ret", rnd(F.col("ret")))


ACF = f"""v as (select *, ret - avg(ret) over (partition by asset) as dv from d), k as (select unnest(range(1, 11)) as lag),
x as (select a.asset, k.lag, sum(a.dv * b.dv) as s from v a join k on true join v b on b.asset = a.asset and b.i = a.i - k.lag group by all), t as (select asset, sum(dv * dv) as v, count(*) as n from v group by asset)
select x.asset, x.lag::int as lag, round(s / v, 6) as acf, abs(s / v) > 1.96 / sqrt(n) as significant from x join t using (asset)"""


@query(f"with {{EB}}, {CURVE}, {ACF}")
def stats_autocorrelation(spark, d):
    return metrics.autocorrelation(path(spark, d), "ret", 10).withColumn("acf", rnd(F.col("acf")))


SIM = f"{UPDOWN}, {sim_sql('close', *LS, 0, 'ex = -position')}, {LEDGER.partition('select asset, ts, (case')[0]}"
TRADES = f"""{SIM} , led as (select asset, ts, action, case when act then seq else 0 end as trade_seq, op, hc, case when action = 4 then (case when pp > 0 then 1 else -1 end) * (price / op - 1) end as tr from t),
tt as (select asset, trade_seq::bigint as trade_seq, min(ts) as entry_ts, max(ts) filter (action = 4) as exit_ts, min(op) as entry_price, max(hc)::bigint as held, max(tr) as trade_return from led where trade_seq > 0 group by asset, trade_seq)"""


def trades(spark, d):
    led = simulate.ledger(simulate.simulate(_both_sides(spark, d), simulate.Rules(cost=COST, slippage=SLIP)))
    return metrics.trade_summary(led)


@query(f"with recursive {{EB}}, {TRADES} select asset, trade_seq, entry_ts, exit_ts, entry_price, held, round(trade_return, 6) as trade_return from tt")
def trades_summary(spark, d):
    return trades(spark, d).withColumn("trade_return", rnd(F.col("trade_return")))


@query(
    f"""with recursive {{EB}}, {TRADES}, s as (select asset, count(*) as trade_count, count(*) filter (trade_return > 1e-12) as wins, count(*) filter (trade_return < -1e-12) as losses, count(*) filter (abs(trade_return) <= 1e-12) as breakeven, avg(trade_return) as ar,
sum(trade_return) filter (trade_return > 0) as g, sum(trade_return) filter (trade_return < 0) as l, count(trade_return) as n from tt group by asset),
q as (select asset, exit_ts, trade_return < -1e-12 as lose, row_number() over (partition by asset order by exit_ts) - row_number() over (partition by asset, trade_return < -1e-12 order by exit_ts) as isl from tt where trade_return is not null),
m as (select asset, max(k) as k from (select asset, isl, count(*) as k from q where lose group by asset, isl) group by asset)
select asset, trade_count, wins, losses, breakeven, round(ar, 6) as avg_return, round(wins / nullif(n, 0)::double, 6) as win_rate, round(g / abs(l), 6) as profit_factor, coalesce(k, 0)::bigint as max_losses from s left join m using (asset)""".replace("q as (select asset, exit_ts", "qq as (select asset, exit_ts").replace("from q where lose", "from qq where lose").replace(", s as (select asset, count", ", ss as (select asset, count").replace("from s left join m", "from ss left join m")
)
def trades_statistics(spark, d):
    out = metrics.trade_statistics(trades(spark, d))
    return out.select("asset", "trade_count", "wins", "losses", "breakeven", *[rnd(F.col(c)).alias(c) for c in ("avg_return", "win_rate", "profit_factor")], "max_losses")


@query(
    f"""with {{EB}}, {CURVE}, s as (select least(greatest(ceil(sqrt(count(*))), 5), 40)::int as k, min(ret) as a, max(ret) as z from d), b as (select unnest(range(0, k)) as bin, a, (z - a) / k as w, k from s),
n as (select least(floor((ret - a) / ((z - a) / k)), k - 1)::int as bin, count(*) as c from d, s group by 1) select b.bin::int as bin, round(a + bin * w, 6) as low, round(a + (bin + 1) * w, 6) as high, coalesce(c, 0) as count from b left join n using (bin)"""
)
def report_return_histogram(spark, d):
    out = metrics.histogram(path(spark, d), "ret")
    return out.select("bin", rnd(F.col("low")).alias("low"), rnd(F.col("high")).alias("high"), "count")


@query("with {EB}, s as (select min(n) as a, greatest(ceil((max(n) - min(n) + 1) / 20.0), 1)::bigint as w from bars) select (a + (n - a) // w * w)::bigint as low, count(*) as count from bars, s group by 1")
def report_integer_histogram(spark, d):
    return metrics.integer_histogram(event_bars(spark, d), "n")


@query(
    f"""with {{EB}}, r as (select *, row_number() over (partition by asset order by close, ts) as i, count(*) over (partition by asset) as k, sum(close) over (partition by asset) as t, sum(close) over (partition by asset order by close, ts rows between unbounded preceding and current row) as s from bars where close > 0)
select asset, round(1 - 2 * sum((2 * s - close) / (2 * t * k)), 6) as gini, round(sum(close / t) filter (i > k - greatest(ceil(k * 0.2), 1)), 6) as top20_share from r group by asset"""
)
def report_concentration(spark, d):
    out = metrics.gini(event_bars(spark, d), "close")
    return out.select("asset", rnd(F.col("gini")).alias("gini"), rnd(F.col("top20_share")).alias("top20_share"))


@query(f"with {{EB}}, {CURVE}, m as (select min(n) as n from (select max(i) as n from d group by asset)) select i::int as pos, round(avg(equity), 6) as equity from d, m where i <= m.n group by i")
def report_mean_curve(spark, d):
    return metrics.mean_curve(curve(spark, d)).select(F.col("pos").cast("int").alias("pos"), rnd(F.col("equity")).alias("equity"))


# Factors: market value and book value stand in as volume and n

FACTORS = f"""h as (select *, close / nullif({lag('close')}, 0) - 1 as ret from bars), f as (select *, close / nullif({lag('close', 3)}, 0) - 1 as mom, {lag('close', 1)} / nullif({lag('close', 4)}, 0) - 1 as mom_skip,
{full(5, 'ret', roll(5, 'stddev_samp(ret)'))} * sqrt(252) as vol, n / nullif(volume, 0) as btm from h)"""


def factor_frame(spark, d):
    from ..operators.indicators import with_helpers

    rows, c = with_helpers(event_bars(spark, d)), F.col("close")
    return rows.withColumns({
        "mom": factors.price_momentum(c, 3), "mom_skip": factors.price_momentum(c, 3, 1), "vol": factors.realized_volatility(F.col("ret"), 5),
        "btm": factors.ratio(F.col("n").cast("double"), F.col("volume")),
    })


@query(f"with {{EB}}, {FACTORS} select asset, ts, round(mom, 6) as mom, round(mom_skip, 6) as mom_skip, round(vol, 6) as vol, round(btm, 6) as btm from f")
def factor_raw(spark, d):
    return factor_frame(spark, d).select("asset", "ts", *[rnd(F.col(c)).alias(c) for c in ("mom", "mom_skip", "vol", "btm")])


@query(
    f"""with {{EB}}, {FACTORS}, w as (select *, coalesce(mom, median(mom) over (partition by ts)) as filled, greatest(least(mom, quantile_cont(mom, 0.9) over (partition by ts)), quantile_cont(mom, 0.1) over (partition by ts)) as wins,
(mom - avg(mom) over (partition by ts)) / nullif(stddev_samp(mom) over (partition by ts), 0) as z, case when asset in ('click', 'view') then 'a' when asset = 'error' then null else 'b' end as grp from f)
select asset, ts, round(filled, 6) as filled, case when mom is not null then round(wins, 6) end as wins, round(z, 6) as z, round(case when grp is null then mom else mom - avg(mom) over (partition by ts, grp) end, 6) as neutral,
case when mom is not null then round((rank() over (partition by ts, mom is null order by mom) + (count(*) over (partition by ts, mom) - 1) / 2.0::double) / count(*) over (partition by ts, mom is null), 6) end as pct from w"""
)
def factor_clean(spark, d):
    mom = F.col("mom")
    grp = F.when(F.col("asset").isin("click", "view"), "a").when(F.col("asset") == "error", F.lit(None)).otherwise("b")
    rows = factor_frame(spark, d).withColumn("grp", grp)
    return rows.select(
        "asset", "ts", rnd(factors.fill_missing(mom)).alias("filled"), rnd(factors.winsorize(mom, 0.1, 0.9)).alias("wins"), rnd(factors.standardize(mom)).alias("z"),
        rnd(factors.neutralize(mom, F.col("grp"))).alias("neutral"), rnd(factors.percentile_rank(mom)).alias("pct"),
    )


@query(f"with {{EB}}, {FACTORS} select asset, ts, round(case when mom is not null or vol is not null then coalesce(mom, 0) * 0.75::double - coalesce(vol, 0) * 0.25::double end, 6) as manual, round(case when mom is not null or vol is not null then (coalesce(mom, 0) + coalesce(vol, 0)) / 2 end, 6) as equal from f")
def factor_composite(spark, d):
    return factor_frame(spark, d).select(
        "asset", "ts", rnd(factors.combine("manual_weight", ["mom", "vol"], {"mom": 3.0, "vol": -1.0})).alias("manual"), rnd(factors.combine("equal_weight", ["mom", "vol"])).alias("equal")
    )


@query(f"with {{EB}}, {FACTORS} select 'mom' as factor, count(*) as rows, round(avg((mom is null)::int), 6) as missing_ratio from f union all select 'vol', count(*), round(avg((vol is null)::int), 6) from f")
def factor_coverage(spark, d):
    return factors.coverage(factor_frame(spark, d), ["mom", "vol"]).withColumn("missing_ratio", rnd(F.col("missing_ratio")))


RANKED = "(rank() over (partition by ts order by {0}) + (count(*) over (partition by ts, {0}) - 1) / 2.0::double)"


@query(
    f"""with {{EB}}, {FACTORS}, g as (select *, lead(close) over ({O}) / close - 1 as fwd from f), r as (select *, {RANKED.format('mom')} as rs, {RANKED.format('fwd')} as rf from g where mom is not null and fwd is not null)
select ts, count(*) as n, round(corr(mom, fwd), 6) as ic, round(corr(rs, rf), 6) as rank_ic from r group by ts having count(*) >= 2"""
)
def factor_information_coefficient(spark, d):
    out = factors.information_coefficient(factor_frame(spark, d), "mom")
    return out.select("ts", "n", rnd(F.col("ic")).alias("ic"), rnd(F.col("rank_ic")).alias("rank_ic"))


@query("with {EB} select asset, ts, ts + 1 as known_at from bars where n > 70")
def factor_point_in_time(spark, d):
    rows = event_bars(spark, d).withColumn("known_at", F.when(F.col("n") > 70, F.date_add("ts", 1)).otherwise(F.col("ts")))
    return factors.known_later(rows).select("asset", "ts", "known_at")
