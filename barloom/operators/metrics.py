"""Performance metrics of equity curves (keys, ts, equity): windows for paths, one aggregate per key for numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div, safe_power, upto

KEYS = ("asset",)


def with_path(curve: DataFrame, keys=KEYS) -> DataFrame:
    """Add ret (0 on the first row), peak, drawdown and the row number."""
    w = by_time(*keys)
    rows = curve.withColumns({
        "ret": F.coalesce(div(F.col("equity"), F.lag("equity").over(w)) - 1, F.lit(0.0)), "peak": F.max("equity").over(upto(*keys)), "i": F.row_number().over(w),
    })
    return rows.withColumn("drawdown", div(F.col("equity"), F.col("peak")) - 1)


def buy_and_hold(panel: DataFrame, keys=KEYS, start: float = 100.0) -> DataFrame:
    """equity = start * close / first close."""
    first = F.first("close").over(by_time(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return panel.select(*keys, "ts", (start * div(F.col("close"), first)).alias("equity"))


def summary(path: DataFrame, time_unit: int = 252, rf: float = 0.0, keys=KEYS, least_one_year: bool = True) -> DataFrame:
    """One row per key. Years are n / time_unit, at least one year unless least_one_year is off (the other
    convention); the first row's zero return counts."""
    agg = path.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("equity", "ts").alias("_a"), F.max_by("equity", "ts").alias("_z"), F.avg("ret").alias("mean_return"),
        F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("std"),
        F.coalesce(F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")))), F.lit(0.0)).alias("downside_risk"), F.min("drawdown").alias("max_drawdown"),
    )
    years = F.col("n") / time_unit
    years = F.greatest(years, F.lit(1.0)) if least_one_year else years
    tr, mdd, root = F.col("total_return"), F.abs("max_drawdown"), math.sqrt(time_unit)
    excess = F.col("mean_return") - rf / time_unit
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = agg.withColumn("total_return", div(F.col("_z"), F.col("_a")) - 1)
    out = out.withColumn("annualized_return", F.when(1 + tr > 0, safe_power(1 + tr, 1 / years) - 1).otherwise(F.lit(-1.0)))
    return out.withColumns({
        "annualized_std": F.col("std") * root, "recovery_factor": zero(div(tr, F.nullif(mdd, F.lit(0.0)))),
        "calmar": zero(div(F.col("annualized_return") - rf, F.nullif(mdd, F.lit(0.0)))), "sharpe": zero(div(excess, F.nullif(F.col("std"), F.lit(0.0))) * root),
        "sortino": zero(div(excess, F.nullif(F.col("downside_risk"), F.lit(0.0))) * root),
    }).drop("_a", "_z")


def walk_forward_sharpe(path: DataFrame, keys=KEYS) -> DataFrame:
    """The other Sharpe: population deviation, 252 bars, no risk-free rate, first return dropped."""
    r = path.where("i > 1").groupBy(*keys).agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"))
    return r.select(*keys, F.coalesce(div(F.col("m"), F.nullif(F.col("s"), F.lit(0.0))) * math.sqrt(252), F.lit(0.0)).alias("wfa_sharpe"))


def against_benchmark(path: DataFrame, benchmark: DataFrame, time_unit: int = 252, rf: float = 0.0, keys=KEYS) -> DataFrame:
    """information_ratio (per period), beta, alpha (per period) and correlation against (ts, bench_ret)."""
    both = path.where("i > 1").join(benchmark.where("bench_ret is not null"), "ts")
    d = F.col("ret") - F.col("bench_ret")
    agg = both.groupBy(*keys).agg(
        F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"), F.covar_samp("ret", "bench_ret").alias("_c"), F.var_samp("bench_ret").alias("_v"),
        F.avg("ret").alias("_r"), F.avg("bench_ret").alias("_b"), F.corr("ret", "bench_ret").alias("correlation"), F.count("*").alias("n"),
    )
    agg = agg.withColumns({"information_ratio": div(F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))), "beta": div(F.col("_c"), F.nullif(F.col("_v"), F.lit(0.0)))})
    f = rf / time_unit
    return agg.select(*keys, "information_ratio", "beta", (F.col("_r") - (f + F.col("beta") * (F.col("_b") - f))).alias("alpha"), F.when(F.col("n") >= 3, F.col("correlation")).alias("correlation"))


def tail_risk(path: DataFrame, keys=KEYS) -> DataFrame:
    """var/cvar at 95 and 99 %, bias-corrected skewness and excess kurtosis, best and worst return."""
    q = path.groupBy(*keys).agg(
        F.percentile("ret", F.lit(0.05)).alias("var95"), F.percentile("ret", F.lit(0.01)).alias("var99"), F.skewness("ret").alias("_g"), F.kurtosis("ret").alias("_k"),
        F.count("*").cast("double").alias("_n"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
    )
    cut = path.join(q.select(*keys, "var95", "var99"), list(keys)).groupBy(*keys).agg(
        F.avg(F.when(F.col("ret") <= F.col("var95"), F.col("ret"))).alias("cvar95"), F.avg(F.when(F.col("ret") <= F.col("var99"), F.col("ret"))).alias("cvar99")
    )
    n = F.col("_n")
    return q.join(cut, list(keys)).select(
        *keys, "var95", "var99", "cvar95", "cvar99", "best", "worst", (F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_k") + 6)).alias("kurtosis"),
    )


def page_metrics(path: DataFrame, keys=KEYS) -> DataFrame:
    """Per key: average drawdown over all bars, win rate among bars with a return, gross profit and loss, profit
    factor, gain-loss ratio, and best, worst and share of positive months. path has ts, equity, ret, drawdown, i."""
    r, later = F.col("ret"), F.col("i") > 1
    up, down = F.when(later & (r > 0), r), F.when(later & (r < 0), r)
    bars = path.groupBy(*keys).agg(
        F.avg("drawdown").alias("average_drawdown"), F.avg(F.when(later & (r != 0), (r > 0).cast("double"))).alias("win_rate"),
        F.coalesce(F.sum(up), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.sum(down), F.lit(0.0)).alias("gross_loss"), F.abs(div(F.avg(up), F.avg(down))).alias("gain_loss_ratio"),
    )
    lost = F.abs("gross_loss")
    bars = bars.withColumn("profit_factor", F.when(lost > 0, F.col("gross_profit") / lost).when(F.col("gross_profit") == 0, 0.0))
    months = period_returns(path, "month", keys).groupBy(*keys).agg(
        F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_month_ratio")
    )
    return bars.join(months, list(keys), "left")


def islands(path: DataFrame, cond, keys=KEYS) -> DataFrame:
    """Number runs of rows on which cond has one value: adds flag and island (same for all rows of a run)."""
    rows = path.withColumn("flag", cond)
    turn = F.coalesce((F.col("flag") != F.lag("flag").over(by_time(*keys))).cast("int"), F.lit(0))
    return rows.withColumn("_turn", turn).withColumn("island", F.sum("_turn").over(upto(*keys))).drop("_turn")


def longest_run(path: DataFrame, cond, name: str, keys=KEYS) -> DataFrame:
    runs = islands(path, cond, keys).where("flag").groupBy(*keys, "island").agg(F.count("*").alias("k"))
    every = path.select(*keys).distinct()
    return every.join(runs.groupBy(*keys).agg(F.max("k").alias(name)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def drawdown_stats(path: DataFrame, keys=KEYS) -> DataFrame:
    """average_drawdown (mean of the episodes' minima, an open one included), longest episode in rows and in days."""
    eps = islands(path, F.col("drawdown") < 0, keys).where("flag").groupBy(*keys, "island").agg(
        F.min("drawdown").alias("low"), F.count("*").alias("k"), F.datediff(F.max("ts"), F.min("ts")).alias("days")
    )
    agg = eps.groupBy(*keys).agg(F.avg("low").alias("average_drawdown"), F.max("k").alias("longest_periods"), F.max("days").alias("longest_days"))
    every = path.select(*keys).distinct().join(agg, list(keys), "left")
    return every.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("average_drawdown", "longest_periods", "longest_days")])


def drawdown_episodes(path: DataFrame, keys=KEYS) -> DataFrame:
    """One row per fall below a peak: peak_ts, trough_ts, recovery_ts (NULL if open), depth, recovery_days."""
    rows = path.withColumn("_new", (F.col("equity") >= F.col("peak")).cast("int"))
    rows = rows.withColumn("episode", F.sum("_new").over(upto(*keys)))
    eps = rows.groupBy(*keys, "episode").agg(
        F.min("ts").alias("peak_ts"), F.min_by("ts", F.struct("drawdown", "ts")).alias("trough_ts"), F.min("drawdown").alias("depth")
    )
    eps = eps.withColumn("recovery_ts", F.lead("peak_ts").over(Window.partitionBy(*keys).orderBy("episode"))).where("depth < 0")
    return eps.select(*keys, "peak_ts", "trough_ts", "recovery_ts", "depth", F.datediff("recovery_ts", "trough_ts").alias("recovery_days"))


def recovery_percentiles(episodes: DataFrame, keys=KEYS) -> DataFrame:
    q = episodes.where("recovery_days is not null").groupBy(*keys).agg(F.percentile("recovery_days", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p75"), F.col("q")[2].alias("p90"))


def period_returns(curve: DataFrame, unit: str, keys=KEYS) -> DataFrame:
    """Return per calendar period with gaps carried forward; the first period is measured from its own first
    value and left out if it has one row only."""
    p = F.trunc("ts", unit)
    per = curve.groupBy(*keys, p.alias("period")).agg(F.max_by("equity", "ts").alias("last"), F.min_by("equity", "ts").alias("first"), F.count("*").alias("k"))
    step = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
    spine = per.groupBy(*keys).agg(F.explode(F.sequence(F.min("period"), F.max("period"), F.expr(step))).alias("period"))
    w = Window.partitionBy(*keys).orderBy("period")
    rows = spine.join(per, [*keys, "period"], "left")
    rows = rows.withColumn("last", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_prev": F.lag("last").over(w), "_i": F.row_number().over(w)})
    base = F.when(F.col("_i") == 1, F.when(F.col("k") >= 2, F.col("first"))).otherwise(F.col("_prev"))
    return rows.withColumn("ret", div(F.col("last"), base) - 1).where("ret is not null").select(*keys, "period", "ret")


def autocorrelation(rows: DataFrame, x: str, lags: int, keys=KEYS, adjusted: bool = False) -> DataFrame:
    """(keys, lag, acf, significant): sum of lagged products of deviations over their squares; band 1.96/sqrt(n).
    ``adjusted`` divides each sum by its own number of pairs, as partial autocorrelations want it."""
    w, whole = by_time(*keys), Window.partitionBy(*keys)
    d = rows.withColumn("_d", F.col(x) - F.avg(x).over(whole))
    pairs = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    agg = pairs.groupBy(*keys).agg(
        F.count("_d").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)]
    )
    long = agg.select(*keys, "n", "_v", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(1, lags + 1)])).alias("e"))
    acf = div(F.col("e.s"), F.nullif(F.col("_v"), F.lit(0.0)))
    acf = div(acf * F.col("n"), F.col("n") - F.col("e.lag")) if adjusted else acf
    return long.select(*keys, F.col("e.lag").alias("lag"), acf.alias("acf"), (F.abs(acf) > 1.96 / F.sqrt("n")).alias("significant"))


def trade_summary(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """One row per trade: entry and exit time and price, type, held bars, return (NULL while open)."""
    return ledger.where("trade_seq > 0").groupBy(*keys, "trade_seq").agg(
        F.min("ts").alias("entry_ts"), F.max(F.when(F.col("action") == 4, F.col("ts"))).alias("exit_ts"), F.min("trade_open_price").alias("entry_price"),
        F.max("holding_count").alias("held"), F.max("trade_return").alias("trade_return"),
    )


def trade_statistics(trades: DataFrame, keys=KEYS) -> DataFrame:
    """Outcomes with a band of 1e-12 around zero: counts, win_rate, profit_factor, averages, longest losing streak."""
    e, r = 1e-12, F.col("trade_return")
    closed = trades.where("trade_return is not null")
    agg = trades.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.count_if(r > e).alias("wins"), F.count_if(r < -e).alias("losses"), F.count_if(F.abs(r) <= e).alias("breakeven"),
        F.avg(r).alias("avg_return"), F.sum(F.when(r > 0, r)).alias("_g"), F.sum(F.when(r < 0, r)).alias("_l"), F.count(r).alias("_n"),
    )
    out = agg.select(
        *keys, "trade_count", "wins", "losses", "breakeven", "avg_return", div(F.col("wins").cast("double"), F.col("_n").cast("double")).alias("win_rate"),
        div(F.col("_g"), F.abs("_l")).alias("profit_factor"),
    )
    streak = longest_run(closed.withColumnRenamed("exit_ts", "ts"), r < -e, "max_losses", keys)
    return out.join(streak, list(keys), "left").withColumn("max_losses", F.coalesce("max_losses", F.lit(0)))


def histogram(rows: DataFrame, x: str) -> DataFrame:
    """Equal-width bins, their number the root of n between 5 and 40: (bin, low, high, count), empty bins too."""
    stats = rows.agg(F.count(x).alias("n"), F.min(x).alias("a"), F.max(x).alias("z"))
    stats = stats.withColumn("k", F.least(F.greatest(F.ceil(F.sqrt("n")), F.lit(5)), F.lit(40)).cast("int")).withColumn("w", (F.col("z") - F.col("a")) / F.col("k"))
    place = F.when(F.col("w") > 0, F.least(F.floor((F.col(x) - F.col("a")) / F.col("w")), F.col("k") - 1)).otherwise(0).cast("int")
    counts = rows.where(f"`{x}` is not null").crossJoin(F.broadcast(stats)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))  # one row
    bins = stats.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "a", "w")
    return bins.join(counts, "bin", "left").select(
        "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("count", F.lit(0)).alias("count")
    )


def integer_histogram(rows: DataFrame, x: str, most: int = 20) -> DataFrame:
    """At most ``most`` bins of integer width: (low, count)."""
    stats = rows.agg(F.min(x).alias("a"), F.max(x).alias("z")).withColumn("w", F.greatest(F.ceil((F.col("z") - F.col("a") + 1) / most), F.lit(1)))
    return rows.crossJoin(F.broadcast(stats)).groupBy((F.col("a") + F.floor((F.col(x) - F.col("a")) / F.col("w")) * F.col("w")).cast("long").alias("low")).agg(F.count("*").alias("count"))


def gini(rows: DataFrame, x: str, keys=KEYS) -> DataFrame:
    """Concentration of positive values: gini by the trapezoid area under the Lorenz curve, and the top 20 % share."""
    pos = rows.where(F.col(x) > 0)
    w, whole = Window.partitionBy(*keys).orderBy(x, "ts"), Window.partitionBy(*keys)
    r = pos.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(whole), "_t": F.sum(x).over(whole), "_s": F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    area = (2 * F.col("_s") - F.col(x)) / (2 * F.col("_t") * F.col("_n"))
    top = F.col("_i") > F.col("_n") - F.greatest(F.ceil(F.col("_n") * 0.2), F.lit(1))
    return r.groupBy(*keys).agg((1 - 2 * F.sum(area)).alias("gini"), F.sum(F.when(top, F.col(x) / F.col("_t"))).alias("top20_share"))


def mean_curve(curves: DataFrame, keys=KEYS) -> DataFrame:
    """Mean equity by position over several curves, cut to the shortest."""
    rows = curves.withColumn("pos", F.row_number().over(by_time(*keys)))
    shortest = rows.groupBy(*keys).agg(F.max("pos").alias("n")).agg(F.min("n").alias("n"))
    return rows.crossJoin(F.broadcast(shortest)).where("pos <= n").groupBy("pos").agg(F.avg("equity").alias("equity"))


def exposure(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """exposure_pct: share of bars in a position; max_holding_ratio: longest run in a position over all bars."""
    rows = ledger.withColumn("_in", F.col("position") != 0)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"), (100 * F.avg(F.col("_in").cast("double"))).alias("exposure_pct"))
    run = longest_run(rows, F.col("_in"), "_k", keys)
    return n.join(run, list(keys)).select(*keys, "exposure_pct", (F.col("_k") / F.col("_n")).alias("max_holding_ratio"))
