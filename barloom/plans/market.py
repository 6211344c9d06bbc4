"""Queries over bars: cleaning, indicators, conditions, calendars, joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, rnd, trailing
from ..operators import align, calendar, clean, contract
from ..operators import indicators as ind
from ..operators.conditions import with_mask
from ..sources.bars import event_bars, order_bars, ship_feature
from .base import query

O = "partition by asset order by ts"  # noqa: E741


def roll(n: int, call: str) -> str:
    """SQL: an aggregate over the last n rows of the asset."""
    return f"{call} over ({O} rows between {n - 1} preceding and current row)"


def full(n: int, x: str, value: str) -> str:
    """SQL: value where the last n rows all have x."""
    return f"case when {roll(n, f'count({x})')} >= {n} then {value} end"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({O})"


HELPED = f"h as (select *, {lag('close')} as prev_close, close - {lag('close')} as change, close / nullif({lag('close')}, 0) - 1 as ret from bars)"


@query("with {EB} select asset, ts, open, high, low, close, round(volume, 6) as volume, n from bars")
def bars_events(spark, d):
    return event_bars(spark, d).withColumn("volume", rnd(F.col("volume")))


@query("with {OB} select asset, ts, open, high, low, close, round(volume, 4) as volume, n from bars")
def bars_orders(spark, d):
    return order_bars(spark, d).withColumn("volume", rnd(F.col("volume"), 4))


@query("with {SHIP} select ts, qty, round(disc, 6) as disc from ship")
def source_ship_feature(spark, d):
    return ship_feature(spark, d).withColumn("disc", rnd(F.col("disc")))


# Indicators


@query(f"with {{EB}} select asset, ts, round({full(3, 'close', roll(3, 'avg(close)'))}, 6) as sma3, round({full(5, 'close', roll(5, 'avg(close)'))}, 6) as sma5 from bars")
def indicator_sma(spark, d):
    return event_bars(spark, d).select("asset", "ts", rnd(ind.sma(F.col("close"), 3)).alias("sma3"), rnd(ind.sma(F.col("close"), 5)).alias("sma5"))


@query(f"with {{EB}} select asset, ts, round(close / nullif({lag('close', 3)}, 0) - 1, 6) as momentum3 from bars")
def indicator_momentum(spark, d):
    return event_bars(spark, d).select("asset", "ts", rnd(ind.momentum(F.col("close"), 3)).alias("momentum3"))


@query(f"with {{EB}}, {HELPED} select asset, ts, round({full(5, 'ret', roll(5, 'stddev_samp(ret)'))} * sqrt(252), 6) as vol5 from h")
def indicator_volatility(spark, d):
    return ind.with_helpers(event_bars(spark, d)).select("asset", "ts", rnd(ind.volatility(F.col("close"), 5, returns=F.col("ret"))).alias("vol5"))


@query(f"with {{EB}} select asset, ts, round({full(5, 'close', f'(close - {roll(5, "avg(close)")}) / nullif({roll(5, "stddev_samp(close)")}, 0)')}, 6) as z5 from bars")
def indicator_zscore(spark, d):
    return event_bars(spark, d).select("asset", "ts", rnd(ind.zscore(F.col("close"), 5)).alias("z5"))


@query(f"with {{EB}} select asset, ts, round({full(5, 'close', roll(5, 'quantile_cont(close, 0.75)'))}, 6) as p75 from bars")
def indicator_percentile(spark, d):
    return event_bars(spark, d).select("asset", "ts", rnd(ind.percentile(F.col("close"), 5, 75)).alias("p75"))


@query(
    f"""with {{EB}}, b as (select *, {roll(5, 'avg(close)')} as m, {roll(5, 'stddev_samp(close)')} * 2 as dev, {roll(5, 'count(close)')} as k from bars)
select asset, ts, case when k >= 5 then round(m, 6) end as middle, case when k >= 5 then round(m + dev, 6) end as upper, case when k >= 5 then round(m - dev, 6) end as lower,
case when k >= 5 then round(2 * dev / nullif(m, 0), 6) end as width, case when k >= 5 then round((close - (m - dev)) / nullif(2 * dev, 0), 6) end as percent_b from b"""
)
def indicator_bollinger(spark, d):
    bands = ("middle", "upper", "lower", "width", "percent_b")
    return event_bars(spark, d).select("asset", "ts", *[rnd(ind.bollinger(F.col("close"), 5, 2.0, b)).alias(b) for b in bands])


@query(
    f"""with {{EB}}, {HELPED}, g as (select *, {roll(5, 'avg(greatest(change, 0))')} as gain, {roll(5, 'avg(greatest(-change, 0))')} as loss, {roll(5, 'count(change)')} as k from h)
select asset, ts, case when k >= 5 then round(100 - 100 / (1 + gain / nullif(loss, 0)), 6) end as rsi5 from g"""
)
def indicator_rsi(spark, d):
    return ind.with_helpers(event_bars(spark, d)).select("asset", "ts", rnd(ind.rsi(F.col("change"), 5)).alias("rsi5"))


#: Rows of a block of time in the recursive filters: few, so that the queries run over several blocks.
BLOCK = 40
NUMBERED = f"n as (select *, row_number() over ({O}) as i from bars)"


def ema_cte(name: str, x: str, span: int, source: str = "n") -> str:
    a = 2 / (span + 1)
    return (
        f"{name} as (select asset, ts, i, cast({x} as double) as y from {source} where i = 1 union all "
        f"select n.asset, n.ts, n.i, {a}::double * n.{x} + (1 - {a}::double) * e.y from {name} e join {source} n on n.asset = e.asset and n.i = e.i + 1)"
    )


@query(f"with recursive {{EB}}, {NUMBERED}, {ema_cte('e', 'close', 5)} select asset, ts, case when i >= 5 then round(y, 6) end as ema5 from e")
def indicator_ema(spark, d):
    out = ind.recursive(event_bars(spark, d), {"ema5": {"op": "ema", "period": 5}}, BLOCK)
    return out.select("asset", "ts", rnd(F.col("ema5")).alias("ema5"))


@query(
    f"""with recursive {{EB}}, {NUMBERED}, {ema_cte('f', 'close', 3)}, {ema_cte('s', 'close', 6)},
l as (select asset, ts, f.i, f.i - 5 as j, f.y - s.y as line from f join s using (asset, ts) where f.i >= 6),
g as (select asset, ts, j, line, line as y from l where j = 1 union all
  select l.asset, l.ts, l.j, l.line, 0.4::double * l.line + 0.6::double * g.y from g join l on l.asset = g.asset and l.j = g.j + 1)
select n.asset, n.ts, round(l.line, 6) as macd, case when g.j >= 4 then round(g.y, 6) end as signal, case when g.j >= 4 then round(l.line - g.y, 6) end as histogram
from n left join l using (asset, ts) left join g using (asset, ts)"""
)
def indicator_macd(spark, d):
    spec = {"op": "macd", "fast": 3, "slow": 6, "signal": 4}
    names = {"macd": "line", "signal": "signal", "histogram": "histogram"}
    out = ind.recursive(event_bars(spark, d), {k: {**spec, "output": v} for k, v in names.items()}, BLOCK)
    return out.select("asset", "ts", *[rnd(F.col(k)).alias(k) for k in names])


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@query(
    f"""with recursive {{EB}}, n as (select *, row_number() over ({O}) as i, {TR} as tr from bars),
w as (select asset, 5 as i, avg(tr) as y from n where i <= 5 group by asset having count(*) = 5 union all
  select n.asset, n.i, (w.y * 4 + n.tr) / 5 from w join n on n.asset = w.asset and n.i = w.i + 1)
select n.asset, n.ts, round(w.y, 6) as atr_wilder, round({full(5, 'tr', roll(5, 'avg(tr)'))}, 6) as atr_sma from n left join w using (asset, i)"""
)
def indicator_atr(spark, d):
    out = ind.recursive(event_bars(spark, d), {"atr_wilder": {"op": "atr", "period": 5}, "atr_sma": {"op": "atr", "period": 5, "method": "sma"}}, BLOCK)
    return out.select("asset", "ts", rnd(F.col("atr_wilder")).alias("atr_wilder"), rnd(F.col("atr_sma")).alias("atr_sma"))


# Older families: warm-up is 0, signals are in {-1, 0, 1}


@query(
    f"""with {{EB}}, m as (select *, row_number() over ({O}) as i, {roll(4, 'avg(close)')} as s0, (4 * close + 3 * {lag('close', 1)} + 2 * {lag('close', 2)} + {lag('close', 3)}) / 10 as w0 from bars),
p as (select *, case when i >= 4 then s0 else 0 end as s, case when i >= 4 then w0 else 0 end as w from m),
q as (select *, {lag('s')} as ps, {lag('w')} as pw, {lag('close')} as pc from p)
select asset, ts, round(s, 6) as sma4, round(w, 6) as wma4, case when i > 4 and close > s and pc <= ps then 1 else 0 end as ma1, case when i > 4 and close < w and pc >= pw then -1 else 0 end as ma4 from q"""
)
def legacy_ma_cross(spark, d):
    rows = event_bars(spark, d).withColumns({"s": ind.ma(F.col("close"), 4), "w": ind.ma(F.col("close"), 4, "wma"), "i": F.row_number().over(by_time("asset"))})
    rows = rows.withColumns({"ps": F.lag("s").over(by_time("asset")), "pw": F.lag("w").over(by_time("asset")), "pc": F.lag("close").over(by_time("asset"))})
    c = lambda line, side: ind.price_cross(F.col("close"), F.col(line), F.col("pc"), F.col("p" + line), F.col("i") > 4, side)
    return rows.select("asset", "ts", rnd(F.col("s")).alias("sma4"), rnd(F.col("w")).alias("wma4"), c("s", "up_long").alias("ma1"), c("w", "down_short").alias("ma4"))


@query(
    f"""with recursive {{EB}}, {NUMBERED}, {ema_cte('a', 'close', 4)}, {ema_cte('b', 'close', 9)},
q as (select n.*, a.y as s, b.y as l, lag(a.y) over (partition by n.asset order by n.ts) as ps, lag(b.y) over (partition by n.asset order by n.ts) as pl, {lag('close').replace('close', 'n.close').replace('asset', 'n.asset').replace('by ts', 'by n.ts')} as pc from n join a using (asset, ts) join b using (asset, ts)),
r as (select *, case when close > s then 1 else 0 end as over from q)
select asset, ts, round(s, 6) as ema4, case when i > 4 and close > s and pc <= ps then 1 else 0 end as ma1, case when i > 4 and close < s and pc >= ps then -1 else 0 end as ma4,
case when i > 9 and s > l and ps <= pl then 1 when i > 9 and s < l and ps >= pl then -1 else 0 end as dual,
case when i >= 5 and {roll(2, 'count(*)')} >= 2 and {roll(2, 'min(over)')} = 1 then 1 else 0 end as ma9 from r"""
)
def legacy_ema_cross(spark, d):
    """The moving-average families over exponential averages, which start from the first bar."""
    rows = ind.recursive(event_bars(spark, d), {"s": {"op": "legacy_ema", "period": 4}, "l": {"op": "legacy_ema", "period": 9}}, BLOCK)
    w = by_time("asset")
    rows = rows.withColumns({"i": F.row_number().over(w), "ps": F.lag("s").over(w), "pl": F.lag("l").over(w), "pc": F.lag("close").over(w), "over": F.col("close") > F.col("s")})
    c = lambda side: ind.price_cross(F.col("close"), F.col("s"), F.col("pc"), F.col("ps"), F.col("i") > 4, side)
    s, line, ps, pl, on = F.col("s"), F.col("l"), F.col("ps"), F.col("pl"), F.col("i") > 9
    return rows.select(
        "asset", "ts", rnd(s).alias("ema4"), c("up_long").alias("ma1"), c("down_short").alias("ma4"), ind.crossing(on & (s > line), ps <= pl, on & (s < line), ps >= pl).alias("dual"),
        F.when(ind.run_of(F.col("over"), 2) & (F.col("i") >= 5), 1).otherwise(0).alias("ma9"),
    )


@query(
    f"""with {{EB}}, m as (select *, {roll(3, 'avg(close)')} as f, {roll(6, 'avg(close)')} as s, row_number() over ({O}) as i from bars),
q as (select *, {lag('f')} as pf, {lag('s')} as ps from m)
select asset, ts, case when i > 6 and f > s and pf <= ps then 1 when i > 6 and f < s and pf >= ps then -1 else 0 end as dual from q"""
)
def legacy_dual_ma(spark, d):
    rows = event_bars(spark, d).withColumns({"f": F.avg(F.col("close")).over(trailing(3, "asset")), "s": F.avg(F.col("close")).over(trailing(6, "asset")), "i": F.row_number().over(by_time("asset"))})
    f, s, pf, ps = F.col("f"), F.col("s"), F.lag("f").over(by_time("asset")), F.lag("s").over(by_time("asset"))
    on = F.col("i") > 6
    return rows.select("asset", "ts", ind.crossing(on & (f > s), pf <= ps, on & (f < s), pf >= ps).alias("dual"))


@query(
    f"""with {{EB}}, m as (select *, {roll(4, 'avg(close)')} as s, row_number() over ({O}) as i from bars), c as (select *, case when i >= 4 and close > s then 1 else 0 end as above from m)
select asset, ts, case when {roll(2, 'count(*)')} >= 2 and {roll(2, 'min(above)')} = 1 and i >= 5 then 1 else 0 end as ma9 from c"""
)
def legacy_ma_run(spark, d):
    rows = event_bars(spark, d).withColumns({"s": F.avg(F.col("close")).over(trailing(4, "asset")), "i": F.row_number().over(by_time("asset"))})
    rows = rows.withColumn("above", (F.col("i") >= 4) & (F.col("close") > F.col("s")))
    return rows.select("asset", "ts", F.when(ind.run_of(F.col("above"), 2) & (F.col("i") >= 5), 1).otherwise(0).alias("ma9"))


@query(
    f"""with {{EB}}, m as (select *, {roll(5, 'avg(close)')} as m, {roll(5, 'stddev_pop(close)')} as dev, row_number() over ({O}) as i, {lag('close')} as pc from bars)
select asset, ts, case when i >= 5 and close > m + dev and pc <= m + dev then 1 when i >= 5 and close < m - dev and pc >= m - dev then -1 else 0 end as boll from m"""
)
def legacy_bollinger_cross(spark, d):
    rows = event_bars(spark, d).withColumns({
        "m": F.avg(F.col("close")).over(trailing(5, "asset")), "dev": F.stddev_pop(F.col("close")).over(trailing(5, "asset")), "i": F.row_number().over(by_time("asset")), "pc": F.lag("close").over(by_time("asset")),
    })
    up, low, on = F.col("m") + F.col("dev"), F.col("m") - F.col("dev"), F.col("i") >= 5
    return rows.select("asset", "ts", ind.crossing(on & (F.col("close") > up), F.col("pc") <= up, on & (F.col("close") < low), F.col("pc") >= low).alias("boll"))


@query(
    f"""with {{EB}}, m as (select *, abs(close - {roll(4, 'max(close)')}) <= 1e-10 and {roll(4, 'count(*)')} >= 4 as top, abs(close - {roll(4, 'min(close)')}) <= 1e-10 and {roll(4, 'count(*)')} >= 4 as bottom from bars)
select asset, ts, case when {roll(2, 'count(*)')} >= 2 and {roll(2, 'min(top::int)')} = 1 then 1 else 0 end as hl1, case when bottom then -1 else 0 end as hl4 from m"""
)
def legacy_high_low(spark, d):
    w = trailing(4, "asset")
    rows = event_bars(spark, d).withColumns({
        "top": (F.abs(F.col("close") - F.max(F.col("close")).over(w)) <= 1e-10) & (F.count(F.col("close")).over(w) >= 4), "bottom": (F.abs(F.col("close") - F.min(F.col("close")).over(w)) <= 1e-10) & (F.count(F.col("close")).over(w) >= 4),
    })
    return rows.select("asset", "ts", F.when(ind.run_of(F.col("top"), 2), 1).otherwise(0).alias("hl1"), F.when(F.col("bottom"), -1).otherwise(0).alias("hl4"))


@query(
    f"""with {{EB}}, m as (select *, {roll(6, 'quantile_cont(close, 0.8)')} as hi, {roll(6, 'quantile_cont(close, 0.2)')} as lo, {lag('close')} as pc, row_number() over ({O}) as i from bars)
select asset, ts, case when i >= 6 and close > hi and pc <= hi then 1 when i >= 6 and close < lo and pc >= lo then -1 else 0 end as perc, case when i >= 6 and close between lo and hi then 1 else 0 end as perc5 from m"""
)
def legacy_percentile(spark, d):
    w = trailing(6, "asset")
    rows = event_bars(spark, d).withColumns({
        "hi": F.percentile(F.col("close"), F.lit(0.8)).over(w), "lo": F.percentile(F.col("close"), F.lit(0.2)).over(w), "pc": F.lag("close").over(by_time("asset")), "i": F.row_number().over(by_time("asset")),
    })
    on, hi, lo, pc = F.col("i") >= 6, F.col("hi"), F.col("lo"), F.col("pc")
    return rows.select(
        "asset", "ts", ind.crossing(on & (F.col("close") > hi), pc <= hi, on & (F.col("close") < lo), pc >= lo).alias("perc"), F.when(on & F.col("close").between(lo, hi), 1).otherwise(0).alias("perc5")
    )


@query(
    f"""with {{EB}}, m as (select *, close > 80 as over from bars)
select asset, ts, case when {roll(2, 'count(*)')} >= 2 and {roll(2, 'min(over::int)')} = 1 then 1 else 0 end as value1, case when close between 40 and 120 then 1 else 0 end as value5,
case when over and volume > 5000 and not coalesce({lag('over and volume > 5000')}, false) then 1 else 0 end as dual_threshold from m"""
)
def legacy_value(spark, d):
    rows = event_bars(spark, d).withColumn("over", F.col("close") > 80).withColumn("both", F.col("over") & (F.col("volume") > 5000))
    return rows.select(
        "asset", "ts", F.when(ind.run_of(F.col("over"), 2), 1).otherwise(0).alias("value1"), F.when(F.col("close").between(40, 120), 1).otherwise(0).alias("value5"),
        F.when(ind.rising_edge(F.col("both")), 1).otherwise(0).alias("dual_threshold"),
    )


# Conditions

CROSS = f"c as (select *, {full(3, 'close', roll(3, 'avg(close)'))} as fast, {full(5, 'close', roll(5, 'avg(close)'))} as slow from bars), x as (select *, {lag('fast')} as pf, {lag('slow')} as ps from c)"


def featured(spark, d):
    return event_bars(spark, d).withColumns({"fast": ind.sma(F.col("close"), 3), "slow": ind.sma(F.col("close"), 5)})


@query(f"with {{EB}}, {CROSS} select asset, ts, coalesce(fast > slow and pf <= ps, false) as up, coalesce(fast < slow and pf >= ps, false) as down from x")
def condition_cross(spark, d):
    rows = with_mask(featured(spark, d), {"op": "cross_up", "left": "fast", "right": {"field": "slow"}}, "up")
    return with_mask(rows, {"op": "crosses_below", "left": "fast", "right_field": "slow"}, "down").select("asset", "ts", "up", "down")


@query(
    """with {EB}, c as (select *, case when close > 100 then close end as x from bars)
select asset, ts, coalesce(x > 150, false) as gt, coalesce(x >= 150, false) as ge, coalesce(x < 150, false) as lt, coalesce(x <= 150, false) as le, coalesce(x = 150, false) as eq,
coalesce(x <> 150, true) as ne, not coalesce(x > 150, false) as not_gt, coalesce(x > 150, false) or (coalesce(close < 50, false) and coalesce(n > 50, false)) as tree from c"""
)
def condition_compare(spark, d):
    rows = event_bars(spark, d).withColumn("x", F.when(F.col("close") > 100, F.col("close")))
    for op in ("gt", "ge", "lt", "le", "eq", "ne"):
        rows = with_mask(rows, {"op": op, "left": "x", "right": 150}, op)
    rows = with_mask(rows, {"op": "not", "node": {"op": ">", "left": "x", "right": {"value": 150}}}, "not_gt")
    tree = {"op": "any", "nodes": [
        {"op": "gt", "left": "x", "right": {"param_ref": "level"}},
        {"op": "all", "nodes": [{"op": "lt", "left": "price.close", "right": 50}, {"op": "gt", "left": "N", "right": 50}]},
    ]}
    rows = with_mask(rows, tree, "tree", params={"level": 150})
    return rows.select("asset", "ts", "gt", "ge", "lt", "le", "eq", "ne", "not_gt", "tree")


BOUNDS = [("month", "start"), ("month", "end"), ("quarter", "start"), ("quarter", "end"), ("year", "start"), ("year", "end")]


@query(
    "with {OB}, s as (select distinct ts from bars) select ts, "
    + ", ".join(f"ts = {'min' if s == 'start' else 'max'}(ts) over (partition by date_trunc('{u}', ts)) as {u}_{s}" for u, s in BOUNDS)
    + ", ts = max(ts) over (partition by date_trunc('month', ts)) and month(ts) in (3, 12) as march_december_end from s"
)
def calendar_boundaries(spark, d):
    days = order_bars(spark, d).select("ts").distinct()
    masks = {f"{u}_{s}": calendar.mask({"op": f"calendar.{u}_{s}"}) for u, s in BOUNDS}
    return days.select("ts", *[m.alias(k) for k, m in masks.items()], calendar.mask({"op": "calendar.month_end", "months": [3, 12]}).alias("march_december_end"))


@query(
    """with {OB}, s as (select distinct ts from bars), m as (select *, date_trunc('month', ts)::date as a, last_day(ts) as z from s)
select ts, month(ts) in (1, 7) as month_in, isodow(ts) = 2 as tuesday, ts = a + ((4 - (isodow(a) - 1) + 7) % 7 + 14)::int as third_friday, ts = z - ((isodow(z) - 1 - 0 + 7) % 7)::int as last_monday, true as every from m"""
)
def calendar_weekdays(spark, d):
    days = order_bars(spark, d).select("ts").distinct()
    nodes = {
        "month_in": {"op": "calendar.month_in", "months": [1, 7]}, "tuesday": {"op": "calendar.weekday_eq", "weekday": "tue"},
        "third_friday": {"op": "calendar.nth_weekday_of_month", "weekday": 4, "ordinal": 3}, "last_monday": {"op": "calendar.last_weekday_of_month", "weekday": "monday"},
        "every": {"op": "every_session"},
    }
    return days.select("ts", *[calendar.mask(n).alias(k) for k, n in nodes.items()])


EVENT_DAYS = "e as (select distinct cast(l_shipdate as date) as d from lineitem)"


@query(
    f"""with {{OB}}, s as (select distinct ts from bars), {EVENT_DAYS}, p as (select d, (select max(ts) from s where ts <= d) as b, (select min(ts) from s where ts >= d) as f, (select ts from s where ts = d) as k from e)
select 'previous_trading_day' as policy, d as raw_event_date, b as resolved_session_date, b is not null as triggered from p
union all select 'next_trading_day', d, f, f is not null from p union all select 'skip', d, k, k is not null from p"""
)
def calendar_event_sessions(spark, d):
    days = order_bars(spark, d).select("ts")
    events = spark.read.parquet(f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("event"))
    out = None
    for policy in ("previous_trading_day", "next_trading_day", "skip"):
        one = calendar.event_sessions(days, events, policy).select(F.lit(policy).alias("policy"), "raw_event_date", "resolved_session_date", "triggered")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """with {OB}, s as (select distinct ts from bars), m as (select distinct date_trunc('month', ts)::date as a from s), t as (select a + ((0 - (isodow(a) - 1) + 7) % 7 + 28)::int as d, a from m)
select 'calendar.nth_weekday_of_month' as calendar_op, d as raw_event_date, s.ts as resolved_session_date, s.ts is not null as triggered, case when s.ts is null then 'no_session' end as skip_reason from t left join s on s.ts = t.d where month(d) = month(a)
union all select 'calendar.month_start', ts, ts, true, null from s where ts in (select min(ts) from s group by date_trunc('month', ts))"""
)
def calendar_event_frame(spark, d):
    days = order_bars(spark, d).select("ts")
    tree = {"op": "any", "nodes": [{"op": "calendar.nth_weekday_of_month", "weekday": 0, "ordinal": 5}, {"op": "calendar.month_start"}]}
    return calendar.event_frame(days, tree)


@query(
    f"""with {{EB}}, h as (select *, {lag('close')} as pc from bars) select asset, ts, (coalesce(case when close > pc then 1 when close < pc then -1 end, 0) + coalesce(case when close > 100 then 1 end, 0) + case when n > 60 then 1 else 0 end)::bigint as signal from h"""
)
def legacy_combined(spark, d):
    """Three legacy signals added up bar by bar."""
    rows, last = event_bars(spark, d), F.lag("close").over(by_time("asset"))
    move = F.when(F.col("close") > last, 1).when(F.col("close") < last, -1)
    both = ind.combined(move, F.when(F.col("close") > 100, 1), F.when(F.col("n") > 60, 1).otherwise(0))
    return rows.select("asset", "ts", both.cast("long").alias("signal"))


# Joins


@query(
    """with {OB}, {SHIP}, b as (select *, year(ts) as y from bars), g as (select ts - lag(ts) over (order by ts) as g from (select distinct ts from bars)),
m as (select median(g) as gap from g where g > 0)
select b.asset, b.ts, case when b.ts - s.ts <= 5 * gap then s.ts end as source_ts, case when b.ts - s.ts <= 5 * gap then s.qty end as qty
from b asof left join (select ts + 1 as ts, qty from ship) s on b.ts >= s.ts cross join m"""
)
def join_as_of(spark, d):
    """Quantities shipped, known a day later."""
    base = order_bars(spark, d).select("asset", "ts")
    return align.as_of(base, ship_feature(spark, d).withColumn("ts", F.date_add("ts", 1)), ["qty"], bars=5)


def _event_times(spark, d, kind):
    events = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind)
    return events.groupBy(F.col("ts").cast("timestamp").alias("ts")).agg(F.max("value").alias("value"))


@query(
    """with b as (select distinct ts from events where event_type = 'click'), s as (select ts, max(value) as value from events where event_type = 'view' group by ts),
g as (select epoch_us(ts) - lag(epoch_us(ts)) over (order by ts) as g from b), m as (select median(g) as gap from g where g > 0)
select epoch_us(b.ts) as at_us, case when epoch_us(b.ts) - epoch_us(s.ts) <= 2 * gap then epoch_us(s.ts) end as source_us, case when epoch_us(b.ts) - epoch_us(s.ts) <= 2 * gap then s.value end as value
from b asof left join s on b.ts >= s.ts cross join m"""
)
def join_as_of_intraday(spark, d):
    """The tolerance is a length of time: two median gaps between the clicks' own times."""
    out = align.as_of(_event_times(spark, d, "click").select("ts"), _event_times(spark, d, "view"), ["value"], bars=2)
    return out.select(F.unix_micros("ts").alias("at_us"), F.unix_micros("source_ts").alias("source_us"), "value")


@query(
    """with {OB}, f as (select asset, ts + 1 as ts, close as x from bars)
select b.asset, b.ts, s.ts as source_ts, s.x from bars b asof left join f s on b.asset = s.asset and b.ts >= s.ts"""
)
def join_as_of_by_asset(spark, d):
    """The last close of each asset, known a day later."""
    bars = order_bars(spark, d)
    return align.as_of(bars.select("asset", "ts"), bars.select("asset", F.date_add("ts", 1).alias("ts"), F.col("close").alias("x")), ["x"], by=["asset"])


@query("with {OB}, {SHIP} select asset, ts, qty, round(disc, 6) as disc from bars left join ship using (ts)")
def join_left_validated(spark, d):
    out = align.equi_join(order_bars(spark, d).select("asset", "ts"), ship_feature(spark, d), ["ts"])
    return out.select("asset", "ts", "qty", rnd(F.col("disc")).alias("disc"))


@query("with {OB}, {SHIP} select asset, ts, close, qty from bars join ship using (ts)")
def join_inner_predictor(spark, d):
    return align.equi_join(order_bars(spark, d).select("asset", "ts", "close"), ship_feature(spark, d), ["ts"], "inner").select("asset", "ts", "close", "qty")


@query("with {OB}, g as (select t.ts, a.asset from (select distinct ts from bars) t cross join (select distinct asset from bars) a) select ts, asset, close from g left join bars using (ts, asset)")
def join_reindex_grid(spark, d):
    return clean.densify(order_bars(spark, d), ["close"])


GRID = "g as (select t.ts, a.asset from (select distinct ts from bars) t cross join (select distinct asset from bars) a), p as (select ts, asset, close from g left join bars using (ts, asset))"


@query(
    f"""with {{OB}}, {GRID}, f as (select *, coalesce(close, last_value(close ignore nulls) over ({O} rows between 2 preceding and current row)) as ffill2,
coalesce(close, first_value(close ignore nulls) over ({O} rows between current row and 1 following)) as bfill1, coalesce(close, 0) as zero from p)
select asset, ts, ffill2, bfill1, zero, lag(ffill2, 2) over ({O}) as lagged from f"""
)
def align_fill_and_lag(spark, d):
    rows = clean.densify(order_bars(spark, d), ["close"]).withColumns({
        "ffill2": align.fill_stale(F.col("close"), 2), "bfill1": align.fill_stale(F.col("close"), 1, "bfill", label=True), "zero": align.fill_stale(F.col("close"), 0, "zero"),
    })
    return rows.select("asset", "ts", "ffill2", "bfill1", "zero", align.lag_bars(F.col("ffill2"), 2).alias("lagged"))


@query(
    f"""with {{OB}}, f as (select asset, ts + 1 as ts, close as x from bars), j as (select b.asset, b.ts, s.ts as source_ts from bars b asof left join f s on b.asset = s.asset and b.ts >= s.ts),
i as (select *, row_number() over ({O}) as i from j) select asset, ts, source_ts, case when source_ts is not null then (i - min(i) over (partition by asset, source_ts))::double end as age_bars from i"""
)
def align_age_bars(spark, d):
    return align.with_age(join_as_of_by_asset(spark, d).select("asset", "ts", "source_ts"))


@query(
    """with m as (select s_name as asset, date '1995-01-01' + (s_suppkey * 13 % 800)::int as a, case when s_suppkey % 3 > 0 then date '1995-01-01' + (s_suppkey * 13 % 800 + 400)::int end as z from supplier),
t as (select distinct date_trunc('month', o_orderdate)::date as ts from orders) select t.ts, m.asset from t join m on m.a <= t.ts and (m.z is null or t.ts <= m.z)"""
)
def join_constituents_as_of(spark, d):
    k = F.col("s_suppkey") * 13 % 800
    start = F.lit("1995-01-01").cast("date")
    members = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_name").alias("asset"), F.date_add(start, k.cast("int")).alias("start"), F.when(F.col("s_suppkey") % 3 > 0, F.date_add(start, (k + 400).cast("int"))).alias("end")
    )
    dates = spark.read.parquet(f"{d}/orders.parquet").select(F.trunc("o_orderdate", "month").alias("ts")).distinct()
    return align.as_of_members(members, dates)


@query("with {OB}, g as (select t.ts, a.asset from (select distinct ts from bars) t cross join (select distinct asset from bars) a) select ts, asset from g anti join bars using (ts, asset)")
def join_anti(spark, d):
    """Sessions on which an asset has no bar."""
    bars = order_bars(spark, d).select("ts", "asset")
    return clean.densify(bars.withColumn("x", F.lit(1.0)), ["x"]).select("ts", "asset").join(bars, ["ts", "asset"], "left_anti")


# Cleaning


@query(
    f"""with {{EB}}, {HELPED} select asset, ts, round(coalesce(ret, 0), 6) as simple_return, round(case when close > 0 and prev_close > 0 then ln(close / prev_close) else 0 end, 6) as log_return,
round(coalesce(change, 0), 6) as diff_sub, round(coalesce(ret, 0), 6) as diff_div, round(coalesce(prev_close / nullif(close, 0), 0), 6) as diff_relative from h"""
)
def clean_returns(spark, d):
    whole = Window.partitionBy("asset")
    return event_bars(spark, d).select(
        "asset", "ts", rnd(clean.simple_return(F.col("close"), by_time("asset"))).alias("simple_return"), rnd(clean.log_return(F.col("close"), by_time("asset"))).alias("log_return"), rnd(clean.difference(F.col("close"), "sub", by_time("asset"), whole)).alias("diff_sub"),
        rnd(clean.difference(F.col("close"), "div", by_time("asset"), whole)).alias("diff_div"), rnd(clean.stat_difference(F.col("close"), "relative", by_time("asset"))).alias("diff_relative"),
    )


@query(
    f"""with {{OB}}, {GRID} select asset, ts, round(coalesce(close, avg(close) over ({O} rows between 4 preceding and current row), 0), 6) as mean5,
coalesce(close, -1) as constant, coalesce(close, last_value(close ignore nulls) over ({O} rows between unbounded preceding and current row), 0) as ffill from p"""
)
def clean_missing_fill(spark, d):
    rows = clean.densify(order_bars(spark, d), ["close"])
    return rows.select("asset", "ts", rnd(clean.fill(F.col("close"), "mean5")).alias("mean5"), clean.fill(F.col("close"), "constant", -1.0).alias("constant"), clean.fill(F.col("close")).alias("ffill"))


@query(
    """with s as (select p_partkey, case p_partkey % 4 when 0 then '1,' || (p_partkey % 900 + 100)::varchar when 1 then (p_partkey % 50)::varchar || '.5k' when 2 then (p_partkey % 7)::varchar || 'M' else 'n/a' end as t from part)
select p_partkey, t, case p_partkey % 4 when 0 then (1000 + p_partkey % 900 + 100)::double when 1 then (p_partkey % 50 + 0.5::double) * 1000 when 2 then (p_partkey % 7)::double * 1000000 end as x from s"""
)
def clean_number_suffix(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("1,"), (k % 900 + 100).cast("string"))).when(k % 4 == 1, F.concat((k % 50).cast("string"), F.lit(".5k"))).when(k % 4 == 2, F.concat((k % 7).cast("string"), F.lit("M"))).otherwise("n/a")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.alias("t")).withColumn("x", clean.number(F.col("t")))


@query(
    """with o as (select o_orderkey, o_orderdate::date as d from orders where day(o_orderdate) > 0)
select o_orderkey, d as ts from o"""
)
def clean_inferred_dates(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("text"))
    return clean.inferred_dates(rows, "text").select("o_orderkey", "ts")


@query("select o_orderkey, to_timestamp(epoch(o_orderdate))::timestamp as ts from orders")
def clean_epoch_time(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("e"))
    first = rows.agg(F.min_by("e", "o_orderkey").alias("first"))
    return rows.crossJoin(F.broadcast(first)).select("o_orderkey", clean.epoch_time(F.col("e"), F.col("first")).cast("timestamp_ntz").alias("ts"))


@query("with {OB}, f as (select min(ts) as f from (select ts from bars group by ts having count(distinct asset) = (select count(distinct asset) from bars))) select asset, ts, close from bars, f where ts >= f")
def clean_common_start(spark, d):
    return clean.common_start(order_bars(spark, d)).select("asset", "ts", "close")


@query("select cast(o_orderdate as date) as ts, round(avg(o_totalprice), 4) as price from orders group by 1")
def clean_collapse_duplicates(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return clean.collapse_duplicates(rows, ["ts"]).withColumn("price", rnd(F.col("price"), 4))


@query(
    f"""with {{OB}}, r as (select asset, ts, close, row_number() over ({O}) - 1 as i, count(*) over (partition by asset) as n from bars)
select asset, ts, close from r where i % greatest(n // 49, 1) = 0 or i = n - 1"""
)
def clean_downsample(spark, d):
    return clean.downsample(order_bars(spark, d).select("asset", "ts", "close"), 50)


@query("with {OB} select asset, ts, close from bars where ts between date '1996-02-01' and date '1996-03-31'")
def clean_date_slice(spark, d):
    return clean.date_slice(order_bars(spark, d).select("asset", "ts", "close"), "1996-02-01", "1996-03-31")


CONTRACT = {
    "primary_key": {"time_field": "ts", "instrument_field": "asset"}, "alignment_policy": {"join_mode": "asof"},
    "features": [
        {"field": "filled_mean", "source": {"source_id": "filled", "column": "x", "time_field": "day", "instrument_field": "asset"}, "staleness_max_bars": 2, "lag_bars": 1},
        {"field": "open_count", "source": {"source_id": "open", "column": "x", "time_field": "day", "instrument_field": "asset"}, "join_mode": "left", "fill_policy": "zero"},
        {"field": "partial_high", "source": {"source_id": "partial", "column": "x", "time_field": "day", "instrument_field": "asset"}, "join_mode": "left", "fill_policy": "ffill", "staleness_max_bars": 1},
    ],
}


@query(
    f"""with {{OB}}, s as (select o_orderpriority as asset, cast(o_orderdate as date) as day, o_orderstatus as st, avg(o_totalprice) as m, count(*)::double as n, max(o_totalprice) as h from orders group by all),
b as (select asset, ts, row_number() over ({O}) as i from bars), g as (select median(g) as g from (select date_diff('day', lag(ts) over (order by ts), ts) as g from (select distinct ts from bars)) where g > 0),
a as (select b.asset, b.ts, case when date_diff('day', f.day, b.ts) <= 2 * g.g then f.m end as m, case when date_diff('day', f.day, b.ts) <= 2 * g.g then f.day end as day from b asof left join (select * from s where st = 'F') f on b.asset = f.asset and b.ts >= f.day cross join g),
c as (select b.asset, b.ts, b.i, a.m, a.day, o.n, p.h from b join a using (asset, ts) left join s o on o.st = 'O' and o.asset = b.asset and o.day = b.ts left join s p on p.st = 'P' and p.asset = b.asset and p.day = b.ts),
f as (select *, lag(m) over ({O}) as lm, lag(day) over ({O}) as ld, last_value(h ignore nulls) over ({O} rows between 1 preceding and current row) as lh from c)
select f.asset, f.ts, round(lm, 4) as filled_mean, coalesce(n, 0) as open_count, round(lh, 4) as partial_high, case when lm is null then 'missing' when lag(f.ts) over (partition by f.asset order by f.ts) = ld then 'exact' else 'asof' end as filled_origin,
 case when n is null then 'zero_fill' else 'exact' end as open_origin, case when lh is null then 'missing' when h is null then 'ffill' else 'exact' end as partial_origin,
 case when ld is not null then (i - (select max(i) from b where b.asset = f.asset and b.ts <= f.ld))::double end as filled_age from f"""
)
def feature_contract(spark, d):
    """Three sources of orders by status, each with its own policy, joined in one pass."""
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))
    per = orders.groupBy(F.col("o_orderpriority").alias("asset"), "day", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("h"))
    of = lambda status, c: per.where(F.col("o_orderstatus") == status).select("asset", "day", F.col(c).alias("x"))
    out = contract.materialize(order_bars(spark, d).select("asset", "ts"), {"filled": of("F", "m"), "open": of("O", "n"), "partial": of("P", "h")}, CONTRACT)
    origin = lambda f, name: F.col(contract.suffix(f, "value_origin")).alias(name)
    return out.select(
        "asset", "ts", rnd(F.col("filled_mean"), 4).alias("filled_mean"), "open_count", rnd(F.col("partial_high"), 4).alias("partial_high"), origin("filled_mean", "filled_origin"),
        origin("open_count", "open_origin"), origin("partial_high", "partial_origin"), F.col(contract.suffix("filled_mean", "age_bars")).alias("filled_age"),
    )
