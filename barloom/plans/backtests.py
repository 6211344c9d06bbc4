"""Queries over signals, simulators and portfolio accounts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, rnd
from ..operators import portfolio, signals, simulate
from ..sources.bars import event_bars, order_bars
from . import strategy
from .base import query
from .market import CROSS, GRID, O, featured, lag

COST, SLIP = 0.001, 0.0004


def crossed(spark, d):
    """Bars with up and down crosses of the two averages."""
    rows = featured(spark, d)
    w = by_time("asset")
    rows = rows.withColumns({"pf": F.lag("fast").over(w), "ps": F.lag("slow").over(w)})
    up = F.coalesce((F.col("fast") > F.col("slow")) & (F.col("pf") <= F.col("ps")), F.lit(False))
    down = F.coalesce((F.col("fast") < F.col("slow")) & (F.col("pf") >= F.col("ps")), F.lit(False))
    return rows.withColumns({"up": up, "down": down})


UPDOWN = f"{CROSS}, u as (select *, coalesce(fast > slow and pf <= ps, false) as up, coalesce(fast < slow and pf >= ps, false) as down, row_number() over ({O}) as i from x)"
CARRY = f"over ({O} rows between unbounded preceding and current row)"


@query(
    f"""with {{EB}}, {UPDOWN}, e as (select *, case when up then 1 when down then 0 end as ev, case when up or (close < 40 and down) then 1 when close < 60 then 0 end as e1, case when close < 60 then 0 when up then 1 end as e2 from u),
l as (select *, lag(ev) over ({O}) as lev from e)
select asset, ts, coalesce(last_value(ev ignore nulls) {CARRY}, 0) as held, coalesce(last_value(lev ignore nulls) {CARRY}, 0) as held_next_open,
coalesce(last_value(case when up then 1 when close < 60 then 0 end ignore nulls) {CARRY}, 0) as entry_wins, coalesce(last_value(e2 ignore nulls) {CARRY}, 0) as exit_wins from l"""
)
def signal_state_position(spark, d):
    rows, up, low = crossed(spark, d), F.col("up"), F.col("close") < 60
    return rows.select(
        "asset", "ts", signals.state_position(up, F.col("down")).alias("held"), signals.state_position(up, F.col("down"), next_open=True).alias("held_next_open"),
        signals.state_position(up, low).alias("entry_wins"), signals.state_position(up, low, "entry_then_exit").alias("exit_wins"),
    )


def sim_sql(price: str, entry: str, exit_: str, delay: int, close_rule: str, reset: str = "false") -> str:
    fee = (1 - COST) * (1 - SLIP)
    return f"""s as (select asset, ts, i, {price} as price, coalesce(lag({entry}, {delay}) over ({O}), 0) as en, coalesce(lag({exit_}, {delay}) over ({O}), 0) as ex from u),
k as (select asset, ts, i, en::int as position, (en <> 0)::int as action, case when en <> 0 then {fee}::double else 1 end as cash, case when en <> 0 then {fee}::double else 1::double end as worth, case when en <> 0 then price else 0 end as fill, 0 as held, 0::double as open_ret, 0::double as held_ret from s where i = 1
 union all
 select asset, ts, i, case when opens then en::int when closes then 0 else position end, case when opens then 1 when closes then 4 else 0 end,
  case when opens or closes then worth * {fee}::double else cash end, case when opens or closes then worth * {fee}::double else worth end, case when opens then price when closes then 0 else fill end, case when opens or closes then 0 else held end, open_ret, held_ret
 from (select *, position = 0 and en <> 0 as opens, position <> 0 and ({close_rule}) as closes from
  (select k.asset, s.ts, s.i, k.position, k.cash, k.fill, s.en, s.ex, s.price,
   case when k.position <> 0 then (case when {reset} and s.en = k.position then 0 else k.held + 1 end) else 0 end as held,
   case when k.position <> 0 then k.position * (s.price / k.fill - 1) else 0 end as open_ret,
   case when k.position <> 0 and k.worth > 0 then k.cash * (1 + k.position * (s.price / k.fill - 1)) / k.worth - 1 else 0 end as held_ret,
   case when k.position <> 0 then k.cash * (1 + k.position * (s.price / k.fill - 1)) else k.cash end as worth
   from k join s on s.asset = k.asset and s.i = k.i + 1)))"""


RES = f"select asset, ts, position::double as position, action, round(100 * worth, 6) as equity, round(coalesce(worth / lag(worth) over ({O}) - 1, 0), 6) as ret, round(held_ret, 6) as held_ret, round(open_ret, 6) as open_ret from k"


def _simulated(rows, rules):
    out = simulate.simulate(rows, rules)
    return out.select("asset", "ts", "position", "action", *[rnd(F.col(c)).alias(c) for c in ("equity", "ret", "held_ret", "open_ret")])


@query(f"with recursive {{EB}}, {UPDOWN}, {sim_sql('close', 'case when up then 1 else 0 end', 'case when down then -1 else 0 end', 1, 'ex = -position')} {RES}")
def simulate_long(spark, d):
    rows = crossed(spark, d).select("asset", "ts", "open", "close", F.col("up").cast("double").alias("entry"), (-F.col("down").cast("double")).alias("exit"))
    return _simulated(rows, simulate.Rules(delay=1, cost=COST, slippage=SLIP))


LS = ("case when up then 1 when down then -1 else 0 end", "case when down then -1 when up then 1 else 0 end")


def _both_sides(spark, d):
    side = F.when(F.col("up"), 1.0).when(F.col("down"), -1.0).otherwise(0.0)
    return crossed(spark, d).select("asset", "ts", "open", "close", side.alias("entry"), side.alias("exit"))


@query(f"with recursive {{EB}}, {UPDOWN}, {sim_sql('open', *LS, 1, 'ex = -position')} {RES}")
def simulate_long_short_open(spark, d):
    return _simulated(_both_sides(spark, d), simulate.Rules(delay=1, price="open", cost=COST, slippage=SLIP))


@query(f"with recursive {{EB}}, {UPDOWN}, {sim_sql('close', *LS, 0, 'ex = -position or held >= case when position = 1 then 3 else 2 end')} {RES}")
def simulate_timer_or(spark, d):
    return _simulated(_both_sides(spark, d), simulate.Rules(cost=COST, slippage=SLIP, long_bars=3, short_bars=2, combine="or"))


@query(f"with recursive {{EB}}, {UPDOWN}, {sim_sql('close', *LS, 0, 'held >= 4', 'true')} {RES}")
def simulate_timer_reset(spark, d):
    return _simulated(_both_sides(spark, d), simulate.Rules(cost=COST, slippage=SLIP, long_bars=4, short_bars=4, combine="timer_only", reset=True))


LEDGER = f"""q as (select *, sum((action = 1)::int) {CARRY} as seq, coalesce(lag(position) over ({O}), 0) as pp, action <> 0 or position <> 0 as act from k),
t as (select q.*, s.price, first(price order by ts) over (partition by asset, seq, act order by ts rows between unbounded preceding and current row) as op, row_number() over (partition by asset, seq, act order by ts) - 1 as hc from q join (select asset, i, price from s) s using (asset, i))
select asset, ts, (case when act then seq else 0 end)::bigint as trade_seq, case action when 1 then (case when position > 0 then 1 else 2 end) when 4 then (case when pp > 0 then 3 else 4 end) else 0 end as type_code, case when act then op end as trade_open_price,
(case when act then hc else 0 end)::bigint as holding_count, case when action = 4 then round((case when pp > 0 then 1 else -1 end) * (price / op - 1), 6) end as trade_return from t"""


@query(f"with recursive {{EB}}, {UPDOWN}, {sim_sql('close', *LS, 0, 'ex = -position')}, {LEDGER}")
def trade_ledger(spark, d):
    out = simulate.ledger(simulate.simulate(_both_sides(spark, d), simulate.Rules(cost=COST, slippage=SLIP)))
    return out.select("asset", "ts", "trade_seq", "type_code", "trade_open_price", "holding_count", rnd(F.col("trade_return")).alias("trade_return"))


FEE2 = ((1 - COST) * (1 - SLIP)) ** 2


@query(f"with {{EB}}, {UPDOWN}, f as (select *, case when up then close / open * {FEE2}::double else 1 end as f from u) select asset, ts, up as traded, round(f - 1, 6) as ret, round(100 * product(f) {CARRY}, 6) as equity from f")
def simulate_same_session(spark, d):
    out = simulate.same_session(crossed(spark, d).withColumn("entry", F.col("up")), COST, SLIP)
    return out.select("asset", "ts", "traded", rnd(F.col("ret")).alias("ret"), rnd(F.col("equity")).alias("equity"))


@query(
    f"""with {{EB}}, {UPDOWN}, l as (select *, lead(ts, 1) over ({O}) as enter_ts, lead(ts, 2) over ({O}) as leave_ts, lead(open, 1) over ({O}) as p, lead(close, 2) over ({O}) as q from u)
select asset, ts, enter_ts, leave_ts, round(q / p - 1, 6) as ret from l where up and leave_ts is not null"""
)
def simulate_bar_offset(spark, d):
    out = simulate.bar_offset(crossed(spark, d).withColumn("entry", F.col("up")), 1, 2)
    return out.select("asset", "ts", "enter_ts", "leave_ts", rnd(F.col("ret")).alias("ret"))


# Portfolios: the panel is the event bars, the score a three-bar momentum

SCORED = f"m as (select *, close / nullif({lag('close', 3)}, 0) - 1 as score from bars), r as (select *, case when score is not null then row_number() over (partition by ts, score is not null order by score desc, asset) end as rank from m)"
TARGET = f"{SCORED}, t as (select *, coalesce(rank <= 2, false) as selected, case when rank <= 2 then least(1.0::double / sum((rank <= 2)::int) over (partition by ts), 0.6::double) else 0::double end as target from r)"


def scored(spark, d):
    bars = event_bars(spark, d)
    return bars.withColumn("score", F.try_divide("close", F.lag("close", 3).over(by_time("asset"))) - 1)


def targeted(spark, d):
    rows = signals.ranked(scored(spark, d), "score", n=2)
    return rows.withColumn("target", signals.equal_weight(F.col("selected"), 0.6)).withColumn("backtest_id", F.lit("top2"))


@query(f"with {{EB}}, {TARGET} select asset, ts, rank, selected, round(target, 6) as target from t")
def select_top_n(spark, d):
    return targeted(spark, d).select("asset", "ts", "rank", "selected", rnd(F.col("target")).alias("target"))


@query(f"with {{EB}}, {SCORED}, q as (select *, case when score is not null then row_number() over (partition by ts, score is not null order by score desc, asset desc) end as rank2 from r) select asset, ts, rank2 as rank from q")
def select_rank_reverse_ties(spark, d):
    return signals.ranked(scored(spark, d), "score", reverse_ties=True).select("asset", "ts", "rank")


DRIFT = f"""h as (select *, coalesce(lag(target) over ({O}), 0) as w, coalesce(close / nullif({lag('close')}, 0) - 1, 0) as r from t),
p as (select *, sum(w * r) over (partition by ts) as p from h), b as (select ts, any_value(p) as ret, sum(abs(target - case when 1 + p > 0 then w * (1 + r) / (1 + p) else w end)) as turnover, sum(target) as gross, count(*) filter (abs(target) > 1e-12) as selected from p group by ts)"""


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, e as (select *, 100 * product((1 + ret) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts) as equity from b)
select 'top2' as backtest_id, ts, round(ret, 6) as ret, round(turnover, 6) as turnover, round(gross, 6) as gross, selected, round(equity, 6) as equity, round(equity / (1 - turnover * {COST}::double) * turnover * {COST}::double, 6) as trade_cost from e"""
)
def portfolio_every_bar(spark, d):
    out = portfolio.every_bar(targeted(spark, d), COST)
    return out.select("backtest_id", "ts", "selected", *[rnd(F.col(c)).alias(c) for c in ("ret", "turnover", "gross", "equity", "trade_cost")])


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, e as (select *, 100 * product((1 + ret) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts) as equity from b)
select 'top2' as backtest_id, ts, round(equity, 6) as equity, round(turnover, 6) as turnover, round(1 - gross, 6) as cash from e"""
)
def portfolio_fold_parity(spark, d):
    """The fold with a rebalance on every bar gives the closed form's curve."""
    out = portfolio.account(targeted(spark, d).withColumn("rebalance", F.lit(True)), COST)
    return out.select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("equity", "turnover", "cash")])


def weekly(spark, d):
    """Targets with rebalances on the first session of each week of the year."""
    rows = targeted(spark, d).withColumn("seg", F.floor((F.dayofyear("ts") - 1) / 7))
    first = rows.groupBy("seg").agg(F.min("ts").alias("ts")).select("ts", F.lit(True).alias("rebalance"))
    return rows.join(first, "ts", "left").withColumn("rebalance", F.coalesce("rebalance", F.lit(False))).withColumn("backtest_id", F.lit("weekly"))


@query(
    f"""with recursive {{EB}}, {TARGET}, h as (select *, (dayofyear(ts) - 1) // 7 as seg, coalesce(close / nullif({lag('close')}, 0) - 1, 0) as r from t),
j as (select asset, ts, r, target, ts = min(ts) over (partition by seg) as reb, dense_rank() over (order by ts) as i, dense_rank() over (order by asset) as n from h),
g as (select i, any_value(ts) as ts, any_value(reb) as reb, list(r order by n) as r, list(target order by n) as t from j group by i),
k as (select i, ts, case when reb then 100 * (1 - list_sum(list_transform(t, lambda x: abs(x))) * {COST}::double) else 100::double end as equity, 0::double as ret, case when reb then list_sum(list_transform(t, lambda x: abs(x))) else 0 end as turnover, case when reb then t else list_transform(t, lambda x: 0::double) end as w from g where i = 1
union all
select i, ts, case when reb then eq * (1 - tu * {COST}::double) else eq end, ret, case when reb then tu else 0 end, case when reb then t else w end from
 (select *, list_sum(list_transform(list_zip(t, w), lambda z: abs(z[1] - z[2]))) as tu from
  (select g.i, g.ts, g.reb, g.t, p.ret, k.equity * (1 + p.ret) as eq, list_transform(list_zip(k.w, g.r), lambda z: z[1] * (1 + z[2]) / (1 + p.ret)) as w
   from k join g on g.i = k.i + 1, lateral (select list_sum(list_transform(list_zip(k.w, g.r), lambda z: z[1] * z[2])) as ret) p)))
select 'weekly' as backtest_id, ts, round(equity, 6) as equity, round(ret, 6) as ret, round(turnover, 6) as turnover from k"""
)
def portfolio_drift_account(spark, d):
    """Weekly rebalances; weights drift between."""
    return portfolio.account(weekly(spark, d), COST).select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("equity", "ret", "turnover")])


def fold_sql(target: str = "t") -> str:
    """A drifting account in SQL, session by session, as a table k (backtest_id, ts, eq, tu, w, gates), from rows w0
    (backtest_id, asset, ts, close, target, reb) on a full grid; ``target`` is what becomes of the list t of a
    session's targets, given wb (the drifted weights), ret, eq1 and pk, as a list of lists of [weights, gates]."""
    each = lambda x, f: f"list_transform({x}, lambda z: {f})"
    return f"""h0 as (select *, coalesce(close / nullif(lag(close) over (partition by backtest_id, asset order by ts), 0) - 1, 0) as r from w0),
j0 as (select *, dense_rank() over (partition by backtest_id order by ts) as i, dense_rank() over (partition by backtest_id order by asset) as n from h0),
g0 as (select backtest_id, i, any_value(ts) as ts, bool_or(reb) as reb, list(r order by n) as r, list(target order by n) as t from j0 group by backtest_id, i),
k as (select backtest_id, 0::bigint as i, ts, 100::double as eq, 100::double as pk, 0::double as tu, {each('t', '0::double')} as w, '' as gates from g0 where i = 1
 union all
 select backtest_id, i, ts, case when reb then eq1 * greatest(0, 1 - tu0 * {COST}::double) else eq1 end, pk, case when reb then tu0 else 0 end, case when reb then nw else wb end, case when reb then fired else '' end from
  (select *, list_sum({each('list_zip(nw, wb)', 'abs(z[1] - z[2])')}) as tu0 from
   (select *, {target} as nw, {GATE_NAMES if target != 't' else "''"} as fired from
    (select *, greatest(kpk, eq1) as pk from
     (select g0.backtest_id, g0.i, g0.ts, g0.reb, g0.t, k.pk as kpk, k.eq * (1 + p.ret) as eq1, p.ret, {each('list_zip(k.w, g0.r)', 'case when 1 + p.ret > 0 then z[1] * (1 + z[2]) / (1 + p.ret) else z[1] end')} as wb
      from k join g0 on g0.backtest_id = k.backtest_id and g0.i = k.i + 1, lateral (select list_sum({each('list_zip(k.w, g0.r)', 'z[1] * z[2]')}) as ret) p)))))"""


WEEKLY = "w0 as (select 'weekly' as backtest_id, asset, ts, close, target, ts = min(ts) over (partition by (dayofyear(ts) - 1) // 7) as reb from t)"


@query(
    f"""with recursive {{EB}}, {TARGET}, {WEEKLY}, {fold_sql()}
select backtest_id, 100::double as start_equity, round(max_by(eq, ts), 6) as final_equity, round(max_by(eq, ts) / 100 - 1, 6) as total_return, count(*) as checkpoints, count(*) filter (tu > 1e-12) as active_rebalances,
round(avg(tu), 6) as average_turnover, round(avg(list_sum(list_transform(w, lambda x: abs(x)))), 6) as average_gross_exposure from k where i > 0 group by backtest_id"""
)
def account_summary(spark, d):
    out = portfolio.accounting_summary(portfolio.account(weekly(spark, d), COST))
    return out.withColumns({c: rnd(F.col(c)) for c in ("final_equity", "total_return", "average_turnover", "average_gross_exposure")})


@query(
    f"""with recursive {{EB}}, {TARGET}, {WEEKLY}, {fold_sql()}, n as (select backtest_id, i, ts, unnest(w) as weight, unnest(range(1, len(w) + 1)) as n from k where i > 0)
select backtest_id, ts, asset, round(weight, 6) as weight from n join (select distinct asset, n from j0) using (n) where abs(weight) > 1e-12"""
)
def account_drifted_holdings(spark, d):
    """Weights on every session of an account that trades weekly."""
    return portfolio.holdings(portfolio.account(weekly(spark, d), COST)).withColumn("weight", rnd(F.col("weight")))


HALVED = "list_transform(t, lambda x: x * (case when ret <= -0.3 then 0.5 else 1 end) * (case when eq1 / pk - 1 <= -0.5 then 0.5 else 1 end))"
LARGEST = f"list_max(list_transform({HALVED}, lambda x: abs(x)))"
#: The place of the largest target, the last one in a tie.
PLACE = f"list_max(list_transform(range(1, len(t) + 1), lambda i: case when abs(list_extract({HALVED}, i)) = {LARGEST} then i else 0 end))"
SINGLE = f"list_transform(range(1, len(t) + 1), lambda i: case when i = {PLACE} then list_extract({HALVED}, i) else 0::double end)"
CLIPPED = f"list_transform(list_zip(wb, {SINGLE}), lambda z: z[1] + greatest(-0.4::double, least(0.4::double, z[2] - z[1])))"
GATE_NAMES = (
    "concat_ws(',', case when ret <= -0.3 then 'max_daily_loss' end, case when eq1 / pk - 1 <= -0.5 then 'max_drawdown' end, case when len(list_filter(t, lambda x: abs(x) > 1e-12)) > 1 then 'max_positions' end, "
    f"case when list_max(list_transform(list_zip(wb, {SINGLE}), lambda z: abs(z[2] - z[1]))) > 0.4::double + 1e-12 then 'max_order_size' end)"
)


@query(
    f"""with recursive {{EB}}, {TARGET}, w0 as (select 'top2' as backtest_id, asset, ts, close, target, true as reb from t), {fold_sql(CLIPPED)}
select backtest_id, ts, round(eq, 6) as equity, round(list_sum(w), 6) as gross, gates from k where i > 0"""
)
def portfolio_risk_gates(spark, d):
    rows = targeted(spark, d).withColumn("rebalance", F.lit(True))
    out = portfolio.account(rows, COST, portfolio.Gates(max_daily_loss=0.3, max_drawdown=0.5, max_positions=1, max_order_size=0.4, action="reduce_exposure"))
    return out.select("backtest_id", "ts", rnd(F.col("equity")).alias("equity"), rnd(F.col("gross")).alias("gross"), F.array_join("gates", ",").alias("gates"))


@query(
    f"""with {{EB}}, {TARGET}, h as (select *, coalesce(lag(target) over ({O}), 0) as nw, coalesce(lag(target, 2) over ({O}), 0) as ow, coalesce(open / nullif({lag('close')}, 0) - 1, 0) as rn, coalesce(close / nullif(open, 0) - 1, 0) as rc, coalesce({lag('close')} / nullif({lag('open')}, 0) - 1, 0) as pc from t),
a as (select *, sum(ow * pc) over (partition by ts) as pd from h), b as (select *, case when 1 + pd > 0 then ow * (1 + pc) / (1 + pd) else ow end as held from a), c as (select *, sum(held * rn) over (partition by ts) as night from b),
e as (select ts, any_value(night) as night, sum(nw * rc) as day, sum(abs(nw - case when 1 + night > 0 then held * (1 + rn) / (1 + night) else held end)) as turnover from c group by ts)
select 'top2' as backtest_id, ts, round(night, 6) as night, round(day, 6) as day, round(turnover, 6) as turnover, round(100 * product((1 + night) * greatest(1 - turnover * {COST}::double, 0) * (1 + day)) over (order by ts), 6) as equity from e"""
)
def portfolio_next_open(spark, d):
    return portfolio.next_open(targeted(spark, d), COST).select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("night", "day", "turnover", "equity")])


@query(
    f"""with {{EB}}, {TARGET}, b as (select ts, sum(abs(target)) as gross, sum(target * coalesce(close / nullif(open, 0) - 1, 0)) as trade from t group by ts),
e as (select *, (1 + trade) * pow((1 - gross * {SLIP}::double) * (1 - gross * {COST}::double), 2) - 1 as ret from b)
select 'top2' as backtest_id, ts, round(gross, 6) as gross, round(ret, 6) as ret, round(100 * product(1 + ret) over (order by ts), 6) as equity from e"""
)
def portfolio_same_session(spark, d):
    return portfolio.session_portfolio(targeted(spark, d), COST, SLIP).select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("gross", "ret", "equity")])


@query(
    f"""with {{EB}}, a as (select *, 0.2::double as base, dayofweek(ts) = 5 as event, case when asset = 'click' then 0.5::double else 0::double end as overlay, coalesce(lead(open) over ({O}) / nullif(open, 0) - 1, 0) as nx, coalesce(close / nullif(open, 0) - 1, 0) as dy from bars),
h as (select *, case when event then 0 else base end as held from a), g as (select *, coalesce(lag(held) over ({O}), 0) as bf from h),
b as (select ts, sum(case when event then overlay * dy else base * nx end) as ret, sum(abs(held - bf) + case when event then 2 * abs(overlay) else 0 end) as turnover from g group by ts)
select 'overlay' as backtest_id, ts, round(ret, 6) as ret, round(turnover, 6) as turnover, round(100 * product(greatest(1 + ret, 0) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts), 6) as equity from b"""
)
def portfolio_event_overlay(spark, d):
    rows = event_bars(spark, d).withColumns({
        "backtest_id": F.lit("overlay"), "base": F.lit(0.2), "event": F.weekday("ts") == 4, "overlay": F.when(F.col("asset") == "click", 0.5).otherwise(0.0),
    })
    return portfolio.event_overlay(rows, COST).select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("ret", "turnover", "equity")])


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, e as (select ts, turnover, 100 * product((1 + ret) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts) as equity from b), f as (select ts, turnover, equity / (1 - turnover * {COST}::double) * turnover * {COST}::double as paid from e),
hb as (select p.*, case when 1 + p.p > 0 then w * (1 + r) / (1 + p.p) else w end as before from p), g as (select hb.*, target - before as delta, turnover, paid from hb join f using (ts))
select asset, ts, round(before, 6) as before, round(target, 6) as target, case when before > 1e-12 and abs(target) <= 1e-12 then 'exit' when target > before + 1e-12 then 'buy' when target < before - 1e-12 then 'sell' else 'hold' end as action,
round(abs(delta) / turnover, 6) as share, round(abs(delta) / turnover * paid, 8) as cost from g where abs(delta) > 1e-12"""
)
def portfolio_rebalance_trades(spark, d):
    out = portfolio.rebalance_trades(targeted(spark, d), COST)
    return out.select("asset", "ts", "action", *[rnd(F.col(c)).alias(c) for c in ("before", "target", "share")], rnd(F.col("cost"), 8).alias("cost"))


@query(f"with {{EB}}, {TARGET}, h as (select *, abs(target - coalesce(lag(target) over ({O}), 0)) > 1e-12 as moved from t) select ts, bool_or(moved) as rebalance from h group by ts")
def trigger_signal_change(spark, d):
    return signals.with_change(targeted(spark, d)).groupBy("ts").agg(F.max("rebalance").alias("rebalance"))


@query(
    """with {EB}, w as (select *, case asset when 'click' then 0.8::double when 'view' then 0.6::double else 0::double end as raw, case when close > 100 then 0.9::double when close > 50 then -0.3::double else 0.1::double end as frame from bars)
select asset, ts, round(raw / 1.4::double, 6) as fixed, round(case when sum(greatest(frame, 0)) over (partition by ts) > 1 then greatest(frame, 0) / sum(greatest(frame, 0)) over (partition by ts) else greatest(frame, 0) end, 6) as long_only,
round(case when sum(abs(frame)) over (partition by ts) > 1 then frame / sum(abs(frame)) over (partition by ts) else frame end, 6) as long_short from w"""
)
def allocate_weights(spark, d):
    rows = event_bars(spark, d).withColumn("frame", F.when(F.col("close") > 100, 0.9).when(F.col("close") > 50, -0.3).otherwise(0.1))
    return rows.select(
        "asset", "ts", rnd(signals.fixed_weight({"click": 0.8, "view": 0.6})).alias("fixed"), rnd(signals.frame_weight(F.col("frame"))).alias("long_only"),
        rnd(signals.frame_weight(F.col("frame"), allow_short=True)).alias("long_short"),
    )


@query(f"with {{EB}}, {TARGET}, b as (select ts, sum(target) as gross from t group by ts) select 'top2' as backtest_id, ts, 'max_gross' as code, round(gross, 6) as value from b where gross > 0.9")
def account_invariants(spark, d):
    curve = portfolio.every_bar(targeted(spark, d), COST)
    return portfolio.invariant_breaches(curve, max_gross=0.9).withColumn("value", rnd(F.col("value")))


@query("select 'top2' as backtest_id, 'valid' as status")
def account_cost_status(spark, d):
    return portfolio.cost_status(portfolio.every_bar(targeted(spark, d), COST), COST)


# Documents


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, e as (select *, 100 * product((1 + ret) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts) as equity from b)
select 'rotation' as backtest_id, ts, round(equity, 6) as equity, round(turnover, 6) as turnover from e"""
)
def strategy_ranked_rotation(spark, d):
    doc = strategy.template("ranked_rotation", cost=COST, allocation={"type": "equal_weight", "position_limit": 0.6})
    return strategy.run(event_bars(spark, d), doc, "rotation").select("backtest_id", "ts", rnd(F.col("equity")).alias("equity"), rnd(F.col("turnover")).alias("turnover"))


NEXT_OPEN = f"""with {{EB}}, {TARGET}, h as (select *, coalesce(lag(target) over ({O}), 0) as nw, coalesce(lag(target, 2) over ({O}), 0) as ow, coalesce(open / nullif({lag('close')}, 0) - 1, 0) as rn, coalesce(close / nullif(open, 0) - 1, 0) as rc, coalesce({lag('close')} / nullif({lag('open')}, 0) - 1, 0) as pc from t),
a as (select *, sum(ow * pc) over (partition by ts) as pd from h), b as (select *, case when 1 + pd > 0 then ow * (1 + pc) / (1 + pd) else ow end as held from a), c as (select *, sum(held * rn) over (partition by ts) as night from b),
e as (select ts, any_value(night) as night, sum(nw * rc) as day, sum(abs(nw - case when 1 + night > 0 then held * (1 + rn) / (1 + night) else held end)) as turnover from c group by ts)
select '{{ID}}' as backtest_id, ts, round(turnover, 6) as turnover, round(100 * product((1 + night) * greatest(1 - turnover * {COST}::double, 0) * (1 + day)) over (order by ts), 6) as equity from e"""
ROTATION = {"cost": COST, "allocation": {"type": "equal_weight", "position_limit": 0.6}}


@query(NEXT_OPEN.replace("{ID}", "open"))
def strategy_next_open(spark, d):
    """A document's targets traded at the next open, in closed form."""
    out = strategy.run(event_bars(spark, d), strategy.template("ranked_rotation", execution="next_open", **ROTATION), "open")
    return out.select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("turnover", "equity")])


@query(NEXT_OPEN.replace("{ID}", "fold"))
def strategy_next_open_fold(spark, d):
    """The same through the fold, which gates and sparse rebalances need."""
    doc = strategy.template("ranked_rotation", execution="next_open", risk_gates={"max_positions": 5}, **ROTATION)
    return strategy.run(event_bars(spark, d), doc, "fold").select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("turnover", "equity")])


@query(
    f"""with {{EB}}, {TARGET}, b as (select ts, sum(abs(target)) as gross, sum(target * coalesce(close / nullif(open, 0) - 1, 0)) as trade from t group by ts),
e as (select *, (1 + trade) * pow((1 - gross * {SLIP}::double) * (1 - gross * {COST}::double), 2) - 1 as ret from b)
select 'session' as backtest_id, ts, round(gross, 6) as gross, round(ret, 6) as ret, round(100 * product(1 + ret) over (order by ts), 6) as equity from e"""
)
def strategy_same_session(spark, d):
    out = strategy.run(event_bars(spark, d), strategy.template("ranked_rotation", execution="same_session", slippage=SLIP, **ROTATION), "session")
    return out.select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("gross", "ret", "equity")])


@query(
    f"""with {{EB}}, {TARGET}, l as (select *, lead(ts, 1) over ({O}) as enter_ts, lead(ts, 3) over ({O}) as leave_ts, lead(close, 3) over ({O}) / nullif(lead(open, 1) over ({O}), 0) - 1 as r from t),
b as (select ts, min(enter_ts) as enter_ts, min(leave_ts) as leave_ts, sum(target) as gross, sum(target * coalesce(r, 0)) as r from l where dayofweek(ts) = 1 and target > 0 group by ts having min(leave_ts) is not null),
e as (select *, (1 + r) * pow(1 - gross * {COST}::double, 2) - 1 as ret from b)
select 'offset' as backtest_id, ts, enter_ts, leave_ts, round(gross, 6) as gross, round(ret, 6) as ret, round(100 * product(1 + ret) over (order by ts), 6) as equity from e"""
)
def strategy_bar_offset(spark, d):
    """Every Monday's choice is bought at the next open and sold at the close two sessions later."""
    doc = strategy.template("ranked_rotation", execution="bar_offset", offset={"enter": 1, "leave": 3}, **ROTATION)
    out = strategy.run(event_bars(spark, d), {**doc, "rebalance": {"op": "calendar.weekday_eq", "weekday": "monday"}}, "offset")
    return out.select("backtest_id", "ts", "enter_ts", "leave_ts", *[rnd(F.col(c)).alias(c) for c in ("gross", "ret", "equity")])


@query(
    f"""with {{EB}}, a as (select *, 0.2::double as base, dayofweek(ts) = 5 as event, case when asset = 'click' then 0.5::double else 0::double end as overlay, coalesce(lead(open) over ({O}) / nullif(open, 0) - 1, 0) as nx, coalesce(close / nullif(open, 0) - 1, 0) as dy from bars),
h as (select *, case when event then 0 else base end as held from a), g as (select *, coalesce(lag(held) over ({O}), 0) as bf from h),
b as (select ts, sum(case when event then overlay * dy else base * nx end) as ret, sum(abs(held - bf) + case when event then 2 * abs(overlay) else 0 end) as turnover from g group by ts)
select 'overlay' as backtest_id, ts, round(ret, 6) as ret, round(turnover, 6) as turnover, round(100 * product(greatest(1 + ret, 0) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts), 6) as equity from b"""
)
def strategy_event_overlay(spark, d):
    panel = event_bars(spark, d)
    names = [r["asset"] for r in panel.select("asset").distinct().collect()]  # one row an asset of the document
    doc = strategy.template("event_overlay", cost=COST, overlay={"event": {"op": "calendar.weekday_eq", "weekday": "friday"}, "weights": {"click": 0.5}})
    doc["allocation"]["weights"] = {n: 0.2 for n in names}
    return strategy.run(panel, doc, "overlay").select("backtest_id", "ts", *[rnd(F.col(c)).alias(c) for c in ("ret", "turnover", "equity")])


@query(
    f"""with {{EB}}, v as (select *, close / nullif({lag('close')}, 0) - 1 as ret, close / nullif({lag('close', 5)}, 0) - 1 as m from bars),
q as (select *, case when count(ret) over ({O} rows between 4 preceding and current row) = 5 then stddev_samp(ret) over ({O} rows between 4 preceding and current row) * sqrt(252) end as c from v),
f as (select asset, ts, coalesce(m, median(m) over (partition by ts)) as m, coalesce(c, median(c) over (partition by ts)) as c from q),
g as (select asset, ts, greatest(least(m, quantile_cont(m, 0.99) over (partition by ts)), quantile_cont(m, 0.01) over (partition by ts)) as m, greatest(least(c, quantile_cont(c, 0.99) over (partition by ts)), quantile_cont(c, 0.01) over (partition by ts)) as c from f),
z as (select asset, ts, (m - avg(m) over (partition by ts)) / nullif(stddev_samp(m) over (partition by ts), 0) as m, (c - avg(c) over (partition by ts)) / nullif(stddev_samp(c) over (partition by ts), 0) as c from g),
s as (select asset, ts, case when m is not null or c is not null then coalesce(m, 0) / 2 - coalesce(c, 0) / 2 end as score from z),
r as (select *, case when score is not null then row_number() over (partition by ts, score is not null order by score desc, asset) end as rank from s)
select asset, ts, round(score, 6) as score, rank, case when rank <= 2 then round(1 / 2.0::double, 6) else 0::double end as target from r"""
)
def strategy_factor_rank(spark, d):
    """The factor stage of a document: raw factors, cleaned by date, composite, rank and weights."""
    out = strategy.targets(event_bars(spark, d), strategy.template("factor_rank"), "factors")
    return out.select("asset", "ts", rnd(F.col("score")).alias("score"), "rank", rnd(F.col("target")).alias("target"))


LOSS = f"""z as (select b.asset, b.ts, k.id as backtest_id, case when k.id = 'long' and asset = 'click' and ts >= date '2024-01-15' then 0 when k.id = 'short' and asset = 'view' and ts >= date '2024-01-10' then close * 30 else close end as px,
 case when k.id = 'long' and asset = 'click' then 1::double when k.id = 'short' and asset = 'view' then -1::double else 0::double end as target from bars b, (values ('long'), ('short')) k(id)),
h as (select *, coalesce(lag(target) over (partition by backtest_id, asset order by ts), 0) as w, coalesce(px / nullif(lag(px) over (partition by backtest_id, asset order by ts), 0) - 1, 0) as r from z),
p as (select *, sum(w * r) over (partition by backtest_id, ts) as p from h), b as (select backtest_id, ts, any_value(p) as ret, sum(abs(target - case when 1 + p > 0 then w * (1 + r) / (1 + p) else w end)) as turnover from p group by backtest_id, ts)
select backtest_id, ts, round(ret, 5) as ret, round(turnover, 5) as turnover, round(100 * product((1 + ret) * greatest(1 - turnover * {COST}::double, 0)) over (partition by backtest_id order by ts), 4) as equity from b"""


def losing(spark, d):
    """Two backtests: one holds an asset whose price falls to 0, one is short of an asset whose price jumps to 30 times."""
    day, click, view = F.col("ts"), F.col("asset") == "click", F.col("asset") == "view"
    rows = event_bars(spark, d).withColumn("backtest_id", F.explode(F.array(F.lit("long"), F.lit("short"))))
    long = F.col("backtest_id") == "long"
    gone, jump = long & click & (day >= F.lit("2024-01-15").cast("date")), ~long & view & (day >= F.lit("2024-01-10").cast("date"))
    return rows.withColumns({
        "close": F.when(gone, 0.0).when(jump, F.col("close") * 30).otherwise(F.col("close")), "target": F.when(long & click, 1.0).when(~long & view, -1.0).otherwise(0.0),
    })


def _lost(curve):
    return curve.select("backtest_id", "ts", rnd(F.col("ret"), 5).alias("ret"), rnd(F.col("turnover"), 5).alias("turnover"), rnd(F.col("equity"), 4).alias("equity"))


@query(f"with {{EB}}, {LOSS}")
def portfolio_total_loss(spark, d):
    return _lost(portfolio.every_bar(losing(spark, d), COST))


@query(f"with {{EB}}, {LOSS}")
def portfolio_total_loss_fold(spark, d):
    return _lost(portfolio.account(losing(spark, d).withColumn("rebalance", F.lit(True)), COST))


@query("with {EB} select 'short' as backtest_id, ts, 'view' as asset, 'long_only_negative_position' as code, -1::double as value from (select distinct ts from bars)")
def account_position_breaches(spark, d):
    curve = portfolio.account(losing(spark, d).withColumn("rebalance", F.lit(True)), COST)
    return portfolio.position_breaches(curve, event_bars(spark, d)).withColumn("value", rnd(F.col("value")))


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, e as (select ts, turnover, 100 * product((1 + ret) * greatest(1 - turnover * {COST}::double, 0)) over (order by ts) as equity from b), f as (select ts, turnover, equity / (1 - turnover * {COST}::double) * turnover * {COST}::double as paid from e),
hb as (select p.*, case when 1 + p.p > 0 then w * (1 + r) / (1 + p.p) else w end as before from p), g as (select hb.*, target - before as delta, turnover, paid from hb join f using (ts))
select 'top2' as backtest_id, asset, ts, round(before, 6) as before, round(target, 6) as target, case when before > 1e-12 and abs(target) <= 1e-12 then 'exit' when target > before + 1e-12 then 'buy' when target < before - 1e-12 then 'sell' else 'hold' end as action,
round(abs(delta) / turnover, 6) as share, round(abs(delta) / turnover * paid, 8) as cost from g where abs(delta) > 1e-12"""
)
def account_trades(spark, d):
    """Trades of a folded account, with the drifted weights before them."""
    out = portfolio.account_trades(portfolio.account(targeted(spark, d).withColumn("rebalance", F.lit(True)), COST))
    return out.select("backtest_id", "asset", "ts", "action", *[rnd(F.col(c)).alias(c) for c in ("before", "target", "share")], rnd(F.col("cost"), 8).alias("cost"))


@query(f"with {{EB}}, {TARGET} select 'top2' as backtest_id, asset, ts, round(target, 6) as weight from t where target > 0")
def account_holdings(spark, d):
    return portfolio.holdings(portfolio.account(targeted(spark, d).withColumn("rebalance", F.lit(True)), COST)).withColumn("weight", rnd(F.col("weight")))


GATED = f"""{fold_sql(CLIPPED)},
o0 as (select g0.ts, g0.t, k.pk as kpk, p.ret, k.eq * (1 + p.ret) as eq1, list_transform(list_zip(k.w, g0.r), lambda z: case when 1 + p.ret > 0 then z[1] * (1 + z[2]) / (1 + p.ret) else z[1] end) as wb
 from k join g0 on g0.backtest_id = k.backtest_id and g0.i = k.i + 1, lateral (select list_sum(list_transform(list_zip(k.w, g0.r), lambda z: z[1] * z[2])) as ret) p),
o1 as (select *, greatest(kpk, eq1) as pk from o0), o2 as (select *, list_max(list_transform(list_zip(wb, {SINGLE}), lambda z: abs(z[2] - z[1]))) as move, len(list_filter(t, lambda x: abs(x) > 1e-12)) as live from o1),
ge as (select ts, 'max_daily_loss' as gate, -0.3::double as lim, ret as obs from o2 where ret <= -0.3 union all select ts, 'max_drawdown', -0.5::double, eq1 / pk - 1 from o2 where eq1 / pk - 1 <= -0.5
 union all select ts, 'max_positions', 1::double, live::double from o2 where live > 1 union all select ts, 'max_order_size', 0.4::double, move from o2 where move > 0.4::double + 1e-12)"""
ALL_IN = "w0 as (select 'top2' as backtest_id, asset, ts, close, target, true as reb from t)"


@query(f"""with recursive {{EB}}, {TARGET}, {ALL_IN}, {GATED} select 'top2' as backtest_id, ts, gate, lim as "limit", round(obs, 6) as observed from ge""")
def account_gate_events(spark, d):
    rows = targeted(spark, d).withColumn("rebalance", F.lit(True))
    out = portfolio.account(rows, COST, portfolio.Gates(max_daily_loss=0.3, max_drawdown=0.5, max_positions=1, max_order_size=0.4, action="reduce_exposure"))
    return portfolio.gate_events(out).withColumns({c: rnd(F.col(c)) for c in ("limit", "observed")})


@query(f"""with recursive {{EB}}, {TARGET}, {ALL_IN}, {GATED} select 'top2' as backtest_id, count(*) as event_count, array_to_string(list_sort(list(distinct gate)), ',') as gates_triggered, min(ts)::varchar as first_event, max(ts)::varchar as last_event from ge""")
def account_gate_summary(spark, d):
    rows = targeted(spark, d).withColumn("rebalance", F.lit(True))
    curve = portfolio.account(rows, COST, portfolio.Gates(max_daily_loss=0.3, max_drawdown=0.5, max_positions=1, max_order_size=0.4, action="reduce_exposure"))
    out = portfolio.gate_summary(curve).withColumn("gates_triggered", F.array_join("gates_triggered", ","))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_event", "last_event")})


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, hb as (select p.*, case when 1 + p.p > 0 then w * (1 + r) / (1 + p.p) else w end as before from p),
a as (select *, case when before > 1e-12 and abs(target) <= 1e-12 then 'exit' when target > before + 1e-12 then 'buy' when target < before - 1e-12 then 'sell' else 'hold' end as action from hb where abs(target - before) > 1e-12)
select asset, ts, action, rank, concat_ws('; ', case when rank is not null then 'rank ' || rank || ' by score' when before > 0 and target <= 0 then 'not selected at this rebalance' end, case when rank is not null then 'eligible' when action <> 'hold' then 'not eligible' end) as reason from a"""
)
def report_trade_reasons(spark, d):
    """Why each trade of a rotation was made."""
    rows = portfolio.rebalance_trades(targeted(spark, d), COST)
    return rows.select("asset", "ts", "action", "rank", portfolio.trade_reason(F.col("before"), F.col("target"), F.col("action"), F.col("rank"), rank_by="score").alias("reason"))


@query(
    f"""with recursive {{EB}}, {TARGET}, {WEEKLY}, {fold_sql()}, kk as (select * from k where i > 0)
select 'weekly' as backtest_id, count(*) as equity_rows, sum(len(list_filter(w, lambda x: abs(x) > 1e-12)))::bigint as holding_rows, count(*) filter (tu > 1e-12) as rebalance_rows, 0::bigint as gate_event_rows, any_value(len(w))::int as weight_columns from kk"""
)
def account_run_report(spark, d):
    """Row counts that an export of a weekly account must match."""
    curve = portfolio.account(weekly(spark, d), COST)
    return portfolio.run_report(curve, portfolio.account_trades(curve)).drop("trade_rows")


@query(
    f"""with recursive {{EB}}, v0 as (select *, unnest([4, 5, 6]) as slow from bars),
a0 as (select *, case when count(*) over (w rows between 2 preceding and current row) = 3 then avg(close) over (w rows between 2 preceding and current row) end as fa,
 case slow {" ".join(f"when {n} then case when count(*) over (w rows between {n - 1} preceding and current row) = {n} then avg(close) over (w rows between {n - 1} preceding and current row) end" for n in (4, 5, 6))} end as sa
 from v0 window w as (partition by slow, asset order by ts)),
x0 as (select *, lag(fa) over w as pf, lag(sa) over w as ps from a0 window w as (partition by slow, asset order by ts)),
e0 as (select *, last_value(case when fa > sa and pf <= ps then 1 when fa < sa and pf >= ps then 0 end ignore nulls) over (partition by slow, asset order by ts rows between unbounded preceding and current row) = 1 as held from x0),
y0 as (select *, case when held then 1.0::double / sum(held::int) over (partition by slow, ts) else 0::double end as target from e0),
c0 as (select *, max((abs(target - coalesce(lt, 0)) > 1e-12)::int) over (partition by slow, ts) = 1 as reb from (select *, lag(target) over (partition by slow, asset order by ts) as lt from y0)),
w0 as (select 'v' || (slow - 4)::varchar as backtest_id, asset, ts, close, target, reb from c0), {fold_sql()}
select backtest_id, ts, round(eq, 6) as equity, round(tu, 6) as turnover from k where i > 0"""
)
def strategy_matrix(spark, d):
    doc = {**strategy.template("single_signal"), "cost": COST}
    doc["features"]["slow"]["period"] = {"param_ref": "slow"}
    out = strategy.run_matrix(event_bars(spark, d), doc, [{"slow": 4}, {"slow": 5}, {"slow": 6}])
    return out.select("backtest_id", "ts", rnd(F.col("equity")).alias("equity"), rnd(F.col("turnover")).alias("turnover"))


# Reports on accounts


@query(
    f"""with {{EB}}, {TARGET}, h as (select *, coalesce(lag(target) over ({O}), 0) as w, coalesce(close / nullif({lag('close')}, 0) - 1, 0) as r from t)
select asset, round(sum(w * r), 6) as contribution, round(avg(w), 6) as mean_weight, count(*) filter (abs(w) > 1e-12) as active_days, round(sum(w * r) / sum(sum(w * r)) over (), 6) as share from h group by asset"""
)
def report_contributions(spark, d):
    w = by_time("asset")
    rows = targeted(spark, d).withColumns({"w": F.coalesce(F.lag("target").over(w), F.lit(0.0)), "r": F.coalesce(F.try_divide("close", F.lag("close").over(w)) - 1, F.lit(0.0))})
    agg = rows.groupBy("asset").agg(F.sum(F.col("w") * F.col("r")).alias("contribution"), F.avg("w").alias("mean_weight"), F.count_if(F.abs("w") > 1e-12).alias("active_days"))
    total = agg.agg(F.sum("contribution").alias("t"))
    out = agg.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("contribution", "t"))  # one row
    return out.select("asset", "active_days", *[rnd(F.col(c)).alias(c) for c in ("contribution", "mean_weight", "share")])


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT} select count(*) filter (turnover > 1e-12) as rebalances, round(sum(turnover), 6) as total_turnover, round(avg(turnover) filter (turnover > 1e-12), 6) as mean_active, round(max(turnover), 6) as max_turnover from b"""
)
def report_turnover(spark, d):
    b = portfolio.every_bar(targeted(spark, d), COST)
    on = F.col("turnover") > 1e-12
    return b.agg(F.count_if(on).alias("rebalances"), rnd(F.sum("turnover")).alias("total_turnover"), rnd(F.avg(F.when(on, F.col("turnover")))).alias("mean_active"), rnd(F.max("turnover")).alias("max_turnover"))


@query(
    f"""with {{EB}}, {TARGET}, {DRIFT}, hd as (select *, target - case when 1 + p > 0 then w * (1 + r) / (1 + p) else w end as delta from p), tr as (select asset, ts, row_number() over (partition by ts order by asset) as ordinal from hd where abs(delta) > 1e-12), ev as (select ts, 1 as ordinal from hd group by ts having max(abs(delta)) > 1e-12)
select ev.ts, ev.ordinal::int as ordinal, tr.asset from ev left join tr using (ts, ordinal)"""
)
def report_event_trades(spark, d):
    """Rebalance events joined to trades by date and place within the day."""
    rows = portfolio.rebalance_trades(targeted(spark, d), COST)
    trades = rows.select("asset", "ts", F.row_number().over(Window.partitionBy("ts").orderBy("asset")).alias("ordinal"))
    events = rows.select("ts").distinct().withColumn("ordinal", F.lit(1))
    return events.join(trades, ["ts", "ordinal"], "left").select("ts", "ordinal", "asset")


@query(
    f"""with {{OB}}, f as (select asset, ts + 1 as ts, close as x from bars), j as (select b.asset, b.ts, s.ts as source_ts from bars b asof left join f s on b.asset = s.asset and b.ts >= s.ts),
i as (select *, row_number() over ({O}) as i from j), g as (select *, case when source_ts is not null then i - min(i) over (partition by asset, source_ts) end as age from i)
select asset, count(*) as rows, count(*) filter (age > 3) as stale, count(*) filter (source_ts is null) as missing, max(age)::double as max_age, count(*) filter (age > 3) > 0.2 * count(*) as warn from g group by asset"""
)
def report_feature_audit(spark, d):
    """Staleness of a joined feature by asset, with a warning above 20 % stale rows."""
    from .market import align_age_bars

    rows = align_age_bars(spark, d)
    stale = F.count_if(F.col("age_bars") > 3)
    return rows.groupBy("asset").agg(
        F.count("*").alias("rows"), stale.alias("stale"), F.count_if(F.col("source_ts").isNull()).alias("missing"), F.max("age_bars").alias("max_age"), (stale > 0.2 * F.count("*")).alias("warn")
    )


@query(
    f"""with {{OB}}, {GRID}, b as (select *, unnest(['close', 'month_close']) as feature from g),
f as (select asset, 'close' as feature, ts + 1 as ts from bars union all select distinct asset, 'month_close', (date_trunc('month', ts) + interval 1 month)::date from bars),
j as (select b.asset, b.feature, b.ts, s.ts as source_ts from b asof left join f s on b.asset = s.asset and b.feature = s.feature and b.ts >= s.ts),
i as (select *, row_number() over (partition by asset, feature order by ts) as i from j), a as (select *, case when source_ts is not null then i - min(i) over (partition by asset, feature, source_ts) end as age from i),
s as (select asset, feature, count(*) as rows, count(*) filter (age > 1) as stale_rows, count(*) filter (age > 0) as filled_rows, coalesce(max(age), 0)::double as max_age_bars from a group by asset, feature)
select *, round(stale_rows / rows::double, 6) as stale_ratio, round(filled_rows / rows::double, 6) as fill_ratio,
concat_ws(',', case when stale_rows / rows::double >= 0.2 then 'stale_ratio' end, case when filled_rows / rows::double >= 0.2 then 'fill_ratio' end, case when max_age_bars >= 5 then 'max_age' end) as warnings from s"""
)
def report_feature_quality(spark, d):
    """Thresholds and warnings of the feature audit: each asset's last close, known a day later, and the close of its
    last whole month, on every session of the market."""
    from ..operators import align, clean

    bars, keys = order_bars(spark, d), ["asset", "feature"]
    grid = clean.densify(bars, []).select("asset", "ts", F.explode(F.array(F.lit("close"), F.lit("month_close"))).alias("feature"))
    daily = bars.select("asset", F.lit("close").alias("feature"), F.date_add("ts", 1).alias("ts"))
    monthly = bars.select("asset", F.lit("month_close").alias("feature"), F.add_months(F.trunc("ts", "month"), 1).alias("ts")).distinct()
    rows = align.with_age(align.as_of(grid, daily.unionByName(monthly), [], by=keys), tuple(keys))
    out = align.audit(rows, keys).withColumn("warnings", F.array_join("warnings", ","))
    return out.withColumns({c: rnd(F.col(c)) for c in ("stale_ratio", "fill_ratio")})


@query(
    f"""with recursive {{EB}}, {UPDOWN}, k as (select asset, ts, i, case when up then i end as since, false as fire from u where i = 1 union all
 select u.asset, u.ts, u.i, case when k.since is not null then (case when u.down or u.i - k.since >= 3 then null else k.since end) when u.up then u.i end, k.since is not null and (u.down or u.i - k.since >= 3) from k join u on u.asset = k.asset and u.i = k.i + 1)
select asset, ts, fire as exit from k"""
)
def timer_exit_mask(spark, d):
    rows = crossed(spark, d).select("asset", "ts", F.col("up").alias("entry"), F.col("down").alias("exit"))
    return simulate.timer_exit(rows, 3).select("asset", "ts", "exit")


@query(
    f"""with recursive {{EB}}, {UPDOWN}, {sim_sql('close', *LS, 0, 'ex = -position')}, b as (select *, position <> 0 as inn from k), g as (select *, row_number() over ({O}) - row_number() over (partition by asset, inn order by ts) as isl from b),
r as (select asset, max(c) as m from (select asset, isl, count(*) as c from g where inn group by asset, isl) group by asset)
select asset, round(100 * avg(inn::int), 6) as exposure_pct, round(coalesce(any_value(m), 0) / count(*)::double, 6) as max_holding_ratio from b left join r using (asset) group by asset"""
)
def metrics_exposure(spark, d):
    from ..operators import metrics

    out = metrics.exposure(simulate.simulate(_both_sides(spark, d), simulate.Rules(cost=COST, slippage=SLIP)))
    return out.select("asset", rnd(F.col("exposure_pct")).alias("exposure_pct"), rnd(F.col("max_holding_ratio")).alias("max_holding_ratio"))


@query(f"with {{EB}}, {TARGET} select asset, ts, round(target, 6) as target from t")
def account_checked_targets(spark, d):
    return portfolio.checked(targeted(spark, d), max_gross=1.2).select("asset", "ts", rnd(F.col("target")).alias("target"))


@query(
    """with m as (select s_name as asset, date '1995-01-01' + (s_suppkey * 13 % 800)::int as a, case when s_suppkey % 3 > 0 then date '1995-01-01' + (s_suppkey * 13 % 800 + 400)::int end as z from supplier)
select count(*) as row_count, count(distinct asset) as symbols, (count(*) - count(distinct row(asset, a, z)))::bigint as duplicate_rows, 0::bigint as missing, count(distinct asset) filter (a <= date '1996-01-01' and (z is null or z >= date '1996-01-01')) as covered,
case when count(distinct asset) filter (a <= date '1996-01-01' and (z is null or z >= date '1996-01-01')) = 0 then 'invalid' when count(*) > count(distinct row(asset, a, z)) then 'warning' else 'valid' end as status from m"""
)
def account_universe_report(spark, d):
    k, start = F.col("s_suppkey") * 13 % 800, F.lit("1995-01-01").cast("date")
    members = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_name").alias("asset"), F.date_add(start, k.cast("int")).alias("start"), F.when(F.col("s_suppkey") % 3 > 0, F.date_add(start, (k + 400).cast("int"))).alias("end")
    )
    return portfolio.universe_report(members, members.select("asset"), F.lit("1996-01-01").cast("date"))


@query(
    """with {EB}, a as (select asset, ts from bars where close > 100), b as (select asset, ts from bars where n > 60), last as (select *, row_number() over (partition by asset order by ts desc) as k from bars)
select 'both' as what, asset, ts from (select * from a intersect select * from b) union all select 'only_first', asset, ts from (select * from a except select * from b)
union all select 'either', asset, ts from (select * from a union select * from b) union all select 'last', asset, ts from last where k = 1"""
)
def set_operations(spark, d):
    """Intersection, difference, union and keep-last, as the loaders and reports use them."""
    bars = event_bars(spark, d)
    a, b = bars.where("close > 100").select("asset", "ts"), bars.where("n > 60").select("asset", "ts")
    last = bars.withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))).where("k = 1").select("asset", "ts")
    out = None
    for name, df in (("both", a.intersect(b)), ("only_first", a.exceptAll(b)), ("either", a.union(b).distinct()), ("last", last)):
        one = df.select(F.lit(name).alias("what"), "asset", "ts")
        out = one if out is None else out.unionByName(one)
    return out
