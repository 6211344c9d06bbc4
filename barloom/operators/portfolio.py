"""Multi-asset accounting on long frames (backtest_id, ts, asset, close, target, ...).

Where targets are set on every bar the account is a product of per-bar factors. Between sparse rebalances
each holding grows with its own price, so a segment's value is a sum over holdings: windows as well.
Only gates that look at the equity reached so far need a fold, one per backtest.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div, upto
from .simulate import compounded

ID = "backtest_id"


def drifted(weight, r, total):
    """Weights after a bar's returns; they stay where the account as a whole is lost (1 + total <= 0)."""
    return F.when(1 + total > 0, weight * (1 + r) / (1 + total)).otherwise(weight)


def before_trades(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of an every-bar target frame with _p, the account's return over the bar, and before, the weight
    just before the bar's trade: the last target drifted by one bar's return."""
    w = by_time(*keys, "asset")
    rows = df.withColumns({"_w": F.coalesce(F.lag("target").over(w), F.lit(0.0)), "_r": F.coalesce(div(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))})
    rows = rows.withColumn("_p", F.sum(F.col("_w") * F.col("_r")).over(Window.partitionBy(*keys, "ts")))
    return rows.withColumn("before", drifted(F.col("_w"), F.col("_r"), F.col("_p"))).drop("_w", "_r")


def _curve(rows: DataFrame, cost, keys: tuple[str, ...]) -> DataFrame:
    bars = rows.groupBy(*keys, "ts").agg(
        F.first("_p").alias("ret"), F.sum(F.abs(F.col("target") - F.col("before"))).alias("turnover"),
        F.sum("target").alias("gross"), F.sum(F.abs("target")).alias("gross_size"), F.count_if(F.abs("target") > 1e-12).alias("selected"),
    )
    rate = cost_column(cost)
    kept = F.greatest(1 - F.col("turnover") * rate, F.lit(0.0))
    bars = bars.withColumn("equity", 100 * compounded((1 + F.col("ret")) * kept, upto(*keys)))
    last = F.coalesce(F.lag("equity").over(by_time(*keys)), F.lit(100.0))
    return bars.withColumn("trade_cost", last * (1 + F.col("ret")) * F.col("turnover") * rate)


def cost_column(cost):
    """A rate, rates by backtest_id (by what stands in front of the first |), or a list of rates by the number of ids v0, v1...,
    which stays one literal of the plan however long it is."""
    if isinstance(cost, list):
        if len(set(cost)) == 1:
            return F.lit(float(cost[0]))
        return F.get(F.from_json(F.lit(json.dumps(list(map(float, cost)))), "array<double>"), F.substring(F.substring_index(ID, "|", 1), 2, 20).cast("int"))
    rates = set(cost.values()) if isinstance(cost, dict) else {cost}
    if len(rates) == 1:
        return F.lit(float(rates.pop()))
    return F.create_map(*[F.lit(x) for k, v in cost.items() for x in (k, float(v))])[F.substring_index(ID, "|", 1)]


def every_bar(df: DataFrame, cost, keys: tuple[str, ...] = (ID,)) -> DataFrame:
    """Closed form for targets set on every bar: one row per (keys, ts) with ret, turnover, trade_cost, gross, gross_size, selected, equity.

    cost is a rate, or a dict of rates by backtest_id. gross is the net sum of the weights, gross_size that of their sizes.
    """
    return _curve(before_trades(df, keys), cost, keys)


def next_open(df: DataFrame, cost, keys: tuple[str, ...] = (ID,)) -> DataFrame:
    """Targets of a bar are traded at the next open: the night at the old weights, the day at the new ones.

    One row per (keys, ts): night, day, turnover, equity. Weights are those of the last two targets.
    """
    w = by_time(*keys, "asset")
    rows = df.withColumns({
        "_new": F.coalesce(F.lag("target").over(w), F.lit(0.0)), "_old": F.coalesce(F.lag("target", 2).over(w), F.lit(0.0)),
        "_n": F.coalesce(div(F.col("open"), F.lag("close").over(w)) - 1, F.lit(0.0)), "_c": F.coalesce(div(F.col("close"), F.col("open")) - 1, F.lit(0.0)),
        "_pc": F.coalesce(div(F.lag("close").over(w), F.lag("open").over(w)) - 1, F.lit(0.0)),
    })
    whole = Window.partitionBy(*keys, "ts")
    rows = rows.withColumn("_pd", F.sum(F.col("_old") * F.col("_pc")).over(whole))
    rows = rows.withColumn("_held", drifted(F.col("_old"), F.col("_pc"), F.col("_pd")))  # yesterday's weights at its close
    rows = rows.withColumn("_night", F.sum(F.col("_held") * F.col("_n")).over(whole))
    rows = rows.withColumn("_at_open", drifted(F.col("_held"), F.col("_n"), F.col("_night")))
    bars = rows.groupBy(*keys, "ts").agg(
        F.first("_night").alias("night"), F.sum(F.col("_new") * F.col("_c")).alias("day"), F.sum(F.abs(F.col("_new") - F.col("_at_open"))).alias("turnover")
    )
    factor = (1 + F.col("night")) * F.greatest(1 - F.col("turnover") * cost_column(cost), F.lit(0.0)) * (1 + F.col("day"))
    return bars.withColumn("equity", 100 * compounded(factor, upto(*keys)))


def session_portfolio(df: DataFrame, cost, slippage, keys: tuple[str, ...] = (ID,)) -> DataFrame:
    """Weighted same-session round trips: in at the open, out at the close. One row per (keys, ts): gross, ret, equity."""
    bars = df.groupBy(*keys, "ts").agg(
        F.sum(F.abs("target")).alias("gross"), F.sum(F.col("target") * F.coalesce(div(F.col("close"), F.col("open")) - 1, F.lit(0.0))).alias("trade")
    )
    fee = F.greatest(1 - F.col("gross") * cost_column(slippage), F.lit(0.0)) * F.greatest(1 - F.col("gross") * cost_column(cost), F.lit(0.0))
    bars = bars.withColumn("ret", (1 + F.col("trade")) * fee * fee - 1).drop("trade")
    return bars.withColumn("equity", 100 * compounded(1 + F.col("ret"), upto(*keys)))


def event_overlay(df: DataFrame, cost, keys: tuple[str, ...] = (ID,)) -> DataFrame:
    """Baseline weights (base) earn open to open; on event sessions (event) they are flat and overlay
    weights (overlay) earn open to close; the baseline returns at the next open. One row per (keys, ts): ret, turnover, equity.
    """
    w = by_time(*keys, "asset")
    rows = df.withColumns({"_next": F.coalesce(div(F.lead("open").over(w), F.col("open")) - 1, F.lit(0.0)), "_day": F.coalesce(div(F.col("close"), F.col("open")) - 1, F.lit(0.0))})
    held = F.when(F.col("event"), F.lit(0.0)).otherwise(F.col("base"))
    rows = rows.withColumn("_held", held).withColumn("_before", F.coalesce(F.lag("_held").over(w), F.lit(0.0)))
    bars = rows.groupBy(*keys, "ts").agg(
        F.sum(F.when(F.col("event"), F.col("overlay") * F.col("_day")).otherwise(F.col("base") * F.col("_next"))).alias("ret"),
        F.sum(F.abs(F.col("_held") - F.col("_before")) + F.when(F.col("event"), 2 * F.abs("overlay")).otherwise(0.0)).alias("turnover"),
    )
    factor = F.greatest(1 + F.col("ret"), F.lit(0.0)) * F.greatest(1 - F.col("turnover") * cost_column(cost), F.lit(0.0))
    return bars.withColumn("equity", 100 * compounded(factor, upto(*keys)))


def offset_portfolio(df: DataFrame, enter: int, leave_: int, cost, enter_at: str = "open", leave_at: str = "close", keys: tuple[str, ...] = (ID,)) -> DataFrame:
    """Weighted round trips from session t+enter to session t+leave_ of every session with a target and a flag
    ``rebalance``; costs at both ends. One row per (keys, ts): enter_ts, leave_ts, gross, ret, equity.
    Signals past the data are dropped; a trip that begins before the last one ends is an error.
    """
    w, bars = by_time(*keys, "asset"), by_time(*keys)
    rows = df.withColumns({
        "_a": F.lead("ts", enter).over(w), "_z": F.lead("ts", leave_).over(w),
        "_g": F.coalesce(div(F.lead(leave_at, leave_).over(w), F.nullif(F.lead(enter_at, enter).over(w), F.lit(0.0))) - 1, F.lit(0.0)),
    })
    trips = rows.where(F.col("rebalance") & (F.abs("target") > 1e-12)).groupBy(*keys, "ts").agg(
        F.min("_a").alias("enter_ts"), F.min("_z").alias("leave_ts"), F.sum(F.abs("target")).alias("gross"), F.sum(F.col("target") * F.col("_g")).alias("_r")
    ).where("leave_ts is not null")
    late = F.lag("leave_ts").over(bars) >= F.col("enter_ts") if leave_ > enter else F.lit(False)
    trips = trips.withColumn("_ok", F.when(late, F.raise_error(F.lit("overlapping trades"))).otherwise(F.lit(True))).where("_ok").drop("_ok")
    fee = F.greatest(1 - F.col("gross") * cost_column(cost), F.lit(0.0))
    trips = trips.withColumn("ret", (1 + F.col("_r")) * fee * fee - 1).drop("_r")
    return trips.withColumn("equity", 100 * compounded(1 + F.col("ret"), upto(*keys)))


@dataclass(frozen=True)
class Gates:
    """Limits checked in this order at each rebalance; action is flatten, pause_trading, reduce_exposure or block_new_orders."""

    max_daily_loss: float | None = None
    max_drawdown: float | None = None
    max_positions: int | None = None
    max_order_size: float | None = None
    action: str = "flatten"
    reduce_to: float = 0.5

    def cut(self, target: np.ndarray, before: np.ndarray) -> np.ndarray:
        if self.action in ("flatten", "pause_trading"):
            return np.zeros_like(target)
        if self.action == "reduce_exposure":
            return target * self.reduce_to
        if self.action == "block_new_orders":
            same = np.sign(target) == np.where(before != 0, np.sign(before), np.sign(target))
            return np.where((np.abs(target) > np.abs(before)) & same, before, target)
        return target

    def apply(self, target: np.ndarray, before: np.ndarray, equity: float, peak: float, ret: float) -> tuple[np.ndarray, list[tuple[str, float, float]]]:
        """(weights, [(gate, limit, observed)])."""
        events: list[tuple[str, float, float]] = []
        out = np.nan_to_num(target, posinf=0.0, neginf=0.0)
        if self.max_daily_loss is not None and ret <= -abs(self.max_daily_loss):
            out = self.cut(out, before)
            events.append(("max_daily_loss", -abs(self.max_daily_loss), ret))
        down = equity / peak - 1 if peak > 0 else 0.0
        if self.max_drawdown is not None and down <= -abs(self.max_drawdown):
            out = self.cut(out, before)
            events.append(("max_drawdown", -abs(self.max_drawdown), down))
        live = np.flatnonzero(np.abs(out) > 1e-12)
        if self.max_positions is not None and len(live) > self.max_positions:
            order = live[np.argsort(np.abs(out[live]), kind="stable")[::-1]]
            out = out.copy()
            out[order[self.max_positions :]] = 0.0
            events.append(("max_positions", float(self.max_positions), float(len(live))))
        move = out - before
        if self.max_order_size is not None and (np.abs(move) > self.max_order_size + 1e-12).any():
            events.append(("max_order_size", float(self.max_order_size), float(np.abs(move).max())))
            out = before + np.clip(move, -self.max_order_size, self.max_order_size)
        return out, events


CURVE = (
    f"{ID} string, ts date, equity double, ret double, turnover double, trade_cost double, selected int, gross double, gross_size double, cash double, "
    "weights map<string,double>, before map<string,double>, contributions map<string,double>, gates array<string>, "
    "gate_events array<struct<gate:string,limit:double,observed:double>>"
)


def full_grid(df: DataFrame) -> DataFrame:
    """A row for every asset of a backtest on every session of it: target 0 and no price where there was none."""
    sessions = df.groupBy(ID, "ts").agg(F.max(F.coalesce("rebalance", F.lit(False))).alias("trade"))
    assets = df.select(ID, "asset").distinct()
    rows = sessions.join(assets, ID).join(df.select(ID, "ts", "asset", "open", "close", "target"), [ID, "ts", "asset"], "left")
    return rows.withColumn("target", F.coalesce(F.nanvl("target", F.lit(0.0)), F.lit(0.0)))


def _settled(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint, if the session names a folder for them."""
    sc, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None and folder:
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df


STEP = ("ts", "half")


def _segments(rows: DataFrame) -> DataFrame:
    """rows (id, asset, ts, half, r, target, trade) with ret, before (weights just before the trade) and held.

    A segment runs from the bar after a start, where weights are set, to the next start. In it a holding is worth its first
    weight times its growth, the account the sum of them and cash. A bar on which all is lost leaves the
    weights as they were, so it is a start too; such bars are split off in rounds, one for each in a segment.
    """
    own, all_ = by_time(ID, "asset", order=STEP), Window.partitionBy(ID, *STEP)
    rows = rows.withColumns({"start": F.col("trade"), "w0": F.col("target")})
    while True:
        seg = rows.withColumns({
            "k": F.coalesce(F.sum(F.col("start").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_last": F.coalesce(F.lag("w0").over(own), F.lit(0.0)),
        })
        piece = by_time(ID, "asset", "k", order=STEP)
        seg = seg.withColumns({
            "_base": F.when(F.col("k") == 0, 0.0).otherwise(F.first("_last").over(piece)), "_g": compounded(1 + F.col("r"), piece.rowsBetween(Window.unboundedPreceding, 0)),
        })
        seg = seg.withColumn("_v", 1 + F.sum(F.col("_base") * (F.col("_g") - 1)).over(all_))
        seg = seg.withColumns({"_g1": F.coalesce(F.lag("_g").over(piece), F.lit(1.0)), "_v1": F.coalesce(F.lag("_v").over(piece), F.lit(1.0))})
        seg = seg.withColumns({
            "ret": F.col("_v") / F.col("_v1") - 1, "_was": F.col("_base") * F.col("_g1") / F.col("_v1"),
            "_lost": (F.col("_v") <= 0) & ~F.col("start") & (F.coalesce(F.min("_v").over(piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)) > 0),
        })
        seg = seg.withColumn("before", F.when(F.col("_v") > 0, F.col("_base") * F.col("_g") / F.col("_v")).otherwise(F.col("_was")))
        if seg.where("_lost").isEmpty():
            break
        rows = seg.select(*rows.columns, "_lost", "_was").withColumns({"start": F.col("start") | F.col("_lost"), "w0": F.when(F.col("_lost"), F.col("_was")).otherwise(F.col("w0"))}).drop("_lost", "_was")
        rows = _settled(rows)
    return seg.withColumn("held", F.when(F.col("trade"), F.col("target")).otherwise(F.col("before"))).withColumn("gain", F.col("_was") * F.col("r"))


def account(df: DataFrame, cost, gates=None, at: str = "close") -> DataFrame:
    """Drift accounting with sparse rebalances over (backtest_id, ts, asset, open, close, target, rebalance).

    Between rebalances weights drift with returns; at one, turnover is the sum of absolute weight
    changes and costs equity * turnover * cost. With at = "next_open" a session's target is traded at
    the next session's open: the night earns at the old weights, the day at the new ones. cost and
    gates may be dicts by backtest_id. Returns the equity curve with the weights before and after the
    trade and contributions as maps, and the gates that fired, with limit and observed value.

    Without gates windows do it all, spread over backtests, assets and sessions (a row of all assets of a session
    and the bars of one backtest, a few numbers each, are the largest units); with gates each backtest is folded.
    """
    if at not in ("close", "next_open"):
        raise ValueError(at)
    if gates:
        return folded_account(df, cost, gates, at)
    if "open" not in df.columns:
        df = df.withColumn("open", F.lit(None).cast("double"))
    rows = full_grid(df.withColumn(ID, F.col(ID).cast("string")))
    w = by_time(ID, "asset")
    clean = lambda now, then: F.coalesce(F.when(F.abs(r := div(now, F.nullif(then, F.lit(0.0))) - 1) < float("inf"), r), F.lit(0.0))
    last = F.lag("close").over(w)
    if at == "close":
        rows = rows.withColumn("r", clean(F.col("close"), last)).withColumn("half", F.lit(0))
    else:
        rows = rows.withColumns({
            "_night": clean(F.col("open"), last), "_day": clean(F.col("close"), F.col("open")), "target": F.coalesce(F.lag("target").over(w), F.lit(0.0)),
            "trade": F.coalesce(F.lag("trade").over(w), F.lit(False)),
        })
        halves = F.array(F.struct(F.lit(0).alias("half"), F.col("_night").alias("r"), F.col("trade").alias("t")), F.struct(F.lit(1).alias("half"), F.col("_day").alias("r"), F.lit(False).alias("t")))
        rows = rows.withColumn("_h", F.explode(halves)).select(ID, "asset", "ts", "target", "_h.half", "_h.r", F.col("_h.t").alias("trade"))
    rows = _segments(rows.select(ID, "asset", "ts", "half", "r", "target", "trade"))
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", c))))
    end = 0 if at == "close" else 1
    kept = lambda c, half: F.when(F.col("half") == half, F.col(c))
    bars = rows.groupBy(ID, *STEP).agg(
        F.first("ret").alias("ret"), F.sum(F.when(F.col("trade"), F.abs(F.col("held") - F.col("before"))).otherwise(0.0)).alias("turnover"),
        F.count_if(F.abs("held") > 1e-12).cast("int").alias("selected"), F.sum("held").alias("gross"), F.sum(F.abs("held")).alias("gross_size"),
        pairs("held").alias("weights"), pairs("before").alias("before"), pairs("gain").alias("contributions"),
    )
    steps = by_time(ID, order=STEP)
    rate = cost_column(cost)
    factor = (1 + F.col("ret")) * F.greatest(1 - F.col("turnover") * rate, F.lit(0.0))
    bars = bars.withColumn("equity", 100 * compounded(factor, steps.rowsBetween(Window.unboundedPreceding, 0)))
    bars = bars.withColumn("_start", F.coalesce(F.lag("equity").over(steps), F.lit(100.0)))
    bars = bars.withColumn("trade_cost", F.col("_start") * (1 + F.col("ret")) * F.col("turnover") * rate)
    if end:
        of = lambda c, half: F.max(kept(c, half)).alias(c)
        both = F.map_zip_with(F.max_by("contributions", -F.col("half")), F.max_by("contributions", "half"), lambda k, a, b: a + b)
        bars = bars.groupBy(ID, "ts").agg(
            ((1 + F.max(kept("ret", 0))) * (1 + F.max(kept("ret", 1))) - 1).alias("ret"), of("equity", 1), *[of(c, 0) for c in ("turnover", "trade_cost", "_start", "selected", "gross", "gross_size")],
            F.min_by("weights", "half").alias("weights"), F.min_by("before", "half").alias("before"), both.alias("contributions"),
        )
    return bars.select(
        ID, "ts", "equity", F.when(F.col("_start") == 0, 0.0).otherwise(F.col("ret")).alias("ret"), "turnover", "trade_cost", "selected", "gross", "gross_size", F.greatest(1 - F.col("gross"), F.lit(0.0)).alias("cash"),
        "weights", "before", "contributions", F.array().cast("array<string>").alias("gates"), F.array().cast("array<struct<gate:string,limit:double,observed:double>>").alias("gate_events"),
    )


def accounting_summary(curve: DataFrame) -> DataFrame:
    """Per backtest: start_equity, final_equity, total_return, checkpoints (sessions), active_rebalances, average_turnover
    and average_gross_exposure (by size), both over all sessions."""
    return curve.groupBy(ID).agg(
        F.lit(100.0).alias("start_equity"), F.max_by("equity", "ts").alias("final_equity"), (F.max_by("equity", "ts") / 100 - 1).alias("total_return"), F.count("*").alias("checkpoints"),
        F.count_if(F.col("turnover") > 1e-12).alias("active_rebalances"), F.avg("turnover").alias("average_turnover"), F.avg("gross_size").alias("average_gross_exposure"),
    )


def folded_account(df: DataFrame, cost, gates=None, at: str = "close") -> DataFrame:
    """account as a fold of each backtest, session by session, which gates need; a backtest's history must fit a task."""
    late = at == "next_open"

    def returns(now: np.ndarray, then: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            r = now / np.where(then == 0, np.nan, then) - 1
        return np.where(np.isfinite(r), r, 0.0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[ID].iloc[0]
        own = name.split("|")[0]
        rate = cost[own] if isinstance(cost, dict) else cost
        gate = gates.get(own) if isinstance(gates, dict) else gates
        wide = lambda c: pdf.pivot(index="ts", columns="asset", values=c).sort_index()
        close = wide("close")
        target = wide("target").reindex_like(close).fillna(0.0).to_numpy()
        trade = pdf.groupby("ts")["rebalance"].max().reindex(close.index).fillna(False).to_numpy(bool)
        names, p = list(close.columns), close.to_numpy(float)
        night = returns(wide("open").reindex_like(close).to_numpy(float)[1:], p[:-1]) if late else returns(p[1:], p[:-1])
        night = np.vstack([np.zeros(len(names)), night])
        day = returns(p, wide("open").reindex_like(close).to_numpy(float)) if late else None
        if late:
            target, trade = np.vstack([np.zeros(len(names)), target[:-1]]), np.append(False, trade[:-1])
        weight, equity, peak, rows = np.zeros(len(names)), 100.0, 100.0, []

        def earn(r):
            nonlocal weight, equity
            gain = weight * r
            total = float(gain.sum())
            equity *= 1 + total
            if 1 + total > 0:
                weight = weight * (1 + r) / (1 + total)
            return gain, total

        for t, ts in enumerate(close.index):
            start = equity
            gain, ret = earn(night[t])
            peak = max(peak, equity)
            turnover = paid = 0.0
            fired: list[tuple[str, float, float]] = []
            before = weight
            if trade[t]:
                new = target[t]
                if gate is not None:
                    new, fired = gate.apply(new, weight, equity, peak, ret)
                turnover = float(np.abs(new - weight).sum())
                paid = equity * turnover * rate
                equity *= max(0.0, 1 - turnover * rate)
                weight = new
            held = weight
            if late:
                more, of_day = earn(day[t])
                gain, ret = gain + more, (1 + ret) * (1 + of_day) - 1
                peak = max(peak, equity)
            rows.append((
                name, ts, equity, ret if start else 0.0, turnover, paid, int((np.abs(held) > 1e-12).sum()), float(held.sum()), float(np.abs(held).sum()), max(0.0, 1 - float(held.sum())), dict(zip(names, held.tolist())),
                dict(zip(names, before.tolist())), dict(zip(names, gain.tolist())), [e[0] for e in fired], [dict(zip(("gate", "limit", "observed"), e)) for e in fired],
            ))
        return pd.DataFrame(rows, columns=["backtest_id", "ts", "equity", "ret", "turnover", "trade_cost", "selected", "gross", "gross_size", "cash", "weights", "before", "contributions", "gates", "gate_events"])

    if "open" not in df.columns:
        df = df.withColumn("open", F.lit(None).cast("double"))
    return df.select(F.col(ID).cast("string"), "ts", "asset", "open", "close", "target", "rebalance").groupBy(ID).applyInPandas(one, CURVE)


def holdings(curve: DataFrame) -> DataFrame:
    """(backtest_id, ts, asset, weight) after each session's trade, from an account's curve."""
    return curve.select(ID, "ts", F.explode("weights").alias("asset", "weight")).where(F.abs("weight") > 1e-12)


def gate_events(curve: DataFrame) -> DataFrame:
    """(backtest_id, ts, gate, limit, observed), one row per gate that fired."""
    return curve.select(ID, "ts", F.explode("gate_events").alias("e")).select(ID, "ts", "e.gate", "e.limit", "e.observed")


def rebalance_audit(curve: DataFrame) -> DataFrame:
    """Sessions of an account on which weights were traded: turnover, trade_cost, equity, selected, gross."""
    return curve.where("turnover > 1e-12").select(ID, "ts", "turnover", "trade_cost", "equity", "selected", "gross")


def _trades(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Trades with share and cost from rows with before, target, turnover and trade_cost of their session."""
    from .signals import action_label

    rows = rows.withColumn("delta", F.col("target") - F.col("before")).withColumn("action", action_label(F.col("before"), F.col("target")))
    share = div(F.abs("delta"), F.col("turnover"))
    return rows.where(F.abs("delta") > 1e-12).withColumns({"share": share, "cost": share * F.col("trade_cost")})


def trade_reason(before, target, action, rank=None, eligible=None, rank_by: str = ""):
    """Why an asset was traded: its rank (and by what), that it was not selected, whether it was eligible; else target unchanged."""
    rank = F.lit(None) if rank is None else rank
    eligible = rank.isNotNull() if eligible is None else F.coalesce(eligible, F.lit(False))
    place = F.when(rank.isNotNull(), F.concat(F.lit("rank "), rank.cast("string"), F.lit(f" by {rank_by}" if rank_by else "")))
    place = F.coalesce(place, F.when((before > 0) & (target <= 0), F.lit("not selected at this rebalance")))
    said = F.concat_ws("; ", place, F.when(eligible, F.lit("eligible")).when(action != "hold", F.lit("not eligible")))
    return F.when(said == "", "target unchanged").otherwise(said)


def gate_summary(curve: DataFrame) -> DataFrame:
    """Per backtest: event_count, gates_triggered (sorted names), first and last session with an event; 0 and none without one."""
    found = gate_events(curve).groupBy(ID).agg(
        F.count("*").alias("event_count"), F.array_sort(F.collect_set("gate")).alias("gates_triggered"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event")
    )
    every = curve.select(ID).distinct().join(found, ID, "left")
    return every.withColumns({"event_count": F.coalesce("event_count", F.lit(0)), "gates_triggered": F.coalesce("gates_triggered", F.array().cast("array<string>"))})


def run_report(curve: DataFrame, trades: DataFrame) -> DataFrame:
    """What an export must hold, per backtest: rows of the curve, holdings, rebalances, trades and gate events, and assets with a weight."""
    counts = curve.groupBy(ID).agg(
        F.count("*").alias("equity_rows"), F.sum(F.aggregate(F.map_values("weights"), F.lit(0), lambda a, w: a + (F.abs(w) > 1e-12).cast("int"))).alias("holding_rows"),
        F.count_if(F.col("turnover") > 1e-12).alias("rebalance_rows"), F.sum(F.size("gate_events")).alias("gate_event_rows"), F.max(F.size("weights")).alias("weight_columns"),
    )
    traded = trades.groupBy(ID).agg(F.count("*").alias("trade_rows"))
    return counts.join(traded, ID, "left").withColumn("trade_rows", F.coalesce("trade_rows", F.lit(0)))


def account_trades(curve: DataFrame) -> DataFrame:
    """(backtest_id, ts, asset, before, target, delta, action, share, cost): the trades of an account's curve,
    against the drifted weights; the session's cost is dealt out by size."""
    moved = curve.where("turnover > 1e-12").select(ID, "ts", "turnover", "trade_cost", "before", F.explode("weights").alias("asset", "target"))
    rows = moved.withColumn("before", F.coalesce(F.col("before")[F.col("asset")], F.lit(0.0)))
    return _trades(rows, (ID,)).select(ID, "ts", "asset", "before", "target", "delta", "action", "share", "cost")


def rebalance_trades(df: DataFrame, cost, keys: tuple[str, ...] = (ID,)) -> DataFrame:
    """Trades of an every-bar target frame, with before (the drifted weight), delta, action, share by size, and
    the asset's part of the session's cost; with a column score in the frame also its rank on the day."""
    rows = before_trades(df, keys)
    bars = _curve(rows, cost, keys).select(*keys, "ts", "turnover", "trade_cost")
    return _trades(rows.drop("_p").join(bars, [*keys, "ts"]), keys)


def invariant_breaches(curve: DataFrame, long_only: bool = True, max_gross: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """Rows (backtest_id, ts, code, value) where an equity curve breaks an account rule; each rule is one filter. max_gross
    limits the sum of sizes (gross_size, or the size of gross in curves without it)."""
    size = F.col("gross_size") if "gross_size" in curve.columns else F.abs("gross")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rules = {
        "non_finite_equity": (bad(F.col("equity")), F.col("equity")), "non_finite_return": (bad(F.col("ret")), F.col("ret")),
        "negative_fee": (F.col("trade_cost") < -tolerance, F.col("trade_cost")), "negative_turnover": (F.col("turnover") < -tolerance, F.col("turnover")),
        "negative_cash": ((1 - F.col("gross") < -tolerance) & F.lit(long_only), 1 - F.col("gross")),
        "max_gross": (size > max_gross + tolerance, size), "negative_equity": (F.col("equity") < 0, F.col("equity")),
    }
    checks = F.array(*[F.struct(F.lit(k).alias("code"), hit.alias("hit"), v.cast("double").alias("value")) for k, (hit, v) in rules.items()])
    return curve.select(ID, "ts", F.explode(checks).alias("c")).where("c.hit").select(ID, "ts", "c.code", "c.value")


def position_breaches(curve: DataFrame, panel: DataFrame | None = None, trades: DataFrame | None = None, long_only: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """Rows (backtest_id, ts, asset, code, value) where an account's positions, prices (panel: ts, asset, close)
    or trades (see account_trades) break a rule. Equity must be what the last equity, the return and the
    cost make of it; trades added up must give the weights that are held, beside their drift.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    found = lambda rows, hit, code, value, asset: rows.where(hit).select(ID, "ts", asset.cast("string").alias("asset"), F.lit(code).alias("code"), value.cast("double").alias("value"))
    held = curve.select(ID, "ts", F.explode("weights").alias("asset", "weight"))
    weight, asset = F.col("weight"), F.col("asset")
    out = found(held, bad(weight), "non_finite_position_qty", weight, asset)
    add = lambda more: out.unionByName(more)
    if long_only:
        out = add(found(held, weight < -tolerance, "long_only_negative_position", weight, asset))
    last = F.coalesce(F.lag("equity").over(by_time(ID)), F.lit(100.0))
    made = curve.withColumn("_gap", F.col("equity") - (last * (1 + F.col("ret")) - F.col("trade_cost")))
    out = add(found(made, F.abs("_gap") > tolerance * F.greatest(F.abs("equity"), F.lit(1.0)), "equity_cash_market_value_mismatch", F.col("_gap"), F.lit(None)))
    value = curve.withColumn("_gap", F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x) - F.col("gross"))
    out = add(found(value, F.abs("_gap") > tolerance, "market_value_positions_prices_mismatch", F.col("_gap"), F.lit(None)))
    if panel is not None:
        prices = panel.select(F.lit(None).cast("string").alias(ID), "ts", "asset", "close")
        out = add(found(prices, bad(F.col("close")), "non_finite_price", F.col("close"), asset))
    if trades is not None:
        cost, target = F.col("cost"), F.col("target")
        out = add(found(trades, bad(cost) | (cost < -tolerance), "trade_record_negative_or_non_finite_fee", cost, asset))
        if long_only:
            out = add(found(trades, target < -tolerance, "trade_record_long_only_negative_position", target, asset))
        both = trades.join(held, [ID, "ts", "asset"], "left").withColumn("_gap", F.col("before") + F.col("delta") - F.coalesce("weight", F.lit(0.0)))
        out = add(found(both, F.abs("_gap") > tolerance, "trade_record_position_reconciliation_mismatch", F.col("_gap"), asset))
    return out


def cost_status(curve: DataFrame, cost: float) -> DataFrame:
    """Per backtest: not_configured, no_turnover, valid or invalid_cost_accounting."""
    return curve.groupBy(ID).agg(F.sum("turnover").alias("t"), F.sum("trade_cost").alias("c")).select(
        ID,
        F.when(F.lit(cost) == 0, "not_configured").when(F.col("t") <= 1e-12, "no_turnover").when(F.col("c") > 0, "valid").otherwise("invalid_cost_accounting").alias("status"),
    )


def checked(df: DataFrame, long_only: bool = True, max_gross: float = 1.0) -> DataFrame:
    """The frame, failing at run time on a non-finite close, a short target in a long-only account, or gross above max_gross."""
    gross = F.sum(F.abs("target")).over(Window.partitionBy(ID, "ts"))
    bad = (
        F.when(F.isnan("close") | (F.abs("close") == float("inf")), F.lit("non-finite price"))
        .when((F.col("target") < -1e-12) & F.lit(long_only), F.lit("short target in a long-only account")).when(F.col("_gross") > max_gross + 1e-9, F.lit("gross exposure above the limit"))
    )
    rows = df.withColumn("_gross", gross)
    return rows.withColumn("_ok", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.lit(True))).where("_ok").drop("_ok", "_gross")


def universe_report(members: DataFrame, configured: DataFrame, as_of) -> DataFrame:
    """One row about a constituents table (asset, start, end) against configured assets (asset): rows,
    symbols, duplicates, missing configured symbols, members at as_of, and a status."""
    n = members.agg(F.count("*").alias("row_count"), F.count_distinct("asset").alias("symbols"))
    twice = members.groupBy("asset", "start", "end").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    missing = configured.select("asset").distinct().join(members.select("asset"), "asset", "left_anti").agg(F.count("*").alias("missing"))
    live = members.where((F.col("start") <= as_of) & (F.col("end").isNull() | (F.col("end") >= as_of))).agg(F.count_distinct("asset").alias("covered"))
    row = n.crossJoin(twice).crossJoin(missing).crossJoin(live)  # one row each
    return row.withColumn("status", F.when(F.col("row_count") == 0, "invalid").when((F.col("missing") > 0) | (F.col("covered") == 0), "invalid").when(F.col("duplicate_rows") > 0, "warning").otherwise("valid"))
