"""Single-asset trade simulation: one ordered fold per backtest, and closed forms where there is no state."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div, upto


@dataclass(frozen=True)
class Rules:
    """delay: bars from signal to fill. price: open or close. long_bars, short_bars: exit after so many
    held bars (0: never), joined with exit signals by combine: or, and, timer_only, or "" (and if other
    exits exist, else timer alone). reset: a same-side entry signal restarts the timer."""

    delay: int = 0
    price: str = "close"
    cost: float = 0.0
    slippage: float = 0.0
    long_bars: int = 0
    short_bars: int = 0
    combine: str = ""
    other_exits: bool = False
    reset: bool = False


def leave(signal: bool, due: bool, timed: bool, r: Rules) -> bool:
    """Does a position close, given an exit signal and a due timer?"""
    if not timed:
        return signal
    how = r.combine or ("and" if r.other_exits else "timer_only")
    return {"and": signal and due, "or": signal or due, "timer_only": due}[how]


def fold(entry: np.ndarray, exit_: np.ndarray, price: np.ndarray, r: Rules) -> dict[str, np.ndarray]:
    """The state machine over one backtest's bars.

    entry: 1 long, -1 short; exit_: -1 leaves long, 1 leaves short. Equity starts at 100. A position is
    marked every bar from its fill price; costs come off at both fills. ret is the equity's change,
    costs included; held_ret the bar's return of a position held into it, before the costs of leaving
    it (0 on the bar of an entry and when flat); open_ret the return since the entry (0 when flat).
    """
    n = len(price)
    entry, exit_ = (np.concatenate([np.zeros(min(r.delay, n)), x])[:n] for x in (entry, exit_))
    fee = (1 - r.slippage) * (1 - r.cost)
    position, action, equity, open_ret, held_ret = np.zeros(n), np.zeros(n, int), np.empty(n), np.zeros(n), np.zeros(n)
    side, cash, fill, held = 0, 1.0, 0.0, 0
    for t in range(n):
        worth = cash
        if side:
            held += 1
            if fill > 0:
                open_ret[t] = side * (price[t] / fill - 1)
                worth = cash * (1 + open_ret[t])
                held_ret[t] = 100 * worth / equity[t - 1] - 1 if equity[t - 1] > 0 else 0.0
            bars = r.long_bars if side > 0 else r.short_bars
            if r.reset and entry[t] == side:
                held = 0
            if leave(exit_[t] == -side, 0 < bars <= held, bars > 0, r):
                side, action[t] = 0, 4
                worth *= fee
                cash = worth
        elif entry[t] in (1, -1):
            side, action[t], fill, held = int(entry[t]), 1, price[t], 0
            worth *= fee
            cash = worth
        position[t], equity[t] = side, 100 * worth
    before = np.concatenate([[np.nan], equity[:-1]])
    return {"position": position, "action": action, "equity": equity, "ret": np.nan_to_num(equity / before - 1), "held_ret": held_ret, "open_ret": open_ret}


COLUMNS = "position double, action int, equity double, ret double, held_ret double, open_ret double"


def simulate(df: DataFrame, rules: Rules, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Simulate each backtest of a frame with ts, open, close, entry, exit; adds position, action (1 open, 4 close), equity, ret, held_ret, open_ret."""
    keep = list(df.columns)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        num = lambda c: pdf[c].fillna(0).to_numpy(float)
        return pd.concat([pdf[keep], pd.DataFrame(fold(num("entry"), num("exit"), num(rules.price), rules))], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(one, f"{fields}, {COLUMNS}")


def ledger(sim: DataFrame, price: str = "close", keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Trade ledger columns from position and action: trade_seq, type_code (1 new long, 2 new short, 3 close
    long, 4 close short), open_price, holding count and, on closing rows, trade_return. Windows only."""
    w = by_time(*keys)
    rows = sim.withColumns({
        "_seq": F.sum((F.col("action") == 1).cast("long")).over(upto(*keys)), "_prev": F.coalesce(F.lag("position").over(w), F.lit(0.0)),
    })
    rows = rows.withColumn("_on", (F.col("action") != 0) | (F.col("position") != 0))
    trade = Window.partitionBy(*keys, "_seq", "_on").orderBy("ts")
    first = F.first(price).over(trade)
    closing = F.col("action") == 4
    out = rows.withColumns({
        "trade_seq": F.when(F.col("_on"), F.col("_seq")).otherwise(0),
        "type_code": F.when(F.col("action") == 1, F.when(F.col("position") > 0, 1).otherwise(2)).when(closing, F.when(F.col("_prev") > 0, 3).otherwise(4)).otherwise(0),
        "trade_open_price": F.when(F.col("_on"), first), "holding_count": F.when(F.col("_on"), F.row_number().over(trade) - 1).otherwise(0).cast("long"),
    })
    sign = F.when(F.col("_prev") > 0, 1.0).otherwise(-1.0)
    return out.withColumn("trade_return", F.when(closing, sign * (div(F.col(price), F.col("trade_open_price")) - 1))).drop("_seq", "_prev", "_on")


def compounded(factor: Column, window=None) -> Column:
    """Product of the factors of any sign, running over a window or of a group: 0 from the first 0 on."""
    over = (lambda c: c) if window is None else (lambda c: c.over(window))
    size = F.exp(over(F.sum(F.ln(F.nullif(F.abs(factor), F.lit(0.0))))))
    odd = over(F.sum((factor < 0).cast("int"))) % 2 == 1
    return F.when(over(F.max((factor == 0).cast("int"))) == 1, 0.0).otherwise(F.coalesce(F.when(odd, -size).otherwise(size), F.lit(1.0)))


def same_session(df: DataFrame, cost: float, slippage: float, side: int = 1, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Round trip within each signalled bar: in at the open, out at the close, costs at both ends.
    Bars with an unusable price are skipped and marked. Adds traded, skipped, ret, equity."""
    fee = (1 - slippage) * (1 - cost)
    good = F.coalesce((F.col("open") > 0) & (F.col("close") > 0), F.lit(False))
    rows = df.withColumns({"traded": F.col("entry") & good, "skipped": F.col("entry") & ~good})
    factor = F.when(F.col("traded"), (1 + side * (F.col("close") / F.col("open") - 1)) * fee * fee).otherwise(1.0)
    rows = rows.withColumn("ret", factor - 1)
    return rows.withColumn("equity", 100 * compounded(1 + F.col("ret"), upto(*keys)))


def bar_offset(df: DataFrame, enter: int, leave_: int, enter_at: str = "open", leave_at: str = "close", keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Round trips from bar t+enter to bar t+leave_ of each signal; signals past the data are dropped.

    One row per trade: ts (signal), enter_ts, leave_ts, ret. A trade that begins before the last one
    ends is an error when the rows are computed.
    """
    w = by_time(*keys)
    rows = df.withColumns({
        "_i": F.row_number().over(w), "enter_ts": F.lead("ts", enter).over(w), "leave_ts": F.lead("ts", leave_).over(w),
        "_p": F.lead(enter_at, enter).over(w), "_q": F.lead(leave_at, leave_).over(w),
    }).where(F.col("entry") & F.col("leave_ts").isNotNull())
    overlap = F.lag(F.col("_i") + leave_).over(w) > F.col("_i") + enter
    rows = rows.withColumn("_ok", F.when(overlap, F.raise_error(F.lit("overlapping trades"))).otherwise(F.lit(True)))
    return rows.where("_ok").select(*keys, "ts", "enter_ts", "leave_ts", (div(F.col("_q"), F.col("_p")) - 1).alias("ret"))


def timer_exit(df: DataFrame, bars: int, combine: str = "or", reset: bool = False, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Replace the exit mask by one that leaves ``bars`` rows after an entry (or / and / timer_only with the given exits)."""
    keep = list(df.columns)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        entry, exit_ = pdf["entry"].to_numpy(bool), pdf["exit"].to_numpy(bool)
        out, since = np.zeros(len(pdf), bool), None
        for t in range(len(pdf)):
            if since is not None:
                if reset and entry[t]:
                    since = t
                due = t - since >= bars
                if {"or": exit_[t] or due, "and": exit_[t] and due, "timer_only": due}[combine]:
                    out[t], since = True, None
            elif entry[t]:
                since = t
        return pdf.assign(exit=out)[keep]

    return df.groupBy(*keys).applyInPandas(one, df.schema)
