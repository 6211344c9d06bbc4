"""Rolling indicators on long panels (asset, ts, open, high, low, close, volume).

All but the recursive ones are window expressions over one (asset, ts) ordering, so any number of
them shares a single shuffle. A value is NULL until its window is full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div, pct_change, trailing
from . import blocks

KEY = "asset"


def full(value: Column, x: Column, n: int) -> Column:
    """value where the last n rows all have x."""
    return F.when(F.count(x).over(trailing(n, KEY)) >= n, value)


def sma(x: Column, n: int = 14) -> Column:
    return full(F.avg(x).over(trailing(n, KEY)), x, n)


def momentum(x: Column, n: int = 14) -> Column:
    return pct_change(x, by_time(KEY), n)


def volatility(x: Column, n: int = 14, annualize: bool = True, returns: Column | None = None) -> Column:
    """Sample deviation of one-bar returns; ``returns`` must be a materialised column of pct_change(x)."""
    r = returns if returns is not None else pct_change(x, by_time(KEY))
    s = full(F.stddev_samp(r).over(trailing(n, KEY)), r, n)
    return s * math.sqrt(252) if annualize else s


def zscore(x: Column, n: int = 14) -> Column:
    w = trailing(n, KEY)
    return full(div(x - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))), x, n)


def percentile(x: Column, n: int = 14, q: float = 50.0) -> Column:
    return full(F.percentile(x, F.lit(q / 100)).over(trailing(n, KEY)), x, n)


def bollinger(x: Column, n: int = 20, k: float = 2.0, band: str = "middle", population: bool = False) -> Column:
    w = trailing(n, KEY)
    mid = F.avg(x).over(w)
    dev = (F.stddev_pop(x) if population else F.stddev_samp(x)).over(w) * k
    bands = {
        "middle": mid, "upper": mid + dev, "lower": mid - dev, "width": div(2 * dev, mid), "percent_b": div(x - (mid - dev), 2 * dev),
    }
    if band not in bands:
        raise ValueError(f"band must be one of {sorted(bands)}")
    return full(bands[band], x, n)


def rsi(change: Column, n: int = 14) -> Column:
    """Simple-average RSI from a materialised one-bar change; NULL without losses."""
    w = trailing(n, KEY)
    gain, loss = F.avg(F.greatest(change, F.lit(0.0))).over(w), F.avg(F.greatest(-change, F.lit(0.0))).over(w)
    return full(100 - div(F.lit(100.0), 1 + div(gain, loss)), change, n)


def true_range(prev_close: Column) -> Column:
    """From a materialised previous close; the first bar has high - low only."""
    h, low = F.col("high"), F.col("low")
    return F.greatest(h - low, F.abs(h - prev_close), F.abs(low - prev_close))


def with_helpers(bars: DataFrame, x: str = "close") -> DataFrame:
    """Add prev_close, change, ret and tr, which nested indicators need as columns."""
    w = by_time(KEY)
    out = bars.withColumn("prev_close", F.lag(x).over(w))
    return out.withColumns({
        "change": F.col(x) - F.col("prev_close"), "ret": div(F.col(x), F.col("prev_close")) - 1, "tr": true_range(F.col("prev_close")),
    })


# Recursive filters: exponential averages over blocks of time (see blocks.averages).


def recursive(bars: DataFrame, specs: dict[str, dict], block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Add recursive indicators: name -> {op: ema|macd|atr|legacy_ema, source, period, fast, slow, signal, output, method}.

    All averages that only need bars share one pass, signal lines of MACD a second one. Histories of more than
    block_rows rows are cut into blocks of time, so an asset's history may be longer than a task holds. A
    Wilder average starts from the first full simple average; legacy_ema has no warm-up.
    """
    at = blocks.cuts([bars], rows=block_rows)
    fields, w = bars.columns, by_time(KEY)
    alpha = lambda span: 2.0 / (span + 1)
    helpers, first, second, out = {}, {}, {}, {}
    seen = lambda c, n: F.count(F.col(c)).over(w.rowsBetween(Window.unboundedPreceding, 0)) >= n
    if any(s["op"] == "atr" for s in specs.values()):
        bars = bars.withColumn("_tr", true_range(F.lag("close").over(w)))
    for i, (name, s) in enumerate(specs.items()):
        op, x = s["op"], s.get("source", "close")
        if op in ("ema", "legacy_ema"):
            n = s.get("period", 14)
            first[f"_e{i}"] = (x, alpha(n))
            out[name] = F.col(f"_e{i}") if op == "legacy_ema" else F.when(seen(x, n), F.col(f"_e{i}"))
        elif op == "macd":
            fast, slow, signal = s.get("fast", 12), s.get("slow", 26), s.get("signal", 9)
            first[f"_f{i}"], first[f"_s{i}"] = (x, alpha(fast)), (x, alpha(slow))
            line = F.when(seen(x, max(fast, slow)), F.col(f"_f{i}") - F.col(f"_s{i}"))
            helpers[f"_l{i}"] = line
            second[f"_g{i}"] = (f"_l{i}", alpha(signal))
            sig = F.when(seen(f"_l{i}", signal), F.col(f"_g{i}"))
            out[name] = {"line": F.col(f"_l{i}"), "signal": sig, "histogram": F.col(f"_l{i}") - sig}[s.get("output", "line")]
        elif op == "atr":
            n, how = s.get("period", 14), s.get("method", "wilder")
            if how == "wilder":
                place = F.row_number().over(w)
                bars = bars.withColumn(f"_w{i}", F.when(place == n, F.avg("_tr").over(trailing(n, KEY))).when(place > n, F.col("_tr")))
                first[f"_e{i}"] = (f"_w{i}", 1.0 / n)
                out[name] = F.col(f"_e{i}")
            elif how == "ema":
                first[f"_e{i}"] = ("_tr", alpha(n))
                out[name] = F.when(seen("_tr", n), F.col(f"_e{i}"))
            else:
                out[name] = full(F.avg("_tr").over(trailing(n, KEY)), F.col("_tr"), n)
        else:
            raise ValueError(f"unknown recursive indicator {op}")
    rows = blocks.averages(bars, first, KEY, at) if first else bars
    rows = rows.withColumns(helpers) if helpers else rows
    rows = blocks.averages(rows, second, KEY, at) if second else rows
    return rows.withColumns(out).select(*fields, *specs)


#: Families whose signals are in {-1, 0, 1} and whose warm-up is 0.


def ma(x: Column, n: int, kind: str = "sma") -> Column:
    """Moving average with 0 for the warm-up; weighted averages weigh the newest bar most. Its exponential kind is recursive()'s legacy_ema."""
    w = by_time(KEY)
    if kind == "sma":
        y = F.avg(x).over(trailing(n, KEY))
    elif kind == "wma":
        y = sum((n - i) * F.lag(x, i).over(w) for i in range(n)) / (n * (n + 1) / 2)
    else:
        raise ValueError(kind)
    return F.when(F.row_number().over(w) >= n, y).otherwise(0.0)


def crossing(up_now: Column, up_before: Column, down_now: Column, down_before: Column, up: int = 1, down: int = -1) -> Column:
    return F.coalesce(F.when(up_now & up_before, up).when(down_now & down_before, down), F.lit(0))


def price_cross(x: Column, line: Column, prev_x: Column, prev_line: Column, started: Column, side: str) -> Column:
    """+1 (side up_long, down_long) or -1 (up_short, down_short) when x crosses the line; 0 before both bars are there."""
    over, under = (x > line) & (prev_x <= prev_line), (x < line) & (prev_x >= prev_line)
    way, sign = side.split("_")
    return F.when(started & (over if way == "up" else under), 1 if sign == "long" else -1).otherwise(0)


def combined(*signals: Column) -> Column:
    """Legacy signals on one bar, added up; a missing one counts 0."""
    return sum((F.coalesce(s, F.lit(0)) for s in signals), F.lit(0))


def run_of(cond: Column, m: int) -> Column:
    """Whether the last m rows all satisfy cond (False until m rows are there); cond must be a materialised column."""
    w = trailing(m, KEY)
    return (F.count(F.lit(1)).over(w) >= m) & (F.min(cond.cast("int")).over(w) == 1)


def rising_edge(cond: Column) -> Column:
    """cond and not cond one bar earlier; cond must be a materialised column."""
    return cond & ~F.coalesce(F.lag(cond).over(by_time(KEY)), F.lit(False))
