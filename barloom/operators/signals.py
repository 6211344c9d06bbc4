"""Masks and scores to positions, selections and target weights; trigger and timer rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div, upto


def state_event(entry: Column, exit_: Column, policy: str = "exit_then_entry") -> Column:
    """1 where a position is entered, 0 where it is left, else NULL. On a bar with both: exit_then_entry enters
    (the later one wins), entry_then_exit leaves, flat_on_conflict leaves."""
    if policy not in ("exit_then_entry", "entry_then_exit", "flat_on_conflict"):
        raise ValueError(policy)
    enter = F.when(entry, 1).when(exit_, 0)
    return enter if policy == "exit_then_entry" else F.when(exit_, 0).when(entry, 1)


def state_position(entry: Column, exit_: Column, policy: str = "exit_then_entry", keys: tuple[str, ...] = ("asset",), next_open: bool = False) -> Column:
    """1 or 0 carried forward from the last state_event. next_open acts one bar later."""
    event = state_event(entry, exit_, policy)
    if next_open:
        event = F.lag(event).over(by_time(*keys))
    return F.coalesce(F.last(event, ignorenulls=True).over(upto(*keys)), F.lit(0))


def ranked(df: DataFrame, score: str, eligible: str | None = None, ascending: bool = False, reverse_ties: bool = False, n: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add rank within each (keys, ts) of rows that are eligible and have a score (NULL for others); ties by asset,
    backwards with reverse_ties. With n, selected marks the first n."""
    ok = F.col(score).isNotNull() if eligible is None else F.col(score).isNotNull() & F.col(eligible)
    by = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy(*keys, "ts", "_ok").orderBy(by, F.col("asset").desc() if reverse_ties else F.col("asset"))
    out = df.withColumn("_ok", ok).withColumn("rank", F.when(F.col("_ok"), F.row_number().over(w))).drop("_ok")
    return out if n is None else out.withColumn("selected", F.coalesce(F.col("rank") <= n, F.lit(False)))


def equal_weight(selected: Column, limit=1.0, keys: tuple[str, ...] = ()) -> Column:
    """min(1/k, limit) for the k selected assets of a (keys, ts); the rest is cash. limit is a number or a column."""
    k = F.sum(selected.cast("int")).over(Window.partitionBy(*keys, "ts"))
    return F.when(selected, F.least(div(F.lit(1.0), k.cast("double")), limit if isinstance(limit, Column) else F.lit(float(limit)))).otherwise(0.0)


def fixed_weight(weights: dict[str, float], profiles: dict[str, dict[str, float]] | None = None, profile: str | None = None, normalize: bool = True, asset: str = "asset", signed: bool = False) -> Column:
    """Given weights by asset, or those of a named profile; negative ones count 0 (unless ``signed``), and they
    are scaled down only if their sizes add up to more than 1 (and not at all without ``normalize``)."""
    if profile is not None:
        if profile not in (profiles or {}):
            raise ValueError(f"unknown weight profile {profile!r}")
        weights = profiles[profile]
    weights = {a: float(w) if signed else max(0.0, float(w)) for a, w in weights.items()}
    total = sum(map(abs, weights.values()))
    scale = 1.0 / total if total > 1 and normalize else 1.0
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(F.col(asset) == name, w * scale).otherwise(out)
    return out


def frame_weight(target: Column, allow_short: bool = False, max_gross: float = 1.0) -> Column:
    """A given target: shorts clipped to 0 unless allowed, scaled to max_gross where a ts exceeds it. target must be a column."""
    t = F.coalesce(target, F.lit(0.0))
    t = t if allow_short else F.greatest(t, F.lit(0.0))
    gross = F.sum(F.abs(t)).over(Window.partitionBy("ts"))
    return F.when(gross > max_gross, t * max_gross / gross).otherwise(t)


def changed(target: str = "target", tolerance: float = 1e-12, keys: tuple[str, ...] = ()) -> Column:
    """signal.change: does any asset's target of this (keys, ts) differ from its last one? target must be a materialised column."""
    moved = F.abs(F.col(target) - F.coalesce(F.col("_prev_target"), F.lit(0.0))) > tolerance
    return F.max(moved.cast("int")).over(Window.partitionBy(*keys, "ts")) == 1


def with_change(df: DataFrame, target: str = "target", name: str = "rebalance", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("_prev_target", F.lag(target).over(by_time(*keys, "asset"))).withColumn(name, changed(target, keys=keys)).drop("_prev_target")


def action_label(before: Column, after: Column) -> Column:
    """buy, sell, exit, hold, new_short or close_short, within 1e-12."""
    e = 1e-12
    return (
        F.when((before < -e) & (F.abs(after) <= e), "close_short").when((F.abs(before) > e) & (F.abs(after) <= e), "exit")
        .when((after < -e) & (before >= -e), "new_short").when(after > before + e, "buy").when(after < before - e, "sell").otherwise("hold")
    )


def lookahead_problems(execution: str, entry_fields: list[str], completed: set[str]) -> list[str]:
    """Same-session and bar-offset execution may not use values that only the bar's close completes."""
    if execution not in ("same_session", "bar_offset"):
        return []
    late = {"close", "price.close", *completed}
    return [f"entry uses {f!r}, known only after the bar closes" for f in entry_fields if f.lower() in {x.lower() for x in late}]
