"""Features of many sources joined to a panel as a contract document says: join mode, tolerance, fill, lag and audit of each.

All sources are merged with the base and put in time order once (align.carried); what a contract asks for
on top are windows over the panel's own bars, which share one more ordering.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import align, blocks

MODES = ("asof", "left", "inner")
FILLS = ("none", "ffill", "bfill", "zero")


def problems(doc: dict, sources: Mapping[str, DataFrame] | None = None) -> list[str]:
    """What is wrong with a contract; empty if nothing is."""
    out, seen = [], set()
    key = doc.get("primary_key", {})
    if not isinstance(key.get("time_field"), str):
        out.append("primary_key.time_field is missing")
    default = doc.get("alignment_policy", {}).get("join_mode", "asof")
    for item in doc.get("features", []):
        name, source = item.get("field"), item.get("source", {})
        if not isinstance(name, str) or not source.get("column"):
            out.append(f"feature {name!r} needs a field and a source column")
            continue
        if name in seen:
            out.append(f"field {name} is given twice")
        seen.add(name)
        if (mode := item.get("join_mode", default)) not in MODES:
            out.append(f"unknown join mode {mode!r} of {name}")
        fill = item.get("fill_policy", "none")
        if fill not in FILLS:
            out.append(f"unknown fill policy {fill!r} of {name}")
        if fill == "bfill" and not name.startswith("label."):
            out.append(f"{name} cannot use bfill because it can leak future values")
        if int(item.get("lag_bars", 0) or 0) < 0:
            out.append(f"lag of {name} is negative")
        if bool(key.get("instrument_field")) != bool(source.get("instrument_field")) and source.get("source_id") is not None:
            out.append(f"{name}: an instrument field must be given on both sides or on none")
        if sources is not None and source.get("source_id") is not None and source["source_id"] not in sources:
            out.append(f"source {source['source_id']!r} of {name} is not given")
    return out


def suffix(field: str, what: str) -> str:
    """The name of an audit column."""
    safe = re.sub(r"_+", "_", "".join(c if c.isalnum() else "_" for c in field.strip().lower())).strip("_") or "field"
    return f"__audit__{safe}__{what}"


def materialize(base: DataFrame, sources: Mapping[str, DataFrame], doc: dict, audit: bool = True, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """base with a column for each feature of the contract, and its audit columns.

    doc has primary_key (time_field, instrument_field if there are several instruments), alignment_policy (join_mode asof,
    left or inner; asof_tolerance_bars) and features: field, source (source_id, column, time_field, instrument_field; without
    a source_id the column is the base's own), fill_policy, lag_bars, staleness_max_bars, and join_mode of its
    own if it differs. An as-of tolerance is so many median gaps of the base's times: the contract's, else the largest
    staleness_max_bars of the source's features. left and inner take rows of exactly the base time, of which a source may
    have one; inner drops base rows without one. Fills go over at most staleness_max_bars bars, lags come after them, both within
    an instrument. A null time matches nothing. Audit: source_id, source_time, join_mode, value_origin (exact, asof, ffill, bfill,
    zero_fill, base_frame or missing), age_bars, was_filled, lag_applied, stale_flag.
    """
    if found := problems(doc, sources):
        raise ValueError("; ".join(found))
    key, policy = doc["primary_key"], doc.get("alignment_policy", {})
    ts, instrument = key["time_field"], key.get("instrument_field")
    by = [instrument] if instrument else []
    groups: dict[tuple, list[dict]] = {}
    for item in doc["features"]:
        s = item["source"]
        if s.get("source_id") is not None:
            groups.setdefault((s["source_id"], s.get("time_field", ts), s.get("instrument_field"), item.get("join_mode", policy.get("join_mode", "asof"))), []).append(item)
    merged = {}
    for i, ((source_id, time, own, _), items) in enumerate(groups.items()):
        columns = list(dict.fromkeys(x["source"]["column"] for x in items))
        df = sources[source_id]
        cols = [F.col(f"`{time}`").alias(ts), *([F.col(f"`{own}`").alias(instrument)] if own else []), *[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(columns)]]
        merged[f"_g{i}"] = (df.select(*cols).where(F.col(ts).isNotNull()), [f"c{j}" for j in range(len(columns))])
    at = blocks.cuts([base, *(df for df, _ in merged.values())], ts, block_rows)
    rows = align.carried(base, merged, by, ts, at) if merged else base
    kind = base.schema[ts].dataType.simpleString()
    second = lambda c: align.seconds(c, kind)
    gap = None
    for i, ((_, _, _, mode), items) in enumerate(groups.items()):
        v = F.col(f"_g{i}")
        exact = F.coalesce(v["source_ts"] == F.col(ts), F.lit(False))
        if mode == "asof":
            if (bars := _tolerance(policy, items)) is not None:
                gap = (align.median_gap(base, ts, at) or math.inf) if gap is None else gap
                rows = rows.withColumn(f"_g{i}", F.when(second(F.col(ts)) - second(v["source_ts"]) <= gap * bars, v))
        else:
            twice = F.when(v["n"] > 1, F.raise_error(F.lit(f"{mode} join of {items[0]['source']['source_id']} requires unique source keys")).cast("boolean"))
            rows = rows.withColumn(f"_g{i}", F.when(F.coalesce(twice, exact), v))
            if mode == "inner":
                rows = rows.where(F.col(f"_g{i}").isNotNull())
    order = Window.partitionBy(*by).orderBy(ts)
    rows = rows.withColumn("_bar", F.row_number().over(order))
    place = {}
    for i, ((source_id, _, _, mode), items) in enumerate(groups.items()):
        names = list(dict.fromkeys(x["source"]["column"] for x in items))
        place |= {x["field"]: (i, f"c{names.index(x['source']['column'])}", source_id, mode) for x in items}
        if audit:  # the bar at a value's own time, or the last one before it: one before the first that sees the value
            seen = F.min(F.struct("_bar", F.col(ts).alias("at"))).over(Window.partitionBy(*by, F.col(f"_g{i}.source_ts")))
            rows = rows.withColumn(f"_m{i}", seen).withColumn(f"_p{i}", F.col(f"_m{i}._bar") - (F.col(f"_m{i}.at") != F.col(f"_g{i}.source_ts")).cast("int"))
    new: dict[str, Column] = {}
    for k, item in enumerate(doc["features"]):
        name, fill, lag, limit = item["field"], item.get("fill_policy", "none"), int(item.get("lag_bars", 0) or 0), item.get("staleness_max_bars")
        if name in place:
            i, column, source_id, mode = place[name]
            raw, time, bar = F.col(f"_g{i}.{column}"), F.col(f"_g{i}.source_ts"), F.col(f"_p{i}") if audit else F.lit(None).cast("int")
            origin = F.when(raw.isNotNull() & time.isNotNull(), F.when(time == F.col(ts), "exact").otherwise("asof"))
        else:
            source_id, mode, raw, time, bar = "", "base_frame", F.col(f"`{item['source']['column']}`"), F.col(ts), F.col("_bar")
            origin = F.when(raw.isNotNull(), "base_frame")
        # plain columns between the steps: a window cannot hold another
        own = {f"_v{k}": raw, **({f"_s{k}": time, f"_b{k}": bar, f"_o{k}": origin} if audit else {})}
        rows = rows.withColumns(own).withColumn(f"_r{k}", F.col(f"_v{k}"))
        if fill == "zero":
            rows = rows.withColumn(f"_v{k}", F.coalesce(f"_v{k}", F.lit(0.0)))
        elif fill != "none":
            spread = _filled(fill, limit, order)
            rows = rows.withColumns({c: spread(c) for c in own if not c.startswith("_o")})
        if audit:
            rows = rows.withColumn(f"_o{k}", F.when(F.col(f"_o{k}").isNull() & F.col(f"_v{k}").isNotNull(), F.lit("zero_fill" if fill == "zero" else fill)).otherwise(F.col(f"_o{k}")))
        if lag:
            rows = rows.withColumns({c: F.lag(c, lag).over(order) for c in own})
        value = F.col(f"_v{k}")
        new[name] = value
        if audit:
            age = F.when(F.col(f"_s{k}").isNotNull() & (F.col(f"_b{k}") > 0), (F.col("_bar") - F.col(f"_b{k}")).cast("double"))
            new |= {
                suffix(name, "source_id"): F.lit(source_id), suffix(name, "source_time"): F.col(f"_s{k}"), suffix(name, "join_mode"): F.lit(mode),
                suffix(name, "value_origin"): F.when(value.isNotNull(), F.coalesce(f"_o{k}", F.lit("missing"))).otherwise("missing"), suffix(name, "age_bars"): age,
                suffix(name, "was_filled"): F.col(f"_r{k}").isNull() & value.isNotNull(), suffix(name, "lag_applied"): F.lit(lag),
                suffix(name, "stale_flag"): F.coalesce(age > limit, F.lit(False)) if isinstance(limit, int) and limit >= 0 else F.lit(False),
            }
    return rows.select(*base.columns, *[c.alias(n) for n, c in new.items()])


def _tolerance(policy: dict, items: list[dict]) -> int | None:
    bars = policy.get("asof_tolerance_bars")
    if isinstance(bars, int) and bars > 0:
        return bars
    given = [x["staleness_max_bars"] for x in items if isinstance(x.get("staleness_max_bars"), int) and x["staleness_max_bars"] >= 0]
    return max(given) if given and max(given) > 0 else None


def _filled(how: str, limit: int | None, order):
    """What a fill makes of a column over the panel's bars."""
    far = Window.unboundedPreceding if limit is None else -limit
    if how == "ffill":
        return lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(far, 0))
    if how == "bfill":
        return lambda c: F.first(c, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing if limit is None else limit))
    return lambda c: c
