"""Calendar conditions on available sessions: masks as Columns, and auditable event tables.

Period boundaries are the first and last *available* session of a period, over all assets.
Weekday targets are true calendar dates and are never rolled; event dates can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def weekday_number(x) -> int:
    """0 for Monday; numbers, names and three-letter names."""
    if isinstance(x, int):
        if not 0 <= x <= 6:
            raise ValueError(f"bad weekday {x}")
        return x
    name = str(x).strip().lower()
    if name.isdigit():
        return weekday_number(int(name))
    for i, w in enumerate(WEEKDAYS):
        if len(name) >= 3 and w.startswith(name):
            return i
    raise ValueError(f"bad weekday {x!r}")


def _months(c: Column, months) -> Column:
    return F.lit(True) if months is None else (F.month(c).isin([int(m) for m in months]) if months else F.lit(False))


def edge_name(unit: str, side: str) -> str:
    return f"_{unit}_{side}"


def with_edges(df: DataFrame, *nodes, ts: str = "ts") -> DataFrame:
    """Add, for each period boundary in the condition trees, the first or last available date of the row's period.

    The dates come from an aggregate of one row a period, joined by broadcast: a window over the rows
    of a period would put a whole year of all assets into one task. mask() uses the columns if they are there.
    """
    wanted = set()

    def find(x):
        if isinstance(x, list):
            for y in x:
                find(y)
        elif isinstance(x, dict):
            unit, _, side = str(x.get("op", "")).removeprefix("calendar.").rpartition("_")
            if unit in ("month", "quarter", "year") and side in ("start", "end"):
                wanted.add((unit, side))
            find([v for v in x.values() if isinstance(v, (list, dict))])

    find(list(nodes))
    for unit in sorted({u for u, _ in wanted}):
        period = F.date_trunc(unit, F.col(ts))
        edges = df.groupBy(period.alias("_period")).agg(*[(F.min(ts) if s == "start" else F.max(ts)).alias(edge_name(unit, s)) for u, s in sorted(wanted) if u == unit])
        df = df.withColumn("_period", period).join(F.broadcast(edges), "_period", "left").drop("_period")  # a row a period
    return df


def without_edges(df: DataFrame) -> DataFrame:
    return df.drop(*[edge_name(u, s) for u in ("month", "quarter", "year") for s in ("start", "end")])


def boundary(unit: str, side: str, months=None, ts: str = "ts", columns=()) -> Column:
    """Is ts the first (start) or last (end) available date of its month, quarter or year? From the column that
    with_edges() adds, if it is among the columns, else by a window over the period's rows (for tables of dates)."""
    t = F.col(ts)
    if edge_name(unit, side) in columns:
        edge = F.col(edge_name(unit, side))
    else:
        edge = (F.min(t) if side == "start" else F.max(t)).over(Window.partitionBy(F.date_trunc(unit, t)))
    return F.coalesce((t == edge) & _months(t, months), F.lit(False))


def nth_weekday(c: Column, weekday: int, ordinal: int) -> Column:
    """Date of the ordinal-th such weekday in c's month (negative from the end); NULL if outside the month or 0."""
    first = F.trunc(c, "month")
    last = F.last_day(c)
    if ordinal > 0:
        out = F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (ordinal - 1))
    elif ordinal < 0:
        out = F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)) + 7 * (-ordinal - 1))
    else:
        return F.lit(None).cast("date")
    return F.when(F.month(out) == F.month(first), out)


def mask(node: dict, ts: str = "ts", columns=()) -> Column:
    op = node["op"].removeprefix("calendar.")
    t, months = F.col(ts), node.get("months")
    if op == "every_session":
        return t.isNotNull()
    if op == "month_in":
        return F.coalesce(_months(t, list(months or [])), F.lit(False))
    if op == "weekday_eq":
        return F.coalesce(F.weekday(t) == weekday_number(node["weekday"]), F.lit(False))
    unit, _, side = op.rpartition("_")
    if unit in ("month", "quarter", "year") and side in ("start", "end"):
        return boundary(unit, side, months, ts, columns)
    if op == "last_weekday_of_month":
        return F.coalesce((nth_weekday(t, weekday_number(node["weekday"]), -1) == t) & _months(t, months), F.lit(False))
    if op == "nth_weekday_of_month":
        return F.coalesce((nth_weekday(t, weekday_number(node["weekday"]), int(node["ordinal"])) == t) & _months(t, months), F.lit(False))
    if op == "event_date":
        if node.get("adjustment_policy", "skip") != "skip":
            raise ValueError("adjusted event dates need event_sessions()")
        dates = [str(d) for d in node.get("dates", [])]
        return F.coalesce(t.isin([F.lit(d).cast("date") for d in dates]), F.lit(False)) if dates else F.lit(False)
    raise ValueError(f"unknown calendar op {node['op']!r}")


def event_sessions(sessions: DataFrame, events: DataFrame, policy: str = "skip") -> DataFrame:
    """Audit rows of event dates (column event): event, resolved session, triggered, skip_reason.

    previous_trading_day and next_trading_day resolve to the nearest available session on that side:
    sessions and events are merged in date order and carried along, in date ranges with the carry of
    earlier ranges, so neither side is broadcast or compared pair by pair.
    """
    days = sessions.select(F.col("ts").alias("d")).where("d is not null").distinct()
    wanted = events.select(F.col("event").cast("date").alias("d")).where("d is not null").distinct()
    both = days.withColumn("s", F.col("d")).unionByName(wanted.withColumn("e", F.col("d")), allowMissingColumns=True)
    rows = both.groupBy("d").agg(F.max("s").alias("s"), F.max("e").alias("e")).withColumn("y", F.year("d"))
    if policy == "skip":
        out = rows.withColumn("r", F.col("s"))
    elif policy in ("previous_trading_day", "next_trading_day"):
        back = policy.startswith("prev")
        w = Window.partitionBy("y").orderBy(F.col("d").asc() if back else F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
        yearly = rows.groupBy("y").agg((F.max("s") if back else F.min("s")).alias("m"))
        wy = Window.orderBy(F.col("y").asc() if back else F.col("y").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = yearly.select("y", F.last("m", ignorenulls=True).over(wy).alias("c"))  # one row a year
        out = rows.withColumn("r", F.last("s", ignorenulls=True).over(w)).join(carry, "y").withColumn("r", F.coalesce("r", "c"))
    else:
        raise ValueError(f"unknown adjustment policy {policy!r}")
    return out.where("e is not null").select(
        F.lit("calendar.event_date").alias("calendar_op"), F.col("e").alias("raw_event_date"), F.col("r").alias("resolved_session_date"),
        F.col("r").isNotNull().alias("triggered"),
        F.when(F.col("r").isNull(), F.lit("no_session" if policy == "skip" else "out_of_range")).alias("skip_reason"),
    )


def event_frame(sessions: DataFrame, node: dict, events: DataFrame | None = None) -> DataFrame:
    """Audit rows of a tree: one row per target of each calendar op in it (and/or/not are walked)."""
    kids = node.get("nodes", node.get("conditions", [node["node"]] if "node" in node else []))
    if kids:
        frames = [event_frame(sessions, k, events) for k in kids]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    if node["op"] == "calendar.event_date":
        return event_sessions(sessions, events, node.get("adjustment_policy", "skip"))
    days = sessions.select("ts").where("ts is not null").distinct()
    op = node["op"].removeprefix("calendar.")
    if op in ("nth_weekday_of_month", "last_weekday_of_month"):
        target = nth_weekday(F.col("ts"), weekday_number(node["weekday"]), int(node.get("ordinal", -1)))
        targets = days.select(target.alias("t")).where("t is not null").where(_months(F.col("t"), node.get("months"))).distinct()
        hit = targets.join(days, targets["t"] == days["ts"], "left")
        return hit.select(
            F.lit(node["op"]).alias("calendar_op"), F.col("t").alias("raw_event_date"), F.col("ts").alias("resolved_session_date"),
            F.col("ts").isNotNull().alias("triggered"), F.when(F.col("ts").isNull(), F.lit("no_session")).alias("skip_reason"),
        )
    return days.withColumn("_hit", mask(node)).where("_hit").select(
        F.lit(node["op"]).alias("calendar_op"), F.col("ts").alias("raw_event_date"), F.col("ts").alias("resolved_session_date"),
        F.lit(True).alias("triggered"), F.lit(None).cast("string").alias("skip_reason"),
    )


def trigger_sessions(sessions: DataFrame, node: dict, events: DataFrame | None = None) -> DataFrame:
    """Distinct resolved sessions of a calendar tree."""
    return event_frame(sessions, node, events).where("triggered").select(F.col("resolved_session_date").alias("ts")).distinct()
