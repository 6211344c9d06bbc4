"""Joining outside series to a panel: validated equi joins, as-of joins, fills, lags, ages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time
from . import blocks


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing at run time on a repeated key. The check rides on the rows themselves: no second pass."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate source keys on {keys}"))).otherwise(F.lit(True))).drop("_n")


def equi_join(base: DataFrame, source: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Many-to-one join; a repeated source key is an error."""
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    return base.join(unique_by(source, keys), keys, how)


def resolve_instrument(base_columns: list[str], source_columns: list[str], instruments: int, key: str | None = None) -> list[str]:
    """Extra join keys: several instruments without a common instrument column are an error."""
    if key is not None:
        if key not in base_columns or key not in source_columns:
            raise ValueError(f"instrument key {key!r} must be on both sides")
        return [key]
    if "asset" in base_columns and "asset" in source_columns:
        return ["asset"]
    if instruments > 1 and "asset" in source_columns:
        raise ValueError("several instruments need an instrument key")
    return []


def seconds(c, kind: str):
    """A date or time column as seconds."""
    return (F.unix_date(c) * 86400).cast("double") if kind == "date" else F.unix_micros(c.cast("timestamp")) / 1e6


def median_gap(base: DataFrame, ts: str = "ts", at: list[float] | None = None) -> float | None:
    """The median positive gap in seconds between the frame's distinct times; None without a gap."""
    at = blocks.cuts([base], ts) if at is None else at
    times = blocks.with_block(base.select(ts).where(F.col(ts).isNotNull()).distinct(), at, ts)
    times = times.select("_block", seconds(F.col(ts), base.schema[ts].dataType.simpleString()).alias("s"))
    # gaps inside blocks by window, gaps between blocks from their ends: no single-partition sort of all times
    inside = times.select((F.col("s") - F.lag("s").over(Window.partitionBy("_block").orderBy("s"))).alias("g"))
    ends = times.groupBy("_block").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    between = ends.select((F.col("a") - F.lag("b").over(Window.orderBy("_block"))).alias("g"))  # one row a block
    return quantile(inside.unionByName(between).where("g > 0"), "g", 0.5)


def quantile(df: DataFrame, column: str, share: float, most: int = 50_000) -> float | None:
    """The exact quantile (linear between neighbours) of a column, by selection: passes narrow an interval that must
    hold the wanted places by approximate quantiles and counts, until few distinct values are left in it."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))  # equal values count once
    n, distinct, low, high = rows.agg(F.sum("n"), F.count("*"), F.min(column), F.max(column)).first()
    if not n:
        return None
    place = share * (n - 1)
    want = (math.floor(place), math.ceil(place))
    below = 0
    while distinct > most:
        inside = rows.where(F.col(column).between(low, high))
        total = inside.agg(F.sum("n")).first()[0]
        aim = [(w - below + 0.5) / total for w in want]
        shares = [max(0.0, min(aim) - 0.02), min(1.0, max(aim) + 0.02)]
        a, b = inside.agg(F.percentile_approx(column, shares, F.lit(1000))).first()[0]
        count = inside.agg(F.sum(F.when(F.col(column) < a, F.col("n"))), F.sum(F.when(F.col(column) <= b, F.col("n"))), F.count_if(F.col(column).between(a, b))).first()
        under, upto_ = below + (count[0] or 0), below + (count[1] or 0)
        if (a, b) == (low, high) or not (under <= want[0] and want[1] < upto_):
            break  # as narrow as it gets
        low, high, below, distinct = a, b, under, count[2]
    reach, found = below, {}
    for value, k in rows.where(F.col(column).between(low, high)).orderBy(column).toLocalIterator():  # few values, in order
        for w in want:
            if reach <= w < reach + k:
                found[w] = value
        reach += k
        if len(found) == len(set(want)):
            break
    return found[want[0]] + (found[want[1]] - found[want[0]]) * (place - want[0])


def carried(base: DataFrame, sources: dict[str, tuple[DataFrame, list[str]]], by: list[str], ts: str = "ts", at: list[float] | None = None) -> DataFrame:
    """base with one struct a source: source_ts, the columns at their newest at or before the base time, and n,
    the source's rows of exactly the base time.

    Base and sources are merged and put in time order once, and the newest row of every source is carried forward in
    the same pass. The pass is cut into blocks of time; what earlier blocks knew last comes from a table of one row a block and key.
    """
    kind = base.schema[ts].dataType
    sources = {k: (df.withColumn(ts, F.col(ts).cast(kind)), columns) for k, (df, columns) in sources.items()}
    if at is None:
        at = blocks.cuts([base, *(df for df, _ in sources.values())], ts)
    both = base.withColumn("_side", F.lit(1))
    for name, (df, columns) in sources.items():
        right = df.select(*by, ts, F.struct(F.col(ts).alias("source_ts"), *[F.col(f"`{c}`") for c in columns]).alias(f"_v{name}"), F.lit(0).alias("_side"))
        both = both.unionByName(right, allowMissingColumns=True)
    both = blocks.with_block(both, at, ts)
    key = [*by, "_block"] if at else by
    w = Window.partitionBy(*key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*key, ts)
    out = both.withColumns({f"_l{n}": F.last(f"_v{n}", ignorenulls=True).over(w) for n in sources}).withColumns({f"_n{n}": F.count(f"_v{n}").over(same) for n in sources}).where("_side = 1")
    if at:
        newest = both.groupBy(*key).agg(*[F.max_by(f"_v{n}", F.when(F.col(f"_v{n}").isNotNull(), F.col(ts))).alias(f"_m{n}") for n in sources])
        wy = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = newest.select(*[F.col(c).alias("_k" + c) for c in key], *[F.last(f"_m{n}", ignorenulls=True).over(wy).alias(f"_c{n}") for n in sources])  # one row a block and key
        on = [F.col(c).eqNullSafe(F.col("_k" + c)) for c in key]
        out = out.join(carry, on, "left").withColumns({f"_l{n}": F.coalesce(f"_l{n}", f"_c{n}") for n in sources})
    return out.select(*base.columns, *[F.col(f"_l{n}").withField("n", F.col(f"_n{n}")).alias(n) for n in sources])


def as_of(base: DataFrame, source: DataFrame, columns: list[str], by: list[str] | None = None, bars: float | None = None, ts: str = "ts", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Add each column's latest source value at or before the base time, and source_ts.

    With ``bars``, values older than that many median base gaps, measured in seconds, are NULL. See ``carried``.
    """
    at = blocks.cuts([base, source], ts, block_rows)
    out = carried(base, {"_s": (source, columns)}, by or [], ts, at)
    value = F.col("_s")
    if bars is not None:
        gap = median_gap(base, ts, at)
        kind = base.schema[ts].dataType.simpleString()
        fresh = seconds(F.col(ts), kind) - seconds(F.col("_s.source_ts"), kind) <= F.lit(gap * bars if gap is not None else math.inf)
        out, value = out.withColumn("_s", F.when(fresh, value)), F.col("_s")
    return out.select(*base.columns, F.col("_s.source_ts").alias("source_ts"), *[F.col(f"_s.`{c}`").alias(c) for c in columns])


def fill_stale(x, limit: int, how: str = "ffill", keys: tuple[str, ...] = ("asset",), label: bool = False):
    """Forward or backward fill over at most ``limit`` rows, or zero; backward only for label fields."""
    w = by_time(*keys)
    if how == "ffill":
        return F.coalesce(x, F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0)))
    if how == "bfill":
        if not label:
            raise ValueError("bfill looks ahead; it is allowed for label.* fields only")
        return F.coalesce(x, F.first(x, ignorenulls=True).over(w.rowsBetween(0, limit)))
    if how == "zero":
        return F.coalesce(x, F.lit(0.0))
    raise ValueError(how)


def lag_bars(x, k: int, keys: tuple[str, ...] = ("asset",)):
    """Shift after filling, within each instrument."""
    return F.lag(x, k).over(by_time(*keys)) if k else x


def with_age(df: DataFrame, keys: tuple[str, ...] = ("asset",), ts: str = "ts", source_ts: str = "source_ts") -> DataFrame:
    """Add age_bars: rows since the row at (or the first after) the value's own time; NULL without a value."""
    rows = df.withColumn("_i", F.row_number().over(by_time(*keys, order=(ts,))))
    first = F.min("_i").over(Window.partitionBy(*keys, source_ts))  # a value is first seen at its own bar
    return rows.withColumn("age_bars", F.when(F.col(source_ts).isNotNull(), (F.col("_i") - first).cast("double"))).drop("_i")


def audit(rows: DataFrame, feature: str | list[str] = "feature", stale_after: int = 1, stale_ratio: float = 0.2, fill_ratio: float = 0.2, max_age: int = 5) -> DataFrame:
    """Quality of joined features, one row each, from rows with age_bars: rows, stale_rows (older than
    stale_after bars), filled_rows (carried from an earlier bar), max_age_bars, both ratios, and the
    warnings: a ratio at its threshold or above it, an age at the limit or above it."""
    age = F.col("age_bars")
    out = rows.groupBy(feature).agg(
        F.count("*").alias("rows"), F.count_if(age > stale_after).alias("stale_rows"), F.count_if(age > 0).alias("filled_rows"), F.coalesce(F.max(age), F.lit(0.0)).alias("max_age_bars")
    ).withColumns({"stale_ratio": F.col("stale_rows") / F.col("rows"), "fill_ratio": F.col("filled_rows") / F.col("rows")})
    warn = {"stale_ratio": F.col("stale_ratio") >= stale_ratio, "fill_ratio": F.col("fill_ratio") >= fill_ratio, "max_age": F.col("max_age_bars") >= max_age}
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in warn.items()])))


#: 9999-12-31 in days since 1970.
LAST_DAY = 2_932_896


def as_of_members(members: DataFrame, dates: DataFrame, days: int = 32) -> DataFrame:
    """Constituents valid on each date: start <= date <= end (open ends allowed).

    Time is cut into buckets of ``days`` days. A member goes to the buckets in which it starts or ends, and dates there
    meet it by their bucket; the whole buckets between are covered by runs of 2, 4, 8... buckets, and a
    date looks its bucket's run up at each length. So a membership of n buckets takes about 2 log2(n) rows, both
    sides meet by equal keys, and no date is compared with members of other times.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    spans = members.withColumns({"_i": F.floor(day("start") / days).cast("long"), "_j": F.floor(F.coalesce(day("end"), F.lit(LAST_DAY)) / days).cast("long")}).where("_i <= _j")
    levels = math.ceil(math.log2(2 * LAST_DAY / days)) + 1
    edges = F.array_distinct(F.array("_i", "_j"))
    parts = spans.select("asset", "start", "end", F.explode(F.transform(edges, lambda e: F.struct(F.lit(-1).alias("level"), e.alias("cell")))).alias("p"))
    # inside (i, j): at each level, the cells that are whole in it but whose parent is not
    first, after = F.col("_i") + 1, F.col("_j")
    up = lambda x, k: F.ceil(x / F.lit(2**k)).cast("long")
    down = lambda x, k: F.floor(x / F.lit(2**k)).cast("long")
    cells = []
    for k in range(levels):
        a, z = up(first, k), down(after, k)  # whole cells a..z-1 of this level
        pa, pz = 2 * up(first, k + 1), 2 * down(after, k + 1)  # those that whole cells of the next level cover
        whole = pa < pz
        left, right = F.when(a < z, F.when(whole, F.when(a < pa, a)).otherwise(a)), F.when(a < z, F.when(whole, F.when(pz < z, pz)).otherwise(F.when(z - 1 > a, z - 1)))
        cells += [F.struct(F.lit(k).alias("level"), left.alias("cell")), F.struct(F.lit(k).alias("level"), right.alias("cell"))]
    inner = spans.where(first < after).select("asset", "start", "end", F.explode(F.array(*cells)).alias("p")).where("p.cell is not null")
    keyed = parts.unionByName(inner).select("asset", "start", "end", F.col("p.level").alias("_level"), F.col("p.cell").alias("_cell"))
    bucket = F.floor(F.unix_date(F.col("ts").cast("date")) / days).cast("long")
    looks = [F.struct(F.lit(-1).alias("level"), bucket.alias("cell")), *(F.struct(F.lit(k).alias("level"), down(bucket, k).alias("cell")) for k in range(levels))]
    asked = dates.select("ts", F.explode(F.array(*looks)).alias("p")).select("ts", F.col("p.level").alias("_level"), F.col("p.cell").alias("_cell"))
    met = asked.join(keyed, ["_level", "_cell"])
    return met.where((F.col("_level") >= 0) | (F.col("start") <= F.col("ts")) & (F.col("end").isNull() | (F.col("ts") <= F.col("end")))).select("ts", "asset")
