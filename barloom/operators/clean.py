"""Cleaning and schema operators over raw market frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div

#: Spellings of the standard columns.
NAMES = {
    "Time": ("time", "date", "timestamp", "datetime", "period"), "Open": ("open", "o"), "High": ("high", "h"), "Low": ("low", "l"),
    "Close": ("close", "c"), "Volume": ("volume", "v", "vol"),
}


def standard_columns(df: DataFrame) -> DataFrame:
    """Rename by spelling, any case; the first match of each standard name wins, later ones keep theirs."""
    taken: set[str] = set()
    new = []
    for c in df.columns:
        std = next((k for k, names in NAMES.items() if c.strip().lower() in names), None)
        if std and std not in taken:
            taken.add(std)
            new.append(F.col(f"`{c}`").alias(std))
        else:
            new.append(F.col(f"`{c}`"))
    return df.select(*new)


def required_columns(df: DataFrame) -> DataFrame:
    """Just the six standard columns; missing ones are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in NAMES])


def number(c: Column) -> Column:
    """Text such as 1,234.5, 2.5K, 3M or 1B as a double; NULL if it is none."""
    s = F.upper(F.trim(F.regexp_replace(c.cast("string"), ",", "")))
    for letter, power in (("K", "E3"), ("M", "E6"), ("B", "E9")):
        s = F.regexp_replace(s, f"{letter}$", power)
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?$"), s.try_cast("double"))


def epoch_time(c: Column, first: Column) -> Column:
    """Epoch numbers as timestamps: milliseconds if the first value exceeds 1e10, else seconds."""
    return F.when(first > 1e10, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c.cast("long")))


def inferred_dates(df: DataFrame, column: str, to: str = "ts") -> DataFrame:
    """Parse dates day-first and month-first and keep the reading that fails less (day-first in a tie)."""
    c = F.col(f"`{column}`")

    def read(day_first: bool) -> Column:
        order = ("d/M/y", "d-M-y") if day_first else ("M/d/y", "M-d-y")
        return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in ("y-M-d", "y/M/d", *order)])

    fails = df.agg(F.count_if(read(True).isNull() & c.isNotNull()).alias("d"), F.count_if(read(False).isNull() & c.isNotNull()).alias("m"))
    return df.crossJoin(F.broadcast(fails)).withColumn(to, F.when(F.col("d") <= F.col("m"), read(True)).otherwise(read(False))).drop("d", "m")


def fill(x: Column, how: str = "ffill", value: float = 0.0, keys: tuple[str, ...] = ("asset",)) -> Column:
    """Fill missing values by the mean of five rows (itself and the four before), a constant, or the last value; what is left becomes 0."""
    w = by_time(*keys)
    by = {
        "mean5": F.avg(x).over(w.rowsBetween(-4, 0)), "constant": F.lit(value),
        "ffill": F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }
    return F.coalesce(x, by[how], F.lit(0.0))


def collapse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the mean of the numeric columns."""
    numeric = [c for c, t in df.dtypes if c not in keys and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric])


def simple_return(x: Column, w) -> Column:
    return F.coalesce(div(x, F.lag(x).over(w)) - 1, F.lit(0.0))


def log_return(x: Column, w) -> Column:
    prev = F.lag(x).over(w)
    return F.coalesce(F.when((x > 0) & (prev > 0), F.ln(div(x, prev))), F.lit(0.0))


def difference(x: Column, how: str, w, whole) -> Column:
    """sub: x - previous; div: x / previous - 1, only for a series (window ``whole``) without a zero, else sub."""
    prev = F.lag(x).over(w)
    sub = x - prev
    if how == "div":
        has_zero = F.coalesce(F.max((x == 0).cast("int")).over(whole), F.lit(0)) == 1
        return F.coalesce(F.when(has_zero, sub).otherwise(div(x, prev) - 1), F.lit(0.0))
    return F.coalesce(sub, F.lit(0.0))


def stat_difference(x: Column, how: str, w) -> Column:
    """absolute: x - previous; relative: previous / x (sic); NULL becomes 0."""
    prev = F.lag(x).over(w)
    return F.coalesce(x - prev if how == "absolute" else div(prev, x), F.lit(0.0))


def date_slice(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def downsample(df: DataFrame, most: int, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Every k-th row and the last, k = n // (most - 1) at least 1, per key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = df.withColumn("_i", F.row_number().over(by_time(*keys)) - 1).withColumn("_n", n)
    step = F.greatest(F.floor(F.col("_n") / (most - 1)), F.lit(1))
    return rows.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def common_start(panel: DataFrame, x: str = "close") -> DataFrame:
    """Drop dates before the first on which every asset of the panel has a value."""
    assets = panel.select("asset").distinct().agg(F.count("*").alias("assets"))
    first = (
        panel.where(F.col(x).isNotNull()).groupBy("ts").agg(F.count_distinct("asset").alias("n"))
        .join(F.broadcast(assets), F.col("n") == F.col("assets")).agg(F.min("ts").alias("first"))
    )
    return panel.join(F.broadcast(first), F.col("ts") >= F.col("first")).drop("first")  # one row


def densify(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The panel on the full grid of its dates and assets; missing cells are NULL. The asset list is a dimension."""
    grid = panel.select("ts").distinct().crossJoin(panel.select("asset").distinct())
    return grid.join(panel.select("ts", "asset", *columns), ["ts", "asset"], "left")
