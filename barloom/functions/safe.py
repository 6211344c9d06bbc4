"""Null-safe arithmetic: NaN and infinities become NULL at the boundary, division by zero gives NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def denan(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rnd(c: Column, digits: int = 6) -> Column:
    """Rounded, with -0 as 0."""
    return F.round(c, digits) + F.lit(0.0)


def all_of(masks: list[Column], empty: bool) -> Column:
    return reduce(lambda a, b: a & b, masks) if masks else F.lit(empty)


def any_of(masks: list[Column], empty: bool) -> Column:
    return reduce(lambda a, b: a | b, masks) if masks else F.lit(empty)


def by_time(*keys: str, order: tuple[str, ...] = ("ts",)):
    """A window over each key's rows in time order."""
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(n: int, *keys: str, order: tuple[str, ...] = ("ts",)):
    return by_time(*keys, order=order).rowsBetween(-(n - 1), 0)


def upto(*keys: str, order: tuple[str, ...] = ("ts",)):
    return by_time(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def pct_change(x: Column, w, n: int = 1) -> Column:
    return div(x, F.lag(x, n).over(w)) - 1


def safe_power(base: Column, exponent: Column, fallback: float = 0.0) -> Column:
    """base ** exponent for a positive base, else the fallback; never NaN or infinite."""
    return F.coalesce(denan(F.when(base > 0, F.pow(base, exponent))), F.lit(fallback))


def safe_sqrt(x: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.when(x >= 0, F.sqrt(x)), F.lit(fallback))


def control(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for a broadcast, once it is counted: control data of more than ``most`` rows is an error."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows of control data")
    return F.broadcast(df)
