"""Cross-sectional factors on long panels: per-date windows, composites, audits, information coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div
from .indicators import full, trailing


def _date(keys=()):
    return Window.partitionBy(*keys, "ts")


def price_momentum(x: Column, lookback: int = 126, skip: int = 0) -> Column:
    """x[-skip] / x[-skip-lookback] - 1; a lookback of 0 or less counts as 126."""
    n, w = (lookback if lookback > 0 else 126), by_time("asset")
    return div(F.lag(x, skip).over(w) if skip else x, F.lag(x, skip + n).over(w)) - 1


def realized_volatility(ret: Column, lookback: int = 126) -> Column:
    """From a materialised one-bar return."""
    return full(F.stddev_samp(ret).over(trailing(lookback, "asset")), ret, lookback) * math.sqrt(252)


def ratio(a: Column, b: Column) -> Column:
    """book_to_market, return_on_equity: NULL where the denominator is 0."""
    return div(a, F.nullif(b, F.lit(0.0)))


def fill_missing(x: Column, how: str = "cross_section_median", value: float = 0.0, keys: tuple[str, ...] = ()) -> Column:
    by = {
        "cross_section_median": lambda: F.percentile(x, F.lit(0.5)).over(_date(keys)), "zero": lambda: F.lit(0.0), "constant": lambda: F.lit(value),
        "ffill": lambda: F.last(x, ignorenulls=True).over(by_time("asset").rowsBetween(Window.unboundedPreceding, 0)),
    }
    return F.coalesce(x, by[how]())


def winsorize(x: Column, low: float = 0.01, high: float = 0.99, keys: tuple[str, ...] = ()) -> Column:
    q = lambda p: F.percentile(x, F.lit(p)).over(_date(keys))
    return F.when(x.isNotNull(), F.greatest(F.least(x, q(high)), q(low)))


def standardize(x: Column, keys: tuple[str, ...] = ()) -> Column:
    return div(x - F.avg(x).over(_date(keys)), F.nullif(F.stddev_samp(x).over(_date(keys)), F.lit(0.0)))


def neutralize(x: Column, group: Column | None, keys: tuple[str, ...] = ()) -> Column:
    """Minus the date's group mean; rows without a group stay, as does everything without groups."""
    return x if group is None else F.when(group.isNull(), x).otherwise(x - F.avg(x).over(Window.partitionBy(*keys, "ts", group)))


def percentile_rank(x: Column, keys: tuple[str, ...] = ()) -> Column:
    """Average rank over count, per date."""
    w = Window.partitionBy(*keys, "ts", x.isNull())
    low = F.rank().over(w.orderBy(x))
    ties = F.count("*").over(Window.partitionBy(*keys, "ts", x))
    return F.when(x.isNotNull(), (low + (ties - 1) / 2) / F.count("*").over(w))


def composite(weights: dict[str, float]) -> Column:
    """Weighted mean, weights over the sum of their sizes; a missing factor counts 0 if another is there."""
    total = sum(abs(w) for w in weights.values())
    out = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0))
    return F.when(F.coalesce(*[F.col(c) for c in weights]).isNotNull(), out)


def combine(how: str, factors: list[str], weights: dict[str, float] | None = None) -> Column:
    if how == "equal_weight":
        return composite({f: 1.0 for f in factors})
    if how == "manual_weight":
        return composite({f: weights[f] for f in factors})
    raise NotImplementedError(f"{how} is reserved")


def known_later(df: DataFrame, known_at: str = "known_at") -> DataFrame:
    """Point-in-time violations: rows whose value became known after their date."""
    return df.where(F.col(known_at) > F.col("ts"))


def coverage(df: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, rows, missing_ratio)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).isNull().alias("m")) for f in factors])).alias("e"))
    return long.groupBy("e.factor").agg(F.count("*").alias("rows"), F.avg(F.col("e.m").cast("double")).alias("missing_ratio"))


def information_coefficient(df: DataFrame, score: str, price: str = "close") -> DataFrame:
    """Per date with two assets or more: Pearson and rank correlation of score and next-bar return."""
    nxt = div(F.lead(price).over(by_time("asset")), F.col(price)) - 1
    rows = df.withColumn("_f", nxt).where(f"`{score}` is not null and _f is not null")
    rows = rows.withColumns({"_rs": percentile_rank(F.col(score)), "_rf": percentile_rank(F.col("_f"))})
    return rows.groupBy("ts").agg(F.count("*").alias("n"), F.corr(score, "_f").alias("ic"), F.corr("_rs", "_rf").alias("rank_ic")).where("n >= 2")
