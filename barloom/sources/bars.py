"""OHLCV bars from raw tables; ties in time are broken by the primary key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars_from(rows: DataFrame, asset: str, ts: str, value: str, key: str, unit: str = "day") -> DataFrame:
    """(asset, ts, open, high, low, close, volume, n): one partial-aggregated shuffle by (asset, bar)."""
    order = F.struct(ts, key)
    bar = F.to_date(ts) if unit == "day" else F.date_trunc(unit, ts)
    return rows.groupBy(F.col(asset).alias("asset"), bar.alias("ts")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, order).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def ship_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse daily outside series: (ts, qty, disc) of lineitem by ship date."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.to_date("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))


#: The same bars in DuckDB SQL, as bodies of common table expressions.
EVENT_BARS = """bars as (
  select event_type as asset, cast(ts as date) as ts, first(value order by events.ts, event_id) as open, max(value) as high, min(value) as low,
         last(value order by events.ts, event_id) as close, sum(value) as volume, count(*) as n
  from events group by event_type, cast(ts as date))"""
ORDER_BARS = """bars as (
  select o_orderpriority as asset, cast(o_orderdate as date) as ts, first(o_totalprice order by o_orderdate, o_orderkey) as open,
         max(o_totalprice) as high, min(o_totalprice) as low, last(o_totalprice order by o_orderdate, o_orderkey) as close,
         sum(o_totalprice) as volume, count(*) as n
  from orders group by o_orderpriority, cast(o_orderdate as date))"""
SHIP = """ship as (select cast(l_shipdate as date) as ts, sum(l_quantity) as qty, avg(l_discount) as disc from lineitem group by cast(l_shipdate as date))"""
