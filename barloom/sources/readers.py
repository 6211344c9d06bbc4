"""Scans: files of any supported kind to long frames, a cache with a lifetime, and paged online sources."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.safe import denan
from ..operators.clean import NAMES, inferred_dates, required_columns, standard_columns


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: csv, parquet, orc, json, jsonl; xlsx needs pandas' optional reader and goes through the driver."""
    kind = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "orc":
        return reader.orc(path)
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").json(path)
    if kind in ("xlsx", "xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    raise ValueError(f"unsupported file {path!r}")


def single_asset(spark: SparkSession, path: str) -> DataFrame:
    """The six standard columns of a price file, prices as doubles."""
    df = required_columns(standard_columns(scan(spark, path)))
    return df.select("Time", *[denan(F.col(c).try_cast("double")).alias(c) for c in NAMES if c != "Time"])


def time_column(columns: list[str], given: str | None = None) -> str:
    """The given name, else the first time-like name, else the first column."""
    if given is not None:
        if given not in columns:
            raise ValueError(f"no column {given!r}")
        return given
    return next((c for c in columns if c.strip().lower() in NAMES["Time"]), columns[0])


def wide_market(df: DataFrame, field: str, time: str | None = None) -> DataFrame:
    """A date x asset table of one field as (ts, asset, field)."""
    t = time_column(df.columns, time)
    assets = [c for c in df.columns if c != t]
    rows = df.select(F.to_date(t).alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in assets])
    return rows.unpivot("ts", assets, "asset", field).withColumn(field, denan(F.col(field)))


def multi_field(frames: dict[str, DataFrame]) -> DataFrame:
    """Several wide tables, one per field, as one long panel: full outer on (ts, asset)."""
    out = None
    for name, df in frames.items():
        one = wide_market(df, name)
        out = one if out is None else out.join(one, ["ts", "asset"], "full")
    return out


def with_retried(first: DataFrame, retried: DataFrame, field: str = "close") -> DataFrame:
    """Symbols fetched in a second try joined to the first: the first try's values win."""
    b = retried.withColumnRenamed(field, "_again")
    return first.join(b, ["ts", "asset"], "full").withColumn(field, F.coalesce(field, "_again")).drop("_again")


def predictor(spark: SparkSession, path: str, time: str | None = None) -> DataFrame:
    """A predictor file with its time column parsed day-first or month-first, whichever fails less; other columns as doubles."""
    df = scan(spark, path)
    t = time_column(df.columns, time)
    out = inferred_dates(df, t, "ts")
    return out.select("ts", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns if c != t])


def joined_predictor(price: DataFrame, outside: DataFrame) -> DataFrame:
    """Inner join on ts; no common time is an error at run time."""
    out = price.join(outside, "ts")
    empty = out.limit(1).agg(F.count("*").alias("n")).where(F.when(F.col("n") == 0, F.raise_error(F.lit("no common time"))).otherwise(F.lit(True)))
    return out.join(F.broadcast(empty.select(F.lit(1).alias("_ok"))), F.lit(True)).drop("_ok")


def event_dates(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    return scan(spark, path).select(F.to_date(column).alias("event")).where("event is not null").distinct()


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Constituents: asset with optional start and end dates."""
    df = scan(spark, path)
    names = {c.lower(): c for c in df.columns}
    asset = next(names[c] for c in ("asset", "symbol", "ticker") if c in names)
    day = lambda *cs: next((F.to_date(names[c]) for c in cs if c in names), F.lit(None).cast("date"))
    return df.select(F.col(asset).alias("asset"), day("start", "start_date", "date").alias("start"), day("end", "end_date").alias("end"))


def runs(spark: SparkSession, pattern: str) -> DataFrame:
    """All result files of a path pattern, with their file as source_file."""
    return spark.read.option("mergeSchema", True).parquet(pattern).withColumn("source_file", F.col("_metadata.file_path"))


def cached(spark: SparkSession, folder: str, identity: dict, load: Callable[[], DataFrame], hours: float = 12.0, now: float | None = None) -> DataFrame:
    """load() once per identity and lifetime: kept as Parquet under a hash of the identity.

    The folder is reached through the session's file system, so it can be any store that Spark writes.
    """
    key = hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder}/{key}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = fs.exists(mark) and (now or time.time()) - fs.getFileStatus(mark).getModificationTime() / 1000 < hours * 3600
    if not fresh:
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class PagedBars(DataSource):
    """Candles from a paged source: options symbols, start, end (epoch seconds), interval (seconds), page, fetch.

    ``fetch`` names a function module:name(symbol, start, end, interval) -> rows (epoch seconds, open, high,
    low, close, volume), so that any exchange's client, or a recorded one, can be plugged in. Every
    symbol is read in its own task, pages of ``page`` bars, repeated timestamps dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "asset string, ts timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


#: Seconds of the bar lengths that sources offer, and bars a page.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
PAGES = {"coinbase": 300, "binance": 1000}


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s.strip()) for s in self.options["symbols"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        step, page = int(self.options.get("interval", 86400)), int(self.options.get("page", 300))
        at, end, last = int(self.options["start"]), int(self.options["end"]), None
        while at < end:
            for ts, *values in sorted(fetch(partition.value, at, min(at + step * page, end), step)):
                if last is None or ts > last:
                    last = ts
                    yield (partition.value, datetime.datetime.fromtimestamp(ts, datetime.timezone.utc), *map(float, values))
            at += step * page
