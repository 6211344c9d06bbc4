"""Sinks: result frames as Parquet, CSV or JSON Lines with small JSON documents beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document(spark: SparkSession, path: str, content: dict) -> None:
    """A JSON document, written through Spark so that any store works."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def portfolio(frames: dict[str, DataFrame], path: str, config: dict, validation: dict, csv: bool = False) -> None:
    """equity_curve, holdings, rebalance_audit, rebalance_trades, risk_gate_events as zstd Parquet, with
    config, validation and metadata documents; maps become JSON text in CSV."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        if csv:
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes])
            flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}_csv")
    document(spark, f"{path}/config", config)
    document(spark, f"{path}/validation", validation)
    document(spark, f"{path}/metadata", {"frames": sorted(frames)})


def trade_records(df: DataFrame, path: str, kinds: tuple[str, ...] = ("parquet",), audit: DataFrame | None = None) -> None:
    """Trade records partitioned by nothing, one folder per kind; audit rows as JSON Lines and Parquet."""
    for kind in kinds:
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(f"{path}/csv")
        elif kind in ("parquet", "json", "orc"):
            getattr(writer, kind)(f"{path}/{kind}")
        else:
            raise ValueError(f"unsupported kind {kind!r}")
    if audit is not None:
        audit.write.mode("overwrite").json(f"{path}/audit_jsonl")
        audit.write.mode("overwrite").parquet(f"{path}/audit")
        document(audit.sparkSession, f"{path}/audit_manifest", {"columns": audit.columns})


def metrics(df: DataFrame, path: str, meta: dict) -> None:
    """Metrics with doubles as floats, and their metadata."""
    df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").parquet(f"{path}/metrics")
    document(df.sparkSession, f"{path}/metadata", meta)


def factors(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def walk_forward(chosen: DataFrame, ranking: DataFrame, path: str) -> None:
    chosen.write.mode("overwrite").parquet(f"{path}/selected_optimum")
    ranking.write.mode("overwrite").option("header", True).csv(f"{path}/ranking")


def report(df: DataFrame, path: str) -> None:
    """A statistics report as CSV and JSON Lines."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")
