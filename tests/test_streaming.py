"""Streaming forms give what the batch forms give."""

import datetime as dt

import numpy as np
import pandas as pd

from barloom.operators.simulate import Rules, fold
from barloom.streaming.bars import streaming_bars, streaming_simulator


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_bars(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, 6 * (i % 4)), "x", float(i)) for i in range(12)]
    schema = "id long, ts timestamp, kind string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(streaming_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "kind", "ts", "value", "id"), "bars_out", "complete")
    got = spark.table("bars_out").orderBy("ts").toPandas()
    assert got[["open", "high", "low", "close", "volume", "n"]].values.tolist() == [[a, a + 3, a, a + 3, 4 * a + 6, 4] for a in (0.0, 4.0, 8.0)]


def test_simulator_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 40
    price, entry, exit_ = 100 + rng.normal(0, 1, n).cumsum(), rng.choice([0, 1, -1], n).astype(float), rng.choice([0, 1, -1], n).astype(float)
    pdf = pd.DataFrame({"asset": "a", "ts": pd.date_range("2024-01-01", periods=n), "price": price, "entry": entry, "exit": exit_})
    schema = "asset string, ts timestamp, price double, entry double, exit double"
    for k in range(2):
        spark.createDataFrame(pdf.iloc[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = Rules(cost=0.001, long_bars=3, combine="or")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    drain(streaming_simulator(stream, rules), "sim_out", "append")
    got = spark.table("sim_out").orderBy("ts").toPandas()
    want = fold(entry, exit_, price, rules)
    assert np.allclose(got["equity"], want["equity"]) and got["action"].tolist() == want["action"].tolist()
