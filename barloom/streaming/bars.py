"""Streaming forms (our extension): bars with a watermark, and the trade simulator as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.simulate import Rules, leave


def streaming_bars(events: DataFrame, asset: str, ts: str, value: str, key: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """OHLCV per asset and window of event time; rows later than the watermark are left out."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    order = F.struct("_t", key)
    bars = t.groupBy(F.col(asset).alias("asset"), F.window("_t", every).alias("_w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n")
    )
    return bars.select("asset", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


STATE = "side int, cash double, fill double, held int"
OUT = "asset string, ts timestamp, position int, action int, equity double"


def streaming_simulator(bars: DataFrame, rules: Rules) -> DataFrame:
    """The simulator's fold over a stream of (asset, ts, price, entry, exit) in event-time order within each
    micro-batch; side, cash, fill price and bars held are the state of each asset. Signals act on their own bar."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, cash, fill, held = state.get if state.exists else (0, 1.0, 0.0, 0)
        fee = (1 - rules.slippage) * (1 - rules.cost)
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                worth, action = cash, 0
                if side:
                    held += 1
                    worth = cash * (1 + side * (r.price / fill - 1))
                    bars_ = rules.long_bars if side > 0 else rules.short_bars
                    if leave(r.exit == -side, 0 < bars_ <= held, bars_ > 0, rules):
                        side, action, worth = 0, 4, worth * fee
                        cash = worth
                elif r.entry in (1, -1):
                    side, action, fill, held, worth = int(r.entry), 1, r.price, 0, worth * fee
                    cash = worth
                rows.append((key[0], r.ts, side, action, 100 * worth))
        state.update((side, cash, fill, held))
        yield pd.DataFrame(rows, columns=["asset", "ts", "position", "action", "equity"])

    return bars.groupBy("asset").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
