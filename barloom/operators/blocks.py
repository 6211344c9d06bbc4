"""Blocks of time that hold about equally many rows, for work that runs along time, and exponential averages over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 200_000


def micros(c: Column, kind: str) -> Column:
    """A date or time as a whole number, of microseconds for times and of days for dates."""
    return F.unix_date(c) if kind == "date" else F.unix_micros(c.cast("timestamp"))


def cuts(frames: list[DataFrame], ts: str = "ts", rows: int = BLOCK_ROWS) -> list[float]:
    """Times that cut all rows of the frames into blocks of about so many, by approximate quantiles.

    The cuts follow the rows, not the clock: a crowded hour gets many blocks, a quiet year one. Rows of one
    time stay together. One pass of an aggregate; the cuts are control data, one number a block.
    """
    at = None
    for df in frames:
        one = df.select(micros(F.col(ts), df.schema[ts].dataType.simpleString()).alias("t"))
        at = one if at is None else at.unionByName(one)
    n = at.count()
    k = -(-n // rows)
    if k < 2:
        return []
    shares = [i / k for i in range(1, k)]
    found = at.agg(F.percentile_approx("t", shares, F.lit(max(10_000, 20 * k))).alias("q")).first()["q"]
    return sorted(set(map(float, found or [])))


def with_block(df: DataFrame, at: list[float], ts: str = "ts", name: str = "_block") -> DataFrame:
    """df with the number of each row's block; rows without a time go to the first."""
    if not at:
        return df.withColumn(name, F.lit(0))
    t = F.coalesce(micros(F.col(ts), df.schema[ts].dataType.simpleString()).cast("double"), F.lit(at[0] - 1))
    cut = Bucketizer(splits=[-math.inf, *at, math.inf], inputCol="_t", outputCol=name)
    return cut.transform(df.withColumn("_t", t)).drop("_t").withColumn(name, F.col(name).cast("int"))


# An exponential average as affine maps: y -> decay * y + gain, one for each value, composed over blocks.


def block_map(x: np.ndarray, alpha: float) -> dict:
    """What a block of values does to an average from before it: rows, missing rows ahead of its first value and
    behind its last, that first value, and the map from the average there to the average at its last value."""
    seen = np.flatnonzero(~np.isnan(x))
    if not len(seen):
        return {"n": len(x), "lead": len(x), "tail": len(x), "first": None, "decay": 1.0, "gain": 0.0}
    rest = x[seen[0] :]
    ewm = lambda v: pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-1]
    zero, one = rest.copy(), np.where(np.isnan(rest), np.nan, 0.0)
    zero[0], one[0] = 0.0, 1.0
    return {"n": len(x), "lead": int(seen[0]), "tail": len(x) - 1 - int(seen[-1]), "first": float(x[seen[0]]), "decay": float(ewm(one)), "gain": float(ewm(zero))}


def entered(y: float | None, gap: float, lead: int, first: float, alpha: float) -> float:
    """The average at a block's first value, from the average before the block."""
    if y is None:
        return first
    w = (1.0 - alpha) ** (gap + lead + 1.0)
    return (w * y + alpha * first) / (w + alpha)


def prefixes(maps: pd.DataFrame, alpha: float) -> tuple[list, list]:
    """The average and its age in missing rows before each block, from the maps in order."""
    y, gap, ys, gaps = None, 0.0, [], []
    for n, lead, tail, first, decay, gain in maps[["n", "lead", "tail", "first", "decay", "gain"]].itertuples(index=False):
        ys.append(y)
        gaps.append(gap)
        if first is None or pd.isna(first):
            gap += n
        else:
            y, gap = decay * entered(y, gap, int(lead), first, alpha) + gain, float(tail)
    return ys, gaps


def block_values(x: np.ndarray, alpha: float, y: float | None, gap: float) -> np.ndarray:
    """The averages at a block's rows; a missing value keeps the last one."""
    seen = np.flatnonzero(~np.isnan(x))
    out = np.full(len(x), np.nan if y is None else y)
    if len(seen):
        rest = x[seen[0] :].copy()
        rest[0] = entered(y, gap, int(seen[0]), rest[0], alpha)
        out[seen[0] :] = pd.Series(rest).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def averages(df: DataFrame, specs: dict[str, tuple[str, float]], key: str, at: list[float], ts: str = "ts") -> DataFrame:
    """df with exponential averages, name -> (column, alpha): y0 = x0, y = alpha x + (1 - alpha) y; over gaps the value
    stays while its weight decays.

    Each block of a key's rows becomes an affine map in a task of its own; a prefix over the maps, one row a block, gives
    every block its start, and a second pass over the blocks the values. Without cuts a key is one block.
    """
    rows = with_block(df, at, ts)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    out_schema = ", ".join([*fields, *(f"`{n}` double" for n in specs)])
    names = [f.name for f in df.schema.fields]
    ordered = lambda pdf: pdf.sort_values(ts, kind="stable").reset_index(drop=True)
    values = lambda pdf, c: pd.to_numeric(pdf[c]).to_numpy(float)

    def fill(pdf: pd.DataFrame, start: dict) -> pd.DataFrame:
        pdf = ordered(pdf)
        for name, (column, alpha) in specs.items():
            pdf[name] = block_values(values(pdf, column), alpha, *start.get(name, (None, 0.0)))
        return pdf[[*names, *specs]]

    if not at:
        return rows.groupBy(key).applyInPandas(lambda pdf: fill(pdf, {}), out_schema)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        found = [{"name": name, **block_map(values(pdf, c), a)} for name, (c, a) in specs.items()]
        return pd.DataFrame([{"key": str(pdf[key].iloc[0]), "block": int(pdf["_block"].iloc[0]), **f} for f in found])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        y, gap = prefixes(pdf, specs[pdf["name"].iloc[0]][1])
        return pdf[["key", "block", "name"]].assign(y=pd.array(y, "Float64"), gap=gap)

    used = sorted({c for c, _ in specs.values()})
    narrow = rows.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, ts, "_block", *used]))
    table = narrow.groupBy(key, "_block").applyInPandas(maps, "key string, block int, name string, n long, lead long, tail long, first double, decay double, gain double")
    before = table.groupBy("key", "name").applyInPandas(starts, "key string, block int, name string, y double, gap double")  # one row a block

    def finish(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return fill(pdf, {n: (None if pd.isna(y) else y, g) for n, y, g in start[["name", "y", "gap"]].itertuples(index=False)})

    keyed = rows.withColumn("_key", F.col(key).cast("string"))
    return keyed.groupBy("_key", "_block").cogroup(before.groupBy("key", "block")).applyInPandas(lambda pdf, start: finish(pdf, start) if len(pdf) else pd.DataFrame(columns=[*names, *specs]), out_schema)
