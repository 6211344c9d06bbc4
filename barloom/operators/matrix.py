"""Parameter domains, period-keyed precompute, matrix aggregation, plateau and robust scores."""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.safe import control, div
from .indicators import full, trailing
from .simulate import compounded


def expand(domain: dict) -> list[float]:
    """fixed {value}, set {values} or range {start, stop, step}, the end included within 1e-12."""
    kind = domain.get("type", "fixed")
    if kind == "fixed":
        return [domain["value"]]
    if kind == "set":
        return list(domain["values"])
    if kind == "range":
        a, z, s = domain["start"], domain["stop"], domain.get("step", 1)
        if s <= 0:
            raise ValueError("step must be positive")
        out, k = [], 0
        while a + k * s <= z + 1e-12:
            out.append(a + k * s)
            k += 1
        return out
    raise ValueError(f"unknown domain {kind!r}")


def combos(domains: dict[str, dict], hard_cap: int = 100_000, warn_cap: int = 10_000) -> tuple[list[dict], list[str]]:
    """Cartesian product of the axes, with warnings; more than hard_cap is an error."""
    axes = {k: expand(d) for k, d in domains.items()}
    n = 1
    for v in axes.values():
        n *= len(v)
    if n > hard_cap:
        raise ValueError(f"{n} combinations exceed the cap of {hard_cap}")
    rows = [dict(zip(axes, values)) for values in product(*axes.values())]
    return rows, [f"{n} combinations exceed {warn_cap}"] if n > warn_cap else []


def sampled(rows: list[dict], budget: int, seed: int = 42) -> list[dict]:
    """A seeded random choice in the old order, when there are more combinations than the budget."""
    if len(rows) <= budget:
        return rows
    return [rows[i] for i in sorted(random.Random(seed).sample(range(len(rows)), budget))]


def suggested(domains: dict[str, dict], scores: list[tuple[dict, float]], batch: int, seed: int = 42, best: float = 0.25, tries: int = 24) -> list[dict]:
    """New combinations by a tree-structured Parzen estimate over the axes' own values.

    The scores so far are split into the best share and the rest. Each axis has a density for both,
    smoothed over neighbouring values and never 0; of ``tries`` combinations drawn from the best ones'
    densities, the one with the largest ratio of both is taken, ``batch`` times without repeats. With
    fewer than four scores, or none left to draw, combinations are drawn evenly.
    """
    axes, rng = {k: expand(d) for k, d in domains.items()}, random.Random(seed + len(scores))
    seen = {tuple(p[k] for k in axes) for p, _ in scores}
    size = 1
    for v in axes.values():
        size *= len(v)
    ranked_ = sorted(scores, key=lambda s: -s[1])
    cut = max(1, round(best * len(ranked_)))

    def density(rows: list[tuple[dict, float]], k: str) -> list[float]:
        values = axes[k]
        at = [values.index(p[k]) for p, _ in rows]
        width = max(1.0, len(values) / 6)
        raw = [1.0 / len(values) + sum(math.exp(-(((i - j) / width) ** 2) / 2) for j in at) for i in range(len(values))]
        return [r / sum(raw) for r in raw]

    good, bad = ({k: density(rows, k) for k in axes} for rows in (ranked_[:cut], ranked_[cut:]))
    out: list[dict] = []
    while len(out) < batch and len(seen) < size:
        even = len(scores) < 4
        drawn = [{k: rng.choices(v, None if even else good[k])[0] for k, v in axes.items()} for _ in range(tries)]
        fresh = [c for c in drawn if tuple(c.values()) not in seen]
        if not fresh:  # what is left is rare under the densities: take it in order
            fresh = [dict(zip(axes, next(v for v in product(*axes.values()) if v not in seen)))]
        ratio = lambda c: sum(math.log(good[k][axes[k].index(c[k])] / bad[k][axes[k].index(c[k])]) for k in axes)
        pick = fresh[0] if even else max(fresh, key=ratio)
        seen.add(tuple(pick.values()))
        out.append(pick)
    return out


def search(evaluate, domains: dict[str, dict], budget: int, batch: int = 8, seed: int = 42) -> list[tuple[dict, float]]:
    """Sequential search: ``evaluate`` scores a batch of combinations, in one Spark plan, and gives one number
    each (None or NaN counts as the worst); the scores so far, best first. Only parameters and scores are on the driver."""
    scores: list[tuple[dict, float]] = []
    while len(scores) < budget:
        rows = suggested(domains, scores, min(batch, budget - len(scores)), seed)
        if not rows:
            break
        found = [float("-inf") if v is None or v != v else float(v) for v in evaluate(rows)]
        scores += list(zip(rows, found))
    return sorted(scores, key=lambda s: -s[1])


def dominates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: row i of a is at least as good as row j of b in every column (larger is better) and better in one."""
    return (a[:, None, :] >= b[None, :, :]).all(axis=2) & (a[:, None, :] > b[None, :, :]).any(axis=2)


def best_rows(values: np.ndarray, block: int = 1024) -> np.ndarray:
    """Mask of the rows that no row dominates; equal rows stay together. Blocks meet the front found so far."""
    keep: list[int] = []
    for start in range(0, len(values), block):
        rows = np.array([*keep, *range(start, min(start + block, len(values)))])
        keep = rows[~dominates(values[rows], values[rows]).any(axis=0)].tolist()
    out = np.zeros(len(values), bool)
    out[keep] = True
    return out


def sorted_fronts(values: np.ndarray) -> np.ndarray:
    """The number of each row's front: 0 is dominated by none, 1 only by front 0, and so on."""
    out, left, k = np.zeros(len(values), np.int64), np.arange(len(values)), 0
    while len(left):
        best = best_rows(values[left])
        out[left[best]] = k
        left, k = left[~best], k + 1
    return out


def crowding(values: np.ndarray) -> np.ndarray:
    """Per row of one front: the summed gaps between its neighbours in each objective, over the objective's range; ends are infinite."""
    out = np.zeros(len(values))
    for c in values.T:
        order = np.argsort(c, kind="stable")
        width = c[order[-1]] - c[order[0]] if len(c) else 0.0
        out[order[[0, -1]]] = np.inf
        if width > 0:
            out[order[1:-1]] += (c[order[2:]] - c[order[:-2]]) / width
    return out


def search_front(evaluate, domains: dict[str, dict], budget: int, directions: tuple[str, ...] = ("max", "max", "min"), batch: int = 8, seed: int = 42) -> list[tuple[dict, tuple, int]]:
    """Sequential search for several objectives: ``evaluate`` gives a tuple of numbers for each combination of a batch.

    Combinations are ordered by their front, within it by crowding distance (the less crowded first), and that order
    guides the next draws as scores do in ``search``. Returns (combination, values, front), best first; front 0 is the
    set that nothing found dominates. A missing value is the worst.
    """
    sign = np.array([1.0 if d == "max" else -1.0 for d in directions])
    rows: list[dict] = []
    values = np.zeros((0, len(directions)))
    order = np.zeros(0, np.int64)
    front = np.zeros(0, np.int64)
    while len(rows) < budget:
        guided = [(rows[i], -float(k)) for k, i in enumerate(order)]
        new = suggested(domains, guided, min(batch, budget - len(rows)), seed)
        if not new:
            break
        found = np.array([[np.nan if v is None else float(v) for v in t] for t in evaluate(new)]).reshape(len(new), -1) * sign
        rows, values = rows + new, np.vstack([values, np.where(np.isnan(found), -np.inf, found)])
        front, spread = sorted_fronts(values), np.zeros(len(rows))
        for k in range(front.max() + 1):
            spread[front == k] = crowding(np.nan_to_num(values[front == k], neginf=-1e300))
        order = np.lexsort((-spread, front))
    return [(rows[i], tuple((values[i] * sign).tolist()), int(front[i])) for i in order]


def halved(evaluate, rows: list[dict], shares: tuple[float, ...] = (1 / 9, 1 / 3, 1.0), keep: float = 1 / 3) -> tuple[list[tuple[dict, float]], list[dict]]:
    """Successive halving: all combinations are scored on the first share of the history, the best ``keep`` of them
    on the next, and so on. ``evaluate(rows, share)`` gives one number each. Returns the last rung's scores, best first, and
    a report of the rungs: share, evaluated, kept."""
    report, scores = [], []
    for i, share in enumerate(shares):
        found = [float("-inf") if v is None or v != v else float(v) for v in evaluate(rows, share)]
        scores = sorted(zip(rows, found), key=lambda s: -s[1])
        left = len(scores) if i + 1 == len(shares) else max(1, math.ceil(len(scores) * keep))
        report.append({"share": share, "evaluated": len(rows), "kept": left})
        rows = [r for r, _ in scores[:left]]
    return scores, report


def front(rows: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """Rows that no row dominates in the objectives (name -> max or min); rows with a NULL in one are left out.

    Each task keeps the front of its own rows; only those fronts meet in one task.
    """
    names = list(objectives)
    sign = np.array([1.0 if objectives[n] == "max" else -1.0 for n in names])
    full_ = rows.where(" and ".join(f"`{n}` is not null" for n in names))

    def own(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = held[best_rows(held[names].to_numpy(float) * sign)]
        if held is not None:
            yield held

    return full_.mapInPandas(own, rows.schema).coalesce(1).mapInPandas(own, rows.schema)


def combo_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """combo_id and one column per axis; a control-plane table bounded by the cap."""
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], ["combo_id", *rows[0]])


def averages_by_period(panel: DataFrame, periods: list[int], x: str = "close") -> DataFrame:
    """(asset, ts, close, period, avg): every distinct period once, all over one ordering of the panel."""
    cells = F.array(*[F.struct(F.lit(p).cast("long").alias("period"), full(F.avg(x).over(trailing(p, "asset")), F.col(x), p).alias("avg")) for p in periods])
    rows = panel.select("asset", "ts", "close", cells.alias("_c"))
    return rows.select("asset", "ts", "close", F.explode("_c").alias("e")).select("asset", "ts", "close", "e.period", "e.avg")


def sweep_average_cross(panel: DataFrame, combos_: DataFrame, periods: list[int]) -> DataFrame:
    """Total return of holding while fast > slow, for every (fast, slow) combo and asset.

    Averages are computed once per distinct period and joined to combos by period, so the work grows
    with periods plus combos' own rows, not with recomputed windows.
    """
    avg = averages_by_period(panel, periods)
    fast = avg.select("asset", "ts", "close", F.col("period").alias("fast"), F.col("avg").alias("fa"))
    slow = avg.select("asset", "ts", F.col("period").alias("slow"), F.col("avg").alias("sa"))
    grid = fast.join(control(combos_), "fast").join(slow, ["asset", "ts", "slow"])
    w = Window.partitionBy("combo_id", "asset").orderBy("ts")
    held = F.coalesce(F.lag((F.col("fa") > F.col("sa")).cast("double")).over(w), F.lit(0.0))
    r = F.coalesce(div(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))
    rows = grid.withColumn("r", held * r)
    return rows.groupBy("combo_id", "fast", "slow", "asset").agg((compounded(1 + F.col("r")) - 1).alias("total_return"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))


def cell_aggregate(rows: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """mean, median, best, worst and population deviation per cell."""
    return rows.groupBy(x, y).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("best"), F.min(value).alias("worst"), F.stddev_pop(value).alias("std")
    )


def grid_pivot(cells: DataFrame, x: str, y: str, value: str, columns: list) -> DataFrame:
    return cells.groupBy(x).pivot(y, columns).agg(F.first(value))


def parameter_importance(rows: DataFrame, params: list[str], score: str) -> DataFrame:
    """Population deviation of the mean score by value of each parameter, over the largest, at most 1."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("v")) for p in params])).alias("e"), F.col(score).alias("_s"))
    spread = long.groupBy("e.param", "e.v").agg(F.avg("_s").alias("m")).groupBy("param").agg(F.stddev_pop("m").alias("spread"))
    top = F.max("spread").over(Window.partitionBy())  # one row per parameter
    return spread.select("param", F.least(F.coalesce(div(F.col("spread"), F.nullif(top, F.lit(0.0))), F.lit(0.0)), F.lit(1.0)).alias("importance"))


def plateau(cells: DataFrame, x: str, y: str, value: str, reach: float = 20) -> DataFrame:
    """Neighbours within ``reach`` on both axes. support: their share at 90 % of the cell or more (of the cell
    itself if it is negative); stability: 1 - their population deviation over max(|cell|, 1), at least 0;
    plateau_score: 0.6 support + 0.4 stability.

    Cells meet by buckets of the reach on both axes (each cell visits its 3 x 3 buckets), not all with all.
    """
    a = cells.select(x, y, F.col(value).alias("_c")).withColumns({"_bx": F.floor(F.col(x) / reach), "_by": F.floor(F.col(y) / reach)})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = a.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("_c").alias("_v"), "_bx", "_by", F.explode(near).alias("_d"))
    b = b.select("_x", "_y", "_v", (F.col("_bx") + F.col("_d.i")).alias("_bx"), (F.col("_by") + F.col("_d.j")).alias("_by"))
    close = (F.abs(F.col(x) - F.col("_x")) <= reach) & (F.abs(F.col(y) - F.col("_y")) <= reach)
    pairs = a.join(b, ["_bx", "_by"]).where(close & ~((F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))))
    bar = F.when(F.col("_c") >= 0, 0.9 * F.col("_c")).otherwise(F.col("_c"))
    agg = pairs.groupBy(x, y, "_c").agg(F.count("*").alias("neighbours"), F.avg((F.col("_v") >= bar).cast("double")).alias("support"), F.stddev_pop("_v").alias("_s"))
    out = agg.withColumn("stability", F.greatest(F.lit(0.0), 1 - F.col("_s") / F.greatest(F.abs("_c"), F.lit(1.0))))
    return out.select(x, y, "neighbours", "support", "stability", (0.6 * F.col("support") + 0.4 * F.col("stability")).alias("plateau_score"))


def best_region(cells: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Centre and mean of the best 3 x 3 region of a dense grid, by sums along one axis and then the other."""
    ranks = cells.withColumns({"_i": F.dense_rank().over(Window.partitionBy(y).orderBy(x)), "_j": F.dense_rank().over(Window.partitionBy(x).orderBy(y))})
    row = ranks.withColumns({c: F.sum(e).over(Window.partitionBy(y).orderBy("_i").rowsBetween(-1, 1)) for c, e in (("_s", F.col(value)), ("_k", F.lit(1)))})
    both = row.withColumns({c: F.sum(c).over(Window.partitionBy(x).orderBy("_j").rowsBetween(-1, 1)) for c in ("_s", "_k")})
    return both.where("_k = 9").select(x, y, (F.col("_s") / 9).alias("region_mean")).orderBy(F.desc("region_mean"), x, y).limit(1)


def robust_score(sharpe: str, ratio: str, std: str, drawdown: str):
    """sharpe + OOS/IS ratio - 0.25 |std| - 0.25 |min(drawdown, 0)|."""
    return F.col(sharpe) + F.col(ratio) - 0.25 * F.abs(F.col(std)) - 0.25 * F.abs(F.least(F.col(drawdown), F.lit(0.0)))


#: Weights of Sharpe, plateau and drawdown penalty, and sort keys, by ranking profile.
PROFILES = {
    "balanced": ((1.0, 0.35, 0.3), ("robust_score", "plateau_score", "sharpe")),
    "stability_first": ((0.75, 0.5, 0.35), ("stability_score", "plateau_score", "robust_score", "sharpe")),
    "performance_first": ((1.2, 0.2, 0.2), ("robust_score", "sharpe", "plateau_score")),
    "drawdown_aware": ((0.9, 0.35, 0.5), ("robust_score", "max_drawdown", "plateau_score", "sharpe")),
}


def _unit(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))


def with_scores(rows: DataFrame, profile: str = "balanced") -> DataFrame:
    """Add stability_score (plateau, exposure in %, drawdown, trades up to 30, weighed 0.45, 0.2, 0.2, 0.15) and
    robust_score by the profile's weights, from plateau_score, exposure, max_drawdown, trade_count, sharpe."""
    (a, b, c), _ = PROFILES[profile]
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    fall = _unit(F.abs("max_drawdown"))
    return rows.withColumns({
        "stability_score": 0.45 * zero("plateau_score") + 0.2 * _unit(F.col("exposure") / 100) + 0.2 * (1 - fall) + 0.15 * _unit(F.col("trade_count") / 30),
        "robust_score": a * zero("sharpe") + b * zero("plateau_score") - c * fall,
    })


def review(accepted):
    """Pass if accepted, Review from a plateau score of 0.45 or a Sharpe of 0.75, else Fail."""
    near = (F.coalesce(F.col("plateau_score"), F.lit(0.0)) >= 0.45) | (F.coalesce(F.col("sharpe"), F.lit(0.0)) >= 0.75)
    return F.when(accepted, "Pass").when(near, "Review").otherwise("Fail")


def ranked(rows: DataFrame, profile: str, ties: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """Add position by the profile's keys, all descending with NULLs last; ties by the given columns."""
    order = [F.desc_nulls_last(k) for k in PROFILES[profile][1] if k in rows.columns]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*order, *ties)))


def shortlist(rows: DataFrame, ties: list[str]) -> DataFrame:
    """The best row by each of robust_score, plateau_score, total_return and calmar: (representative_type, row)."""
    out = None
    for kind in ("robust_score", "plateau_score", "total_return", "calmar"):
        if kind not in rows.columns:
            continue
        best = rows.orderBy(F.desc_nulls_last(kind), *ties).limit(1).withColumn("representative_type", F.lit(kind))
        out = best if out is None else out.unionByName(best)
    return out


def cluster_count(n: int, most: int = 5) -> int:
    """1 up to three rows, 2 up to eight, then the root of n, at most ``most``."""
    return 1 if n <= 3 else 2 if n <= 8 else min(most, max(2, round(n**0.5)))


def clusters(rows: DataFrame, params: list[str], score: str | None = None, most: int = 5, seed: int = 42) -> DataFrame:
    """k-means clusters of standardised parameters (k: cluster_count). The representative is the row nearest
    its cluster's medians by the sum of distances; ties by the higher score, then by the parameters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = rows.count()
    k = cluster_count(n, most)
    v = VectorAssembler(inputCols=params, outputCol="_raw").transform(rows)
    v = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(v).transform(v)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(v) if k > 1 else None
    out = model.transform(v) if model else v.withColumn("cluster", F.lit(0))
    whole = Window.partitionBy("cluster")
    far = sum((F.abs(F.col(p) - F.percentile(p, F.lit(0.5)).over(whole)) for p in params), F.lit(0.0))
    out = out.withColumn("_far", far)
    pick = F.row_number().over(whole.orderBy("_far", *([F.desc_nulls_last(score)] if score else []), *params)) == 1
    return out.withColumn("representative", pick).drop("_raw", "_x", "_far")
