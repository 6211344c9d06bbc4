"""Statistical diagnostics of series: lagged correlation, stationarity, autocorrelation, distribution, seasonality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, div

KEYS = ("asset",)
LAGS = (*range(31), 45, 60)
LEAST_PAIRS = 30


def average_rank(x, *keys):
    """Rank from 1 with ties averaged, within the keys; x must be a column."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def lagged_pairs(rows: DataFrame, x: str, y: str, lags=LAGS, keys=KEYS) -> DataFrame:
    """(keys, lag, x, y): x with y as many rows later."""
    w = by_time(*keys)
    ahead = F.array(*[F.struct(F.lit(int(k)).alias("lag"), (F.lead(y, int(k)).over(w) if k else F.col(y)).alias("y")) for k in lags])
    rows = rows.withColumn("_ahead", ahead)
    return rows.select(*keys, "ts", F.col(x).alias("x"), F.explode("_ahead").alias("e")).select(*keys, "ts", "x", "e.lag", "e.y").where("x is not null and y is not null")


def chatterjee(pairs: DataFrame, a: str, b: str, keys) -> DataFrame:
    """xi(a -> b) = 1 - n sum |r(i+1) - r(i)| / (2 sum l (n - l)), rows in order of a, r ranks of b from below, l from above."""
    w = Window.partitionBy(*keys)
    r = pairs.withColumns({"_r": F.count("*").over(w.orderBy(b).rangeBetween(Window.unboundedPreceding, 0)), "_l": F.count("*").over(w.orderBy(F.col(b).desc()).rangeBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(w)})
    r = r.withColumn("_d", F.abs(F.lead("_r").over(w.orderBy(a, "ts")) - F.col("_r")))
    return r.groupBy(*keys).agg((1 - div(F.max("_n") * F.sum("_d"), 2.0 * F.sum(F.col("_l") * (F.col("_n") - F.col("_l"))))).alias("xi"))


def lagged_correlation(rows: DataFrame, x: str, y: str, lags=LAGS, keys=KEYS, least: int = LEAST_PAIRS) -> DataFrame:
    """(keys, lag, n, pearson, spearman, xi) for lags with enough pairs; xi is the larger of both directions."""
    by = [*keys, "lag"]
    pairs = lagged_pairs(rows, x, y, lags, keys)
    ranks = pairs.withColumns({"_rx": average_rank(F.col("x"), *by), "_ry": average_rank(F.col("y"), *by)})
    base = ranks.groupBy(*by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman")).where(F.col("n") >= least)
    forth, back = chatterjee(pairs, "x", "y", by), chatterjee(pairs, "y", "x", by).withColumnRenamed("xi", "xi2")
    return base.join(forth, by).join(back, by).select(*by, "n", "pearson", "spearman", F.greatest("xi", "xi2").alias("xi"))


def best_lag(correlations: DataFrame, keys=KEYS) -> DataFrame:
    """Lags with the largest absolute rank correlation and the largest xi; ties to the smaller lag."""
    return correlations.groupBy(*keys).agg(
        F.max_by("lag", F.struct(F.abs("spearman"), -F.col("lag"))).alias("spearman_lag"), F.max_by("lag", F.struct("xi", -F.col("lag"))).alias("xi_lag")
    )


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function of an array: its power series near 0, the tail's continued
    fraction beyond; exact to about 1e-15."""
    x = np.asarray(x, float)
    a = np.abs(x)
    density = np.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    near = np.minimum(a, 3.0)
    term = total = near.copy()
    for k in range(1, 60):
        term = term * near * near / (2 * k + 1)
        total = total + term
    far, tail = np.maximum(a, 3.0), np.zeros_like(a)
    for k in range(80, 0, -1):
        tail = k / (far + tail)
    upper = np.where(a <= 3, 0.5 - total * density, density / (far + tail))
    return np.where(np.isnan(x), np.nan, np.where(x > 0, 1 - upper, upper))


def beta_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t by the continued fraction of the incomplete beta function."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    x, a, b = df / (df + t * t), df / 2, np.full(t.shape, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    sizes, back = np.unique(a, return_inverse=True)
    beta = (gamma(sizes + 0.5) - gamma(sizes) - math.lgamma(0.5))[back].reshape(t.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(beta + a * np.log(x) + b * np.log1p(-x))
    small = lambda v: np.where(v == 0, 1e-300, v)

    def fraction(x, a, b):
        c, d = np.ones_like(x), 1 / small(1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / small(1 + top * d)
                c = small(1 + top / c)
                h = h * c * d
            if (np.abs(c * d - 1) < 1e-14).all():
                break
        return h

    low = x < (a + 1) / (a + b + 2)
    y, p, q = np.where(low, x, 1 - x), np.where(low, a, b), np.where(low, b, a)
    out = front * fraction(y, p, q) / p
    return np.where(x >= 1, 1.0, np.where(low, out, 1 - out))


def correlation_p(r, n) -> np.ndarray:
    """Two-sided p-values of correlations of n pairs."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    inner = np.where(np.abs(r) >= 1, 0.0, r)
    return np.where(np.abs(r) >= 1, 0.0, beta_tail(inner * np.sqrt((n - 2) / (1 - inner * inner)), n - 2))


def distribution(rows: DataFrame, x: str, keys=KEYS) -> DataFrame:
    """Population skewness and excess kurtosis, Kolmogorov-Smirnov distance to the *standard* normal,
    Anderson-Darling statistic against the normal with the sample's mean and deviation, is_normal (always False)."""
    cdf = F.pandas_udf(lambda s: pd.Series(normal_cdf(s.to_numpy(float))), "double")
    r = rows.where(f"`{x}` is not null")
    w, whole = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys)
    r = r.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(whole), "_z": div(F.col(x) - F.avg(x).over(whole), F.nullif(F.stddev_samp(x).over(whole), F.lit(0.0)))})
    r = r.withColumns({"_p": cdf(x), "_q": cdf("_z"), "_u": cdf(-F.col("_z"))})
    d = F.greatest(F.col("_i") / F.col("_n") - F.col("_p"), F.col("_p") - (F.col("_i") - 1) / F.col("_n"))
    low, i, n = F.lit(1e-300), F.col("_i"), F.col("_n")
    term = ((2 * i - 1) * F.ln(F.greatest("_q", low)) + (2 * (n - i) + 1) * F.ln(F.greatest("_u", low))) / n
    return r.groupBy(*keys).agg(
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess_kurtosis"), F.max(d).alias("ks"), (-F.max("_n") - F.sum(term)).alias("anderson")
    ).withColumn("is_normal", F.lit(False))


def durbin(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations by the Levinson-Durbin recursion."""
    out, phi = [], np.zeros(0)
    for k in range(1, len(acf) + 1):
        past = acf[: k - 1][::-1]
        den = 1 - phi @ acf[: k - 1] if k > 1 else 1.0
        a = (acf[k - 1] - phi @ past) / den if den else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


def partial_autocorrelation(acf: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, lag, pacf) from (keys, lag, acf) with adjusted autocorrelations; a row a lag, not the series, goes to one task."""
    names = list(keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf.assign(pacf=durbin(pdf["acf"].to_numpy(float)))[[*names, "lag", "pacf"]]

    kinds = ", ".join(f"{k} {acf.schema[k].dataType.simpleString()}" for k in names)
    return acf.groupBy(*names).applyInPandas(one, f"{kinds}, lag int, pacf double")


def default_lags(rows: DataFrame, keys=KEYS, most: int = 60) -> int:
    """min(most, half of the longest series)."""
    longest = rows.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    return max(1, min(most, longest // 2))


#: Asymptotic critical points of the tests with a constant, 1, 5 and 10 % (KPSS also 2.5 %).
ADF_POINTS = (-3.43, -2.86, -2.57)
KPSS_POINTS = (0.739, 0.463, 0.347)
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
#: MacKinnon's response surface of the unit-root test with a constant (1994): the normal quantile
#: of the p-value as a polynomial of the statistic, up to and above the turn, and the ends of its range.
ADF_TURN, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(statistic: float) -> float:
    if np.isnan(statistic):
        return float("nan")
    if statistic > ADF_MOST:
        return 1.0
    if statistic < ADF_LEAST:
        return 0.0
    quantile = sum(c * statistic**k for k, c in enumerate(ADF_LOW if statistic <= ADF_TURN else ADF_HIGH))
    return float(normal_cdf(np.array([quantile]))[0])


def kpss_p(statistic: float) -> float:
    """Between the tabulated points by straight lines, not beyond them: 0.01 to 0.1."""
    points, p = zip(*KPSS_TABLE)
    return float("nan") if np.isnan(statistic) else float(np.interp(statistic, points, p))


def most_lags(n: int) -> int:
    """Lags that the unit-root regression of n values may try."""
    return max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))


def _level_t(gram: np.ndarray, rows: float, lags: int) -> tuple[float, float]:
    """(information criterion, t statistic of the level) from the moments of [1, level, lagged changes..., change]."""
    use = [0, 1, *range(2, 2 + lags)]
    a, y, yy = gram[np.ix_(use, use)], gram[use, -1], gram[-1, -1]
    if rows <= len(use):
        return float("inf"), float("nan")
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a * np.outer(scale, scale), hermitian=True) * np.outer(scale, scale)
    beta = inverse @ y
    left = max(yy - beta @ y, 1e-300)
    aic = rows * np.log(left / rows) + 2 * len(use)
    return aic, float(beta[1] / np.sqrt(max(left / (rows - len(use)) * inverse[1, 1], 1e-300)))


def _moments(rows: DataFrame, x: str, keys: tuple[str, ...], most: int | None):
    """(rows with n, m, i and v = [1, level, changes m..1 bars ago, change], names of the columns, widest m).

    m is the number of lags that a series may try, or ``most``; levels are centred. v is padded at the
    left of the changes, so every row has the same width.
    """
    w, whole = by_time(*keys), Window.partitionBy(*keys)
    r = rows.where(f"`{x}` is not null").select(*keys, "ts", F.col(x).cast("double").alias("_x"))
    r = r.withColumns({"n": F.count("*").over(whole), "_x": F.col("_x") - F.avg("_x").over(whole), "i": F.row_number().over(w)})
    m = F.lit(most) if most is not None else F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("n") / 100, 0.25)), F.floor(F.col("n") / 2) - 2)).cast("int")
    r = r.withColumns({"m": m, "_l": F.lag("_x").over(w), "_d": F.col("_x") - F.lag("_x").over(w)})
    wide = most if most is not None else (r.agg(F.max("m")).first()[0] or 0)
    past = F.collect_list("_d").over(w.rowsBetween(-wide, 0))
    r = r.withColumn("_p", past).where("i > 1")
    pad = F.array_repeat(F.lit(0.0), F.lit(wide + 1) - F.size("_p"))
    return r.select(*keys, "n", "m", "i", F.concat(F.array(F.lit(1.0), F.col("_l")), pad, "_p").alias("v")), wide


def unit_root(rows: DataFrame, x: str, lags: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, adf): the augmented unit-root regression with a constant, at a fixed number of lags, or at the
    one that the information criterion chooses, fitted again on all rows that it leaves.

    The rows become one moment matrix a task and series, which are added up; only matrices and the first few rows of each
    series, which the refit needs, are solved in one place.
    """
    names, (table, wide) = list(keys), _moments(rows, x, keys, lags)
    size = wide + 3
    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in names)

    def gram(batches):
        for pdf in batches:
            for key, part in pdf.groupby(names, dropna=False, sort=False):
                v = np.array(part["v"].tolist())
                yield pd.DataFrame({**{k: [u] for k, u in zip(names, key)}, "rows": [len(v)], "g": [(v.T @ v).ravel()]})

    fitted = table.where(F.col("i") >= F.col("m") + 2).select(*names, "v")
    sums = fitted.mapInPandas(gram, f"{kinds}, rows long, g array<double>").groupBy(*names).agg(
        F.sum("rows").alias("rows"), F.array(*[F.sum(F.get("g", F.lit(k))) for k in range(size * size)]).alias("g") if size <= 6 else F.collect_list("g").alias("g")
    )
    if size > 6:  # one matrix a task
        sums = sums.withColumn("g", F.aggregate("g", F.array_repeat(F.lit(0.0), size * size), lambda a, b: F.zip_with(a, b, lambda p, q: p + q)))
    head = table.groupBy(*names).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.array_sort(F.collect_list(F.when(F.col("i") < F.col("m") + 2, F.struct("i", "v")))).alias("head"))
    both = head.join(sums, names, "left")

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                t = float("nan")
                if r["g"] is not None and not np.isscalar(r["g"]):
                    g = np.array(r["g"]).reshape(size, size)
                    # the changes stand oldest first: lags from the nearest on
                    order = [0, 1, *range(size - 2, 1, -1), size - 1]
                    g, count, m = g[np.ix_(order, order)], float(r["rows"]), int(r["m"])
                    best = lags
                    if lags is None:
                        best = int(np.argmin([_level_t(g, count, p)[0] for p in range(m + 1)]))
                        for h in r["head"]:
                            if h["i"] >= best + 2:
                                v = np.array(h["v"])[order]
                                g, count = g + np.outer(v, v), count + 1
                    t = _level_t(g, count, best)[1]
                out.append([*(r[k] for k in names), int(r["n"]), t])
            yield pd.DataFrame(out, columns=[*names, "n", "adf"])

    return both.select(*names, "n", "m", "rows", "g", "head").mapInPandas(solve, f"{kinds}, n long, adf double")


def level_stationarity(rows: DataFrame, x: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, lags, kpss): the level statistic with its data-dependent bandwidth, by windows and aggregates."""
    w, whole = by_time(*keys), Window.partitionBy(*keys)
    r = rows.where(f"`{x}` is not null").select(*keys, "ts", F.col(x).cast("double").alias("_x"))
    r = r.withColumns({"_e": F.col("_x") - F.avg("_x").over(whole), "_n": F.count("*").over(whole)}).drop("_x")
    few = F.floor(F.pow(F.col("_n").cast("double"), F.lit(2 / 9)))
    most = int(r.agg(F.max(few)).first()[0] or 0)
    lagged = r.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, most + 1)}).withColumn("_c", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pair = lambda k: F.when(few >= k, 2 * F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) / F.col("_n"))
    agg = lagged.groupBy(*keys, "_n").agg(
        F.sum(F.col("_e") * F.col("_e")).alias("_v"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"), *[F.coalesce(pair(k), F.lit(0.0)).alias(f"_p{k}") for k in range(1, most + 1)]
    )
    s0 = sum((F.col(f"_p{k}") for k in range(1, most + 1)), F.col("_v") / F.col("_n"))
    s1 = sum((k * F.col(f"_p{k}") for k in range(1, most + 1)), F.lit(0.0))
    auto = F.floor(1.1447 * F.pow(F.pow(div(s1, s0), 2), 1 / 3) * F.pow(F.col("_n").cast("double"), F.lit(1 / 3)))
    agg = agg.withColumn("lags", F.coalesce(F.least(auto, F.col("_n") - 1), F.lit(0)).cast("long")).select(*keys, "_n", "_v", "_cc", "lags")
    wide = int(agg.agg(F.max("lags")).first()[0] or 0)
    if wide:
        back = F.reverse(F.collect_list("_e").over(w.rowsBetween(-wide, -1)))
        rows_ = r.join(agg.select(*keys, "lags"), list(keys)).withColumn("_b", back)
        weigh = F.aggregate(F.transform("_b", lambda v, i: v * F.greatest(F.lit(0.0), 1 - (i + 1) / (F.col("lags") + 1))), F.lit(0.0), lambda a, v: a + v)
        more = rows_.groupBy(*keys).agg(F.sum(F.col("_e") * weigh).alias("_w"))
        agg = agg.join(more, list(keys))
    else:
        agg = agg.withColumn("_w", F.lit(0.0))
    s2 = (F.col("_v") + 2 * F.col("_w")) / F.col("_n")
    return agg.select(*keys, F.col("_n").alias("n"), "lags", div(F.col("_cc"), F.col("_n") * F.col("_n") * F.greatest(s2, F.lit(1e-300))).alias("kpss"))


def stationarity(rows: DataFrame, x: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """ADF and KPSS statistics, p-values, and verdicts at 5 %; NULL for series of fewer than 10 values."""
    p = lambda f: F.pandas_udf(lambda s: s.map(f).astype(float), "double")
    both = unit_root(rows, x, None, keys).join(level_stationarity(rows, x, keys).drop("n", "lags"), list(keys))
    long = F.col("n") >= 10
    both = both.withColumns({c: F.when(long, F.col(c)) for c in ("adf", "kpss")}).withColumns({"adf_p": p(adf_p)("adf"), "kpss_p": p(kpss_p)("kpss")})
    return both.select(
        *keys, "adf", "kpss", *[F.when(long, F.col(c)).alias(c) for c in ("adf_p", "kpss_p")], F.coalesce(F.col("adf") < ADF_POINTS[1], F.lit(False)).alias("adf_stationary"),
        F.coalesce(F.col("kpss") < KPSS_POINTS[1], F.lit(False)).alias("kpss_stationary"),
    )


def seasonality(rows: DataFrame, x: str, period: int, keys=KEYS) -> DataFrame:
    """Additive decomposition with a known period: strength = max(0, 1 - var(residual) / var(detrended)), seasonal if > 0.1.

    The trend is a centred moving average, the season the mean of each phase less the mean of those.
    """
    w, whole = by_time(*keys), Window.partitionBy(*keys)
    half = period // 2
    mid = w.rowsBetween(-half, half)
    r = rows.withColumn("_i", F.row_number().over(w))
    mean = F.avg(x).over(mid) if period % 2 else (F.sum(x).over(mid) - (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2) / period
    r = r.withColumn("_t", F.when(F.count(x).over(mid) == 2 * half + 1, mean)).withColumn("_d", F.col(x) - F.col("_t")).withColumn("_phase", F.col("_i") % period)
    phase = r.groupBy(*keys, "_phase").agg(F.avg("_d").alias("_s"))
    phase = phase.withColumn("_s", F.col("_s") - F.avg("_s").over(whole))
    both = r.join(phase, [*keys, "_phase"])
    strength = F.greatest(1 - div(F.var_samp(F.col("_d") - F.col("_s")), F.var_samp("_d")), F.lit(0.0))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), strength.alias("strength")).withColumn("seasonal", (F.col("strength") > 0.1) & (F.col("n") >= F.greatest(F.lit(100), F.lit(3 * period))))


def dominant_period(acf: DataFrame, keys=KEYS) -> DataFrame:
    """The lag of the highest local peak of the autocorrelations."""
    w = Window.partitionBy(*keys).orderBy("lag")
    peak = acf.withColumns({"_p": F.lag("acf").over(w), "_n": F.lead("acf").over(w)}).where("acf > _p and acf > _n")
    return peak.groupBy(*keys).agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("period"))
