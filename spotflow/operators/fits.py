"""Fits and curves: two populations, normal curves, smoothing, crossings, envelopes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of the bins in which values are counted before the two-population fit.
FINE = 1e-3
#: Cubic least-squares weights over five values for the value in the middle, and for the first two; the last two
#: mirror them (fixed values of the Savitzky-Golay filter of order 3 and window 5).
MIDDLE, FIRST, SECOND = (-3, 12, 17, 12, -3), (69, 4, -6, 4, -1), (2, 27, 12, -8, 2)


def mixture(x: np.ndarray, n: np.ndarray, mu: np.ndarray, var: np.ndarray, share: np.ndarray, rounds: int = 1_000, close: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, bool] | None:
    """Expectation-maximisation of two normal populations over values x that occur n times: log likelihood,
    means, variances, shares and whether it converged; None if a population vanishes."""
    last = -math.inf
    for _ in range(rounds):
        log_p = np.log(share) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mu) ** 2 / (2 * var)
        top = log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p - top)
        total = p.sum(axis=1, keepdims=True)
        likelihood = float((n * (top + np.log(total))[:, 0]).sum())
        resp = p / total * n[:, None]
        of = resp.sum(axis=0)
        if (of < 1e-9 * n.sum()).any():
            return None
        mu = (resp * x[:, None]).sum(axis=0) / of
        var = (resp * (x[:, None] - mu) ** 2).sum(axis=0) / of
        share = of / n.sum()
        if (var < FINE**2 / 12).any():  # a population inside one bin
            return None
        if abs(likelihood - last) <= close * abs(likelihood):
            return likelihood, mu, var, share, True
        last = likelihood
    return last, mu, var, share, False


def smoothed(y: np.ndarray) -> np.ndarray:
    """The moving cubic over five values of `smooth`, for an array of at least five."""
    out = np.convolve(y, np.array(MIDDLE[::-1]) / 35, "same")
    out[0], out[1] = y[:5] @ np.array(FIRST) / 70, y[:5] @ np.array(SECOND) / 35
    out[-1], out[-2] = y[-5:] @ np.array(FIRST[::-1]) / 70, y[-5:] @ np.array(SECOND[::-1]) / 35
    return out


def steepest_start(x: np.ndarray, n: np.ndarray, width: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Where to start a fit of two populations whose other starts failed: the two highest peaks of the slope of the smoothed
    histogram, of at least a fifth of the highest; None without two."""
    bins = np.floor(x / width).astype(int)
    y = np.bincount(bins - bins.min(), weights=n)
    if len(y) < 5:
        return None
    y = smoothed(y)
    slope = np.abs(np.gradient(y))
    change = np.flatnonzero(np.diff(slope, prepend=np.nan) != 0)  # a plateau counts by its first value
    inner = slope[change]
    tops = [int(change[k]) for k in range(1, len(change) - 1) if inner[k] > inner[k - 1] and inner[k] > inner[k + 1] and inner[k] >= slope.max() / 5]
    tops = sorted(tops, key=lambda k: (-slope[k], k))[:2]
    if len(tops) < 2 or (y[tops] <= 0).any():
        return None
    return (np.array(tops) + bins.min()) * width, np.full(2, 0.1), y[tops] / y[tops].sum()


def fit_two(x: np.ndarray, n: np.ndarray, starts: int = 5) -> tuple[float, float, float, float, float, int]:
    """mu and sigma of the slower and the faster population, share of the slower, and 0 (converged), 1 (not
    converged) or 2 (no fit, the rest NaN)."""
    best, rng = None, np.random.default_rng(7)
    if len(x) >= 2:
        mean = (n * x).sum() / n.sum()
        wide = np.full(2, (n * (x - mean) ** 2).sum() / n.sum())
        tries = [(rng.choice(x, 2, replace=False, p=n / n.sum()), wide, np.full(2, 0.5)) for _ in range(starts)]
        for mu, var, share in [*tries, (np.array([-3.0, -2.0]), np.full(2, 0.1), np.full(2, 0.5))]:
            found = mixture(x, n, mu, var, share)
            if found and (best is None or found[0] > best[0] + 1e-9 * abs(best[0])):
                best = found
        if best is None and (start := steepest_start(x, n)):
            best = mixture(x, n, *start)
    if best is None:
        return *[math.nan] * 5, 2
    _, mu, var, share, settled = best
    slow, fast = np.argsort(mu)
    return float(mu[slow]), float(var[slow] ** 0.5), float(mu[fast]), float(var[fast] ** 0.5), float(share[slow]), 0 if settled else 1


def two_populations(values: DataFrame, column: str = "log_d") -> DataFrame:
    """file_id, mu1, sigma1, mu2, sigma2, fraction1 and error_code of the two normal populations of a column.
    Values are counted in bins of FINE first, so that a file of any size is a bounded table of bins to the fit;
    non-finite values are left out."""
    v = F.col(column)
    fine = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counted = fine.groupBy("file_id", F.round(v / FINE).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        found = fit_two(group["bin"].to_numpy() * FINE, group["n"].to_numpy(dtype=float))
        return pd.DataFrame([(group["file_id"].iloc[0], *found)], columns=["file_id", "mu1", "sigma1", "mu2", "sigma2", "fraction1", "error_code"])

    return counted.groupBy("file_id").applyInPandas(fit, "file_id long, mu1 double, sigma1 double, mu2 double, sigma2 double, fraction1 double, error_code int")


def normal_curve(stats: DataFrame, low: float, high: float, points: int, bin_width: float) -> DataFrame:
    """file_id, x and y: for each row of stats (file_id, mu, sigma, n) the counts that a normal distribution puts
    into bins of a width, at `points` places from low to high."""
    x = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    rows = stats.filter("sigma > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    y = F.exp(-((F.col("x") - F.col("mu")) ** 2) / (2 * F.col("sigma") ** 2)) / (F.col("sigma") * math.sqrt(2 * math.pi))
    return rows.select("file_id", "i", "x", (y * F.col("n") * bin_width).alias("y"))


def smooth(series: DataFrame, value: str = "y") -> DataFrame:
    """series (file_id, i, value) with `smooth`, a moving cubic over five values whose ends use the cubic of the
    first and last five, and `slope`, the absolute central difference of it (one-sided at the ends). Series of
    fewer than five values have nulls. i must tell the rows of a file apart."""
    w = Window.partitionBy("file_id").orderBy("i")
    y = F.col(value)

    def taps(weights: tuple[int, ...], first: int, unit: int) -> Column:
        at = [F.lag(y, -(first + k)).over(w) if first + k < 0 else F.lead(y, first + k).over(w) for k in range(5)]
        return sum((a * (c / unit) for a, c in zip(at, weights)), F.lit(0.0))

    last = F.count("*").over(Window.partitionBy("file_id"))
    i = F.row_number().over(w)
    found = F.when(i == 1, taps(FIRST, 0, 70)).when(i == 2, taps(SECOND, -1, 35)).when(i == last, taps(FIRST[::-1], -4, 70)).when(i == last - 1, taps(SECOND[::-1], -3, 35)).otherwise(taps(MIDDLE, -2, 35))
    rows = series.withColumn("smooth", found)
    s, before, after = F.col("smooth"), F.lag("smooth").over(w), F.lead("smooth").over(w)
    return rows.withColumn("slope", F.abs(F.when(before.isNull(), after - s).when(after.isNull(), s - before).otherwise((after - before) / 2)))


def find_peaks(series: DataFrame, value: str = "y", share: float = 0.0, most: int = 2) -> DataFrame:
    """file_id, rank (from 1), i and value of the highest peaks of each series (file_id, i, value): values above the ones
    before and behind, of at least `share` of the greatest value of the series. Equal values that follow each other are one,
    at the first i; the ends are no peaks, nulls are left out. Of equal peaks the earlier counts first."""
    w = Window.partitionBy("file_id").orderBy("i")
    rows = series.filter(F.col(value).isNotNull()).select("file_id", "i", F.col(value).alias("_v"))
    top = rows.groupBy("file_id").agg((F.max("_v") * share).alias("_least"))
    steps = rows.withColumn("_b", F.lag("_v").over(w)).filter("_b IS NULL OR _b <> _v")
    ends = steps.withColumn("_n", F.lead("_v").over(w)).filter("_v > _b AND _v > _n").join(top, "file_id").filter("_v >= _least")
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("_v"), "i"))
    return ends.withColumn("rank", rank).filter(F.col("rank") <= most).select("file_id", "rank", "i", F.col("_v").alias(value))


def auto_edges(values: DataFrame, column: str, bins: int) -> DataFrame:
    """file_id, low and width of `bins` equal bins that cover a column's values: both are whole multiples of a unit, the
    power of ten two digits below the plain width (range / bins). One distinct value gives bins of width 1 around it;
    null and non-finite values are left out."""
    v = F.col(column).cast("double")
    fine = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("file_id", v.alias("_v"))
    ends = fine.groupBy("file_id").agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"))
    places = 2 - F.floor(F.log10((F.col("_h") - F.col("_l")) / bins)).cast("int")
    unit = F.pow(F.lit(10.0), places)  # by whole numbers of units, so that edges are the nearest doubles
    low = F.floor(F.col("_l") * unit)
    width = F.ceil((F.col("_h") * unit - low) / bins)
    flat = F.col("_h") <= F.col("_l")
    return ends.select("file_id", F.when(flat, F.floor(F.col("_l")) - bins // 2).otherwise(low / unit).cast("double").alias("low"), F.when(flat, 1.0).otherwise(F.greatest(width, F.lit(1)) / unit).alias("width"))


def auto_histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """file_id, bin (from 0), centre and n of the bins of auto_edges; the last one holds its upper edge as well."""
    v = F.col(column).cast("double")
    edges = auto_edges(values, column, bins)
    rows = values.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).join(edges, "file_id")
    n = rows.groupBy("file_id", F.least(F.floor((v - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    centre = ((F.col("low") + F.col("bin") * F.col("width")) + (F.col("low") + (F.col("bin") + 1) * F.col("width"))) / 2
    return every.join(n, ["file_id", "bin"], "left").select("file_id", "bin", centre.alias("centre"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def curve_crossings(curves: DataFrame) -> DataFrame:
    """file_id and x of the first crossing of y1 and y2 over the common x (rows in the order of i); null if they never
    cross. A crossing at the end of a segment belongs to the next; parallel segments have none."""
    w = Window.partitionBy("file_id").orderBy("i")
    rows = curves.withColumn("d", F.col("y1") - F.col("y2")).withColumn("dn", F.lead("d").over(w)).withColumn("xn", F.lead("x").over(w))
    t = F.col("d") / F.nullif(F.col("d") - F.col("dn"), F.lit(0.0))
    met = rows.withColumn("t", t).filter("t >= 0 AND t < 1").groupBy("file_id").agg(F.min_by(F.col("x") + F.col("t") * (F.col("xn") - F.col("x")), "i").alias("x"))
    return curves.select("file_id").distinct().join(met, "file_id", "left")


def bin_envelope(counts: DataFrame) -> DataFrame:
    """file_id, bin, and the mean, least and greatest n over the iterations (file_id, iteration, bin, n); an iteration
    without a bin counts 0 there."""
    runs = counts.groupBy("file_id").agg(F.count_distinct("iteration").alias("runs"))
    g = counts.groupBy("file_id", "bin").agg(F.sum("n").alias("total"), F.min("n").alias("low"), F.max("n").alias("high"), F.count_distinct("iteration").alias("met")).join(runs, "file_id")
    low = F.when(F.col("met") < F.col("runs"), F.least(F.lit(0), "low")).otherwise(F.col("low"))
    return g.select("file_id", "bin", (F.col("total") / F.col("runs")).alias("mean"), low.alias("low"), "high")
