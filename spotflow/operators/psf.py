"""Maximum-likelihood fit of a round Gaussian spot to small windows of photon counts.

Windows are rows; a batch of them is fitted together, one numpy operation for a step of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

_erf = np.frompyfunc(math.erf, 1, 1)
#: Columns that a fit adds: position in the window from 0, total photons, background of a pixel, width, the bounds of
#: the variances of both positions, and whether the fit settled on finite values.
FIT = {"fit_x": T.DoubleType(), "fit_y": T.DoubleType(), "photons": T.DoubleType(), "background": T.DoubleType(), "sigma": T.DoubleType(), "crlb_x": T.DoubleType(), "crlb_y": T.DoubleType(), "is_fit": T.BooleanType()}


def _profile(at: np.ndarray, sigma: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of a Gaussian in each pixel of a row, and its derivatives by position and width."""
    z = np.arange(size + 1)[None, :] - 0.5 - at[:, None]
    s = sigma[:, None]
    cdf = 0.5 * (1 + _erf(z / (math.sqrt(2) * s)).astype(float))
    pdf = np.exp(-(z**2) / (2 * s**2)) / (math.sqrt(2 * math.pi) * s)
    zp = z * pdf / s
    return np.diff(cdf, axis=1), -np.diff(pdf, axis=1), -np.diff(zp, axis=1)


def _model(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of each window (n, size * size) and their derivatives (n, 5, size * size) by x, y, photons,
    background and width."""
    ex, dx, sx = _profile(p[:, 0], p[:, 4], size)
    ey, dy, sy = _profile(p[:, 1], p[:, 4], size)
    outer = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(p), -1)
    n = p[:, 2:3]
    shape = outer(ey, ex)
    grad = np.stack([n * outer(ey, dx), n * outer(dy, ex), shape, np.ones_like(shape), n * (outer(sy, ex) + outer(ey, sx))], axis=1)
    return n * shape + p[:, 3:4], grad


def fit_spots(counts: np.ndarray, variance: np.ndarray, size: int, rounds: int = 50, start: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters (x, y, photons, background, width) of each window, the lower bounds of their variances, and which
    fits are finite: Fisher scoring with damping on the Poisson likelihood; a pixel's read-out variance adds to both
    its count and its expectation."""
    data = np.maximum(counts, 0) + variance
    low = counts.min(axis=1)
    above = counts - low[:, None]
    total = np.maximum(above.sum(axis=1), 1e-6)
    grid = np.arange(size * size)
    p = np.column_stack([(above * (grid % size)).sum(axis=1) / total, (above * (grid // size)).sum(axis=1) / total, total, np.maximum(low, 0.01), np.full(len(counts), start)])
    least, most = np.array([-0.5, -0.5, 1e-3, 1e-3, 0.3]), np.array([size - 0.5, size - 0.5, np.inf, np.inf, float(size)])
    damping = np.full(len(p), 1e-3)

    def likelihood(q: np.ndarray) -> np.ndarray:
        mu = _model(q, size)[0] + variance
        return (data * np.log(mu) - mu).sum(axis=1)

    best = likelihood(p)
    for _ in range(rounds):
        mu, grad = _model(p, size)
        mu = mu + variance
        slope = np.einsum("nk,npk->np", data / mu - 1, grad)
        info = np.einsum("npk,nk,nqk->npq", grad, 1 / mu, grad)
        diagonal = np.einsum("npp->np", info)
        damped = info + np.eye(5) * (damping[:, None] * diagonal + 1e-12)[:, None, :]
        q = np.clip(p + np.linalg.solve(damped, slope[:, :, None])[:, :, 0], least, most)
        new = likelihood(q)
        better = new >= best
        p, best = np.where(better[:, None], q, p), np.where(better, new, best)
        damping = np.clip(np.where(better, damping / 5, damping * 5), 1e-9, 1e9)
    mu, grad = _model(p, size)
    info = np.einsum("npk,nk,nqk->npq", grad, 1 / (mu + variance), grad) + np.eye(5) * 1e-12
    bound = np.einsum("npp->np", np.linalg.pinv(info))
    return p, bound, np.isfinite(p).all(axis=1) & np.isfinite(bound).all(axis=1)


def fit_psf(peaks: DataFrame, roi: str = "roi", variance: str | None = None, rounds: int = 50) -> DataFrame:
    """peaks with the columns of FIT. `roi` is a square window, row by row; `variance` names a column with the read-out
    variances of its pixels. A window that is null, not square or holds null or non-finite values is not fitted: its
    columns are null and is_fit is false."""
    kept = peaks.drop(*FIT)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in FIT.items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.full((len(batch), 8), np.nan)
            windows = [np.asarray([] if r is None else r, dtype=np.float64) for r in batch[roi]]
            sizes = np.array([math.isqrt(len(w)) if len(w) and math.isqrt(len(w)) ** 2 == len(w) and np.isfinite(w).all() else 0 for w in windows])
            for size in set(sizes.tolist()) - {0, 1, 2}:
                some = np.flatnonzero(sizes == size)
                counts = np.stack([windows[i] for i in some])
                extra = np.zeros_like(counts)
                if variance:
                    extra = np.nan_to_num(np.stack([np.asarray(batch[variance].iloc[i], dtype=np.float64) for i in some]))
                p, bound, fine = fit_spots(counts, extra, size, rounds)
                found[some] = np.where(fine[:, None], np.column_stack([p[:, :5], bound[:, :2], np.ones(len(some))]), np.nan)
            columns = {c: found[:, k] for k, c in enumerate(FIT) if c != "is_fit"}
            yield batch.assign(**columns, is_fit=found[:, 7] == 1)

    return kept.mapInPandas(run, schema)
