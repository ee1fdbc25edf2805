"""Whitening of vectors on their leading principal components, found by LOBPCG.

The covariance matrix is never built: each round multiplies it with a block of directions in one pass over the
centred rows, every task with its own share, and adds the products up. Rayleigh-Ritz on the span of the iterate, its
residuals and the previous directions gives the next iterate. Rounds end when the residuals of the wanted components are
at rounding error, which a fresh product of the final block certifies; only then are the rows whitened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.vectors import finite
from spotflow.session import materialize

#: Components beyond the wanted ones in a block, rounds before the block doubles, numbers turned into doubles at a time.
GUARD, ROUNDS, CELLS = 8, 30, 2_000_000
#: A residual of so many times the rounding error of the largest eigenvalue is certified.
ROUNDING = 64 * np.finfo(float).eps
LONGEST = (1 << 63) - 1


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, max(1, CELLS // d)):
            yield batch.slice(i, max(1, CELLS // d))


def whole(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of d longs as a matrix."""
    return column.flatten().to_numpy().reshape(-1, d)


class Centre:
    """n, the sums of each dimension as whole numbers, and whether n * x - sum fits into 62 bits everywhere."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        self.narrow = 2 * n * largest < 1 << 62
        self.total = np.array(sums, dtype=np.int64 if self.narrow else object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum, exactly."""
        return (x if self.narrow else x.astype(object)) * self.n - self.total

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of the squares of n * x - sum for every row, exactly; the largest long if it is beyond that."""
        s = self.scaled(x)
        if not self.narrow or s.shape[1] * int(np.abs(s).max(initial=0)) ** 2 > LONGEST:
            return np.array([min(LONGEST, sum(v * v for v in map(int, row))) for row in s], dtype=np.int64)
        return (s * s).sum(axis=1)


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Sums add up as two halves of 32 bits, so that they are exact for any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n, largest = np.zeros(d, np.int64), np.zeros(d, np.int64), 0, np.zeros(d, np.float64)
        for batch in _pieces(batches, d):
            x = whole(batch.column(0), d)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
            largest = np.maximum(largest, np.abs(x.astype(np.float64)).max(axis=0, initial=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(np.full(d, n)), pa.array(largest)], names=["i", "high", "low", "n", "largest"])

    parts = fit.select("x").mapInArrow(run, "i long, high long, low long, n long, largest double")
    rows = parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy("i").collect()  # d rows
    return Centre(rows[0].n, [(r.high << 32) + r.low for r in rows], int(max(r.largest for r in rows)) + 1)


def covariance_times(fit: DataFrame, d: int, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The covariance (divisor n) times a block of columns, and the variance of each dimension: one pass."""
    b = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, b + 1))
        for batch in _pieces(batches, d):
            c = centre.centred(whole(batch.column(0), d))
            total[:, :b] += c.T @ (c @ block)
            total[:, b] += (c * c).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *[pa.array(t) for t in np.ascontiguousarray(total.T)]], names=names)

    names = ["i", *[f"v{j}" for j in range(b + 1)]]
    parts = fit.select("x").mapInArrow(run, ", ".join(["i long", *[f"{c} double" for c in names[1:]]]))
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]]).orderBy("i").collect()  # d rows
    out = np.array([r[1:] for r in rows]).reshape(d, b + 1) / centre.n
    return out[:, :b], out[:, b]


def moments(fit: DataFrame, d: int, centre: Centre, turn: np.ndarray) -> np.ndarray:
    """The covariance of the whitened rows."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in _pieces(batches, d):
            z = centre.centred(whole(batch.column(0), d)) @ turn
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # k * (k + 1) rows
    total = np.array([r.v for r in rows]).reshape(k + 1, k) / centre.n
    return total[:k] - np.outer(total[k], total[k])


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the span of the blocks; the first one is orthonormal already and is kept."""
    basis = blocks[0]
    for block in blocks[1:]:
        for _ in range(2):
            length = np.linalg.norm(block, axis=0)
            block = block[:, length > 0] / length[length > 0]
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        u = u[:, s > 1e-8 * max(s.max(initial=0), 1e-300)]
        u = np.linalg.qr(u - basis @ (basis.T @ u))[0]
        basis = np.column_stack([basis, u[:, : basis.shape[0] - basis.shape[1]]])
    return basis


def lobpcg(times: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, their unit eigenvectors and residuals of a symmetric matrix, and its trace.

    times(block) gives the matrix times the block and its diagonal. Components of an eigenvalue of no more than rounding
    error are left out. A block that has not met the residual after ROUNDS rounds is doubled: at d columns
    Rayleigh-Ritz is exact.
    """
    m = min(d, k + GUARD)
    rng = np.random.default_rng(seed)
    x = np.linalg.qr(rng.normal(size=(d, m)))[0]
    rest, before, rounds = np.zeros((d, 0)), np.zeros((d, 0)), 0
    while True:
        basis = orthonormal(x, rest, before)
        product, diagonal = times(basis)
        trace = float(diagonal.sum())
        small = basis.T @ product
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1][: x.shape[1]], turn[:, ::-1][:, : x.shape[1]]
        new, image = basis @ turn, product @ turn
        rest = image - new * value
        residual = np.linalg.norm(rest[:, :k], axis=0)
        before, x = new - x @ (x.T @ new), np.linalg.qr(new)[0]
        rounds += 1
        if not trace or (residual <= ROUNDING * max(value[0], 0)).all():
            break
        if rounds % ROUNDS == 0 and x.shape[1] < d:
            extra = rng.normal(size=(d, min(x.shape[1], d - x.shape[1])))
            x = orthonormal(x, extra)
            rest, before = rest[:, :0], before[:, :0]
        elif x.shape[1] == d and rounds % ROUNDS == 0:
            break
    vectors = x[:, :k]
    product, diagonal = times(vectors)
    value = (vectors * product).sum(axis=0)
    residual = np.linalg.norm(product - vectors * value, axis=0)
    keep = value > d * np.finfo(float).eps * max(trace, 0)
    order = np.argsort(-value[keep], kind="stable")
    vectors = vectors[:, keep][:, order]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)
    return value[keep][order], vectors, residual[keep][order], float(diagonal.sum())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and residual for every row of vectors
    (vec_id, embedding) and each of the k leading components.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. An entry c counts as x = floor(scale * c), as
    a long. Components are unit eigenvectors of the covariance (divisor n) of the distinct x vectors, by falling
    eigenvalue e, with the entry of the largest size positive. deviation is the exact sum of (n * x - S)^2 with S the
    sums (the largest long if it is beyond that); whitened is x - S / n on the component over sqrt(e); explained is e over
    the trace; identity_error is the largest absolute entry of whitened's covariance over the distinct vectors less
    the identity; residual is the length of V v - e v. Directions without variance give no component, so that equal vectors alone
    give no rows. Vectors of different lengths are whitened apart. Rows that repeat, or share a vec_id, give rows each.
    """
    spark = vectors.sparkSession
    entry = lambda c: (F.floor(F.lit(scale) * c.cast("double")) + F.lit(0)).cast("long")
    rows = vectors.filter(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))
    rows = materialize(rows, "vectors")
    fit = materialize(rows.select("x").distinct(), "distinct")
    found = None
    for d in sorted(r.d for r in fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).filter("n > 1").collect()):
        some = _whitened(rows.filter(F.size("x") == d), fit.filter(F.size("x") == d), d, min(k, d))
        found = some if found is None else found.unionByName(some)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def _whitened(rows: DataFrame, fit: DataFrame, d: int, k: int) -> DataFrame:
    centre = centre_of(fit, d)
    value, vector, residual, trace = lobpcg(lambda block: covariance_times(fit, d, centre, block), d, k)
    if not len(value):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k, turn = len(value), vector / np.sqrt(value)
    error = float(np.abs(moments(fit, d, centre, turn) - np.eye(k)).max())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, d):
            x = whole(batch.column("x"), d)
            z, n = centre.centred(x) @ turn, len(x)
            each = lambda values: pa.array(np.tile(values, n))
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(n), k)))
            columns = [ids, each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(n * k, centre.n)), pa.array(np.repeat(centre.deviation(x), k)), pa.array(z.ravel())]
            yield pa.RecordBatch.from_arrays([*columns, each(value / trace), pa.array(np.full(n * k, error)), each(residual)], names=names)

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
