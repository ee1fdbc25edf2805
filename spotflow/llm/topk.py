"""Exact top-k by inner product over vectors in order of length.

All vectors are turned by the right singular vectors of the candidates, which puts most of an inner
product into the first dimensions. A query goes through candidates by descending length: a partial
sum over the first dimensions plus the product of the residual lengths (Cauchy-Schwarz) bounds each
score from above, and a candidate is computed in full only if its bound reaches the k-th best score
so far; once the product of the whole lengths is below that, nothing further can count.

Work is cut into tiles of bounded size: candidates by bands of length and a hash, queries by a hash. Both sides of a tile are as
large as memory allows, as every vector is sent once for each tile of the other side that it meets. A tile whose longest candidate cannot reach a query's starting score doesn't see that query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spotflow.llm.vectors import finite, matrix
from spotflow.session import materialize

#: Numbers (dimensions times vectors) of a tile's candidates and of its queries, queries and candidates looked at
#: together, bands of length, longest vectors that give every query its starting score.
CELLS, QUERIES, STEP, BANDS, SEEDS = 1 << 22, 4_096, 1_024, 16, 512
#: Share of the dimensions in the partial sums.
FIRST = 0.25
#: Whole numbers up to EXACT are exact in a double; a score is handed on as high * HIGH + low.
EXACT, HIGH = 2.0**53, 62


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which never overflow."""
    return np.frompyfunc(int, 1, 1)(v)


def best_of_tile(q: np.ndarray, q_id: np.ndarray, start: np.ndarray, c: np.ndarray, c_id: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate id, score) of each query's k best candidates that reach its starting score.
    Scores are exact: doubles where no product of lengths exceeds what they hold, else Python integers."""
    order = np.lexsort((c_id, -(c**2).sum(axis=1)))
    c, c_id = c[order], c_id[order]
    p = max(1, int(FIRST * c.shape[1]))
    qt, ct = q @ turn, c @ turn
    q_len, c_len = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    q_rest, c_rest = np.sqrt((qt[:, p:] ** 2).sum(axis=1)), np.sqrt((ct[:, p:] ** 2).sum(axis=1))
    exact = q_len.max() * c_len.max() < EXACT
    if not exact:
        q_whole, c_whole = whole_numbers(q), whole_numbers(c)
    top = np.full((len(q), k), -np.inf, dtype=np.float64 if exact else object)
    top_id = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = start.copy()
    slack = 1e-9 * (q_len * c_len.max() + 1)  # rounding of the bounds
    for lo in range(0, len(c), STEP):
        hi = min(lo + STEP, len(c))
        live = np.flatnonzero(q_len * c_len[lo] + slack >= floor)
        if not len(live):
            break
        bound = qt[live, :p] @ ct[lo:hi, :p].T + q_rest[live, None] * c_rest[None, lo:hi]
        could = (bound + slack[live, None] >= floor[live, None]) & (q_id[live, None] != c_id[None, lo:hi])
        rows = np.flatnonzero(could.any(axis=1))
        if not len(rows):
            continue
        live, could = live[rows], could[rows]
        columns = np.flatnonzero(could.any(axis=0))
        score = q[live] @ c[lo:hi][columns].T if exact else q_whole[live] @ c_whole[lo:hi][columns].T
        score = np.where(could[:, columns], score, -np.inf)
        all_score = np.concatenate([top[live], score], axis=1)
        all_id = np.concatenate([top_id[live], np.broadcast_to(c_id[lo:hi][columns], score.shape)], axis=1)
        best = np.lexsort((all_id, -all_score), axis=1)[:, :k] if exact else np.array([sorted(range(len(x)), key=lambda j: (-x[j], i[j]))[:k] for x, i in zip(all_score, all_id)])
        top[live], top_id[live] = np.take_along_axis(all_score, best, axis=1), np.take_along_axis(all_id, best, axis=1)
        floor[live] = np.maximum(floor[live], top[live, -1].astype(np.float64))
    number, place = np.nonzero((top > -np.inf) & (top.astype(np.float64) + slack[:, None] >= start[:, None]))
    return number, top_id[number, place], top[number, place]


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of vectors (vec_id, embedding) that the SQL
    condition is_query picks, the k other rows with the highest inner product of floor(scale * x).

    Ties go to the smaller vec_id; with fewer than k candidates all are returned. Vectors that are null,
    empty or hold null or non-finite components take no part, nor do rows without a vec_id. Vectors of
    different lengths have no inner product; there is a pass for every length that occurs. Rows that repeat
    a vec_id are one vector: the longest of them by its norm, then the greatest by its components. Ranks follow
    exact scores; a score beyond a long is given as the nearest long.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(finite("embedding") & F.col("vec_id").isNotNull())
    # floor gives a long, which ends where doubles don't: components beyond it are whole numbers as they are
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**53 / scale, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(is_query).alias("asks"), whole.alias("v"))
    rows = materialize(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("norm < double('Infinity')"), "vectors")
    again = materialize(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "again")
    if not again.isEmpty():
        one = rows.join(again, "vec_id").groupBy("vec_id").agg(F.max(F.struct("norm", "v", "asks")).alias("r"))
        rows = materialize(rows.join(again, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.asks", "r.v", "r.norm")), "vectors")
    found = None
    for d in sorted(r.d for r in rows.groupBy(F.size("v").alias("d")).agg(F.max("asks").alias("asks")).filter("asks").collect()):
        some = _best(rows.filter(F.size("v") == d), d, k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    score = F.when(F.col("high") > 1, F.lit((1 << 63) - 1)).when(F.col("high") < -2, F.lit(-(1 << 63))).otherwise(F.col("high") * (1 << HIGH) + F.col("low"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _best(rows: DataFrame, d: int, k: int) -> DataFrame:
    """query_id, vec_id, high and low (score = high * 2**HIGH + low) of what the tiles find among rows (vec_id,
    asks, v, norm) of d dimensions."""

    def gram(batches):
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column("v"))
            if len(m):
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    sums = rows.select("v").mapInArrow(gram, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    square = np.array([r.x for r in sums.orderBy("i").collect()]).reshape(d, d)  # d * d numbers, whatever the input
    turn = np.linalg.eigh(square)[1][:, ::-1]

    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").collect()
    seed_id, seed = np.array([r.vec_id for r in seeds]), np.array([r.v for r in seeds])

    def starts(batches):
        for batch in batches:
            m, ids = matrix(batch.column("v")), batch.column("query_id").to_numpy()
            start = np.full(len(ids), -np.inf)
            if len(ids) and len(seed_id):
                score = np.where(ids[:, None] == seed_id[None, :], -np.inf, m @ seed.T)
                if score.shape[1] >= k:
                    start = np.partition(score, -k, axis=1)[:, -k]
                    start = start - 1e-12 * d * np.abs(m).max() * np.abs(seed).max() * (np.abs(start) >= EXACT)  # rounding
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "start"])

    asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"))
    asked = asked.withColumnRenamed("q", "v").mapInArrow(starts, "query_id long, v array<double>, q_norm double, start double")
    asked = materialize(asked, "queries")

    cuts = [c for c in rows.approxQuantile("norm", [i / BANDS for i in range(1, BANDS)], 0.01)]
    band = sum(((F.col("norm") >= c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    stats = rows.groupBy(band.alias("band")).agg(F.max("norm").alias("longest"), F.count("*").alias("n")).collect()  # BANDS rows
    most = max(8, CELLS // d)
    parts_of = {r.band: -(-r.n // most) for r in stats}
    groups = max(1, -(-asked.count() // most))
    parts = F.create_map(*[F.lit(x) for b, n in parts_of.items() for x in (b, n)])
    longest = F.array(*[F.struct(F.lit(r.band).alias("band"), F.lit(r.longest).alias("longest"), F.lit(parts_of[r.band]).alias("parts")) for r in stats])
    cands = rows.select("vec_id", "v", band.alias("band")).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("band")]).cast("int"))
    cands = cands.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    seen = asked.withColumn("to", F.explode(longest)).filter(F.col("q_norm") * F.col("to.longest") * (1 + 1e-9) + 1e-6 >= F.col("start"))
    seen = seen.select("query_id", "v", "start", "to.band", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)).alias("part"))
    seen = seen.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        query, other, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        c, c_id = (matrix(right.column("v")), right.column("vec_id").to_numpy()) if len(right) else (None, None)
        for some in (left.slice(i, QUERIES) for i in range(0, len(left) if len(right) else 0, QUERIES)):
            ids = some.column("query_id").to_numpy()
            at, found, scores = best_of_tile(matrix(some.column("v")), ids, some.column("start").to_numpy(), c, c_id, turn, k)
            query.append(ids[at])
            other.append(found)
            score += [int(x) for x in scores]
        high, low = pa.array([x >> HIGH for x in score], pa.int64()), pa.array([x & ((1 << HIGH) - 1) for x in score], pa.int64())
        return pa.table({"query_id": pa.array(np.concatenate(query), pa.int64()), "vec_id": pa.array(np.concatenate(other), pa.int64()), "high": high, "low": low})

    key = ("band", "part", "group")
    return seen.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(tile, "query_id long, vec_id long, high long, low long")
