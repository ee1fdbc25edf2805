"""Near-duplicate vectors by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the product of the two is a grid of cells. A
vector lies in the cell of its nearest centroid pair. It visits cells by ascending sum of the two
distances (multi-sequence traversal with a heap) until the target recall is reached: how many cells
that takes is measured on sampled vectors, all of whose links are known from brute force; the sample
grows until enough of them have links. Where links stay too rare, neighbours are made for the sampled vectors, at
just the least cosine in directions of all kinds, and their cells are measured as well. Equal vectors of a label are one weighted vertex, so copies neither count as links of the measure nor are
compared with each other; their links are added afterwards. Visitors and residents of a cell are
compared exactly, in blocks of bounded size, and tasks return counts and a spanning set of links,
never pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotflow.llm.vectors import finite, matrix
from spotflow.operators.components import connected_components
from spotflow.session import materialize

#: Vectors that train a codebook for each of its centroids, the most centroids, vectors a cell is meant to
#: hold, residents and visitors that are compared in one task.
TRAIN, CENTROIDS, IN_CELL, RESIDENTS, VISITORS = 64, 1_024, 200, 256, 512
#: Vectors whose links are measured at first and at most, those of them with links that settle the measure, and
#: sampled vectors and neighbours made for each where links are too rare for that.
MEASURED, MEASURED_MOST, ENOUGH, MADE_FOR, MADE = 400, 25_600, 100, 1_600, 16


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the rows of points, from a fixed seed."""
    rng = np.random.default_rng(11)
    centre = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = distances(points, centre).argmin(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=k)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre**2).sum(axis=1)[None, :]


def traverse(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """The first cells of the grid by ascending d1[i] + d2[j]."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, pushed = [(s1[0] + s2[0], 0, 0)], [], {(0, 0)}
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def made_neighbours(a: np.ndarray, cosine: float, each: int) -> np.ndarray:
    """For each unit vector `each` others at just the cosine, in random directions from a fixed seed."""
    u = np.random.default_rng(13).normal(size=(len(a), each, a.shape[1]))
    u -= (u * a[:, None]).sum(axis=2, keepdims=True) * a[:, None]
    u /= np.maximum(np.linalg.norm(u, axis=2, keepdims=True), 1e-300)
    return cosine * a[:, None] + np.sqrt(max(0.0, 1 - cosine**2)) * u


def cells_before(d1: np.ndarray, d2: np.ndarray, i: int, j: int) -> int:
    """How many cells the traversal visits before cell (i, j)."""
    return int(np.searchsorted(np.sort(d2), d1[i] + d2[j] - d1).sum())


def compare(v: np.ndarray, v_id: np.ndarray, r: np.ndarray, r_id: np.ndarray, w: np.ndarray, weight: np.ndarray, least: float, returned: Callable[[], np.ndarray]) -> dict[int, list[int]]:
    """For every id with a link between visitors v (of weights w) and residents r (of weights weight): the weight it
    links to, and the smallest id of its component among them. A resident counts the link here only if it does not return
    the visit, which returned() says of every pair: else it counts it where it is the visitor."""
    link = (v @ r.T >= least) & (v_id[:, None] != r_id[None, :])
    a, b = np.nonzero(link)
    if not len(a):
        return {}
    ids = np.unique(np.concatenate([v_id[a], r_id[b]]))
    x, y = np.searchsorted(ids, v_id[a]), np.searchsorted(ids, r_id[b])
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    once = ~returned()[a, b]
    count = np.bincount(x, weights=weight[b], minlength=len(ids)) + np.bincount(y[once], weights=w[a[once]], minlength=len(ids))
    return {int(i): [int(c), int(ids[k])] for i, c, k in zip(ids, count, label)}


def _search(vertices: DataFrame, d: int, kind: str, cosine: float, recall: float) -> DataFrame:
    """vertex, n (weight linked to) and root, from the blocks of the index over vertices (vertex,
    label, u, w, first) of d dimensions."""
    if d == 1:  # vectors of one dimension have no halves
        vertices, d = vertices.withColumn("u", F.concat("u", F.array(F.lit(0.0)).cast(kind))), 2
    n = vertices.count()
    half, k = d // 2, int(min(CENTROIDS, max(2, round((n / IN_CELL) ** 0.5))))

    place = F.pmod(F.xxhash64("first", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    some = vertices.filter(place < min(1.0, TRAIN * k / n)).select("u").toPandas()["u"]  # about TRAIN * k vectors
    train = np.stack([*some]) if len(some) >= k else np.stack([r.u for r in vertices.select("u").limit(max(k, 2)).collect()])
    train = train / np.linalg.norm(train, axis=1, keepdims=True)
    one, two = codebook(train[:, :half], k), codebook(train[:, half:], k)

    # cells that must be visited: ranks of the cells of true neighbours in the traversal of sampled vectors
    def unit(column) -> np.ndarray:
        m = matrix(column)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def sampled(m: float):
        """About m vertices, their labels and unit vectors, by Arrow."""
        asked = vertices.filter(F.pmod(F.xxhash64("first", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < min(1.0, m / n)).select("vertex", "label", "u").toArrow()
        a = unit(asked.column("u")) if len(asked) else np.zeros((0, d))
        return a, asked.column("vertex").to_numpy(), asked.column("label").to_numpy()

    def measure(m: float):
        """Queries with links, cells before those of their links and how many; of about m queries."""
        a, a_id, a_label = sampled(m)
        return vertices.select("vertex", "label", "u").mapInArrow(ranks_of(a, a_id, a_label), "q long, before long, n long").groupBy("q", "before").agg(F.sum("n").alias("n")).toPandas()

    def ranks_of(a: np.ndarray, a_id: np.ndarray, a_label: np.ndarray):
        def ranks(batches):
            before: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                found: dict[tuple[int, int, int], int] = {}
                label, vertex = batch.column("label").to_numpy(zero_copy_only=False), batch.column("vertex").to_numpy()
                for name in set(label) & set(a_label):
                    mine, ask = np.flatnonzero(label == name), np.flatnonzero(a_label == name)
                    m = unit(batch.column("u").take(pa.array(mine)))
                    step = max(64, 4_000_000 // len(ask))  # bounds the product
                    for lo in range(0, len(m), step):
                        x = m[lo : lo + step]
                        i, j = np.nonzero((a[ask] @ x.T >= cosine) & (a_id[ask][:, None] != vertex[mine][None, lo : lo + step]))
                        if not len(i):
                            continue
                        c1, c2 = distances(x[:, :half], one).argmin(axis=1), distances(x[:, half:], two).argmin(axis=1)
                        hits, times = np.unique(np.stack([ask[i], c1[j], c2[j]]), axis=1, return_counts=True)
                        for q, c, e, times_ in zip(*hits.tolist(), times.tolist()):
                            found[q, c, e] = found.get((q, c, e), 0) + times_
                for q, c, e in found.keys() - before.keys():
                    before[q, c, e] = cells_before(distances(a[q : q + 1, :half], one)[0], distances(a[q : q + 1, half:], two)[0], c, e)
                yield pa.RecordBatch.from_pydict({"q": pa.array([x[0] for x in found], pa.int64()), "before": pa.array([before[x] for x in found], pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

        return ranks

    asked, seen = MEASURED, measure(MEASURED)
    while seen["q"].nunique() < ENOUGH and asked < min(n, MEASURED_MOST):
        asked *= 4
        seen = measure(asked)
    settled = seen["q"].nunique() >= ENOUGH or asked >= n
    cells = 1
    if len(seen):
        share = (seen["n"] / seen.groupby("q")["n"].transform("sum")).groupby(seen["before"]).sum().sort_index().cumsum()
        cells = int(min(k * k, 2 * (share.index[share >= recall * share.iloc[-1]][0] + 1)))
    if not settled:
        a = sampled(MADE_FOR)[0]
        before = []
        for x, others in zip(a, made_neighbours(a, cosine, MADE)):
            d1, d2 = distances(x[None, :half], one)[0], distances(x[None, half:], two)[0]
            i, j = distances(others[:, :half], one).argmin(axis=1), distances(others[:, half:], two).argmin(axis=1)
            before += [cells_before(d1, d2, p, q) for p, q in zip(i, j)]
        cells = int(min(k * k, max(cells, np.quantile(before, recall, method="higher") + 1))) if before else cells

    def place_in(batches):
        for batch in batches:
            m = unit(batch.column("u")) if len(batch) else np.zeros((0, d))
            d1, d2 = distances(m[:, :half], one), distances(m[:, half:], two)
            own = d1.argmin(axis=1) * k + d2.argmin(axis=1)
            visits = [[i * k + j for i, j in traverse(x, y, cells)] for x, y in zip(d1, d2)]
            farthest = [x[some[-1] // k] + y[some[-1] % k] for x, y, some in zip(d1, d2, visits)]  # they ascend
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(visits, pa.list_(pa.int64())), pa.array(farthest, pa.float64())], names=[*batch.schema.names, "own", "visits", "farthest"])

    placed = materialize(vertices.select("vertex", "label", "u", "w").mapInArrow(place_in, f"vertex long, label string, u {kind}, w long, own long, visits array<long>, farthest double"), "placed")
    v = placed.select("vertex", "label", "u", "w", "own", F.explode("visits").alias("cell"))
    r = placed.select("vertex", "label", "u", "w", "farthest", F.col("own").alias("cell"))
    held = r.groupBy("label", "cell").agg(F.count("*").alias("residents"))
    come = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("visitors"))
    cut = held.join(come, ["label", "cell"]).select("label", "cell", F.ceil(F.col("residents") / RESIDENTS).cast("int").alias("nr"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("nv"))
    cut = materialize(cut, "cells")
    h = F.xxhash64("vertex")
    v = v.join(cut, ["label", "cell"]).withColumn("vb", F.pmod(h, "nv").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    r = r.join(cut, ["label", "cell"]).withColumn("rb", F.pmod(h, "nr").cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            m, m_id, weight, farthest = unit(right.column("u")), *(right.column(c).to_numpy() for c in ("vertex", "w", "farthest"))
            for lo in range(0, len(left), VISITORS):
                part = left.slice(lo, VISITORS)
                own = part.column("own").to_numpy()

                def returned(own=own) -> np.ndarray:
                    return (distances(m[:, :half], one[own // k]) + distances(m[:, half:], two[own % k]) <= farthest[:, None] + 1e-9).T

                links = compare(unit(part.column("u")), part.column("vertex").to_numpy(), m, m_id, part.column("w").to_numpy(), weight, cosine, returned)
                found += [(i, c, root) for i, (c, root) in links.items()]
        return pa.table({"vertex": pa.array([x[0] for x in found], pa.int64()), "n": pa.array([x[1] for x in found], pa.int64()), "root": pa.array([x[2] for x in found], pa.int64())})

    key = ("label", "cell", "rb", "vb")
    v, r = v.select("vertex", "u", "w", "own", *key), r.select("vertex", "u", "w", "farthest", *key)
    v, r = v.toDF(*v.columns), r.toDF(*r.columns)
    found = v.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(block, "vertex long, n long, root long")
    return materialize(found, "found")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.9999) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself
    included) and kept (vec_id = component_id) for every row of vectors (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision,
    is at least `cosine`. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths; there is an index for every length that occurs. A null
    vec_id has no links, a null component and is not kept; rows that repeat a vec_id are one vector. Codebooks are trained on at
    most TRAIN vectors a centroid. The number of visited cells is measured on MEASURED vectors against all
    others, each with the same say however many links it has, and on more, up to MEASURED_MOST, until ENOUGH
    of them have links or all are measured; else on MADE neighbours of MADE_FOR vectors too. Every row
    is indexed and searched.
    """
    ids = vectors.select(F.col("vec_id").cast("long"))
    raw = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.filter(finite("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), raw.alias("u"), norm.alias("norm")).filter("norm > 0 AND norm < double('Infinity')")
    # copies share a 128-bit fingerprint of label and vector (x + 0.0 makes -0.0 zero)
    plain = F.transform("u", lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", "label", F.col("u").cast(kind).alias("u"), *[F.xxhash64(F.lit(s), "label", plain, F.lit(s)).alias(f"h{s}") for s in (1, 2)])
    rows = materialize(rows, "vectors")
    vertices = rows.groupBy("h1", "h2").agg(F.count("*").alias("w"), F.min("vec_id").alias("first"), F.min("label").alias("label"), F.min("u").alias("u"))
    vertices = materialize(vertices.withColumn("vertex", F.monotonically_increasing_id()).withColumn("d", F.size("u")), "vertices")
    found = None
    for d in sorted(r.d for r in vertices.select("d").distinct().collect()):
        some = _search(vertices.filter(F.col("d") == d), d, kind, cosine, recall)
        found = some if found is None else found.unionByName(some)
    if found is None:
        none = ids.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
        return none.withColumn("kept", F.col("vec_id").isNotNull())
    edges = found.select("vertex", "root").distinct()

    # rows that repeat a vec_id: their vertices are one, and pairs of them are no links
    again = rows.groupBy("vec_id").agg(F.count("*").alias("c")).filter("c > 1").select("vec_id")
    again = rows.join(again, "vec_id").groupBy("vec_id", "h1", "h2").agg(F.count("*").alias("c"))
    again = materialize(again.join(vertices.select("h1", "h2", "vertex", "label", "u"), ["h1", "h2"]).select("vec_id", "c", "vertex", "label", "u"), "again")
    own = None
    if not again.isEmpty():
        edges = edges.union(again.join(again.groupBy("vec_id").agg(F.min("vertex").alias("root")), "vec_id").filter("vertex <> root").select("vertex", "root"))
        x, y = again.select("vec_id", "c", "vertex", "label", "u"), again.toDF("vec_id", "c2", "vertex2", "label2", "u2")

        def dot(p: str, q: str) -> Column:
            return F.aggregate(F.zip_with(F.col(p).cast("array<double>"), F.col(q).cast("array<double>"), lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)

        pairs = x.join(y, "vec_id").filter((F.col("vertex") == F.col("vertex2")) | ((F.col("label") == F.col("label2")) & (dot("u", "u2") >= cosine * F.sqrt(dot("u", "u")) * F.sqrt(dot("u2", "u2")))))
        own = pairs.groupBy("vec_id").agg(F.sum(F.col("c") * F.col("c2")).alias("own"))

    comps = connected_components(edges, "vertex", "root").select(F.col("node").alias("vertex"), "component")
    comps = comps.join(vertices.select("vertex", "first"), "vertex")
    comps = comps.join(comps.groupBy("component").agg(F.min("first").alias("lowest")), "component").select("vertex", "lowest")
    counts = found.groupBy("vertex").agg(F.sum("n").alias("n"))
    linked = vertices.select("vertex", "h1", "h2", "w", "first").join(counts, "vertex", "left").join(comps, "vertex", "left").filter("w > 1 OR lowest IS NOT NULL")
    linked = linked.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w")).alias("n"), F.coalesce("lowest", "first").alias("component"))
    known = rows.select("vec_id", "h1", "h2").join(linked, ["h1", "h2"]).groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = ids.join(known, "vec_id", "left")
    out = out.join(own, "vec_id", "left") if own is not None else out.withColumn("own", F.lit(1))
    out = out.select("vec_id", F.coalesce(F.col("n") - F.coalesce("own", F.lit(1)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
