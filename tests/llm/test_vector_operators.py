"""Operators on vectors against all pairs, with null, zero, broken and repeated vectors."""

import numpy as np
import pytest

from spotflow.llm import multi_index, topk

COLUMNS = "vec_id long, embedding array<float>, label int, u double, cell int, band int, score long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    out = [(i, (centre[i % 30] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist(), i % 3) for i in range(600)]
    out += [(700 + i, out[3][1], 0) for i in range(50)]  # copies
    out += [(800, None, 1), (801, [], 1), (802, [0.0] * 16, 1), (803, [float("nan")] + [1.0] * 15, 1), (804, [float("inf")] + [1.0] * 15, 1), (805, [None] + [1.0] * 15, 1), (806, [1.0, 2.0], 1), (807, out[3][1], None)]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in rows], COLUMNS)


def whole(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)


def test_links_equal_all_pairs(vectors, rows):
    use = [r for r in rows if whole(r[1]) and any(r[1]) and r[2] is not None]
    ids, m = [r[0] for r in use], np.array([r[1] for r in use], dtype=np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in use])
    link = (m @ m.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(m), dtype=bool)
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in np.argwhere(link):
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    n = {r[0]: 0 for r in rows} | dict(zip(ids, link.sum(axis=1).tolist()))
    got = multi_index.near_duplicates(vectors).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, n[i], find(i), find(i) == i) for i in root}
    assert len(got) == len(rows)


def test_multi_sequence_order():
    d1, d2 = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    cells = multi_index.traverse(d1, d2, 6)
    assert sorted(cells) == [(i, j) for i in range(3) for j in range(2)]
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums)


@pytest.mark.parametrize("cells,queries", [(1 << 22, 4_096), (16, 3)])
def test_top_k_equals_all_pairs(vectors, rows, monkeypatch, cells, queries):
    monkeypatch.setattr(topk, "CELLS", cells)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "BANDS", 3)
    use = [r for r in rows if whole(r[1])]
    ids = np.array([r[0] for r in use])
    m = np.floor(256 * np.array([r[1] for r in use], dtype=np.float32).astype(np.float64))
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        score = m @ m[i]
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:5]
        want |= {(int(ids[i]), k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(vectors, "vec_id % 50 = 0").collect()} == want


def test_few_or_no_vectors(spark, vectors):
    none = vectors.filter("false")
    assert topk.top_k(none, "vec_id % 50 = 0").count() == 0 and multi_index.near_duplicates(none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in topk.top_k(few, "vec_id % 50 = 0").collect()} == {(0, 1, 50, 65536), (0, 2, 51, 65536), (50, 1, 0, 65536), (50, 2, 51, 65536)}
    assert {(r.vec_id, r.n_links, r.component_id) for r in multi_index.near_duplicates(few).collect()} == {(0, 2, 0), (50, 2, 0), (51, 2, 0)}


def planted(n, pairs, copies, least=0.935, most=0.97, d=16, seed=9):
    """n vectors of one label, partners of the first `pairs` at a cosine from least to most, copies of the last."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=(pairs, d))
    aside -= (aside * base[:pairs]).sum(axis=1, keepdims=True) * base[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    c = rng.uniform(least, most, size=(pairs, 1))
    m = np.concatenate([base, c * base[:pairs] + np.sqrt(1 - c**2) * aside, np.repeat(base[-1:], copies, axis=0)])
    return m.astype(np.float32)


def found_and_true(spark, m, label=1):
    got = multi_index.near_duplicates(spark.createDataFrame([(i, v.tolist(), label) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int"))
    x = m.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.array([r.n_links for r in got.orderBy("vec_id").collect()]), (x @ x.T >= 0.93).sum(axis=1) - 1


def test_copies_do_not_hide_other_links(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "IN_CELL", 10)
    found, true = found_and_true(spark, planted(1_000, 600, 1_500))
    assert (found <= true).all() and (found[-1_500:] == 1_500).all()
    assert (found[:600] / true[:600]).mean() > 0.99


def test_ids_repeated_with_copies_and_other_vectors(spark):
    near = [1.0, 0.1, 0.0]
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 1), (5, near, 1), (7, near, 1), (5, [0.0, 0.0, 1.0], 1), (9, [0.0, -0.0, 1.0], 1), (4, [0.0, 1.0, 0.0], 1)]
    got = multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {tuple(r) for r in got.collect()} == {(5, 4, 5, True), (7, 3, 5, False), (9, 1, 5, False), (4, 0, 4, True)}


@pytest.mark.parametrize("most", [25_600, 400])  # all vectors are measured; links stay too rare to measure
def test_rare_links_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(multi_index, "IN_CELL", 10)
    monkeypatch.setattr(multi_index, "MEASURED_MOST", most, raising=False)
    found, true = found_and_true(spark, planted(4_000, 40, 0, most=0.94, d=32))
    assert true.sum() == 80 and (found == true).all()


def test_neighbours_are_made_at_the_cosine():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(40, 9))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    made = multi_index.made_neighbours(a, 0.93, 5)
    assert np.allclose((made * a[:, None]).sum(axis=2), 0.93) and np.allclose(np.linalg.norm(made, axis=2), 1)
    assert np.array_equal(made, multi_index.made_neighbours(a, 0.93, 5))


@pytest.mark.parametrize("k", [8, 24])
def test_few_cells_hold_nearly_all_made_neighbours(k):
    """Where nothing is known of links, the cells to visit are a falling share of the grid and still reach fresh neighbours."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, two = multi_index.codebook(x[: 64 * k, :16], k), multi_index.codebook(x[: 64 * k, 16:], k)

    def ranks(some, others):
        out = []
        for v, near in zip(some, others):
            d1, d2 = multi_index.distances(v[None, :16], one)[0], multi_index.distances(v[None, 16:], two)[0]
            i, j = multi_index.distances(near[:, :16], one).argmin(axis=1), multi_index.distances(near[:, 16:], two).argmin(axis=1)
            out += [multi_index.cells_before(d1, d2, p, q) for p, q in zip(i, j)]
        return np.array(out)

    cells = np.quantile(ranks(x[:600], multi_index.made_neighbours(x[:600], 0.93, 16)), 0.999, method="higher") + 1
    c = rng.uniform(0.93, 0.99, size=(600, 1, 1))
    aside = rng.normal(size=(600, 1, 32))
    aside -= (aside * x[-600:, None]).sum(axis=2, keepdims=True) * x[-600:, None]
    fresh = c * x[-600:, None] + np.sqrt(1 - c**2) * aside / np.linalg.norm(aside, axis=2, keepdims=True)
    assert (ranks(x[-600:], fresh) < cells).mean() > 0.99 and cells < {8: 0.7, 24: 0.35}[k] * k * k


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 1) for i in range(60)]
    rows += [(100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 3.0], 1), (102, [2.0, 4.0, 6.1], 1), (150, [1.0, 2.0, 3.0], 2)]
    rows += [(200, [2.0], 1), (201, [7.0], 1), (202, [-1.0], 1), (250, [3.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want_links, want_top = {}, set()
    for i, v, label in rows:
        x = np.array(v, dtype=np.float32).astype(np.float64)
        near = {j for j, w, other in rows if j != i and len(w) == len(v) and other == label and x @ np.array(w, dtype=np.float32).astype(np.float64) >= 0.93 * np.linalg.norm(x) * np.linalg.norm(np.array(w, dtype=np.float32).astype(np.float64))}
        want_links[i] = len(near)
        if i % 50 == 0:
            score = sorted((-int(np.floor(256 * x) @ np.floor(256 * np.array(w, dtype=np.float32).astype(np.float64))), j) for j, w, _ in rows if j != i and len(w) == len(v))[:5]
            want_top |= {(i, k, j, -s) for k, (s, j) in enumerate(score, 1)}
    got = multi_index.near_duplicates(df).collect()
    assert {r.vec_id: r.n_links for r in got} == want_links and want_links[100] == 2 and want_links[200] == 1
    assert {r.vec_id: r.component_id for r in got}[102] == 100
    assert {tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0").collect()} == want_top


def test_rows_that_repeat_a_query_or_candidate(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), *[(i, [float(i), 1.0], 1) for i in range(1, 9)], (3, [3.0, 1.0], 1), (8, [8.0, 1.0], 1), (8, [0.5, 0.5], 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id % 50 = 0").collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(k, 9 - k, 65536 * (9 - k)) for k in range(1, 6)]


def test_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(5)
    for scale in (2.0**18, 2.0**21, 1e10):  # sums beyond 2**53, near 2**63 and beyond a long
        m = rng.normal(size=(40, 6)) * scale
        m[7] = m[3]  # a tie
        rows = [(i, v.tolist(), 1) for i, v in enumerate(m)]
        whole = [[int(np.floor(256 * x)) for x in v] for v in m]
        want = set()
        for i in (0, 20):
            score = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in range(40) if j != i)[:5]
            want |= {(i, k, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, j) in enumerate(score, 1)}
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id % 20 = 0")
        assert {tuple(r) for r in got.collect()} == want
