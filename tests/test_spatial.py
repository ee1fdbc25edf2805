"""Spatial operators with two files, nulls, ties, repeated rows and empty tables, against plain Python."""

import itertools
import math

import numpy as np
import pytest

from spotflow.operators import blocks, display, ordered, overlap, sets, spatial

POINTS = "file_id long, point_id long, x double, y double, n int, cluster_name string"


def points(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], POINTS)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(f, i, *map(float, rng.integers(0, 40, 2))) for f in (0, 1) for i in range(60)]
    return out + [(1, 70, None, 1.0), (1, 71, float("nan"), 1.0), (1, 72, float("inf"), 1.0), (2, 0, 5.0, 5.0)]


def fine(r):
    return r[2] is not None and math.isfinite(r[2])


@pytest.mark.parametrize("size,fan", [(256, 64), (3, 2)])
def test_dbscan_of_two_files_with_equal_ids(spark, rows, monkeypatch, size, fan):
    monkeypatch.setattr(spatial, "IN_BLOCK", size)
    monkeypatch.setattr(blocks, "FAN", fan)
    eps, least = 3.0, 4
    rng = np.random.default_rng(21)
    spots = [(x, y, n) for x, y, n in ((20.0, 20.0, 80), (60.0, 20.0, 50), (63.2, 20.0, 3), (200.0, 5.0, 40))]
    more = np.concatenate([rng.normal(size=(n, 2)) * 0.4 + (x, y) for x, y, n in spots])
    rows = [*rows, *[(0, 200 + i, *map(float, p)) for i, p in enumerate(more)], (0, 400, *map(float, more[0])), (0, 401, *map(float, more[0]))]
    want = {}
    for f in (0, 1, 2):
        own = [r for r in rows if r[0] == f and fine(r)]
        near = {a[1]: [b[1] for b in own if math.dist(a[2:4], b[2:4]) <= eps] for a in own}
        core = sorted(i for i in near if len(near[i]) >= least)
        label, number = {}, 0
        for i in core:
            if i in label:
                continue
            number += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = number
                    todo += [k for k in near[j] if k in core]
        for i in near:
            found = [label[k] for k in near[i] if k in core]
            want[f, i] = (len(near[i]), i in core, label[i] if i in label else min(found, default=-1))
    got = spatial.dbscan(points(spark, rows), eps, least)
    assert got.columns == [*points(spark, []).columns, "n_near", "is_core", "cluster"]
    found = {(r.file_id, r.point_id): (r.n_near, r.is_core, r.cluster) for r in got.collect()}
    assert found == want | {(1, i): (0, False, -1) for i in (70, 71, 72)}
    assert spatial.dbscan(points(spark, []), eps, least).count() == 0


def test_neighbours_with_radius_zero_and_repeated_rows(spark):
    got = spatial.neighbours(points(spark, [(0, 1, 1.0, 1.0), (0, 2, 1.0, 1.0), (0, 2, 1.0, 1.0), (0, 3, 1.5, 1.0)]), 0.0)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted([(1, 1), *[(1, 2)] * 2, *[(2, 1)] * 2, *[(2, 2)] * 4, (3, 3)])


@pytest.mark.parametrize("k", [1, 2, 5, 61])
def test_knn_with_ties_and_copies(spark, rows, k):
    rows = [*rows, *[(1, 100 + i, 7.0, 7.0) for i in range(8)]]
    got = {(r.file_id, r.point_id): r.distance for r in spatial.knn_distance(points(spark, rows), k).collect()}
    for a in filter(fine, rows):
        near = sorted(math.dist(a[2:4], b[2:4]) for b in rows if b[0] == a[0] and fine(b))
        assert (got[a[0], a[1]] is None) if len(near) < k else math.isclose(got[a[0], a[1]], near[k - 1], abs_tol=1e-9)
    assert len(got) == len([r for r in rows if fine(r)])
    assert spatial.knn_distance(points(spark, []), k).count() == 0


def test_golden_distance_from_a_line(spark):
    from pyspark.sql import functions as F

    d = spatial.line_distance(*[F.lit(float(v)) for v in (2, 1, 1, 1, 3, 5)])
    assert math.isclose(spark.range(1).select(d.alias("d")).first().d, 0.9160786212, abs_tol=1e-9)


def test_points_on_borders_and_corners(spark):
    square = [(0, 9, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])]
    ring = spark.createDataFrame(square, "file_id long, poly_id long, ord int, x double, y double")
    rows = [(0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 2.0), (2.0, 4.0), (2.0, 2.0), (4.1, 2.0), (-1.0, 2.0), (2.0, 5.0), (None, 1.0)])] + [(1, 0, 2.0, 2.0)]
    assert sorted((r.file_id, r.point_id) for r in spatial.points_in_polygons(points(spark, rows), ring).collect()) == [(0, 0), (0, 1), (0, 2), (0, 3)]
    s = spatial.polygon_summary(ring).first()
    assert (s.area, s.x, s.y, s.corners) == (16.0, 2.0, 2.0, 4)
    assert spatial.points_in_polygons(points(spark, rows), ring.filter("false")).count() == 0
    assert display.patch_edges(ring).count() == 6


BOXES = "file_id long, id long, x0 double, x1 double, y0 double, y1 double, z0 int, z1 int"


def test_golden_groups_of_boxes(spark):
    boxes = spark.createDataFrame([(0, 1, 0.0, 1.0, 0.0, 1.0, 1, 2), (0, 2, 1.0, 2.0, 1.0, 2.0, 5, 6), (0, 3, 5.0, 6.0, 5.0, 6.0, 1, 1), (1, 1, 0.0, 9.0, 0.0, 9.0, 1, 1), (1, 4, None, 1.0, 0.0, 1.0, 1, 1)], BOXES)
    got = {(r.file_id, r.id): r.group_id for r in overlap.overlap_groups(boxes).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (0, 3): 3, (1, 1): 1, (1, 4): 4}
    assert overlap.overlap_pairs(boxes, strict=True).count() == 0
    assert overlap.overlap_pairs(boxes, time_window=2).count() == 0 and overlap.overlap_pairs(boxes, time_window=3).count() == 1
    assert overlap.overlap_groups(boxes.filter("false")).count() == 0


def test_hulls(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 1, 4.0, 0.0), (0, 1, 4.0, 4.0), (0, 1, 0.0, 4.0), (0, 1, 2.0, 2.0), (0, 1, 2.0, 0.0), (0, 2, 1.0, 1.0), (0, 2, 2.0, 2.0), (0, 2, 3.0, 3.0), (0, 3, 7.0, 7.0)]
    df = points(spark, rows)
    got = {r.point_id: r.area for r in overlap.hull_areas(df, ["file_id", "point_id"]).collect()}
    assert got == {1: 16.0, 2: 0.0, 3: 0.0}
    assert sorted((r.x, r.y) for r in overlap.hull_corners(df, ["file_id", "point_id"]).filter("point_id = 1").collect()) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_large_groups_have_the_same_hull(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(0, 1, *map(float, p)) for p in rng.normal(size=(500, 2))]
    whole = overlap.hull_areas(points(spark, rows), ["file_id"]).first().area
    monkeypatch.setattr(overlap, "HULL", 50)
    assert math.isclose(overlap.hull_areas(points(spark, rows), ["file_id"]).first().area, whole, rel_tol=1e-12)


def test_segment_clusters_against_plain_python(spark):
    rng = np.random.default_rng(7)
    tracks = {t: np.column_stack([np.arange(1, 13), np.cumsum(rng.normal(size=(12, 2)), axis=0) + [t % 3 * 40, 0]]) for t in range(24)}
    df = spark.createDataFrame([(0, t, int(f), float(x), float(y)) for t, m in tracks.items() for f, x, y in m], "file_id long, track_id long, frame int, x double, y double")
    boxes = {}
    for t, m in tracks.items():
        r = math.sqrt(overlap.ring_area(overlap.hull(m[:, 1], m[:, 2])) / math.pi)
        c = m[:, 1:].mean(axis=0)
        boxes[t] = (c[0] - r, c[0] + r, c[1] - r, c[1] + r)

    def meet(a, b, strict=False):
        lt = (lambda p, q: p < q) if strict else (lambda p, q: p <= q)
        return lt(a[0], b[1]) and lt(b[0], a[1]) and lt(a[2], b[3]) and lt(b[2], a[3])

    def groups(items):
        root = {i: i for i in items}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in itertools.combinations(sorted(items), 2):
            if meet(items[a], items[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
        out = {}
        for i in items:
            out.setdefault(find(i), []).append(i)
        return list(out.values())

    want, centres = [], [m[:, 1:].mean(axis=0) for m in tracks.values()]
    for group in groups(boxes):
        ends = {(t, k): (tracks[t][k, 1:], tracks[t][k + 1, 1:]) for t in group for k in range(11)}
        box = {s: (min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])) for s, (a, b) in ends.items()}
        busy = {s: box[s] for s in box if sum(o[0] != s[0] and meet(box[s], box[o], True) for o in box) > 2}
        for cluster in groups(busy):
            if len(cluster) > 1:
                at = np.array([p for s in cluster for p in ends[s]])
                ring = overlap.hull(at[:, 0], at[:, 1])
                inside = sum(all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for a, b in zip(ring, np.roll(ring, -1, axis=0))) for c in centres)
                if inside >= 2:
                    want.append((round(overlap.ring_area(ring), 6), inside))
    got = sorted((round(r.area, 6), r.n) for r in overlap.seg_nastic(df).collect())
    assert got == sorted(want) and want


def test_medians_and_numbers_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v) if v < 9 else None, float("nan") if v == 5 else float(v)) for g, v in rng.integers(0, 12, (300, 2)) % [3, 12]] + [(7, None, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r.g: (r.a, r.b) for r in ordered.medians(df, ["g"], ["a", "b"]).collect()}
    for g in (0, 1, 2):
        assert got[g] == (np.median([r[1] for r in rows if r[0] == g and r[1] is not None]), np.median([r[2] for r in rows if r[0] == g and not math.isnan(r[2])]))
    assert got[7] == (None, None) and len(got) == 4
    numbered = ordered.ordinals(df.filter("a IS NOT NULL").select("g", "a").distinct(), ["g"], ["a"], "i").collect()
    for g in (0, 1, 2):
        assert [r.i for r in sorted((r for r in numbered if r.g == g), key=lambda r: r.a)] == list(range(1, 1 + len([r for r in numbered if r.g == g])))
    assert ordered.medians(df.filter("false"), ["g"], ["a", "b"]).count() == 0


def test_sets_of_empty_tables(spark):
    none = spark.createDataFrame([], "v long, ord long, x double, y double")
    one = spark.createDataFrame([(1, 5, 0.0, 0.0), (1, 2, 1.0, 1.0), (2, 3, 2.5, 0.0)], "v long, ord long, x double, y double")
    assert [(r.v, r.i) for r in sets.distinct_in_order(one, "v", "ord").orderBy("i").collect()] == [(1, 1), (2, 2)]
    assert sets.common_in_order(one, none, "v", "ord").count() == 0 and sets.difference_in_order(one, none, "v", "ord").count() == 2
    assert sets.near_rows(one, none, 1.0).count() == 0 and sets.near_rows(one, one.filter("v = 2"), 1.5).count() == 2


def test_boxes_of_very_different_sizes_equal_all_pairs(spark):
    rng = np.random.default_rng(12)
    sizes = [0.0, 1e-6, 0.3, 3.0, 40.0, 900.0]
    rows = []
    for i in range(150):
        x, y = rng.uniform(-500, 500, 2)
        w, h = rng.choice(sizes, 2)
        rows.append((i % 2, i, float(x), float(x + w), float(y), float(y + h), int(i % 7), int(i % 7 + 2)))
    rows += [(0, 200, 5.0, 5.0, 5.0, 5.0, 0, 9), (0, 201, 5.0, 6.0, 5.0, 6.0, 0, 9), (0, 202, 5.0, 1.0, 5.0, 6.0, 0, 9), (0, 203, float("nan"), 1.0, 5.0, 6.0, 0, 9), (0, 204, float("-inf"), 1.0, 5.0, 6.0, 0, 9), (0, 205, None, 1.0, 5.0, 6.0, 0, 9)]
    boxes = spark.createDataFrame(rows, BOXES)
    fine = [r for r in rows if r[1] < 202]
    for strict in (False, True):
        less = (lambda p, q: p < q) if strict else (lambda p, q: p <= q)
        want = {(a[0], a[1], b[1]) for a in fine for b in fine if a[0] == b[0] and a[1] < b[1] and less(a[2], b[3]) and less(b[2], a[3]) and less(a[4], b[5]) and less(b[4], a[5])}
        got = [tuple(r) for r in overlap.overlap_pairs(boxes, strict=strict).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_points_in_long_and_small_rings_equal_counting_all_edges(spark):
    rng = np.random.default_rng(4)
    rings = {(0, 1): [(100 + r * math.cos(t), 100 + r * math.sin(t)) for t, r in zip(np.linspace(0, 2 * math.pi, 200, endpoint=False), rng.uniform(20, 90, 200))]}
    for k in range(12):
        x, y = rng.uniform(0, 200, 2)
        rings[k % 2, 10 + k] = [(x + a, y + b) for a, b in rng.uniform(-8, 8, (5, 2))]
    rings[1, 50] = [(3.0, 3.0), (9.0, 3.0), (6.0, 3.0)]  # without an area
    rows = [(f, p, k, float(x), float(y)) for (f, p), ring in rings.items() for k, (x, y) in enumerate(ring)]
    at = [(f, i, float(x), float(y)) for f in (0, 1, 2) for i, (x, y) in enumerate(rng.uniform(0, 200, (150, 2)))] + [(1, 900, 5.0, 3.0), (1, 901, 9.5, 3.0)]
    polygons = spark.createDataFrame(rows, "file_id long, poly_id long, ord int, x double, y double")
    got = [tuple(r) for r in spatial.points_in_polygons(points(spark, at), polygons).collect()]
    want = {(f, i, p) for f, i, x, y in at for (g, p), ring in rings.items() if f == g and sum(((ay > y) != (by > y)) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) % 2}
    assert len(got) == len(set(got)) and set(got) == want | {(1, 900, 50)}


def test_a_dense_spot_with_an_outlier_asks_no_more_than_spread_points(spark, monkeypatch):
    """The searches across blocks, and the pairs of blocks that DBSCAN compares, do not grow with the density."""
    rng = np.random.default_rng(2)
    clouds = {"spread": rng.uniform(0, 1e4, (3000, 2)), "spot": np.concatenate([rng.normal(0, 1, (2999, 2)), [[1e6, 1e6]]])}
    asked, compared, plain, close = {}, {}, spatial.dealt, blocks.Blocks.close
    for name, cloud in clouds.items():
        df = points(spark, [(0, i, float(x), float(y)) for i, (x, y) in enumerate(cloud)])

        def counting(asks, rows, name=name):
            asked[name] = asks.count()
            return plain(asks, rows)

        def counted(self, radius, name=name):
            inside, near = close(self, radius)
            compared[name] = near.count()
            return inside, near

        monkeypatch.setattr(spatial, "dealt", counting)
        monkeypatch.setattr(blocks.Blocks, "close", counted)
        got = {r.point_id: r.distance for r in spatial.knn_distance(df, 4).collect()}
        for i in (0, 17, 2999):
            assert math.isclose(got[i], float(np.sort(np.hypot(*(cloud - cloud[i]).T))[3]), rel_tol=1e-12)
        n = spatial.dbscan(df, 20.0, 4).agg({"n_near": "sum"}).first()[0]
        if name == "spot":
            assert n == 2999 * 2999 + 1
    assert asked["spot"] <= 2 * asked["spread"] and compared["spot"] <= 3 * compared["spread"]
