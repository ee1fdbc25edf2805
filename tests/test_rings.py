"""Mask rings, Otsu's threshold and trimmed cells against plain Python."""

import math

import numpy as np
import pytest

from spotflow.operators import overlap, rings, spatial, voronoi

MASK = "file_id long, row int, col int, inside boolean, d int, ring int"


def mask_rows(images):
    return [(f, i, j, bool(v), 1, 2) for f, m in images.items() for (i, j), v in np.ndenumerate(m)]


def flood(cells, steps):
    left, out = set(cells), 0
    while left:
        todo, out = [left.pop()], out + 1
        while todo:
            i, j = todo.pop()
            near = {(i + a, j + b) for a, b in steps} & left
            left -= near
            todo += near
    return out


ROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
CROSS = [(0, 1), (0, -1), (1, 0), (-1, 0)]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    out = {k: rng.random((12, 15)) < p for k, p in enumerate((0.3, 0.5, 0.7))}
    out[3] = np.ones((3, 4), bool)
    out[4] = np.zeros((3, 3), bool)
    out[5] = np.pad(np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool), 1)
    out[6] = np.eye(3, dtype=bool)  # corners only
    return out


def test_rings_have_the_parts_holes_and_pixels_of_the_mask(spark, images):
    rows = mask_rows(images)
    mask = spark.createDataFrame([*rows, rows[0], rows[-1], (7, 0, 0, None, 1, 2)], MASK)
    got = rings.mask_rings(mask).orderBy("file_id", "poly_id", "ord").collect()
    assert rings.mask_rings(mask.filter("false")).count() == 0
    for f, m in images.items():
        own = {}
        for r in got:
            if r.file_id == f:
                own.setdefault((r.poly_id, r.is_hole), []).append((r.x, r.y))
        inside = {(i, j) for (i, j), v in np.ndenumerate(m) if v}
        h, w = m.shape
        outside = {(i, j) for i in range(-1, h + 1) for j in range(-1, w + 1)} - inside
        assert sum(not hole for _, hole in own) == flood(inside, ROUND)
        assert sum(hole for _, hole in own) == flood(outside, CROSS) - 1
        assert sorted(k for k, _ in own) == list(range(1, len(own) + 1))
        twice = sum(a[0] * b[1] - b[0] * a[1] for ring in own.values() for a, b in zip(ring, ring[1:] + ring[:1]))
        assert twice == 2 * len(inside)
        for ring in own.values():
            steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])]
            assert all((s[0] == 0) != (s[1] == 0) and (s[0] == 0) != (t[0] == 0) for s, t in zip(steps, steps[1:] + steps[:1]))
    square = {(r.poly_id, r.is_hole): 0 for r in got if r.file_id == 5}
    assert square == {(1, False): 0, (2, True): 0}
    assert [(r.x, r.y) for r in got if r.file_id == 3] == [(0, 0), (4, 0), (4, 3), (0, 3)]
    assert {r.poly_id for r in got if r.file_id == 6} == {1}


def test_points_in_rings_are_those_in_pixels(spark, images):
    mask = spark.createDataFrame(mask_rows(images), MASK)
    found = rings.mask_rings(mask)
    rng = np.random.default_rng(1)
    rows = [(f, i, float(x), float(y)) for f in (0, 1, 2) for i, (x, y) in enumerate(rng.uniform(0, 12, (80, 2)))]
    points = spark.createDataFrame(rows, "file_id long, point_id long, x double, y double")
    sign = {(r.file_id, r.poly_id): -1 if r.is_hole else 1 for r in found.collect()}
    depth = {}
    for r in spatial.points_in_polygons(points, found).collect():
        depth[r.file_id, r.point_id] = depth.get((r.file_id, r.point_id), 0) + sign[r.file_id, r.poly_id]
    inside = {(r.file_id, r.point_id) for r in spatial.points_in_mask(points, mask).collect()}
    assert {k for k, v in depth.items() if v} == inside


def test_threshold_equals_trying_all_levels(spark):
    rng = np.random.default_rng(2)
    images = {0: np.concatenate([rng.normal(50, 5, 90), rng.normal(120, 9, 40)]), 1: rng.uniform(0, 1, 60), 2: np.full(5, 3.0), 3: np.array([1.0, 1.0, 9.0])}
    rows = [(f, 0, j, float(v), 5) for f, m in images.items() for j, v in enumerate(m)] + [(0, 1, 0, None, 5), (3, 1, 0, float("nan"), 5)]
    pixels = spark.createDataFrame(rows, "file_id long, row int, col int, adu double, level int")
    got = {r.file_id: r.threshold for r in rings.otsu(pixels.drop("level")).collect()}
    assert got.keys() == {0, 1, 3}
    for f in got:
        v = images[f]
        level = np.floor((v - v.min()) / (v.max() - v.min()) * 255 + 0.5)
        score = np.array([(level <= t).mean() * (level > t).mean() * (level[level <= t].mean() - level[level > t].mean()) ** 2 if 0 < (level <= t).mean() < 1 else -1 for t in range(256)])
        assert math.isclose(got[f], np.flatnonzero(score >= score.max() * (1 - 1e-12)).mean())
    inside = rings.otsu_mask(pixels.drop("level"))
    assert inside.filter("file_id = 2 AND inside").count() == 0 and inside.filter("inside IS NULL").count() == 0
    assert inside.filter("file_id = 3 AND inside").count() == 1


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def test_trimmed_cells_fill_what_the_ring_leaves_of_them(spark):
    rng = np.random.default_rng(9)
    rows = [(f, i, *map(float, p)) for f in (0, 1) for i, p in enumerate(rng.normal(size=(40, 2)) * (1 + f))] + [(0, 90, None, 1.0), (2, 1, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "file_id long, point_id long, x double, y double")
    cells = voronoi.voronoi_cells(points, 1000.0).cache()
    hull = overlap.hull_corners(points, ["file_id"])
    dented = [(0, 0, -2.0, -2.0), (0, 1, 2.0, -2.0), (0, 2, 2.0, 2.0), (0, 3, 0.0, 0.0), (0, 4, -2.0, 2.0)]
    shapes = {"hull": hull, "box": rings.limit_rings(spark.createDataFrame([(0, -1.0, 1.0, -0.5, 1.5), (1, -1.0, 1.0, -1.0, 1.0), (5, 0.0, 1.0, 0.0, 1.0)], "file_id long, x0 double, x1 double, y0 double, y1 double")), "dent": spark.createDataFrame(dented, "file_id long, ord int, x double, y double")}
    own = {(r.file_id, r.point_id): [(c.x, c.y) for c in r.corners] for r in cells.filter("NOT is_open").collect()}
    at = rng.uniform(-2, 2, (4000, 2)).tolist()
    for name, shape in shapes.items():
        ring = {}
        for r in sorted(shape.collect(), key=lambda r: r.ord):
            ring.setdefault(r.file_id, []).append((r.x, r.y))
        ring = {f: r if area(r) > 0 else r[::-1] for f, r in ring.items() if area(r)}
        got = {(r.file_id, r.point_id): r for r in rings.trimmed(cells, shape).collect()}
        kept = {(r.file_id, r.point_id): r.area for r in rings.trimmed(cells, shape, "remove").collect()}
        assert got.keys() <= own.keys() and kept.keys() <= got.keys()
        for key, r in got.items():
            cell = own[key]
            assert r.area <= area(cell) * (1 + 1e-9) and r.is_cut == (r.area < area(cell) * (1 - 1e-9))
            if name != "dent":
                assert (key in kept) == (not r.is_cut)
        # the cells are the places nearest to their points, so that a place in the ring is in the cut cell of its nearest point
        for f in ring:
            near = {k: v for k, v in own.items() if k[0] == f}
            share = {k: 0 for k in near}
            for x, y in at:
                inside = [k for k, cell in near.items() if rings.in_ring(x, y, cell)]
                if inside and rings.in_ring(x, y, ring[f]):
                    share[inside[0]] += 1
            box = [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]
            want = sum(share.values()) * 16 / 4000
            have = sum(abs(area(rings.clip([(c.x, c.y) for c in got[k].corners], box))) for k in near if k in got)
            assert abs(have - want) < 0.6
    assert rings.trimmed(cells, hull.filter("false")).count() == 0 and rings.trimmed(cells.filter("false"), hull).count() == 0


def test_clip_by_hand():
    unit = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert area(rings.clip([(0.5, -1.0), (3.0, -1.0), (3.0, 3.0), (0.5, 3.0)], unit)) == 0.5
    assert rings.clip([(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)], unit) == []
    u = [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (0.75, 2.0), (0.75, 0.5), (0.25, 0.5), (0.25, 2.0), (-1.0, 2.0)]
    assert math.isclose(area(rings.clip(u, unit)), 0.75)
