"""Triangles, alpha shapes, outlines and untangled clusters against plain Python over all triples."""

import itertools
import math

import numpy as np
import pytest

from spotflow.operators import blocks, components, shapes, voronoi

POINTS = "file_id long, point_id long, x double, y double, cluster long, region int"


def points(spark, rows):
    return spark.createDataFrame([(*r, c, 9) for r, c in rows], POINTS)


def circle(a, b, c):
    d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))
    if not d:
        return None
    b2, c2 = math.dist(a, b) ** 2, math.dist(a, c) ** 2
    x, y = ((c[1] - a[1]) * b2 - (b[1] - a[1]) * c2) / d, ((b[0] - a[0]) * c2 - (c[0] - a[0]) * b2) / d
    return (a[0] + x, a[1] + y), math.hypot(x, y)


def triangles_of(places):
    """{(a, b, c): radius} of all triples with an empty circle."""
    extent = max(np.ptp([p[0] for p in places.values()]), np.ptp([p[1] for p in places.values()]))
    out = {}
    for t in itertools.combinations(sorted(places), 3):
        found = circle(*[places[i] for i in t])
        if found and found[1] <= shapes.WIDEST * extent and all(math.dist(found[0], q) >= found[1] * (1 - 1e-9) for i, q in places.items() if i not in t):
            out[t] = found[1]
    return out


def regions_of(tri):
    """Sets of triangles that hang together by edges."""
    left, out = set(tri), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            t = todo.pop()
            own.add(t)
            near = {u for u in left if len(set(u) & set(t)) == 2}
            left -= near
            todo += near
        out.append(own)
    return sorted(out, key=min)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    two = np.concatenate([rng.normal(size=(18, 2)), rng.normal(size=(12, 2)) * 0.3 + [6, 1]])
    out = [((f, i, *map(float, p)), 1) for f, cloud in ((0, two), (1, rng.uniform(0, 5, (20, 2)))) for i, p in enumerate(cloud)]
    out += [((0, 40, *out[3][0][2:]), 1), ((1, 50, None, 1.0), 1), ((1, 51, float("nan"), 1.0), 1)]  # a copy; no place
    out += [((2, i, float(i), 2.0 * i), 1) for i in range(5)] + [((3, 0, 1.0, 1.0), 1), ((3, 1, 2.0, 1.0), 1)]  # a line; two points
    return out


def places_of(rows, f):
    found = {}
    for (g, i, x, y), _ in rows:
        if g == f and x is not None and x == x:
            found[x, y] = min(i, found.get((x, y), i))
    return {i: p for p, i in found.items()}


@pytest.fixture(scope="module", params=[256, 4])
def found(spark, rows, request):
    old = voronoi.IN_BLOCK, blocks.FAN
    voronoi.IN_BLOCK, blocks.FAN = request.param, 3
    yield shapes.delaunay(points(spark, rows))
    voronoi.IN_BLOCK, blocks.FAN = old


def test_triangles_equal_all_triples(found, rows):
    got = {}
    for r in found.collect():
        got.setdefault(r.file_id, {})[r.a, r.b, r.c] = r.radius
    assert got.keys() == {0, 1}
    for f in got:
        want = triangles_of(places_of(rows, f))
        assert got[f].keys() == want.keys() and all(math.isclose(got[f][t], want[t], rel_tol=1e-6) for t in want)


@pytest.mark.parametrize("few", [200_000, 3])
def test_alphas_and_regions_equal_trying_all_radii(found, rows, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    every, one, mid = ({r.file_id: r.alpha for r in f(found).collect()} for f in (shapes.all_points_alpha, shapes.one_region_alpha, shapes.concave_alpha))
    for f in (0, 1):
        tri = {(r.a, r.b, r.c): r.radius for r in found.filter(f"file_id = {f}").collect()}
        radii = sorted(set(tri.values()))
        whole = [a for a in radii if {i for t in tri if tri[t] <= a for i in t} == {i for t in tri for i in t}]
        assert every[f] == whole[0]
        single = next(a for a in whole if len(regions_of([t for t in tri if tri[t] <= a])) == 1)
        assert one[f] == single
        rest = [a for a in radii if a >= single]
        assert mid[f] == rest[max(1, math.ceil(0.5 * len(rest))) - 1]
    shape = shapes.alpha_shape(found, shapes.all_points_alpha(found))
    for f in (0, 1):
        got = {}
        for r in shape.filter(f"file_id = {f}").collect():
            got.setdefault(r.region, set()).add((r.a, r.b, r.c))
        tri = [(r.a, r.b, r.c) for r in found.filter(f"file_id = {f} AND radius <= {every[f]!r}").collect()]
        assert [got[k] for k in sorted(got)] == regions_of(tri) and sorted(got) == list(range(1, len(got) + 1))


def test_outline_lies_between_hull_and_tightest(spark, rows):
    df = points(spark, rows)
    areas = {}
    for shrink in (0.0, 0.5, 1.0):
        for f, ring in _rings(shapes.concave_outlines(df, ["file_id", "cluster"], shrink)).items():
            assert len(set(ring)) == len(ring)
            areas[f, shrink] = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    for f in (0, 1):
        p = np.array(list(places_of(rows, f).values()))
        assert math.isclose(areas[f, 0.0], hull_area(p), rel_tol=1e-9)
        assert 0 < areas[f, 1.0] <= areas[f, 0.5] <= areas[f, 0.0]
    assert {f for f, _ in areas} == {0, 1}
    assert shapes.concave_outlines(df.filter("false"), ["file_id", "cluster"]).count() == 0


def _rings(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.ord):
        out.setdefault(r.file_id, []).append((r.x, r.y))
    return out


def hull_area(p):
    p = sorted(map(tuple, p))

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    h = half(p) + half(p[::-1])
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1])) / 2


def test_square_lattice_is_covered_once(spark):
    """Ties: every four points of a lattice are on an empty circle."""
    grid = [((0, 10 * i + j, float(i), float(j)), 1) for i in range(6) for j in range(6)]
    found = shapes.delaunay(points(spark, grid)).filter("area > 1e-6")
    assert found.count() == 50 and math.isclose(found.agg({"area": "sum"}).first()[0], 25.0, rel_tol=1e-9)


def test_clusters_are_taken_apart_where_they_should(spark):
    rng = np.random.default_rng(3)
    blob = lambda n, x: rng.uniform(-1, 1, (n, 2)) + [x, 0]
    parts = [(1, blob(20, 0)), (1, blob(15, 60)), (2, blob(20, 200)), (2, blob(4, 260)), (3, blob(12, 400)), (3, blob(12, 460)), (3, blob(4, 520)), (4, blob(2, 600))]
    rows, i = [], 0
    for c, cloud in parts:
        for p in cloud:
            rows.append(((0, i, *map(float, p)), c))
            i += 1
    rows.append(((0, 999, *rows[0][0][2:]), 1))
    df = points(spark, rows)
    got = {}
    for r in shapes.untangled(df, df.select("file_id", "point_id", "cluster")).collect():
        got.setdefault(r.cluster, []).append(r.point_id)
    sizes = [len(got[k]) for k in sorted(got)]
    assert sizes == [21, 15, 24, 12, 12, 4, 2] and sorted(got) == list(range(1, 8))
    assert sorted(got[1])[-1] == 999 and sorted(x for v in got.values() for x in v) == sorted(r[0][1] for r in rows)
    assert shapes.untangled(df.filter("false"), df.select("file_id", "point_id", "cluster").filter("false")).count() == 0
