"""Voronoi cells against cutting by all points, and their clusters against plain Python."""

import math

import numpy as np
import pytest

from spotflow.operators import blocks, spatial, voronoi

POINTS = "file_id long, point_id long, x double, y double"


def brute(rows):
    """area, neighbours and openness of every distinct position of one file."""
    places = {}
    for _, i, x, y in rows:
        places[x, y] = min(i, places.get((x, y), i))
    xs, ys = [p[0] for p in places], [p[1] for p in places]
    box = [(min(xs), min(ys), -1), (max(xs), min(ys), -1), (max(xs), max(ys), -1), (min(xs), max(ys), -1)]
    out = {}
    for p, i in places.items():
        cell = box
        for q, j in places.items():
            if p != q:
                cell = voronoi.cut(cell, p, q, j)
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(cell, cell[1:] + cell[:1]))
        owners = {c[2] for c in cell}
        out[i] = (abs(twice) / 2, owners - {-1}, -1 in owners)
    return out


@pytest.mark.parametrize("tile", [5, 200])
def test_cells_equal_cutting_by_all(spark, monkeypatch, tile):
    monkeypatch.setattr(voronoi, "IN_BLOCK", tile)
    monkeypatch.setattr(blocks, "FAN", 2)
    monkeypatch.setattr(blocks, "ASKS", 10)
    rng = np.random.default_rng(3)
    cloud = [(0, i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(25, 2)) * 0.02 + 3]))]
    other = [(1, i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 9, (20, 2)))]
    rows = [*cloud, *other, (0, 500, cloud[3][2], cloud[3][3]), (1, 90, None, 1.0), (2, 1, 5.0, 5.0), (3, 1, 0.0, 1.0), (3, 2, 0.0, 3.0)]
    got = voronoi.voronoi_cells(spark.createDataFrame(rows, POINTS)).collect()
    assert {r.file_id for r in got} == {0, 1}
    for f, own in ((0, cloud), (1, other)):
        want = brute(own)
        found = {r.point_id: r for r in got if r.file_id == f}
        assert found.keys() == want.keys()
        for i, (area, neighbours, is_open) in want.items():
            assert math.isclose(found[i].area, area, rel_tol=1e-6, abs_tol=1e-9)
            assert set(found[i].neighbours) == neighbours and found[i].is_open == is_open
        x, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        assert math.isclose(sum(r.area for r in found.values()), float(np.ptp(x) * np.ptp(y)), rel_tol=1e-9)


def test_clusters_of_small_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.uniform(0, 10, (40, 2)), rng.normal(size=(15, 2)) * 0.1 + 3, rng.normal(size=(12, 2)) * 0.1 + 7]))]
    cells = voronoi.voronoi_cells(spark.createDataFrame(rows, POINTS))
    want, small = brute(rows), None
    small = {i for i, (area, _, is_open) in want.items() if area < 0.2 and not is_open}
    groups = []
    while small:
        todo, group = [min(small)], set()
        while todo:
            i = todo.pop()
            if i in small:
                small.discard(i)
                group.add(i)
                todo += want[i][1] & small
        groups.append(group)
    members = voronoi.voronoi_members(cells, 0.2, "area", 3)
    got = voronoi.voronoi_clusters(cells, members).orderBy("cluster").collect()
    big = [g for g in groups if len(g) >= 3]
    assert [r.n for r in got] == [len(g) for g in big] and len(got) >= 2
    assert all(math.isclose(r.area, sum(want[i][0] for i in g), rel_tol=1e-6) for r, g in zip(got, big))
    assert {(r.point_id, r.cluster) for r in members.collect()} == {(i, k) for k, g in enumerate(big, 1) for i in g}
    ring_area = {r.poly_id: r.area for r in spatial.polygon_summary(voronoi.outlines(cells, members)).collect()}
    assert all(ring_area[k] >= r.area * (1 - 1e-6) for k, r in enumerate(got, 1))  # a ring also holds its holes
    assert any(math.isclose(ring_area[k], r.area, rel_tol=1e-6) for k, r in enumerate(got, 1))
    assert voronoi.voronoi_members(cells, 1.5, "density", 3).count() >= 3
    assert voronoi.voronoi_cells(spark.createDataFrame([], POINTS)).count() == 0


def test_rings_of_a_square_with_a_hole():
    outer, inner = [(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (1, 2), (2, 2), (2, 1)]
    sides = [(a, b) for ring in (outer, inner) for a, b in zip(ring, ring[1:] + ring[:1])]
    starts, ends = (np.array(x, dtype=float) for x in zip(*[sides[k] for k in (5, 0, 3, 6, 1, 7, 2, 4)]))
    assert sorted(len(r) for r in voronoi.rings_of(starts, ends)) == [4, 4]
