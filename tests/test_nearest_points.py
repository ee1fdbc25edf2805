"""The nearest points of every point, without a table of pairs."""

import numpy as np

from spotflow.operators import blocks, sets, spatial


def ranked(df, k):
    rows = sets.smallest(df, ["file_id", "point_id"], ["distance", "other"], k).collect()
    return sorted((r.file_id, r.point_id, r.k, r.other, round(r.distance, 9)) for r in rows)


def test_nearest_points_equal_all_pairs(spark, monkeypatch):
    """Ties, copies, places on the edge of the radius and points that have fewer than three."""
    monkeypatch.setattr(spatial, "SIZE", 8)
    monkeypatch.setattr(blocks, "SIZE", 8)
    rng = np.random.default_rng(6)
    rows = [(int(f), i, float(x), float(y)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(-15, 15, 300), rng.integers(-15, 15, 300)))] + [(0, 900 + i, 70.0, 70.0) for i in range(9)] + [(1, 950, 500.0, 0.0), (1, 951, 503.0, 0.0)]
    points = spark.createDataFrame([*rows, (0, 990, None, 1.0), (1, 991, float("nan"), 1.0)], "file_id long, point_id long, x double, y double")
    for radius in (3.0, 0.0, 40.0):
        want = []
        for f, i, x, y in rows:
            near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for g, j, u, v in rows if g == f and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= radius)[:3]
            want += [(f, i, n, j, round(d, 9)) for n, (d, j) in enumerate(near, 1)]
        assert ranked(spatial.nearest_points(points, radius, 3), 3) == sorted(want)
    assert spatial.nearest_points(points.filter("false"), 3.0, 3).count() == 0


def test_copies_make_no_pairs(spark, monkeypatch):
    """3,000 points at each of two places have nine million pairs each; a few rows a place are searched."""
    points = spark.range(6000).selectExpr("0L AS file_id", "id AS point_id", "double(id % 2) * 5 AS x", "1.0D AS y")
    written, write = [], spatial.materialize
    monkeypatch.setattr(spatial, "materialize", lambda df, name: (out := write(df, name), written.append(out.count()))[0])
    got = ranked(spatial.nearest_points(points, 9.0, 3), 3)
    assert len(got) == 18000 and {r[3:] for r in got if r[1] % 2} == {(1, 0.0), (3, 0.0), (5, 0.0)}
    assert sum(written) <= 6000 + 10
