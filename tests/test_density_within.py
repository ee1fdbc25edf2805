"""Densities of points within a radius against plain Python."""

import numpy as np

from spotflow import more_queries
from spotflow.operators import spatial

AREAS = "file_id long, point_id long, x double, y double, area double"


def test_density_within_equals_plain_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(f, i, float(x), float(y), float(a)) for f in (0, 1) for i, (x, y, a) in enumerate(zip(rng.normal(0, 30, 700), rng.normal(0, 30, 700), rng.uniform(1, 9, 700)))]
    rows += [(0, 1000 + i, float(x), float(y), 2.0) for i, (x, y) in enumerate(rng.normal(0, 0.1, (600, 2)))]  # blocks within the radius as a whole
    rows += [(0, 2000 + i, 500.0, 500.0, a) for i, a in enumerate((None, 3.0, None))] + [(0, 2010, 900.0, 1.0, None), (0, 2011, -900.0, 1.0, 0.0)]
    rows += [(1, 3000, None, 1.0, 50.0), (1, 3001, 1.0, float("nan"), 60.0), (2, 1, 0.0, 0.0, None)]
    got = {(r.file_id, r.point_id): r.density for r in spatial.density_within(spark.createDataFrame(rows, AREAS).repartition(3), 8.0).collect()}
    fine = [r for r in rows if r[2] is not None and r[3] == r[3]]
    assert got.keys() == {r[:2] for r in fine}
    for f in (0, 1, 2):
        own, areas = [r for r in fine if r[0] == f], [r[4] for r in rows if r[0] == f and r[4] is not None]
        x, y = (np.array([r[k] for r in own]) for k in (2, 3))
        for r in own:
            ring = [own[k][4] for k in np.flatnonzero(np.sqrt((x - r[2]) ** 2 + (y - r[3]) ** 2) <= 8.0)]
            total = sum(a for a in ring if a is not None)
            want = len(ring) / total * np.mean(areas) if total else None
            assert got[r[:2]] is None if want is None else np.isclose(got[r[:2]], want, rtol=1e-12)


def test_query_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "neighbours", None)
    assert more_queries.first_rank_density(spark, "/root/testdata/sf0.001").count() == 500
