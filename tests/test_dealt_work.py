"""Small tables of much work are dealt over tasks, although their bytes would fit into one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotflow.operators import shapes, spatial, voronoi

POINTS = "file_id long, point_id long, x double, y double"


@pytest.fixture(scope="module")
def points(spark):
    rows = [(0, i, *map(float, p)) for i, p in enumerate(np.random.default_rng(4).normal(size=(4000, 2)))]
    return spark.createDataFrame(rows, POINTS)


def files_of(monkeypatch, module, name, run):
    """How many tasks have written the tables of that name."""
    write, found = module.materialize, []

    def counting(df, label):
        out = write(df, label)
        if label == name:
            found.append(out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(module, "materialize", counting)
    run()
    return found


def test_cells_of_blocks_are_cut_in_several_tasks(points, monkeypatch):
    assert files_of(monkeypatch, voronoi, "cells", lambda: voronoi.voronoi_cells(points))[0] > 1


def test_nearest_within_blocks_are_found_in_several_tasks(points, monkeypatch):
    assert files_of(monkeypatch, spatial, "within", lambda: spatial.knn_distance(points, 3)) > [1]


def test_pairs_of_blocks_are_compared_in_several_tasks(spark):
    rows = spark.createDataFrame([(0, b, 10 * b + i) for b in range(16) for i in range(3)], "file_id long, block long, v long")
    near = spark.createDataFrame([(0, a, b) for a in range(16) for b in range(16)], "file_id long, a long, b long")
    found = spatial._pairs_of_blocks(near, rows, rows, lambda c: {"a": c["a_v"], "b": c["b_v"]}, "a long, b long")
    assert {(r.a, r.b) for r in found.collect()} == {(10 * a + i, 10 * b + i) for a in range(16) for b in range(16) for i in range(3)}
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rings_around_regions_are_traced_in_several_tasks(spark):
    corner = lambda t: [(0, t, 1, t * 10.0, 0.0), (0, t, 2, t * 10.0 + 1, 0.0), (0, t, 3, t * 10.0, 1.0)]
    rows = [(0, t, 3 * t, 3 * t + 1, 3 * t + 2, *[v for _, _, _, x, y in corner(t) for v in (x, y)]) for t in range(24)]
    shape = spark.createDataFrame(rows, "file_id long, region long, a long, b long, c long, ax double, ay double, bx double, by double, cx double, cy double")
    rings = shapes.outer_rings(shape)
    assert rings.count() == 72
    assert rings.select(F.spark_partition_id()).distinct().count() > 1
