"""Empty tables, nulls, ties, repeated rows and clashing column names of the domain operators without a test of their own."""

import math

import numpy as np
import pytest

from spotflow.operators import display, fits, localize, mobility, overlap, reports, voronoi

TRACKS = "file_id long, track_id long, frame int, x double, y double, n int, w double, component long"


def tracks(spark, rows):
    return spark.createDataFrame([(*r, 9, 9.0, 9) for r in rows], TRACKS)


@pytest.fixture(scope="module")
def some(spark):
    rows = [(f, t, k, float(k * t), float(k)) for f in (0, 1) for t in (1, 2) for k in range(1, 7)]
    rows += [(0, 3, 1, None, 1.0), (0, 3, 2, 1.0, 2.0), (0, 3, 3, 4.0, 6.0), (0, 3, 4, float("nan"), 9.0), (0, 3, None, 50.0, 50.0)]
    return rows + [(0, 4, 1, None, None), (1, 5, 2, 3.0, 3.0), (1, 5, 2, 3.0, 3.0)]


def test_track_features_with_nulls_and_repeated_rows(spark, some):
    got = {(r.file_id, r.track_id): r for r in mobility.track_features(tracks(spark, some), 1.0).collect()}
    assert (got[0, 3].n, got[0, 3].duration_s, got[0, 3].displacement, got[0, 3].range) == (5, 4.0, 5.0, 5.0)
    assert got[0, 4].n == 1 and got[0, 4].displacement is None and got[0, 4].range is None
    assert (got[1, 5].n, got[1, 5].displacement) == (2, 0.0)
    assert got[0, 1].displacement == got[1, 1].displacement == math.hypot(5, 5)
    assert mobility.track_features(tracks(spark, [])).count() == 0


def test_curves_and_fits_of_empty_and_gapped_tracks(spark, some):
    curves = mobility.msd(tracks(spark, [r for r in some if r[1] < 3]), 1.0)
    got = {(r.file_id, r.track_id): r for r in mobility.fit_msd(curves).collect()}
    assert len(got) == 4 and all(r.is_fitted for r in got.values())
    gap = curves.filter("NOT (track_id = 1 AND lag = 3)")
    lost = {(r.file_id, r.track_id): r for r in mobility.fit_msd(gap).collect()}
    assert not lost[0, 1].is_fitted and (lost[0, 1].d, lost[0, 1].adj_r2) == (0.0, 0.0) and lost[0, 2].is_fitted
    none = mobility.msd(tracks(spark, []), 1.0)
    assert none.count() == 0 and mobility.fit_msd(none).count() == 0


def test_crossings_of_curves_that_touch_run_along_or_never_meet(spark):
    y = {0: ([3, 1, -1, -2], [0, 0, 0, 0]), 1: ([1, 1, 1, 1], [1, 1, 1, 1]), 2: ([2, 2, 2, 2], [1, 1, 1, 1]), 3: ([1, 0, 1, 2], [0, 0, 2, 1]), 4: ([1.0], [2.0])}
    rows = [(f, i, 10.0 * i, float(a), float(b), 1.0) for f, (p, q) in y.items() for i, (a, b) in enumerate(zip(p, q))]
    df = spark.createDataFrame(rows, "file_id long, i int, x double, y1 double, y2 double, z double")
    got = {r.file_id: r.x for r in fits.curve_crossings(df.drop("z")).collect()}
    assert got == {0: 15.0, 1: None, 2: None, 3: 10.0, 4: None}
    assert fits.curve_crossings(df.drop("z").filter("false")).count() == 0


def test_boxes_and_clusters_of_few_or_no_tracks(spark, some):
    df = tracks(spark, some).select("file_id", "track_id", "frame", "x", "y")
    boxes = {(r.file_id, r.id) for r in overlap.track_boxes(df.filter("x IS NOT NULL AND NOT isnan(x)")).collect()}
    assert boxes == {(0, 1), (0, 2), (1, 1), (1, 2), (0, 3)}  # three rows at least
    for f in (overlap.track_boxes, overlap.nastic):
        assert f(df.filter("false")).count() == 0
    one = overlap.nastic(df.filter("file_id = 0 AND track_id = 1")).collect()
    assert len(one) == 1 and (one[0].n, one[0].area) == (1, 0.0)
    assert overlap.nastic(df.filter("file_id = 0 AND track_id = 1"), min_tracks=2).count() == 0


def test_displays_of_no_axes_and_rings_of_different_length(spark):
    axes = spark.createDataFrame([(0, 0.0, 1000.0, 0.0, 500.0), (1, 5.0, 5.0, 0.0, 1.0), (2, None, 1.0, 0.0, 1.0)], "file_id long, x_low double, x_high double, y_low double, y_high double")
    assert [r.file_id for r in display.scale_bars(axes, -9).collect()] == [0]
    assert display.scale_bars(axes.filter("false"), -9).count() == 0
    rings = spark.createDataFrame([(0, 1, k, float(k), 0.0) for k in (3, 1, 2)] + [(0, 2, k, float(k), 1.0) for k in range(4)] + [(1, 1, 0, 0.0, 0.0)], "file_id long, poly_id long, ord int, x double, y double")
    got = {(r.file_id, r.poly_id): r.face for r in display.patch_faces(rings).collect()}
    assert got == {(0, 1): [1, 2, 3, None], (0, 2): [0, 1, 2, 3], (1, 1): [0]}
    assert display.patch_faces(rings.filter("false")).count() == 0


def test_sheets_of_files_without_rows(spark):
    files = spark.createDataFrame([(0, "/a/b.c.tif", 3, 4, 5), (1, "plain", 1, 1, 1), (2, None, None, None, None)], "file_id long, path string, width int, height int, n_frames int")
    got = {r.file_id: (r.name, r.folder, r.stem) for r in reports.metadata_sheet(files).collect()}
    assert got == {0: ("b.c.tif", "/a", "b.c"), 1: ("plain", "plain", "plain"), 2: (None, None, None)}
    clusters = spark.createDataFrame([(0, 2e6, 5.0, 3, 1.0, 2.0), (0, None, 1.0, 1, 0.0, 0.0)], "file_id long, area double, diameter double, n long, x double, y double")
    sheet = sorted((r.file_id, r.area_um2, r.n) for r in reports.cluster_sheet(files, clusters).collect())
    assert sheet == [(0, 0.0, 1), (0, 2.0, 3), (1, 0.0, 0), (2, 0.0, 0)]
    assert reports.cluster_sheet(files.filter("false"), clusters).count() == 0
    features = mobility.track_features(tracks(spark, [(0, 1, 1, 1.0, 1.0), (0, 2, 1, 1.0, 1.0), (3, 1, 1, 1.0, 1.0)]))
    counts = {r.file_id: (r.n_tracks, r.n_filtered, r.n_masked) for r in reports.tracking_sheet(features, features.filter("file_id = 0 AND track_id = 1"), features.filter("false")).collect()}
    assert counts == {0: (2, 1, 0), 3: (1, 0, 0)}
    valid = spark.createDataFrame([(0, -2.0), (1, -1.0)], "file_id long, log_d double")
    pops = reports.population_sheet(fits.two_populations(valid), valid)
    assert {r.file_id: (r.n, r.error_code) for r in pops.collect()} == {0: (1, 2), 1: (1, 2)}
    assert reports.population_sheet(fits.two_populations(valid.filter("false")), valid.filter("false")).count() == 0


def test_cells_of_points_on_a_slanted_line_and_of_two_points(spark):
    rows = [(0, i, float(i), 2.0 * i) for i in range(5)] + [(1, 0, 0.0, 0.0), (1, 1, 2.0, 1.0)]
    got = voronoi.voronoi_cells(spark.createDataFrame(rows, "file_id long, point_id long, x double, y double")).collect()
    assert {(r.file_id, r.point_id): sorted(r.neighbours) for r in got} == {(0, 0): [1], (0, 1): [0, 2], (0, 2): [1, 3], (0, 3): [2, 4], (0, 4): [3], (1, 0): [1], (1, 1): [0]}
    assert math.isclose(sum(r.area for r in got if r.file_id == 0), 32.0) and math.isclose(sum(r.area for r in got if r.file_id == 1), 2.0)


def test_histograms_and_windows_of_nothing(spark):
    locs = spark.createDataFrame([(0, 1.0), (0, None), (0, float("nan")), (1, 95.0)], "file_id long, photons double")
    got = [(r.bin, r.n) for r in localize.bin_counts(locs, "photons", 0.0, 10.0, 10).orderBy("bin").collect() if r.n]
    assert got == [(0, 1), (9, 1)]
    assert localize.bin_counts(locs.filter("false"), "photons", 0.0, 10.0, 10).filter("n > 0").count() == 0
    assert np.isfinite([r.n for r in localize.bin_counts(locs, "photons", 0.0, 10.0, 10).collect()]).all()
