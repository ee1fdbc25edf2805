"""Fits, curves, mobility and images: goldens, known mixtures, nulls and empty tables."""

import math
import struct

import numpy as np
import pytest

from spotflow.operators import fits, image, localize, mobility, parameters, reports
from spotflow.sources import tiff

TRACKS = "file_id long, track_id long, frame int, x double, y double"


def test_known_mixture_of_two_files(spark):
    rng = np.random.default_rng(1)
    rows = [(0, float(v)) for v in np.concatenate([rng.normal(-3, 0.3, 3000), rng.normal(-1, 0.4, 1000)])] + [(1, 1.0)] * 5 + [(1, None), (1, float("nan"))]
    got = {r.file_id: r for r in fits.two_populations(spark.createDataFrame(rows, "file_id long, log_d double")).collect()}
    r = got[0]
    assert r.error_code == 0 and abs(r.mu1 + 3) < 0.05 and abs(r.mu2 + 1) < 0.1 and abs(r.sigma1 - 0.3) < 0.05 and abs(r.fraction1 - 0.75) < 0.03
    assert got[1].error_code == 2
    assert fits.two_populations(spark.createDataFrame([], "file_id long, log_d double")).count() == 0


def test_smoothing_keeps_a_cubic(spark):
    rows = [(0, i, float(i**3 - 4 * i)) for i in range(9)] + [(1, i, 1.0) for i in range(3)]
    got = fits.smooth(spark.createDataFrame(rows, "file_id long, i int, y double")).collect()
    assert all(math.isclose(r.smooth, r.y, abs_tol=1e-9) for r in got if r.file_id == 0)
    assert all(r.smooth is None for r in got if r.file_id == 1)


def test_goldens_of_mean_squared_displacements(spark):
    straight = [(0, 1, f, 100.0 * (f - 1), 0.0) for f in range(1, 6)]
    gapped = [(0, 2, 1, 0.0, 0.0), (0, 2, 2, 100.0, 0.0), (0, 2, 4, 100.0, 100.0), (0, 2, 9, None, 1.0), (0, None, 1, 1.0, 1.0)]
    curves = mobility.msd(spark.createDataFrame(straight + gapped, TRACKS), 50.0)
    got = {(r.track_id, r.lag): (round(r.msd, 9), round(r.sd, 9), r.n) for r in curves.collect()}
    assert got == {(1, 1): (0.01, 0, 4), (1, 2): (0.04, 0, 3), (1, 3): (0.09, 0, 2), (1, 4): (0.16, 0, 1), (2, 1): (0.01, 0, 1), (2, 2): (0.01, 0, 1), (2, 3): (0.02, 0, 1)}
    fit = {r.track_id: r for r in mobility.fit_msd(curves).collect()}
    assert round(fit[1].d, 9) == 0.725 and round(fit[1].adj_r2, 10) == 0.9790825688 and not fit[2].is_fitted
    assert mobility.fit_msd(curves.filter("false")).count() == 0


def test_long_tracks_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(0, 1, f, *map(float, rng.normal(size=2))) for f in range(80)], TRACKS)
    whole = {r.lag: (r.n, r.msd) for r in mobility.msd(df).collect()}
    monkeypatch.setattr(mobility, "PART", 7)
    parts = {r.lag: (r.n, r.msd) for r in mobility.msd(df).collect()}
    assert whole.keys() == parts.keys() and all(whole[k][0] == parts[k][0] and math.isclose(whole[k][1], parts[k][1]) for k in whole)


def test_histogram_edges_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 2.0), (0, 2.1), (0, None)], "file_id long, v double")
    assert [r.n for r in localize.bin_counts(df, "v", 0.0, 1.0, 2).orderBy("bin").collect()] == [1, 2]
    assert localize.adaptive_bins(df.filter("false"), "v").count() == 0
    assert localize.adaptive_bins(df.filter("v = 0"), "v").count() == 0
    assert localize.adaptive_bins(df.filter("v = 1"), "v").count() == 1
    assert localize.adaptive_histogram(df, df, "v").count() > 0


@pytest.mark.parametrize("sigma,size", [(1.3, 9), (1.5, 10), (0.1, 3), (2.0, 13)])
def test_kernel_sizes_and_both_forms_of_the_convolution(spark, sigma, size):
    kernel = image.dog_kernel(sigma)
    assert kernel.shape == (size, size)
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 50, (16, 14)).astype(float)
    full = np.zeros((16 + size - 1, 14 + size - 1))
    for i in range(size):
        for j in range(size):
            full[i : i + 16, j : j + 14] += kernel[i, j] * frame
    want = full[size // 2 : size // 2 + 16, size // 2 : size // 2 + 14]
    assert np.allclose(image.convolve_image(frame, kernel), want)
    pixels = spark.createDataFrame([(0, 1, i, j, float(frame[i, j])) for i in range(16) for j in range(14)], "file_id long, frame int, row int, col int, adu double")
    got = {(r.row, r.col): r.filtered for r in image.convolve(pixels, kernel).collect()}
    assert all(math.isclose(got[i, j], want[i, j], abs_tol=1e-9) for i in range(16) for j in range(14))


def test_plateaus_and_empty_images(spark):
    rows = [(0, 1, i, j, 5.0 if (i, j) in ((3, 3), (3, 4)) else 9.0 if (i, j) == (6, 2) else 0.0) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(rows, "file_id long, frame int, row int, col int, adu double")
    assert [(r.row, r.col) for r in image.local_maxima(df, "adu", 1.0).collect()] == [(6, 2)]
    none = df.filter("false")
    assert image.local_maxima(none, "adu", 1.0).count() == image.convolve(none, image.dog_kernel()).count() == image.variance_map(none).count() == 0


def tiff_bytes(frames, order="<"):
    """A file with one strip a row and one page a frame."""
    kind = {np.dtype("u1"): (8, 1), np.dtype("u2"): (16, 1), np.dtype("f4"): (32, 3)}[frames[0].dtype]
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for f in frames:
        at = []
        for row in f:
            at.append(len(out))
            out += row.astype(row.dtype.newbyteorder(order)).tobytes()
        n, size = len(at), f.shape[1] * f.itemsize
        lists = len(out)
        out += struct.pack(f"{order}{n}I", *at) + struct.pack(f"{order}{n}I", *[size] * n)
        tags = [(256, 4, 1, f.shape[1]), (257, 4, 1, f.shape[0]), (258, 3, 1, kind[0]), (259, 3, 1, 1), (273, 4, n, lists if n > 1 else at[0]), (278, 4, 1, 1), (279, 4, n, lists + 4 * n if n > 1 else size), (339, 3, 1, kind[1])]
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, t, count, value in tags:
            out += struct.pack(order + "HHI", tag, t, count) + (struct.pack(order + "HH", value, 0) if t == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def test_movies_of_all_kinds_masks_and_broken_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = {}
    for name, kind, order in (("a", "u1", "<"), ("b", "u2", ">"), ("c", "f4", "<")):
        made[name] = [(rng.random((5, 7)) * 200).astype(kind) for _ in range(3)]
        (tmp_path / f"{name}.tif").write_bytes(tiff_bytes(made[name], order))
    (tmp_path / "a_mask.tif").write_bytes(tiff_bytes([np.ones((5, 7), "u1")]))
    (tmp_path / "b_mask.tiff").write_bytes(tiff_bytes([np.ones((5, 8), "u1")]))  # another size
    (tmp_path / "broken.tif").write_bytes(b"II*\0\xff\xff\xff\x7f")
    (tmp_path / "text.tif").write_bytes(b"no image")
    found = tiff.files(spark, str(tmp_path))
    meta = {r.path.rsplit("/", 1)[1]: r for r in tiff.read_metadata(found).collect()}
    assert (meta["b.tif"].width, meta["b.tif"].height, meta["b.tif"].bits, meta["b.tif"].n_frames) == (7, 5, 16, 3) and meta["c.tif"].is_float
    assert meta["broken.tif"].status != "ok" and meta["text.tif"].status == "not a TIFF file"
    assert sorted(r.path[-5:] for r in tiff.movies(tiff.read_metadata(found)).collect()) == ["a.tif", "b.tif", "c.tif"]
    for r in tiff.read_frames(found).collect():
        name = r.path.rsplit("/", 1)[1].removesuffix(".tif")
        if name in made:
            assert np.allclose(np.array(r.pixels).reshape(r.height, r.width), made[name][r.frame - 1].astype("f4"))
    assert tiff.read_frames(found, only=2).count() == 3
    masks = {r.path.rsplit("/", 1)[1]: r.mask_path and r.mask_path.rsplit("/", 1)[1] for r in tiff.masks_of(tiff.read_metadata(found)).collect()}
    assert masks == {"a.tif": "a_mask.tif", "b.tif": None, "c.tif": None}


def wide_tiff(path, frames, order, strip_at):
    """A file with 64-bit offsets whose strips lie at given places, most of it a hole."""
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ", 43, 8, 0, 16))
        at = 16
        for k, (image, place) in enumerate(zip(frames, strip_at)):
            tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, image.itemsize * 8), (259, 3, 1), (273, 16, place), (279, 16, image.nbytes), (339, 3, 3 if image.dtype.kind == "f" else 1)]
            f.seek(at)
            f.write(struct.pack(order + "Q", len(tags)))
            for tag, kind, value in tags:
                f.write(struct.pack(order + "HHQ", tag, kind, 1) + struct.pack(order + {3: "H6x", 4: "I4x", 16: "Q"}[kind], value))
            after = at + 8 + 20 * len(tags) + 8
            f.write(struct.pack(order + "Q", after if k + 1 < len(frames) else 0))
            at = after
            f.seek(place)
            f.write(image.astype(image.dtype.newbyteorder(order)).tobytes())


@pytest.mark.parametrize("order", ["<", ">"])
def test_movies_beyond_what_a_row_can_hold(spark, tmp_path, order, monkeypatch):
    """The frames of a movie of 5 GB are read by their offsets, also where the file ends within one."""
    rng = np.random.default_rng(6)
    frames = [(rng.random((4, 6)) * 60_000).astype("u2") for _ in range(4)]
    wide_tiff(tmp_path / "long.tif", frames, order, [4_000, 2_500_000_000, 3_000_000_000, 5_000_000_000])
    wide_tiff(tmp_path / "cut.tif", frames[:2], order, [4_000, 5_000])
    with open(tmp_path / "cut.tif", "r+b") as f:
        f.truncate(5_010)
    found = tiff.files(spark, str(tmp_path))
    meta = {r.path.rsplit("/", 1)[1]: r for r in tiff.read_metadata(found).collect()}
    assert (meta["long.tif"].n_frames, meta["long.tif"].width, meta["long.tif"].bits, meta["long.tif"].status) == (4, 6, 16, "ok")
    got = {(r.path.rsplit("/", 1)[1], r.frame): r for r in tiff.read_frames(found).collect()}
    assert sorted(got) == [("cut.tif", 1), *[("long.tif", k) for k in range(1, 5)]]
    assert all(np.array_equal(np.array(got["long.tif", k].pixels).reshape(4, 6), frames[k - 1]) for k in range(1, 5))
    assert tiff.frames_at(tiff.read_pages(found)).rdd.getNumPartitions() >= 1
    assert tiff.read_frames(found.filter("false")).count() == 0


def test_files_of_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(tiff_bytes([np.full((3, 4), k, "u1") for k in (1, 2)]))
    found = tiff.files(spark, str(tmp_path))
    want = [tuple(r) for r in tiff.read_frames(found).collect()]
    monkeypatch.setattr(tiff, "STORES", ("none",))
    assert [tuple(r) for r in tiff.read_frames(found).collect()] == want and len(want) == 2
    assert tiff.read_metadata(found).first().n_frames == 2


def test_text_files_and_parameters(spark, tmp_path):
    tracks = spark.createDataFrame([(0, 7, 1, 1.0, 2.0), (0, 9, 1, 3.0, 4.0), (1, 4, 2, 5.0, 6.0)], TRACKS)
    reports.write_text(reports.track_text(tracks), f"{tmp_path}/tracks")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tracks")
    assert sorted((r.file_id, r.trackID, r.posX_nm) for r in back.collect()) == [(0, "1", "1.0"), (0, "2", "3.0"), (1, "1", "5.0")]
    table = parameters.parameter_table(spark)
    assert parameters.changed(table, table).count() == 0 and ("tracking limits N lower", "3.0") in {tuple(r) for r in table.collect()}
    sheet = reports.population_sheet(spark.createDataFrame([(0, -3.0, 0.1, -1.0, 0.1, 0.4, 0)], "file_id long, mu1 double, sigma1 double, mu2 double, sigma2 double, fraction1 double, error_code int"), spark.createDataFrame([(0, -3.0), (0, -2.0), (0, -1.0)], "file_id long, log_d double")).first()
    assert round(sheet.slow_by_split, 9) == round(2 / 3, 9) and round(sheet.d_slow, 9) == 0.001 and sheet.slow_by_fit == 0.4


def test_peaks_with_plateaus_ties_and_nulls(spark):
    series = {0: [1, 3, 3, 2, 5, 5, 4, 9], 1: [0, 2, 0, 2, 0, None, 1, 0], 2: [1, 1, 1], 3: [4, 1, 4], 4: [0, 10, 0, 1, 0]}
    rows = [(f, i, None if v is None else float(v), 1) for f, y in series.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "file_id long, i int, y double, rank int")
    got = sorted((r.file_id, r.rank, r.i, r.y) for r in fits.find_peaks(df).collect())
    assert got == [(0, 1, 4, 5.0), (0, 2, 1, 3.0), (1, 1, 1, 2.0), (1, 2, 3, 2.0), (4, 1, 1, 10.0), (4, 2, 3, 1.0)]
    assert [r.i for r in fits.find_peaks(df.filter("file_id = 4"), share=0.2).collect()] == [1]
    assert fits.find_peaks(df.filter("false")).count() == 0


def test_smoothing_of_arrays_and_the_start_at_the_steepest_places(spark):
    rng = np.random.default_rng(3)
    y = rng.random(12)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "file_id long, i int, y double")
    want = [r.smooth for r in fits.smooth(df).orderBy("i").collect()]
    assert np.allclose(fits.smoothed(y), want)
    x = np.concatenate([rng.normal(-3, 0.2, 5000), rng.normal(-1, 0.2, 3000)])
    at, n = np.unique(np.round(x / fits.FINE) * fits.FINE, return_counts=True)
    mu, var, share = fits.steepest_start(at, n.astype(float))
    assert len(mu) == 2 and share.sum() == pytest.approx(1) and (var == 0.1).all() and ((mu > -3.6) & (mu < -0.4)).all()
    assert fits.steepest_start(np.array([1.0, 1.001]), np.ones(2)) is None
    assert fits.mixture(at, n.astype(float), mu, var, share) is not None


def test_the_last_start_is_used_where_the_others_fail(monkeypatch):
    x = np.arange(40) / 10
    tried, real = [], fits.mixture

    def failing(x, n, mu, var, share, *more):
        tried.append(mu)
        return None if len(tried) <= 6 else real(x, n, mu, var, share, *more)

    monkeypatch.setattr(fits, "mixture", failing)
    monkeypatch.setattr(fits, "steepest_start", lambda x, n: (np.array([1.0, 3.0]), np.full(2, 0.1), np.full(2, 0.5)))
    found = fits.fit_two(x, np.ones(40))
    assert len(tried) == 7 and tried[-1].tolist() == [1.0, 3.0] and found[5] in (0, 1) and found[0] < found[2]


def test_automatic_bins_cover_their_values(spark):
    rng = np.random.default_rng(8)
    rows = [(f, float(v), 3) for f, values in ((0, rng.normal(0, 1, 300)), (1, rng.uniform(1e5, 9e5, 200)), (2, [4.25, 4.25]), (3, [-1e-5, 1e-5]), (4, [0.0, 50.0])) for v in values]
    df = spark.createDataFrame([*rows, (0, None, 3), (0, float("nan"), 3), (1, float("inf"), 3)], "file_id long, v double, low int")
    df = df.drop("low")
    edges = {r.file_id: (r.low, r.width) for r in fits.auto_edges(df, "v", 50).collect()}
    for f, (low, width) in edges.items():
        own = np.array([r[1] for r in rows if r[0] == f])
        assert low <= own.min() and own.max() <= low + 50 * width * (1 + 1e-12)
        assert width <= max(1.0, 1.2 * np.ptp(own) / 50) if f == 2 else width <= 1.2 * np.ptp(own) / 50
    assert edges[2][1] == 1.0
    got = fits.auto_histogram(df, "v", 50).collect()
    for f in range(5):
        own = [r for r in sorted(got, key=lambda r: r.bin) if r.file_id == f]
        assert len(own) == 50 and sum(r.n for r in own) == len([r for r in rows if r[0] == f])
        assert np.allclose([r.centre for r in own], edges[f][0] + edges[f][1] * (np.arange(50) + 0.5))
    assert fits.auto_histogram(df.filter("false"), "v", 50).count() == 0


def test_frames_from_pixels_that_are_missing_repeated_or_outside(spark):
    rows = [(0, 1, 0, 0, 5.0), (0, 1, 0, 0, 7.0), (0, 1, 1, 2, None), (0, 1, 1, 1, -3.0), (0, 1, 9, 9, 4.0), (0, 2, 7, 7, 1.0), (1, 1, 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "file_id long, frame int, row int, col int, adu double")
    got = {(r.file_id, r.frame): list(r.pixels) for r in image.to_frames(df, 2, 3).collect()}
    assert got == {(0, 1): [7, 0, 0, 0, -3, 0], (0, 2): [0] * 6, (1, 1): [0, 0, 0, 2, 0, 0]}
    assert image.to_frames(df.filter("false"), 2, 3).count() == 0
    large = spark.range(512 * 512).selectExpr("0L AS file_id", "1 AS frame", "CAST(id / 512 AS int) AS row", "CAST(id % 512 AS int) AS col", "CAST(id AS double) AS adu")
    r = image.to_frames(large, 512, 512).first()
    assert r.pixels[1000] == 1000.0 and len(r.pixels) == 512 * 512


def test_windows_of_variance_follow_the_camera(spark):
    rng = np.random.default_rng(1)
    frame = rng.random((16, 16)) * 2
    frame[6:9, 7:10] += [[20, 40, 20], [40, 90, 40], [20, 40, 20]]
    pixels = [float(v) for v in frame.ravel()]
    frames = spark.createDataFrame([(f, 1, 16, 16, pixels) for f in (0, 1, 2)], image.FRAME_SCHEMA)
    maps = spark.createDataFrame([(7, i, j, float(100 * i + j)) for i in range(16) for j in range(16)] + [(8, 0, 0, 1.0)], "noise_id long, row int, col int, variance double")
    routes = spark.createDataFrame([(0, 7), (1, 8), (2, 99)], "file_id long, noise_id long")
    noisy = image.with_variance_frames(frames, routes, image.variance_frames(maps, 16, 16))
    got = {r.file_id: r for r in image.detect(noisy, 1.3, 6.0, 5).collect()}
    assert sorted(got) == [0, 1, 2]
    r = got[0]
    want = [100 * i + j for i in range(r.y - 3, r.y + 2) for j in range(r.x - 3, r.x + 2)]
    assert list(r.roi_variance) == want and set(got[1].roi_variance) == {0.0} and set(got[2].roi_variance) == {0.0}
    assert "roi_variance" not in image.detect(frames, 1.3, 6.0, 5).columns
    from spotflow.operators import psf

    assert psf.fit_psf(image.detect(noisy, 1.3, 6.0, 5), variance="roi_variance").filter("is_fit").count() == 3
