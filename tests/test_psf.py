"""Spots with known positions, in windows of two sizes, with broken windows among them."""

import numpy as np

from spotflow.operators import localize, psf


def spot(x, y, n, b, s, size):
    return psf._model(np.array([[x, y, n, b, s]]), size)[0][0]


def test_known_spots(spark):
    rng = np.random.default_rng(3)
    true = [(i, rng.uniform(2.5, 3.5), rng.uniform(2.5, 3.5), rng.uniform(500, 3000), rng.uniform(1, 5), rng.uniform(1.0, 1.6), 7 if i % 2 else 9) for i in range(40)]
    rows = [(i, rng.poisson(spot(*p[:5], p[5])).astype(float).tolist()) for i, *p in true]
    rows += [(100, None), (101, [1.0, 2.0, 3.0]), (102, [float("nan")] * 49), (103, [0.0] * 49)]
    got = {r.i: r for r in psf.fit_psf(spark.createDataFrame(rows, "i int, roi array<float>")).collect()}
    far = []
    for i, x, y, n, b, s, _ in true:
        r = got[i]
        assert r.is_fit and abs(r.sigma - s) < 0.3 and abs(r.photons - n) < 0.2 * n + 150
        far += [(r.fit_x - x) / r.crlb_x**0.5, (r.fit_y - y) / r.crlb_y**0.5]
    assert 0.6 < np.std(far) < 1.5  # as precise as can be
    assert not any(got[i].is_fit for i in (100, 101, 102))
    nm = localize.pixels_to_nm(psf.fit_psf(spark.createDataFrame([(0, 1, 10, 20, rows[1][1])], "file_id long, frame int, x int, y int, roi array<float>")), 100.0, 7).first()
    assert abs(nm.x_nm - (true[1][1] - 3 + 10) * 100) < 30 and abs(nm.y_nm - (true[1][2] - 3 + 20) * 100) < 30


def test_derivatives_equal_differences():
    p = np.array([[3.2, 2.7, 900.0, 4.0, 1.3]])
    _, grad = psf._model(p, 7)
    for k in range(5):
        step = np.zeros((1, 5))
        step[0, k] = 1e-5
        assert np.allclose(grad[0, k], (psf._model(p + step, 7)[0] - psf._model(p - step, 7)[0])[0] / 2e-5, atol=1e-4)
