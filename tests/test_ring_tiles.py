"""Rings that go on in other tiles against plain Python, and what rings within a tile write."""

import numpy as np

from spotflow.operators import rings

MASK = "file_id long, row long, col long, inside boolean"


def plain(inside):
    """Rings of a set of (row, column): is_hole and corners in order, from each one's lowest edge on, in the order of those."""
    start = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 0)}
    step = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}
    beside = {0: (-1, 0), 1: (0, 1), 2: (1, 0), 3: (0, -1)}
    edges = {}
    for r, c in inside:
        for d in range(4):
            if (r + beside[d][0], c + beside[d][1]) not in inside:
                edges.setdefault((r + start[d][0], c + start[d][1]), set()).add(d)
    left, out = {(y, x, d) for (y, x), ds in edges.items() for d in ds}, []
    for first in sorted(left):
        if first in left:
            walk, at = [], first
            while at in left:
                left.remove(at)
                walk.append(at)
                y, x, d = at[0] + step[at[2]][0], at[1] + step[at[2]][1], at[2]
                at = (y, x, next(t % 4 for t in (d + 3, d, d + 1) if t % 4 in edges[y, x]))
            assert at == first
            twice = sum(x * (y + step[d][0]) - (x + step[d][1]) * y for y, x, d in walk)
            out.append((twice < 0, [(x, y) for i, (y, x, d) in enumerate(walk) if walk[i - 1][2] != d]))
    return out


def spiral(n):
    """A path one pixel wide from the border of an n by n image inwards, with a gap of one."""
    m, (y, x), (dy, dx) = np.zeros((n, n), bool), (0, 0), (0, 1)
    m[0, 0] = True
    free = lambda y, x: not (0 <= y < n and 0 <= x < n and m[y, x])
    for _ in range(2 * n):
        while 0 <= y + dy < n and 0 <= x + dx < n and free(y + 2 * dy, x + 2 * dx):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
    return m


def test_rings_across_tiles_equal_plain_walks(spark):
    rng = np.random.default_rng(8)
    side = 2 * rings.TILE + 20
    images = {0: {(i - 5, j - 7) for i, j in np.argwhere(rng.random((side, side - 30)) < 0.6).tolist()}, 1: {(i, j) for i, j in np.argwhere(spiral(side)[:, ::-1]).tolist()}}
    images[2] = {(i + 10**6, j) for i, j in np.argwhere(np.pad(np.zeros((side, side), bool), 2, constant_values=True)).tolist()}
    images[3] = {(rings.TILE - 1, rings.TILE - 1), (rings.TILE, rings.TILE), (rings.TILE, rings.TILE - 2), (rings.TILE - 1, -1), (0, 0)}  # corners of tiles
    rows = [(f, i, j, True) for f, cells in images.items() for i, j in cells]
    rows += rows[:2000] + [(0, None, 1, True), (None, 1, 1, True), (3, 1, None, True), (3, 500, 500, None)]
    got = {}
    for r in rings.mask_rings(spark.createDataFrame(rows, MASK).repartition(7)).orderBy("file_id", "poly_id", "ord").collect():
        is_hole, corners = got.setdefault(r.file_id, {}).setdefault(r.poly_id, (r.is_hole, []))
        corners.append((r.x, r.y))
        assert is_hole == r.is_hole and r.ord == len(corners)
    assert got.keys() == images.keys()
    for f, cells in images.items():
        assert list(got[f].values()) == plain(cells) and list(got[f]) == list(range(1, len(got[f]) + 1))


def test_rings_within_a_tile_write_rows_a_ring(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f, int(i), int(j), True) for f in range(6) for i, j in np.argwhere(rng.random((32, 32)) < 0.5)]
    mask, sizes, write = spark.createDataFrame(rows, MASK), {}, rings.materialize

    def counting(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(rings, "materialize", counting)
    n = rings.mask_rings(mask).select("file_id", "poly_id").distinct().count()
    assert sizes and max(sizes.values()) <= n
