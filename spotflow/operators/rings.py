"""Masks from images by Otsu's threshold, the rings around them, and polygons cut by convex cells.

Masks are cut into tiles of TILE by TILE pixels with a margin of one. A task walks along the pixel edges of its tiles; rings within
a tile are whole, others are pieces that name the edge they go on to. Rings across tiles are the components of that
relation, and a piece's place in its ring follows by pointer doubling, so that a ring of any length is put in
order by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spotflow.operators.blocks import spread
from spotflow.operators.components import connected_components
from spotflow.operators.ordered import ordinals
from spotflow.session import materialize

#: Grey levels of an image's histogram.
LEVELS = 256
#: Pixels along a side of a tile, and the steps of the directions 0 right, 1 up, 2 left, 3 down; a pixel lies to the left of each of its edges.
TILE, STEP = 128, ((1, 0), (0, 1), (-1, 0), (0, -1))
#: A walk along edges within a tile: where it begins, its lowest edge, the edge in another tile it goes on to (null: the ring is whole), number of
#: corners, twice its share of the area, corners before the lowest edge, and the corners.
PIECE = ", ".join(["file_id long", *[f"{e}_{v} long" for e in ("head", "low", "to") for v in "yxd"], "n long, twice long, low_at long, xs array<long>, ys array<long>"])


def grey_levels(pixels: DataFrame, value: str = "adu") -> DataFrame:
    """pixels with `level`: the value on a scale from 0, the least of the file, to LEVELS - 1, the greatest, rounded;
    null where the value is null or the file has one value only."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    ends = pixels.groupBy("file_id").agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    return pixels.join(ends, "file_id").withColumn("level", F.floor((v - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * (LEVELS - 1) + 0.5)).drop("_low", "_high")


def otsu(pixels: DataFrame, value: str = "adu") -> DataFrame:
    """file_id and threshold: the level of grey_levels that splits the file's histogram into two classes, up to it and beyond,
    with the greatest variance between them; the mean of such levels if there are several."""
    counts = grey_levels(pixels, value).filter("level IS NOT NULL").groupBy("file_id", "level").agg(F.count("*").alias("n"))  # LEVELS rows a file at most
    upto = Window.partitionBy("file_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file_id")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LEVELS - 1).cast("long"))).alias("level")
    filled = counts.select("file_id").distinct().select("file_id", every).join(counts, ["file_id", "level"], "left").na.fill({"n": 0})
    rows = filled.select("file_id", "level", F.sum("n").over(upto).alias("w"), F.sum(F.col("level") * F.col("n")).over(upto).alias("m"), F.sum("n").over(whole).alias("all"), F.sum(F.col("level") * F.col("n")).over(whole).alias("total"))
    apart = F.pow(F.col("total") * F.col("w") - F.col("m") * F.col("all"), 2) / (F.col("w") * F.nullif(F.col("all") - F.col("w"), F.lit(0)))
    rows = rows.withColumn("between", apart).withColumn("best", F.max("between").over(whole))
    return rows.filter("between = best").groupBy("file_id").agg(F.avg("level").alias("threshold"))


def otsu_mask(pixels: DataFrame, value: str = "adu") -> DataFrame:
    """file_id, row, col and inside of one-frame images: a level beyond the file's Otsu threshold. A file of one value
    is outside everywhere."""
    rows = grey_levels(pixels, value).join(otsu(pixels, value), "file_id", "left")
    return rows.select("file_id", "row", "col", F.coalesce(F.col("level") > F.col("threshold"), F.lit(False)).alias("inside"))


def _paths(f: np.ndarray, ty: np.ndarray, tx: np.ndarray, r: np.ndarray, c: np.ndarray) -> pa.Table:
    """PIECE rows of whole tiles (file, tile row and column; sorted by them) from the rows and columns of their inside pixels, those of the
    margin of one pixel included."""
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])])
    tile, first, wide = np.cumsum(new) - 1, np.flatnonzero(new), TILE + 2
    keys = np.unique((tile * wide + r - ty * TILE + 1) * wide + c - tx * TILE + 1)
    of, y, x = keys // (wide * wide), keys // wide % wide, keys % wide
    own = (y >= 1) & (y <= TILE) & (x >= 1) & (x <= TILE)
    row, col = y - 1 + (ty[first] * TILE)[of], x - 1 + (tx[first] * TILE)[of]

    def beside(k: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """Where the pixels beside the pixels k are; -1 outside the mask."""
        want = keys[k] + dy * wide + dx
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, at, -1)

    found = []
    for d, (dx, dy) in enumerate(STEP):
        k = np.flatnonzero(own)
        k = k[beside(k, dy, -dx) < 0]
        left, right, turn = beside(k, dx, dy), beside(k, dx + dy, dy - dx), np.full(len(k), d)
        # where pixels touch in a corner, the turn to the right leads around both
        after = np.where(right >= 0, right, np.where(left >= 0, left, k)), (np.where(right >= 0, d + 3, np.where(left >= 0, d, d + 1))) % 4
        left, right = beside(k, -dx, -dy), beside(k, dy - dx, -dx - dy)
        before = np.where(right >= 0, right, np.where(left >= 0, left, k)), (np.where(right >= 0, d + 1, np.where(left >= 0, d, d + 3))) % 4
        found.append((k, turn, *after, *before))
    k, d, k2, d2, k0, d0 = (np.concatenate(v) for v in zip(*found))
    corner = lambda k, d: (row[k] + (d >= 2), col[k] + ((d == 1) | (d == 2)))  # noqa: E731  where an edge begins
    place = lambda k, d: ((of[k] * (wide + 1) + y[k] + (d >= 2)) * (wide + 1) + x[k] + ((d == 1) | (d == 2))) * 4 + d
    order = np.argsort(place(k, d))
    k, d, k2, d2, k0, d0 = (v[order] for v in (k, d, k2, d2, k0, d0))
    at = place(k, d)
    follow = np.where(own[k2], np.searchsorted(at, place(k2, d2)), -1).tolist()
    seen, walk, starts = bytearray(len(k)), [], []
    for e in (*np.flatnonzero(~own[k0]).tolist(), *range(len(k))):
        if not seen[e]:
            starts.append(len(walk))
            while e >= 0 and not seen[e]:
                seen[e] = 1
                walk.append(e)
                e = follow[e]
    walk, starts = np.array(walk, np.int64), np.array(starts, np.int64)
    ends = np.append(starts, len(walk))[1:]
    (ys, xs), turns = corner(k[walk], d[walk]), (d0 != d)[walk]
    dx, dy = np.array(STEP)[d[walk]].T
    upto = np.concatenate([[0], np.cumsum(turns)])
    n, sums = upto[ends] - upto[starts], np.concatenate([[0], np.cumsum(xs * (ys + dy) - (xs + dx) * ys)])
    lows = np.minimum.reduceat(walk, starts) if len(starts) else starts
    where = np.empty(len(k), np.int64)
    where[walk] = np.arange(len(walk))
    head, last = walk[starts], walk[ends - 1]
    out = {"file_id": f[first][of[k[head]]]}
    for name, (a, b) in {"head": (k[head], d[head]), "low": (k[lows], d[lows]), "to": (k2[last], d2[last])}.items():
        gone = own[a] if name == "to" else np.zeros(len(a), bool)
        out |= {f"{name}_{v}": pa.array(w, pa.int64(), mask=gone) for v, w in zip("yxd", (*corner(a, b), b))}
    bounds = pa.array(np.append(0, np.cumsum(n)), pa.int32())
    lists = {v: pa.ListArray.from_arrays(bounds, pa.array(w[turns], pa.int64())) for v, w in (("xs", xs), ("ys", ys))}
    return pa.table(out | {"n": n, "twice": sums[ends] - sums[starts], "low_at": upto[where[lows]] - upto[starts]} | lists)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECE rows of pixels (file_id, ty, tx, r, c) sorted by tile, a batch of whole tiles at a time."""
    held = np.zeros((5, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([v.to_numpy(zero_copy_only=False) for v in batch.columns])], axis=1)
        if held.shape[1]:
            n = int(np.argmax((held[:3] == held[:3, -1:]).all(axis=0)))  # where the last tile begins
            if n:
                yield from _paths(*held[:, :n]).to_batches()
            held = np.unique(held[:, n:], axis=1)
    if held.shape[1]:
        yield from _paths(*held).to_batches()


def mask_rings(mask: DataFrame) -> DataFrame:
    """Corners (file_id, poly_id, is_hole, ord, x, y) of the rings around the inside pixels of a mask (file_id, row, col,
    inside), a pixel being the square from (col, row) to (col + 1, row + 1). Pixels that touch in a corner are in one
    ring. Outer rings have the mask on their left with y upwards, holes too, so that they turn the other way round. Corners on a
    straight line are left out. Rings are numbered from 1 in a file by their lowest edge (row, then column)."""
    cells = mask.filter("inside AND file_id IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"))
    # a pixel on the border of a tile is in the margin of its neighbours
    tiles = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: F.floor((F.col(c) + v) / TILE)))
    inner = lambda c: F.pmod(F.col(c), F.lit(TILE)).between(1, TILE - 2)
    own = lambda c: F.floor(F.col(c) / TILE)
    border = cells.filter(~(inner("r") & inner("c"))).withColumn("ty", F.explode(tiles("r"))).withColumn("tx", F.explode(tiles("c")))
    dealt = cells.filter(inner("r") & inner("c")).withColumn("ty", own("r")).withColumn("tx", own("c")).unionByName(border)
    keys = ("file_id", "ty", "tx")
    pieces = spread(dealt.select(*keys, "r", "c"), *keys).sortWithinPartitions(*keys).mapInArrow(_traced, PIECE)
    pieces = materialize(pieces.withColumn("e", F.monotonically_increasing_id()), "pieces")
    low, slim = F.struct("low_y", "low_x", "low_d"), ("e", "file_id", "n", "twice", "low_y", "low_x", "low_d", "low_at")
    # far: corners from the beginning of a piece to that of its ring's first one
    whole = pieces.filter("to_d IS NULL").select(*slim, F.col("e").alias("ring"), F.lit(0).cast("long").alias("far"))
    parts = pieces.filter("to_d IS NOT NULL")
    if not parts.isEmpty():
        whole = whole.unionByName(_chained(parts, slim))
    whole = materialize(whole, "ringed")
    rings = whole.groupBy("file_id", "ring").agg(F.min(low).alias("_low"), F.sum("n").alias("_all"), (F.sum("twice") < 0).alias("is_hole"), F.min_by("low_at", low).alias("_first"))
    rings = ordinals(rings.select("file_id", "ring", "_low.*", "_all", "_first", "is_hole"), ["file_id"], ["low_y", "low_x", "low_d"], "poly_id")
    placed = whole.select("e", "file_id", "ring", "far").join(rings, ["file_id", "ring"])
    placed = placed.select("e", "poly_id", "is_hole", "_all", (-F.col("far") - F.col("_first")).alias("_from"))
    rows = pieces.select("e", "file_id", "xs", "ys").join(placed, "e").select("file_id", "poly_id", "is_hole", "_all", "_from", F.posexplode(F.arrays_zip("xs", "ys")).alias("k", "v"))
    order = (F.pmod(F.col("_from") + F.col("k"), F.col("_all")) + 1).cast("int")
    return rows.select("file_id", "poly_id", "is_hole", order.alias("ord"), F.col("v.xs").cast("double").alias("x"), F.col("v.ys").cast("double").alias("y"))


def _chained(parts: DataFrame, slim: tuple[str, ...]) -> DataFrame:
    """The columns slim of pieces that go on in other tiles with their ring, its component, and far."""
    heads = parts.select("file_id", F.col("head_y").alias("to_y"), F.col("head_x").alias("to_x"), F.col("head_d").alias("to_d"), F.col("e").alias("next"))
    steps = materialize(parts.select(*slim, "to_y", "to_x", "to_d").join(heads, ["file_id", "to_y", "to_x", "to_d"]).select(*slim, "next"), "steps")
    of = connected_components(steps, "e", "next").select(F.col("node").alias("e"), F.col("component").alias("ring"))
    ringed = materialize(steps.join(of, "e"), "chained")
    stop = ringed.groupBy("ring").agg(F.min_by("e", F.struct("low_y", "low_x", "low_d")).alias("e")).select("e", F.lit(True).alias("_stop"))
    ranks = ringed.join(stop, "e", "left").select("e", F.when(F.col("_stop"), F.col("e")).otherwise(F.col("next")).alias("next"), F.when(F.col("_stop"), 0).otherwise(F.col("n")).cast("long").alias("far"), F.coalesce("_stop", F.lit(False)).alias("done"))
    ranks = materialize(ranks, "ranks")
    # doubled each round until every piece has come to the first one
    while not ranks.filter("NOT done").isEmpty():
        ahead = ranks.select(F.col("e").alias("next"), F.col("next").alias("over"), F.col("far").alias("more"), F.col("done").alias("end"))
        ranks = materialize(ranks.join(ahead, "next").select("e", F.col("over").alias("next"), (F.col("far") + F.col("more")).alias("far"), F.col("end").alias("done")), "ranks")
    return ringed.select(*slim, "ring").join(ranks.select("e", "far"), "e")


Ring = list[tuple[float, float]]


def clip(ring: Ring, cell: Ring) -> Ring:
    """The part of a ring inside a convex cell against the clock. Parts that lie apart are joined along the cell's
    border, which adds no area."""
    for (ax, ay), (bx, by) in zip(cell, cell[1:] + cell[:1]):
        if not ring:
            break
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ring]
        out: Ring = []
        for k, ((px, py), s) in enumerate(zip(ring, side)):
            (qx, qy), t = ring[(k + 1) % len(ring)], side[(k + 1) % len(ring)]
            if s >= 0:
                out.append((px, py))
            if (s > 0 > t) or (s < 0 < t):
                u = s / (s - t)
                out.append((px + u * (qx - px), py + u * (qy - py)))
        ring = out
    return ring


def inside_convex(x: float, y: float, ring: Ring, slack: float) -> bool:
    """In a convex ring against the clock or nearer to it than slack."""
    return all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -slack * max(abs(bx - ax), abs(by - ay)) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))


def in_ring(x: float, y: float, ring: Ring) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def trimmed(cells: DataFrame, rings: DataFrame, how: str = "intersect") -> DataFrame:
    """file_id, point_id, area, corners and is_cut of cells (file_id, point_id, corners, area, is_open; of voronoi_cells with a
    wide margin) within a ring of their file (file_id, ord, x, y, either way round): open cells are left out; cells with a
    corner outside the ring are left out too (how = remove) or cut by it (intersect). Cells without a common
    area go; files without a ring have no cells."""
    packed = rings.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("_r"))
    packed = packed.select(F.col("file_id").cast("long").alias("file_id"), F.transform("_r", lambda v: v["x"]).alias("rx"), F.transform("_r", lambda v: v["y"]).alias("ry"))
    rows = cells.filter("NOT is_open").select("file_id", "point_id", F.transform("corners", lambda v: v["x"]).alias("cx"), F.transform("corners", lambda v: v["y"]).alias("cy")).join(packed, "file_id")
    names = ["file_id", "point_id", "area", "corners", "is_cut"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), pa.bool_()]

    def twice(ring: Ring) -> float:
        x, y = ring[0] if ring else (0.0, 0.0)
        return sum((ax - x) * (by - y) - (bx - x) * (ay - y) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ring, cell = list(zip(r["rx"], r["ry"])), list(zip(r["cx"], r["cy"]))
                ring = ring if twice(ring) > 0 else ring[::-1]
                convex = all((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) >= 0 for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]))
                within = (lambda x, y: inside_convex(x, y, ring, 1e-9)) if convex else (lambda x, y: in_ring(x, y, ring))
                whole = all(within(x, y) for x, y in cell)
                if not whole and how == "remove":
                    continue
                # a ring with a dent may cut a cell whose corners are all inside
                found = cell if whole and convex else clip(ring, cell)
                area = abs(twice(found)) / 2
                if area > 0:
                    cut = not whole or area < abs(twice(cell)) / 2 * (1 - 1e-9)
                    out.append((r["file_id"], r["point_id"], area, [{"x": x, "y": y} for x, y in found], cut))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "file_id long, point_id long, area double, corners array<struct<x:double,y:double>>, is_cut boolean")


def limit_rings(limits: DataFrame) -> DataFrame:
    """Rings (file_id, ord, x, y) of rectangles (file_id, x0, x1, y0, y1)."""
    corners = F.array(*[F.struct(F.lit(i).alias("ord"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")), 1)])
    return limits.select("file_id", F.explode(corners).alias("p")).select("file_id", "p.*")
