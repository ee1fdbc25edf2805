"""Voronoi cells, who touches whom, and clusters of small or dense cells.

A cell is the file's bounding box cut by the bisectors to other points, nearest first, until no point that is
left can cut it. Points are dealt into blocks of equal size wherever they lie. A cell is cut by the points of its own
block, and then asks the blocks around for points nearer to one of its corners than its own point: first those
within twice the distance to a near neighbour, then GROW times as far each time, until nothing beyond can cut it. So
no task ever holds the points of a file, and dense and empty regions cost the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotflow.operators.blocks import SIZE, blocks_of, box_distance, dealt, spread
from spotflow.operators.components import connected_components
from spotflow.operators.ordered import ordinals
from spotflow.operators.spatial import finite_points, first_rank_density
from spotflow.session import materialize

#: The neighbour in a point's own block whose distance sets how far its cell looks first, and how much farther the next time.
NEAR, GROW = 16, 6.0
#: Points of a block, to twice as many.
IN_BLOCK = SIZE
#: A corner on the box has no neighbour behind the edge that begins in it.
BOX = -1
CELL = "file_id long, node long, x double, y double, cx array<double>, cy array<double>, owner array<long>, block long, near double, across double, reach double"

Corner = tuple[float, float, int]  # and the node behind the edge that begins in it


def cut(cell: list[Corner], p: tuple[float, float], q: tuple[float, float], node: int) -> list[Corner]:
    """The part of a convex cell that is nearer to p than to q."""
    nx, ny = q[0] - p[0], q[1] - p[1]
    level = (nx * (p[0] + q[0]) + ny * (p[1] + q[1])) / 2
    side = [nx * x + ny * y - level for x, y, _ in cell]
    if max(side) <= 0:
        return cell
    out: list[Corner] = []
    for k, (x, y, owner) in enumerate(cell):
        s, (ex, ey, _), e = side[k], cell[(k + 1) % len(cell)], side[(k + 1) % len(cell)]
        if s <= 0:
            out.append((x, y, owner))
        if (s < 0 < e) or (e < 0 < s):
            t = s / (s - e)
            out.append((x + t * (ex - x), y + t * (ey - y), node if s < 0 else owner))
        elif s == 0 and e > 0:
            out[-1] = (x, y, node)
    return out


def radius(cell: list[Corner], p: tuple[float, float]) -> float:
    return max(math.hypot(x - p[0], y - p[1]) for x, y, _ in cell)


def cut_by(cell: list[Corner], p: tuple[float, float], others: np.ndarray, nodes: np.ndarray) -> list[Corner]:
    """The cell cut by all others, nearest first."""
    d = np.hypot(others[:, 0] - p[0], others[:, 1] - p[1])
    far = radius(cell, p)
    for k in np.argsort(d, kind="stable").tolist():
        if d[k] > 2 * far:
            break
        if d[k] > 0:
            new = cut(cell, p, (float(others[k, 0]), float(others[k, 1])), int(nodes[k]))
            if new is not cell:
                cell, far = new, radius(new, p)
    return cell


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in CELL.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))})


def _columns(cell: list[Corner]) -> tuple[list, list, list]:
    return [c[0] for c in cell], [c[1] for c in cell], [c[2] for c in cell]


def _of_block(own: pa.Table) -> pa.Table:
    """Cells of the points of a block, cut by each other; near is the distance to the NEAR-th of them. With
    no other block in the file they are done."""
    x, y, nodes = (own.column(c).to_numpy() for c in ("x", "y", "node"))
    at, rows = np.column_stack([x, y]), []
    edges = own.slice(0, 1).select(["x0", "x1", "y0", "y1", "across"]).to_pylist()[0]
    box = [(edges["x0"], edges["y0"], BOX), (edges["x1"], edges["y0"], BOX), (edges["x1"], edges["y1"], BOX), (edges["x0"], edges["y1"], BOX)]
    k = min(NEAR, len(x) - 1)
    reach = math.inf if own.column("blocks")[0].as_py() == 1 else 0.0
    for file_id, block, node, p in zip(own.column("file_id").to_pylist(), own.column("block").to_pylist(), nodes.tolist(), zip(x.tolist(), y.tolist())):
        near = float(np.partition(np.hypot(x - p[0], y - p[1]), k)[k])
        rows.append((file_id, node, *p, *_columns(cut_by(box, p, at, nodes)), block, near, edges["across"], reach))
    return _table(rows)


def _cutters(asks: pa.Table, own: pa.Table) -> pa.Table:
    """node, q, qx and qy of the points of a block that are behind an edge of a cell after it is cut by the block."""
    nodes, at = own.column("node").to_numpy(), np.column_stack([own.column("x").to_numpy(), own.column("y").to_numpy()])
    place = {n: i for i, n in enumerate(nodes.tolist())}
    found: list[tuple[int, int, int]] = []
    for r in asks.to_pylist():
        p = (r["x"], r["y"])
        cell = cut_by(list(zip(r["cx"], r["cy"], [BOX] * len(r["cx"]))), p, at, nodes)
        found += [(r["node"], q, place[q]) for q in {c[2] for c in cell} - {BOX}]
    k = np.array([f[2] for f in found], dtype=np.int64)
    return pa.table({"node": pa.array([f[0] for f in found], pa.int64()), "q": pa.array([f[1] for f in found], pa.int64()), "qx": at[k, 0] if found else np.zeros(0), "qy": at[k, 1] if found else np.zeros(0)})


def _more_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            p, cell = (r["x"], r["y"]), list(zip(r["cx"], r["cy"], r["owner"]))
            others = np.array([(q["qx"], q["qy"]) for q in r["by"]])
            cell = cut_by(cell, p, others, np.array([q["q"] for q in r["by"]]))
            rows.append((r["file_id"], r["node"], *p, *_columns(cell), r["block"], r["near"], r["across"], r["reach"]))
        yield from _table(rows).to_batches()


def voronoi_cells(points: DataFrame, margin: float = 0.0) -> DataFrame:
    """file_id, point_id, x, y, area, corners (array of x and y), behind (the point_id behind the edge that begins in each
    corner, null for the box), neighbours (the distinct ones) and is_open (the cell ends at the file's bounding box) of every distinct position; equal positions are one, named by
    the smallest point_id. Points without coordinates have no cell, nor has a file whose points lie on a line along
    an axis or in one place (its box has no area). The box is wider than the points by `margin` of its longer side."""
    p = finite_points(points).groupBy(F.col("file_id").cast("long").alias("file_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("point_id").alias("point_id"))
    p = materialize(p.withColumn("node", F.monotonically_increasing_id()), "places")
    box = p.groupBy("file_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).filter("x1 > x0 AND y1 > y0")
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * float(margin)
    far_ends = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))  # nothing lies farther apart
    box = box.select("file_id", (F.col("x0") - wide).alias("x0"), (F.col("x1") + wide).alias("x1"), (F.col("y0") - wide).alias("y0"), (F.col("y1") + wide).alias("y1"), far_ends.alias("across"))
    blocks = blocks_of(p.select("file_id", "node", "x", "y").join(box, "file_id"), IN_BLOCK)
    left = materialize(spread(blocks.places, "file_id", "block").groupBy("file_id", "block").applyInArrow(_of_block, CELL), "cells")
    places = blocks.places.select("file_id", "block", "node", "x", "y")
    columns = left.columns
    hypot = lambda v: F.hypot(v["cx"] - F.col("x"), v["cy"] - F.col("y"))
    far = F.array_max(F.transform(F.arrays_zip("cx", "cy"), hypot))
    done, left = left.filter(F.col("reach") == float("inf")), left.filter(F.col("reach") < float("inf"))
    while not left.isEmpty():
        reach = F.when(F.col("reach") == 0, 2 * F.col("near")).otherwise(GROW * F.col("reach"))
        reach = F.when(reach > F.col("across"), 2 * far).otherwise(F.least(2 * far, reach))
        asks = left.select("file_id", "node", "x", "y", "cx", "cy", F.col("block").alias("own"), F.col("reach").alias("seen"), reach.alias("reach"))
        distance = box_distance(F.col("x"), F.col("y"))
        nearer = F.exists(F.arrays_zip("cx", "cy"), lambda v: box_distance(v["cx"], v["cy"]) < hypot(v) * (1 + 1e-9))
        # the distance of a block is asked for again as whether it was within reach before
        found = blocks.meet(asks, lambda: (distance < F.col("reach")) & nearer).filter("block <> own")
        boxes = blocks.levels[0].select("file_id", F.col("node").alias("block"), "x0", "x1", "y0", "y1")
        found = found.join(boxes, ["file_id", "block"]).filter((F.col("seen") == 0) | (distance >= F.col("seen")))
        found = materialize(found.select("file_id", "block", "node", "x", "y", "cx", "cy"), "asks")
        one, other = dealt(found, places)
        keys = ("file_id", "block", "part")
        by = spread(one, *keys).groupBy(*keys).cogroup(spread(other, *keys).groupBy(*keys)).applyInArrow(_cutters, "node long, q long, qx double, qy double")
        by = by.groupBy("node").agg(F.collect_list(F.struct("q", "qx", "qy")).alias("by"))
        rows = materialize(left.withColumn("reach", reach).join(by, "node", "left"), "cutters")
        new = rows.filter("by IS NULL").select(*columns).unionByName(spread(rows.filter("by IS NOT NULL"), "node").mapInArrow(_more_cuts, CELL))
        new = materialize(new, "cells")
        whole = new.filter(2 * far <= F.col("reach"))
        done, left = done.unionByName(whole), new.filter(2 * far > F.col("reach"))
    done = materialize(done, "done")
    names = p.select(F.col("node").alias("other"), F.col("point_id").alias("name"))
    sides = done.select("node", F.posexplode("owner").alias("k", "other")).join(names, "other", "left")
    behind = sides.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda v: v["name"]).alias("behind"))
    corners = F.arrays_zip(F.col("cx").alias("x"), F.col("cy").alias("y"))
    shifted = F.concat(F.slice("cx", 2, F.size("cx") - 1), F.slice("cx", 1, 1)), F.concat(F.slice("cy", 2, F.size("cy") - 1), F.slice("cy", 1, 1))
    cross = F.zip_with(F.arrays_zip("cx", "cy"), F.arrays_zip(shifted[0].alias("nx"), shifted[1].alias("ny")), lambda a, b: (a["cx"] - F.col("x")) * (b["ny"] - F.col("y")) - (b["nx"] - F.col("x")) * (a["cy"] - F.col("y")))
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2
    found = done.select("node", area.alias("area"), corners.alias("corners"), F.array_contains("owner", F.lit(BOX)).alias("is_open"))
    neighbours = F.array_sort(F.array_distinct(F.filter("behind", lambda v: v.isNotNull())))
    return p.join(found, "node").join(behind, "node").select("file_id", "point_id", "x", "y", "area", "corners", "behind", neighbours.alias("neighbours"), "is_open")


def neighbour_edges(cells: DataFrame) -> DataFrame:
    """file_id, p and q (p < q) of cells that share an edge."""
    pairs = cells.select("file_id", F.col("point_id").alias("a"), F.explode("neighbours").alias("b"))
    return pairs.select("file_id", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()


def voronoi_members(cells: DataFrame, threshold: float, method: str = "density", min_n: int = 1, keep_open: bool = False) -> DataFrame:
    """file_id, point_id and cluster of the cells in groups of at least min_n touching cells: those with an area below the
    threshold, or with a normalised first-rank density above it (strictly). Cells that end at the box are left out
    unless keep_open. Clusters are numbered from 1 in a file by their smallest point_id. Cells that touch in one
    corner only are apart."""
    cells = cells if keep_open else cells.filter("NOT is_open")
    cells = materialize(cells.withColumn("node", F.monotonically_increasing_id()), "cells")
    edges = neighbour_edges(cells)
    if method == "density":
        rank = first_rank_density(cells.select("file_id", "point_id", "area"), edges)
        chosen = cells.join(rank.filter(F.col("density") > threshold).select("file_id", "point_id"), ["file_id", "point_id"], "left_semi")
    else:
        chosen = cells.filter(F.col("area") < threshold)
    chosen = materialize(chosen.select("file_id", "point_id", "node"), "chosen")
    a, b = (chosen.select("file_id", F.col("point_id").alias(c), F.col("node").alias(f"n{c}")) for c in "pq")
    comps = connected_components(edges.join(a, ["file_id", "p"]).join(b, ["file_id", "q"]), "np", "nq")
    of = chosen.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    g = of.groupBy("file_id", "component").agg(F.count("*").alias("n"), F.min("point_id").alias("lowest")).filter(F.col("n") >= min_n)
    numbered = ordinals(g, ["file_id"], ["lowest"], "cluster").select("file_id", "component", "cluster")
    return materialize(of.join(numbered, ["file_id", "component"]).select("file_id", "point_id", "cluster"), "clusters")


def voronoi_clusters(cells: DataFrame, members: DataFrame) -> DataFrame:
    """file_id, cluster, n, area, diameter of a circle of that area, mean x and y of the clusters of voronoi_members."""
    g = cells.join(members, ["file_id", "point_id"]).groupBy("file_id", "cluster")
    g = g.agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return g.select("file_id", "cluster", "n", "area", F.sqrt(4 * F.col("area") / F.pi()).alias("diameter"), "x", "y")


def border_sides(cells: DataFrame, members: DataFrame) -> DataFrame:
    """file_id, cluster, x1, y1, x2 and y2 of the sides of a cluster's cells that no other cell of it lies behind."""
    own = cells.join(members, ["file_id", "point_id"])
    after = F.concat(F.slice("corners", 2, F.size("corners") - 1), F.slice("corners", 1, 1))
    sides = own.select("file_id", "cluster", F.explode(F.arrays_zip("corners", after.alias("after"), "behind")).alias("s"))
    sides = sides.select("file_id", "cluster", F.col("s.behind").alias("other"), F.col("s.corners.x").alias("x1"), F.col("s.corners.y").alias("y1"), F.col("s.after.x").alias("x2"), F.col("s.after.y").alias("y2"))
    same = members.select("file_id", "cluster", F.col("point_id").alias("other"), F.lit(True).alias("same"))
    return sides.join(same, ["file_id", "cluster", "other"], "left").filter("same IS NULL").select("file_id", "cluster", "x1", "y1", "x2", "y2")


def rings_of(starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Closed walks over directed sides; corners that differ by rounding only are one."""
    points = np.concatenate([starts, ends])
    unit = max(float(np.ptp(points, axis=0).max()), 1e-300) * 1e-9
    _, place = np.unique(np.round(points / unit), axis=0, return_inverse=True)
    place = place.reshape(-1)
    out: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(zip(place[: len(starts)].tolist(), place[len(starts) :].tolist())):
        if a != b:
            out.setdefault(a, []).append(k)
    after, rings = place[len(starts) :].tolist(), []
    while out:
        at, walk = next(iter(out)), []
        while at in out:
            k = out[at].pop()
            if not out[at]:
                del out[at]
            walk.append(k)
            at = after[k]
        rings.append(starts[walk])
    return rings


def outlines(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Corners (file_id, poly_id = cluster, ord, x, y) of the longest ring around each cluster; inner rings (holes) are
    left out. The sides of one cluster are traced in one task."""

    def trace(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in ("x1", "y1", "x2", "y2")}
        rings = rings_of(np.column_stack([c["x1"], c["y1"]]), np.column_stack([c["x2"], c["y2"]]))
        ring = max(rings, key=lambda r: float(np.hypot(*np.diff(np.vstack([r, r[:1]]), axis=0).T).sum()))
        n, first = len(ring), table.slice(0, 1).to_pylist()[0]
        return pa.table({"file_id": pa.array([first["file_id"]] * n, pa.int64()), "poly_id": pa.array([first["cluster"]] * n, pa.int64()), "ord": pa.array(range(1, n + 1), pa.int32()), "x": ring[:, 0], "y": ring[:, 1]})

    return spread(border_sides(cells, members), "file_id", "cluster").groupBy("file_id", "cluster").applyInArrow(trace, "file_id long, poly_id long, ord int, x double, y double")
