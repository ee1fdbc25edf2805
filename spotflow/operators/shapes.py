"""Delaunay triangles, alpha shapes and concave outlines of points, a file (or any other group) at a time.

A triangle belongs to an alpha shape if the radius of its circumcircle is at most alpha; triangles that share an edge
are one region. When regions merge follows from the lightest spanning forest of the triangles, where two
neighbours are as far apart as the larger of their radii: Spark contracts every tree onto its lightest edge, which at
least halves the trees a round, and one task finishes what a bounded number of edges is left of. So alphas are found for all
groups at once, and no task holds the triangles of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotflow.operators import components
from spotflow.operators.blocks import spread
from spotflow.operators.ordered import medians, ordinals, running_total
from spotflow.operators.spatial import finite_points, knn_distance
from spotflow.operators.voronoi import rings_of, voronoi_cells
from spotflow.session import materialize

#: Circumcircles of a larger radius, in extents of the group, count as none (their corners are on a line but for rounding);
#: cells are cut by a box so much larger. Ties are broken by shifts of up to SHIFT extents.
WIDEST, MARGIN, SHIFT = 300.0, 1000.0, 1e-8


def circumradius(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column]:
    """Radius of the circle through three points and the area between them."""
    side = lambda p, q: F.hypot(p[0] - q[0], p[1] - q[1])
    cross = F.abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))
    return side(a, b) * side(b, c) * side(c, a) / F.nullif(2 * cross, F.lit(0.0)), cross / 2


def delaunay(points: DataFrame) -> DataFrame:
    """file_id, t, a, b, c (point_ids, a the smallest), ax, ay, bx, by, cx, cy, radius and area of the Delaunay triangles of
    the distinct positions, each named by its smallest point_id; t numbers all triangles.

    Positions with four or more on an empty circle are triangulated in one of the ways possible. Points without coordinates
    take no part; a file whose points lie on a line, or of fewer than three, has no triangles.
    """
    p = finite_points(points).groupBy(F.col("file_id").cast("long").alias("file_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("point_id").cast("long").alias("point_id"))
    p = materialize(p, "places")
    extent = p.groupBy("file_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_e"))
    shift = lambda seed: F.col("_e") * SHIFT * F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    moved = p.join(extent, "file_id").select("file_id", "point_id", (F.col("x") + shift(1)).alias("x"), (F.col("y") + shift(2)).alias("y"))
    cells = voronoi_cells(moved, MARGIN)
    before = F.concat(F.slice("behind", F.size("behind"), 1), F.slice("behind", 1, F.size("behind") - 1))
    sides = cells.select("file_id", F.col("point_id").alias("a"), F.explode(F.arrays_zip(before.alias("u"), F.col("behind").alias("v"))).alias("s"))
    found = sides.select("file_id", "a", F.least("s.u", "s.v").alias("b"), F.greatest("s.u", "s.v").alias("c")).filter("s.u IS NOT NULL AND s.v IS NOT NULL AND a < b AND b < c").distinct()
    for c in "abc":
        found = found.join(p.select("file_id", F.col("point_id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), ["file_id", c])
    radius, area = circumradius(*[(F.col(f"{c}x"), F.col(f"{c}y")) for c in "abc"])
    rows = found.join(extent, "file_id").withColumn("radius", radius).withColumn("area", area).filter(F.col("radius") <= WIDEST * F.col("_e"))
    return materialize(rows.select("file_id", F.monotonically_increasing_id().alias("t"), *"abc", *[f"{c}{v}" for c in "abc" for v in "xy"], "radius", "area"), "triangles")


def shared_edges(triangles: DataFrame) -> DataFrame:
    """file_id, s, t and weight (the larger radius) of triangles that share an edge."""
    pairs = F.array(*[F.struct(F.col(x).alias("p"), F.col(y).alias("q")) for x, y in ("ab", "ac", "bc")])
    sides = triangles.select("file_id", "t", "radius", F.explode(pairs).alias("e"))
    both = sides.groupBy("file_id", "e.p", "e.q").agg(F.min("t").alias("s"), F.max("t").alias("t"), F.max("radius").alias("weight"))
    return both.filter("s < t").select("file_id", "s", "t", "weight")


def _kruskal(edges: DataFrame) -> DataFrame:
    """The edges (file_id, s, t, weight, edge) of the lightest forest, from one task."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables)
        order = np.lexsort((table.column("edge").to_numpy(), table.column("weight").to_numpy()))
        nodes, place = np.unique(np.concatenate([table.column("s").to_numpy(), table.column("t").to_numpy()]), return_inverse=True)
        s, t, root, keep = place[: len(table)][order].tolist(), place[len(table) :][order].tolist(), list(range(len(nodes))), []
        for k in range(len(s)):
            u, v = s[k], t[k]
            while root[u] != u:
                root[u] = u = root[root[u]]
            while root[v] != v:
                root[v] = v = root[root[v]]
            if u != v:
                root[u] = v
                keep.append(k)
        yield from table.take(pa.array(order[keep], pa.int64())).to_batches()

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def lightest_forest(edges: DataFrame) -> DataFrame:
    """file_id and weight of the edges (file_id, s, t, weight) of the lightest spanning forest."""
    edges = materialize(edges.withColumn("edge", F.monotonically_increasing_id()).select("file_id", "s", "t", "weight", "edge"), "edges")
    forest = None
    while True:
        few = edges.count() <= components.FEW
        if few:
            taken = materialize(_kruskal(edges), "forest")
        else:
            ends = edges.select("*", F.explode(F.array("s", "t")).alias("node"))
            lightest = ends.groupBy("node").agg(F.min_by(F.struct("file_id", "s", "t", "weight", "edge"), F.struct("weight", "edge")).alias("e"))
            taken = materialize(lightest.select("e.*").distinct(), "lightest")
        forest = taken if forest is None else forest.unionByName(taken)
        if few:
            return forest.select("file_id", "weight")
        of = components.connected_components(taken, "s", "t")
        for c in "st":
            edges = edges.join(of.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c)
        edges = materialize(edges.filter("_s <> _t").select("file_id", F.col("_s").alias("s"), F.col("_t").alias("t"), "weight", "edge"), "contracted")


def all_points_alpha(triangles: DataFrame) -> DataFrame:
    """file_id and alpha: the smallest at which every point is the corner of a triangle."""
    corners = triangles.select("file_id", "radius", F.explode(F.array("a", "b", "c")).alias("point_id"))
    return corners.groupBy("file_id", "point_id").agg(F.min("radius").alias("radius")).groupBy("file_id").agg(F.max("radius").alias("alpha"))


def one_region_alpha(triangles: DataFrame) -> DataFrame:
    """file_id and alpha: the smallest from all_points_alpha on at which the triangles are one region. With alpha, every
    triangle adds a region and every edge of the lightest forest takes one away."""
    forest = lightest_forest(shared_edges(triangles))
    events = triangles.select("file_id", F.col("radius").alias("value"), F.lit(1).alias("change")).unionByName(forest.select("file_id", F.col("weight").alias("value"), F.lit(-1).alias("change")))
    summed = events.groupBy("file_id", "value").agg(F.sum("change").alias("change"))
    counted = running_total(summed, ["file_id"], ["value"], "change", "regions")
    least = all_points_alpha(triangles)
    return counted.join(least, "file_id").filter("value >= alpha AND regions = 1").groupBy("file_id").agg(F.min("value").alias("alpha"))


def concave_alpha(triangles: DataFrame, shrink: float = 0.5) -> DataFrame:
    """file_id and alpha of the outline between the hull (shrink 0) and the tightest one of one region (shrink 1): of
    the m distinct radii from one_region_alpha on, in order, number ceil((1 - shrink) * m), the first at least."""
    least = one_region_alpha(triangles)
    values = materialize(triangles.select("file_id", F.col("radius").alias("value")).distinct().join(least, "file_id").filter("value >= alpha").select("file_id", "value"), "radii")
    ranked = ordinals(values, ["file_id"], ["value"], "i")
    sizes = values.groupBy("file_id").agg(F.greatest(F.ceil((1.0 - shrink) * F.count("*")), F.lit(1)).alias("want"))
    return ranked.join(sizes, "file_id").filter("i = want").select("file_id", F.col("value").alias("alpha"))


def alpha_shape(triangles: DataFrame, alpha: DataFrame) -> DataFrame:
    """The triangles with a radius of at most their file's alpha (file_id, alpha) with `region`: regions are numbered from 1
    in a file by their smallest point_id, then by the next."""
    chosen = materialize(triangles.join(alpha, "file_id").filter("radius <= alpha").drop("alpha"), "chosen")
    of = components.connected_components(shared_edges(chosen), "s", "t")
    rows = materialize(chosen.join(of.withColumnRenamed("node", "t"), "t", "left").withColumn("component", F.coalesce("component", "t")), "regions")
    lowest = rows.groupBy("file_id", "component").agg(F.min(F.struct("a", "b", "c")).alias("low")).select("file_id", "component", "low.*")
    numbers = ordinals(lowest, ["file_id"], ["a", "b", "c"], "region").select("file_id", "component", "region")
    return materialize(rows.join(numbers, ["file_id", "component"]).drop("component"), "shape")


def region_members(shape: DataFrame) -> DataFrame:
    """file_id, region and point_id of the corners of each region; a corner of two regions is in both."""
    return shape.select("file_id", "region", F.explode(F.array("a", "b", "c")).alias("point_id")).distinct()


def region_sides(shape: DataFrame) -> DataFrame:
    """file_id, region, x1, y1, x2 and y2 of the edges with one triangle of the region, which lies on their left."""
    cross = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    end = lambda c: F.struct(F.col(c).alias("id"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"))
    ring = lambda *order: F.array(*[F.struct(end(u).alias("u"), end(v).alias("v")) for u, v in zip(order, (*order[1:], order[0]))])
    sides = shape.select("file_id", "region", F.explode(F.when(cross > 0, ring("a", "b", "c")).otherwise(ring("a", "c", "b"))).alias("s"))
    once = sides.groupBy("file_id", "region", F.least("s.u.id", "s.v.id").alias("p"), F.greatest("s.u.id", "s.v.id").alias("q")).agg(F.count("*").alias("n"), F.first("s").alias("s"))
    return once.filter("n = 1").select("file_id", "region", F.col("s.u.x").alias("x1"), F.col("s.u.y").alias("y1"), F.col("s.v.x").alias("x2"), F.col("s.v.y").alias("y2"))


def outer_rings(shape: DataFrame) -> DataFrame:
    """file_id, region, ord, x and y: the ring around each region with the greatest area, against the clock; holes are left
    out. The sides of a region are put into one task, its triangles are not."""

    def trace(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in ("x1", "y1", "x2", "y2")}
        rings = rings_of(np.column_stack([c["x1"], c["y1"]]), np.column_stack([c["x2"], c["y2"]]))
        after = lambda r: np.roll(r, -1, axis=0)
        ring = max(rings, key=lambda r: float((r[:, 0] * after(r)[:, 1] - after(r)[:, 0] * r[:, 1]).sum()))
        n, first = len(ring), table.slice(0, 1).to_pylist()[0]
        return pa.table({"file_id": pa.array([first["file_id"]] * n, pa.int64()), "region": pa.array([first["region"]] * n, pa.int64()), "ord": pa.array(range(1, n + 1), pa.int32()), "x": ring[:, 0], "y": ring[:, 1]})

    return spread(region_sides(shape), "file_id", "region").groupBy("file_id", "region").applyInArrow(trace, "file_id long, region long, ord int, x double, y double")


def grouped(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """points (with file_id, point_id, x, y and the columns `by`) with file_id replaced by a number of its own for every
    group, and the table from that number (file_id) to the columns `by` under their names with a trailing _."""
    keys = materialize(points.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
    names = keys.select(F.col("_g").alias("file_id"), *[F.col(c).alias(f"{c}_") for c in by])
    return points.join(keys, by).select(F.col("_g").alias("file_id"), "point_id", "x", "y"), names


def concave_outlines(points: DataFrame, by: list[str], shrink: float = 0.5) -> DataFrame:
    """The columns `by`, ord, x and y: the outline of each group of points at concave_alpha, against the clock, holes
    filled. Groups without a triangle have none."""
    own, names = grouped(points, by)
    triangles = delaunay(own)
    rings = outer_rings(alpha_shape(triangles, concave_alpha(triangles, shrink)))
    return rings.join(names, "file_id").select(*[F.col(f"{c}_").alias(c) for c in by], "ord", "x", "y")


def untangled(points: DataFrame, members: DataFrame) -> DataFrame:
    """members (file_id, point_id, cluster) with clusters split into the regions of their alpha shape, at the larger of its
    all_points_alpha and twice the median distance between nearest members of the file.

    Two regions of which one has fewer than five points stay one cluster. A corner of two regions goes to the first. Clusters
    without a triangle stay as they are. Clusters are numbered anew from 1 in a file by their smallest point_id.
    """
    own = materialize(points.select("file_id", "point_id", "x", "y").join(members, ["file_id", "point_id"]), "members")
    near = medians(knn_distance(own, 2), ["file_id"], ["distance"]).select(F.col("file_id").alias("file_id_"), (2 * F.col("distance")).alias("floor"))
    groups, names = grouped(own, ["file_id", "cluster"])
    triangles = delaunay(groups)
    alpha = all_points_alpha(triangles).join(names, "file_id").join(near, "file_id_", "left")
    shape = alpha_shape(triangles, alpha.select("file_id", F.greatest("alpha", F.coalesce("floor", F.lit(0.0))).alias("alpha")))
    of = materialize(region_members(shape).groupBy("file_id", "point_id").agg(F.min("region").alias("region")), "of")
    sizes = of.groupBy("file_id", "region").agg(F.count("*").alias("n")).groupBy("file_id").agg(F.count("*").alias("regions"), F.min("n").alias("least"))
    split = of.join(sizes, "file_id").withColumn("region", F.when((F.col("regions") == 2) & (F.col("least") < 5), 1).otherwise(F.col("region"))).select("file_id", "point_id", "region")
    # a position that several points share is named by the smallest of them in the triangles
    same = groups.groupBy("file_id", "x", "y").agg(F.min("point_id").alias("name"))
    named = groups.join(same, ["file_id", "x", "y"]).join(split.withColumnRenamed("point_id", "name"), ["file_id", "name"], "left").withColumn("region", F.coalesce("region", F.lit(1)))
    rows = named.join(names, "file_id").select(F.col("file_id_").alias("file_id"), "point_id", F.col("cluster_").alias("_c"), F.col("region").cast("long").alias("_r"))
    rows = materialize(rows, "split")
    lowest = rows.groupBy("file_id", "_c", "_r").agg(F.min("point_id").alias("lowest"))
    return rows.join(ordinals(lowest, ["file_id"], ["lowest", "_c", "_r"], "cluster").drop("lowest"), ["file_id", "_c", "_r"]).select("file_id", "point_id", "cluster")
