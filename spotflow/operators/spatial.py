"""Distance joins on a grid, density-based clusters, nearest neighbours and point-in-polygon joins.

Points are rows of file_id, point_id, x and y; the two ids together name a point. Distances are compared
through cells as wide as the radius: a point meets the points of its own and the eight cells around it, so the
join is an equi-join and no file is compared with itself as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotflow.operators.blocks import SIZE, at_level, blocks_of, box_distance, dealt, spread
from spotflow.operators.components import connected_components, smallest_reachable
from spotflow.operators.ordered import ordinals
from spotflow.operators.within import turns
from spotflow.session import materialize

#: Full width at half maximum of a normal distribution, in standard deviations.
FWHM = 2 * math.sqrt(2 * math.log(2))
POINT = ("file_id", "point_id")
#: Edges of a ring in one of its strips.
EDGES_IN_STRIP = 8
#: Positions in a block whose points are compared with each other, to twice as many.
IN_BLOCK = SIZE


def finite_points(points: DataFrame) -> DataFrame:
    """Points whose coordinates are numbers."""
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    return points.filter(fine[0] & fine[1])


def _ring(reach: int = 1) -> Column:
    span = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span])


def neighbours(points: DataFrame, radius: float) -> DataFrame:
    """file_id, a, b and distance of all ordered pairs of points at most `radius` apart, a point with itself
    included. Points with a null or non-finite coordinate have no pairs; with radius 0 equal points are pairs.
    Rows that repeat are points of their own."""
    side = radius if radius > 0 else 1.0
    p = finite_points(points).select(*POINT, "x", "y")
    p = p.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    a = p.withColumn("to", F.explode(_ring()))
    a = a.select("file_id", F.col("point_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("cx") + F.col("to.i")).alias("cx"), (F.col("cy") + F.col("to.j")).alias("cy"))
    b = p.select("file_id", F.col("point_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    pairs = a.join(b.hint("merge"), ["file_id", "cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    return pairs.filter(F.col("distance") <= radius).select("file_id", "a", "b", "distance")


def _pairs_of_blocks(near: DataFrame, left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run over pairs of blocks (file_id, a, b): it gets the columns of left (rows with block) under a_ and those of right under b_,
    as lists, a pair a row."""

    def packed(rows: DataFrame, side: str) -> DataFrame:
        names = [c for c in rows.columns if c not in ("file_id", "block")]
        all_of = spread(rows.withColumnRenamed("block", side), "file_id", side).groupBy("file_id", side).agg(F.collect_list(F.struct(*names)).alias("_l"))
        return all_of.select("file_id", side, *[F.col(f"_l.{c}").alias(f"{side}_{c}") for c in names]).hint("shuffle_hash")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(n)[i].values for n in batch.schema.names if n[:2] in ("a_", "b_")}
                yield from pa.table(run({n: v.to_numpy(zero_copy_only=False) for n, v in one.items()})).to_batches()

    met = spread(near.join(packed(left, "a"), ["file_id", "a"]), "file_id", "b").join(packed(right, "b"), ["file_id", "b"])
    return met.drop("file_id", "a", "b").mapInArrow(kernel, schema)


def _apart(c: dict[str, np.ndarray]) -> np.ndarray:
    """Distances between the points of two blocks."""
    dx, dy = c["a_x"][:, None] - c["b_x"][None], c["a_y"][:, None] - c["b_y"][None]
    dx *= dx
    dy *= dy
    dx += dy
    return np.sqrt(dx, out=dx)


def dbscan(points: DataFrame, epsilon: float, min_pts: int) -> DataFrame:
    """points with n_near (points within epsilon, itself included), is_core (n_near >= min_pts) and cluster.

    Clusters are the connected components of core points, numbered from 1 within a file by their smallest
    point_id; a border point takes the smallest cluster among its core neighbours; -1 is noise. Points without
    coordinates are noise with n_near 0. file_id and point_id together must name a point.

    No pairs are written out. A block of points counts what lies in nodes of the tree that are within epsilon as a whole, and is
    compared with the blocks at the edge only, of which a task returns counts, a spanning set of links and the
    smallest cluster of each border point.
    """
    p = finite_points(points).select(F.col("file_id").cast("long").alias("file_id"), "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = p.groupBy("file_id", "x", "y").agg(F.count("*").alias("w"), F.min("point_id").alias("first")).withColumn("v", F.monotonically_increasing_id())
    blocks = blocks_of(materialize(places, "places"), IN_BLOCK)
    inside, near = blocks.close(epsilon)
    depths = [r.level for r in inside.select("level").distinct().collect()]  # none where no block is near as a whole
    own = blocks.places.select("file_id", "block", "v", "x", "y", "w")

    def in_nodes(rows: DataFrame) -> DataFrame:
        """rows once for each level that nodes within epsilon are of, with level and node."""
        return reduce(DataFrame.unionByName, [at_level(rows, depth) for depth in depths])

    def of_nodes(rows: DataFrame, value: Column, name: str, total: Callable) -> DataFrame:
        """file_id, block and name: a total over the rows in all nodes within epsilon of the block as a whole."""
        sums = in_nodes(rows).groupBy("file_id", "level", "node").agg(value.alias(name))
        return inside.join(sums, ["file_id", "level", "node"]).groupBy("file_id", F.col("a").alias("block")).agg(total(name).alias(name))

    def counted(c: dict[str, np.ndarray]) -> dict:
        n = (_apart(c) <= epsilon) @ c["b_w"]
        return {"v": c["a_v"][n > 0], "n": n[n > 0]}

    edge = _pairs_of_blocks(near, own.select("file_id", "block", "v", "x", "y"), own, counted, "v long, n long").groupBy("v").agg(F.sum("n").alias("n_near"))
    dense = own.join(edge, "v", "left").na.fill({"n_near": 0})
    if depths:
        dense = dense.join(of_nodes(own, F.sum("w"), "whole", F.sum), ["file_id", "block"], "left").withColumn("n_near", F.col("n_near") + F.coalesce("whole", F.lit(0))).drop("whole")
    dense = materialize(dense.withColumn("is_core", F.col("n_near") >= min_pts), "density")
    core = dense.filter("is_core").select("file_id", "block", "v", "x", "y")

    def linked(c: dict[str, np.ndarray]) -> dict:
        i, j = np.nonzero(_apart(c) <= epsilon)
        ends, lowest = smallest_reachable(c["a_v"][i], c["b_v"][j]) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return {"s": ends, "t": lowest}

    links = _pairs_of_blocks(near.filter("a <= b"), core, core, linked, "s long, t long").unionByName(core.select(F.col("v").alias("s"), F.col("v").alias("t")))
    if depths:
        # all core points of a block and of a node within epsilon of it are linked: each is to a vertex that stands for them
        nodes = materialize(in_nodes(core).join(inside.select("file_id", "level", "node").distinct(), ["file_id", "level", "node"], "left_semi").select("file_id", "level", "node", "v"), "in_nodes")
        names = materialize(nodes.select("file_id", "level", "node").distinct().withColumn("t", -1 - F.monotonically_increasing_id()), "nodes")
        of_block = inside.withColumnRenamed("a", "block").join(names, ["file_id", "level", "node"]).groupBy("file_id", "block").agg(F.collect_set("t").alias("t"))
        links = links.unionByName(nodes.join(names, ["file_id", "level", "node"]).select(F.col("v").alias("s"), "t"))
        links = links.unionByName(core.join(of_block, ["file_id", "block"]).select(F.col("v").alias("s"), F.explode("t").alias("t")))
    roots = connected_components(links, "s", "t").filter("node >= 0")
    first = materialize(core.join(roots.select(F.col("node").alias("v"), "component"), "v").join(blocks.places.select("v", "first"), "v"), "roots")
    lowest = first.groupBy("file_id", "component").agg(F.min("first").alias("lowest"))
    numbers = ordinals(lowest, ["file_id"], ["lowest", "component"], "cluster")
    of_core = materialize(first.join(numbers, ["file_id", "component"]).select("file_id", "block", "v", "x", "y", "cluster"), "core")

    def least(c: dict[str, np.ndarray]) -> dict:
        of = np.where(_apart(c) <= epsilon, c["b_cluster"][None], np.iinfo(np.int64).max).min(axis=1)
        some = of < np.iinfo(np.int64).max
        return {"v": c["a_v"][some], "border": of[some]}

    rest = dense.filter("NOT is_core").select("file_id", "block", "v", "x", "y")
    border = _pairs_of_blocks(near, rest, of_core, least, "v long, border long")
    if depths:
        border = border.unionByName(rest.join(of_nodes(of_core, F.min("cluster"), "border", F.min), ["file_id", "block"]).select("v", "border"))
    border = border.groupBy("v").agg(F.min("border").alias("border"))
    known = dense.join(of_core.select("v", "cluster"), "v", "left").join(border, "v", "left").select("file_id", "x", "y", "n_near", "is_core", F.coalesce("cluster", "border", F.lit(-1)).alias("cluster"))
    known = p.join(known, ["file_id", "x", "y"]).select(*POINT, "n_near", "is_core", "cluster").toDF("_f", "_p", "_n", "_core", "_cluster")
    out = points.join(known, (F.col("file_id") == F.col("_f")) & (F.col("point_id") == F.col("_p")), "left")
    return out.select(*points.columns, F.coalesce("_n", F.lit(0)).alias("n_near"), F.coalesce("_core", F.lit(0) >= min_pts).alias("is_core"), F.coalesce("_cluster", F.lit(-1)).alias("cluster"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """file_id, cluster, n, x, y and diameter of every cluster but noise: size, centroid and the full width
    at half maximum of a round normal distribution (0 up to three points)."""
    spread = FWHM * F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2)
    groups = clustered.filter("cluster > 0").groupBy("file_id", "cluster")
    return groups.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.when(F.count("*") > 3, spread).otherwise(0.0).alias("diameter"))


def enough_points(clustered: DataFrame, least: int) -> DataFrame:
    """clustered with clusters of fewer than `least` points turned into noise."""
    n = clustered.filter("cluster > 0").groupBy("file_id", "cluster").agg(F.count("*").alias("_n"))
    return clustered.join(n, ["file_id", "cluster"], "left").withColumn("cluster", F.when(F.col("_n") >= least, F.col("cluster")).otherwise(-1)).select(*clustered.columns)


def point_colors(clustered: DataFrame, scheme: str, seed: int = 1) -> DataFrame:
    """file_id, point_id and color of clustered points: noise/cluster (0, 1), noise/core/border (0, 1, 2) or
    randomN (0 for noise, else a number from 1 to N that a cluster's points share)."""
    noise = F.col("cluster") == -1
    if scheme == "noise/cluster":
        color = F.when(noise, 0)
    elif scheme == "noise/core/border":
        color = F.when(noise, 0).when(~F.col("is_core"), 2)
    else:
        color = F.when(noise, 0).otherwise(F.pmod(F.col("cluster") * 7919 + seed, F.lit(int(scheme.removeprefix("random")))) + 1)
    return clustered.select(*POINT, F.coalesce(color, F.lit(1)).cast("double").alias("color"))


def split_by_distance(tracks: DataFrame, farthest: float) -> DataFrame:
    """tracks (file_id, track_id, frame, x, y) with `step`, the distance to the row before (null for the
    first), and `part`, which grows by one wherever a step is longer than `farthest`."""
    w = Window.partitionBy("file_id", "track_id").orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    rows = tracks.withColumn("step", F.sqrt(dx * dx + dy * dy))
    return rows.withColumn("part", F.sum(F.coalesce((F.col("step") > farthest).cast("long"), F.lit(0))).over(w) + 1)


def _nearest(d: np.ndarray, w: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each row of distances to points of weight w the shortest that add up to k, with their weights."""
    if (w == 1).all() and d.shape[1] > k:
        d, order = np.partition(d, k - 1, axis=1)[:, :k], None
        d = np.sort(d, axis=1)
        return list(d), [np.ones(k, np.int64)] * len(d)
    order = np.argsort(d, axis=1, kind="stable")
    d, w = np.take_along_axis(d, order, axis=1), w[order]
    upto = np.cumsum(w, axis=1)
    ends = (upto < k).sum(axis=1) + 1
    return [x[:e] for x, e in zip(d, ends)], [x[:e] for x, e in zip(w, ends)]


def knn_distance(points: DataFrame, k: int) -> DataFrame:
    """file_id, point_id and distance to the k-th nearest point of the file, itself and equal points counted;
    null where the file has fewer than k points. Points without coordinates are left out.

    Equal positions are one with a weight. The k-th distance within a position's own block bounds the true one; the
    blocks whose boxes lie nearer than that are searched as well. Blocks have the same number of positions
    wherever they lie, and the searches of a block that many positions ask are dealt over tasks.
    """
    p = materialize(finite_points(points).select(F.col("file_id").cast("long").alias("file_id"), "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    places = materialize(p.groupBy("file_id", "x", "y").agg(F.count("*").alias("w")), "places")
    enough = places.groupBy("file_id").agg(F.sum("w").alias("_n")).filter(F.col("_n") >= k).select("file_id")
    blocks = blocks_of(places.join(enough, "file_id", "left_semi"), max(SIZE, 2 * k))
    kinds = "file_id long, x double, y double, d array<double>, w array<long>"

    def found(file_id: pa.Array, x: np.ndarray, y: np.ndarray, d: list, w: list) -> pa.Table:
        return pa.table({"file_id": file_id, "x": x, "y": y, "d": pa.array(d, pa.list_(pa.float64())), "w": pa.array(w, pa.list_(pa.int64()))})

    def search(qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list, list]:
        d, n = [], []
        for i in range(0, len(qx), 512):
            some = _nearest(np.sqrt((qx[i : i + 512, None] - x) ** 2 + (qy[i : i + 512, None] - y) ** 2), w, k)
            d, n = d + some[0], n + some[1]
        return d, n

    def within(own: pa.Table) -> pa.Table:
        x, y, w = (own.column(c).to_numpy() for c in ("x", "y", "w"))
        return found(own.column("file_id"), x, y, *search(x, y, x, y, w)).append_column("block", own.column("block"))

    def across(asks: pa.Table, own: pa.Table) -> pa.Table:
        if not len(asks):
            return found(pa.array([], pa.int64()), np.zeros(0), np.zeros(0), [], [])
        qx, qy = asks.column("x").to_numpy(), asks.column("y").to_numpy()
        return found(asks.column("file_id"), qx, qy, *search(qx, qy, *(own.column(c).to_numpy() for c in ("x", "y", "w"))))

    first = materialize(spread(blocks.places, "file_id", "block").groupBy("file_id", "block").applyInArrow(within, kinds + ", block long"), "within")
    bound = F.when(F.aggregate("w", F.lit(0).cast("long"), lambda s, v: s + v) >= k, F.element_at("d", -1)).otherwise(float("inf"))
    asks = first.select("file_id", "x", "y", bound.alias("bound"), F.col("block").alias("_own"))
    asks = blocks.meet(asks, lambda: box_distance(F.col("x"), F.col("y")) < F.col("bound")).filter("block <> _own")
    asked = materialize(asks.select("file_id", "x", "y", "block"), "asks")
    left, right = dealt(asked, blocks.places)
    keys = ("file_id", "block", "part")
    more = spread(left, *keys).groupBy(*keys).cogroup(spread(right, *keys).groupBy(*keys)).applyInArrow(across, kinds)
    every = first.drop("block").unionByName(more).select("file_id", "x", "y", F.arrays_zip("d", "w").alias("l"))
    merged = F.array_sort(F.flatten(F.collect_list("l")))
    step = lambda s, v: F.struct((s["n"] + v["w"]).alias("n"), F.when((s["n"] < k) & (s["n"] + v["w"] >= k), v["d"]).otherwise(s["d"]).alias("d"))
    reached = F.aggregate("l", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d")), step)
    done = every.groupBy("file_id", "x", "y").agg(merged.alias("l")).select("file_id", "x", "y", reached["d"].alias("distance"))
    return p.join(done, ["file_id", "x", "y"], "left").select(*POINT, "distance")


def nearest_points(points: DataFrame, radius: float, k: int) -> DataFrame:
    """file_id, point_id, other and distance: for every row the k nearest points of the file at most radius away, itself
    included; of those as far the smallest ids, null last. Points without coordinates have none. ids are whole numbers.

    Only the k smallest ids of a position can be among the nearest of any point, and rows at a position share their
    nearest. Positions look through their own block, then through the blocks that their k-th distance reaches; no pairs are listed.
    """
    last = np.iinfo(np.int64).max
    p = finite_points(points.filter("file_id IS NOT NULL")).select(F.col("file_id").cast("long").alias("file_id"), F.coalesce(F.col("point_id").cast("long"), F.lit(last)).alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p, place = materialize(p, "points"), ["file_id", "x", "y"]
    low = p.withColumn("_i", F.row_number().over(Window.partitionBy(*place).orderBy("point_id"))).filter(F.col("_i") <= k)
    places = materialize(low.groupBy(*place).agg(F.collect_list("point_id").alias("ids")), "places")
    blocks = blocks_of(places, max(SIZE, 2 * k))
    kinds = "file_id long, x double, y double, d array<double>, w array<long>"

    def search(asks: pa.Table, own: pa.Table) -> pa.Table:
        qx, qy = (asks.column(c).to_numpy() for c in ("x", "y"))
        ids = own.column("ids").combine_chunks()
        of = np.repeat(np.arange(len(own)), ids.value_lengths().to_numpy())
        ex, ey, who = own.column("x").to_numpy()[of], own.column("y").to_numpy()[of], ids.flatten().to_numpy()
        d, w, n = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for at in range(0, len(qx), SIZE):
            dx, dy = qx[at : at + SIZE, None] - ex, qy[at : at + SIZE, None] - ey
            apart = np.sqrt(dx * dx + dy * dy)
            most = np.partition(apart, k - 1, axis=1)[:, k - 1 : k] if len(ex) > k else np.inf
            i, j = np.nonzero(apart <= np.minimum(most, radius))
            far = apart[i, j]
            order = np.lexsort((who[j], far, i))
            order = order[turns(i[order]) < k]
            d.append(far[order])
            w.append(who[j[order]])
            n.append(np.bincount(i[order], minlength=len(dx)))
        ends = pa.array(np.cumsum(np.concatenate(n)), pa.int32())
        return pa.table({"file_id": asks.column("file_id"), "x": qx, "y": qy, "d": pa.ListArray.from_arrays(ends, np.concatenate(d)), "w": pa.ListArray.from_arrays(ends, np.concatenate(w))})

    within = lambda own: search(own, own).append_column("block", own.column("block"))
    first = materialize(spread(blocks.places, "file_id", "block").groupBy("file_id", "block").applyInArrow(within, kinds + ", block long"), "within")
    bound = F.when(F.size("d") >= k, F.element_at("d", -1)).otherwise(float(radius))
    asks = first.select(*place, bound.alias("bound"), F.col("block").alias("_own")).filter("bound > 0")
    asks = blocks.meet(asks, lambda: box_distance(F.col("x"), F.col("y")) <= F.col("bound") * (1 + 1e-12)).filter("block <> _own")
    left, right = dealt(materialize(asks.select(*place, "block"), "asks"), blocks.places)
    keys = ("file_id", "block", "part")
    right = right.select(*keys, "x", "y", "ids").toDF(*[f"o_{c}" for c in keys], "x", "y", "ids")
    more = spread(left, *keys).groupBy(*keys).cogroup(spread(right, *right.columns[:3]).groupBy(*right.columns[:3])).applyInArrow(search, kinds)
    every = first.drop("block").unionByName(more).select(*place, F.explode(F.arrays_zip("d", "w")).alias("l")).select(*place, F.col("l.d").alias("distance"), F.col("l.w").alias("other"))
    best = every.withColumn("_i", F.row_number().over(Window.partitionBy(*place).orderBy("distance", "other"))).filter(F.col("_i") <= k)
    known = lambda c: F.nullif(F.col(c), F.lit(last)).alias(c)
    return p.join(best.hint("merge"), place).select("file_id", known("point_id"), known("other"), "distance")


def line_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of points from the foot that the reference formula gives for a line through two points: the
    foot's share of the line is divided by the squared 2-norm of the matrix of the two points, not by the
    squared length of the line, so that it is no perpendicular in general."""
    half = (x1 * x1 + x2 * x2 + y1 * y1 + y2 * y2) / 2
    det = x1 * y2 - x2 * y1
    u = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / F.nullif(half + F.sqrt(F.greatest(F.lit(0.0), half * half - det * det)), F.lit(0.0))
    return F.hypot(x1 + u * (x2 - x1) - x, y1 + u * (y2 - y1) - y)


def epsilon_knee(points: DataFrame, k: int) -> DataFrame:
    """file_id and epsilon: the k-th nearest distance at which the sorted curve of all of them is farthest from the
    line through its ends (the first such); null distances are left out."""
    d = knn_distance(points, k).filter("distance IS NOT NULL")
    curve = materialize(ordinals(d, ["file_id"], ["distance", "point_id"], "i").select("file_id", "i", "distance"), "curve")
    ends = curve.groupBy("file_id").agg(F.count("*").cast("double").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    far = line_distance(F.col("i").cast("double"), F.col("distance"), F.lit(1.0), F.col("low"), F.col("n"), F.col("high"))
    rows = curve.join(ends, "file_id").withColumn("far", F.coalesce(far, F.lit(0.0)))
    return rows.groupBy("file_id").agg(F.max_by("distance", F.struct("far", -F.col("i"))).alias("epsilon"))


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """Edges (x1, y1, x2, y2) of closed rings (file_id, poly_id, ord, x, y), the last one back to the first corner."""
    ring = Window.partitionBy("file_id", "poly_id").orderBy("ord")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = [F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias(f"{c}2") for c in ("x", "y")]
    return polygons.select("file_id", "poly_id", "ord", F.col("x").alias("x1"), F.col("y").alias("y1"), *edge)


def polygon_summary(polygons: DataFrame) -> DataFrame:
    """area, centroid (of the area; null without one) and number of corners of each ring."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    g = polygon_edges(polygons).groupBy("file_id", "poly_id").agg(
        F.sum(cross).alias("twice"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"), F.count("*").alias("corners")
    )
    by = F.nullif(3 * F.col("twice"), F.lit(0.0))
    return g.select("file_id", "poly_id", F.abs(F.col("twice") / 2).alias("area"), (F.col("mx") / by).alias("x"), (F.col("my") / by).alias("y"), "corners")


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """file_id, point_id and poly_id of every point inside or on the border of a ring of its file.

    Points meet the boxes of rings through grids, one for each power of two that a ring of the file is as wide as. A ring is
    cut into strips of about EDGES_IN_STRIP edges by height, and a point meets the edges of its strip only: the
    number of edges to its right is odd inside.
    """
    from spotflow.operators.overlap import in_cells, size_class

    edges = materialize(polygon_edges(polygons).filter("x1 IS NOT NULL AND y1 IS NOT NULL"), "edges")
    boxes = edges.groupBy("file_id", "poly_id").agg(F.min("x1").alias("x0"), F.max("x1").alias("x1"), F.min("y1").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("_n"))
    strip = (F.col("y1") - F.col("y0")) / F.ceil(F.col("_n") / EDGES_IN_STRIP)
    boxes = materialize(boxes.withColumn("_high", F.when(strip > 0, strip).otherwise(1.0)).withColumn("_low", F.col("y0")), "boxes")
    extent = boxes.groupBy("file_id").agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("_extent"))
    sized = boxes.join(extent, "file_id").withColumn("_size", size_class(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.col("_extent"))).drop("_extent")
    sizes = sized.groupBy("file_id").agg(F.collect_set("_size").alias("_sizes"))  # a few numbers a file
    rings = in_cells(sized, F.col("_size")).drop("_size", "_n")
    p = finite_points(points).select(*POINT, "x", "y").join(sizes, "file_id").withColumn("grid", F.explode("_sizes")).drop("_sizes")
    side = F.pow(F.lit(2.0), F.col("grid"))
    p = p.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    within = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    near = p.join(rings, ["file_id", "grid", "cx", "cy"]).filter(within)
    near = near.select(*POINT, "poly_id", "x", "y", F.floor((F.col("y") - F.col("_low")) / F.col("_high")).alias("strip"))
    place = lambda v: F.floor((v - F.col("_low")) / F.col("_high"))
    e = edges.join(boxes.select("file_id", "poly_id", "_low", "_high"), ["file_id", "poly_id"])
    e = e.select("file_id", "poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(place(F.least("y1", "y2")), place(F.greatest("y1", "y2")))).alias("strip"))
    x, y, x1, y1, x2, y2 = map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))
    crosses = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1))
    on = ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    met = near.join(e, ["file_id", "poly_id", "strip"]).groupBy(*POINT, "poly_id", "x", "y").agg(F.count_if(crosses).alias("n"), F.max(on).alias("border"))
    return met.filter("n % 2 = 1 OR border").select(*POINT, "poly_id")


def first_rank_density(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, point_id and density: cells of the first ring around a point and itself by their area, in units of
    the file's mean density. areas: file_id, point_id, area; edges: neighbours (file_id, p, q), in one or both
    directions and as often as they may repeat. Null areas count as cells without area."""
    both = edges.select("file_id", F.col("p").alias("point_id"), F.col("q").alias("other")).unionByName(edges.select("file_id", F.col("q").alias("point_id"), F.col("p").alias("other")))
    both = both.unionByName(areas.select(*POINT, F.col("point_id").alias("other"))).distinct()
    of = areas.select("file_id", F.col("point_id").alias("other"), "area")
    ring = both.join(of, ["file_id", "other"]).groupBy(*POINT).agg((F.count("*") / F.nullif(F.sum("area"), F.lit(0.0))).alias("ring"))
    mean = areas.groupBy("file_id").agg(F.avg("area").alias("mean"))
    return ring.join(mean, "file_id").select(*POINT, (F.col("ring") * F.col("mean")).alias("density"))


def density_within(areas: DataFrame, radius: float) -> DataFrame:
    """first_rank_density of points (file_id, point_id, x, y, area) whose neighbours are all within radius. Points
    without coordinates have no row, but count for the mean. Point_ids name points.

    No pairs are written out: a block of points adds the sums of the nodes of the tree that are within radius as a whole, and is
    compared with the blocks at the edge only."""
    p = finite_points(areas).select(F.col("file_id").cast("long").alias("file_id"), "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("area").cast("double").alias("area"))
    # null areas count as cells without area; a file with null areas only has no sum
    sums = (F.count("*").alias("w"), F.sum(F.coalesce("area", F.lit(0.0))).alias("s"), F.count("area").alias("m"))
    places = materialize(p.groupBy("file_id", "x", "y").agg(*sums).withColumn("v", F.monotonically_increasing_id()), "places")
    blocks = blocks_of(places, IN_BLOCK)
    inside, near = blocks.close(radius)
    own = blocks.places.select("file_id", "block", "v", "x", "y", "w", "s", "m")
    of = [F.sum(c).alias(c) for c in "wsm"]

    def added(c: dict[str, np.ndarray]) -> dict:
        within = (_apart(c) <= radius).astype(np.float64)
        some = np.flatnonzero(within.any(axis=1))
        return {"v": c["a_v"][some]} | {k: (within @ c[f"b_{k}"].astype(np.float64))[some] for k in "wsm"}

    at_edge = _pairs_of_blocks(near, own.select("file_id", "block", "v", "x", "y"), own.drop("v"), added, "v long, w double, s double, m double")
    whole = own.select("v", F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m")).limit(0)
    for depth in [r.level for r in inside.select("level").distinct().collect()]:  # none where no block is near as a whole
        nodes = at_level(own, depth).groupBy("file_id", "level", "node").agg(*of)
        of_block = inside.join(nodes, ["file_id", "level", "node"]).groupBy("file_id", F.col("a").alias("block")).agg(*of)
        whole = whole.unionByName(own.select("file_id", "block", "v").join(of_block, ["file_id", "block"]).select("v", *[F.col(c).cast("double").alias(c) for c in "wsm"]))
    ring = at_edge.unionByName(whole).groupBy("v").agg(*of).select("v", (F.col("w") / F.nullif(F.when(F.col("m") > 0, F.col("s")), F.lit(0.0))).alias("ring"))
    mean = areas.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.avg("area").alias("mean"))
    of_place = places.select("file_id", "x", "y", "v").join(ring, "v").join(mean, "file_id").select("file_id", "x", "y", (F.col("ring") * F.col("mean")).alias("density"))
    return p.join(of_place, ["file_id", "x", "y"]).select(*POINT, "density")


def points_in_mask(points: DataFrame, mask: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Points (file_id, point_id, x, y) whose pixel of the mask (file_id, row, col from 0, inside) is inside: the raster
    form of a mask, an equi-join on the pixel. Points off the mask and without coordinates are outside."""
    at = finite_points(points).withColumn("col", F.floor(F.col("x") / pixel_size)).withColumn("row", F.floor(F.col("y") / pixel_size))
    return at.join(mask.filter("inside").select("file_id", "row", "col").distinct(), ["file_id", "row", "col"], "left_semi").select(*points.columns)


def binarized(pixels: DataFrame, value: str = "adu") -> DataFrame:
    """file_id, row, col and inside of one-frame images: at least the middle of the least and the greatest value."""
    ends = pixels.groupBy("file_id").agg(((F.min(value) + F.max(value)) / 2).alias("_middle"))
    return pixels.join(ends, "file_id").select("file_id", "row", "col", (F.col(value) >= F.col("_middle")).alias("inside"))
