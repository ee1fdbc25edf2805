"""Boxes, their overlaps and the clusters of tracks that overlapping boxes make.

Boxes are rows of file_id, id, x0, x1, y0, y1 and for times z0 and z1. They meet through grids, one for each power of
two that a box of the file is as wide as, so that the join is an equi-join and a box of any width lies in at most four cells of
its own grid; smaller boxes look it up there. A pair is reported by the one cell that holds the lower corner of the overlap.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotflow.operators.components import connected_components
from spotflow.operators.counting import SIDES, apart_counts, box_components, proper
from spotflow.operators.spatial import points_in_polygons, polygon_summary
from spotflow.session import materialize

#: The smallest grid of a file, as a power of two of its extent.
FINEST = -20


def size_class(width: Column, extent: Column) -> Column:
    """The power of two that a width does not exceed, no less than FINEST powers below the extent."""
    return F.ceil(F.log2(F.greatest(width, extent * 2.0**FINEST, F.lit(1e-300)))).cast("int")


def in_cells(rows: DataFrame, grid: Column) -> DataFrame:
    """rows (x0, x1, y0, y1) once for each cell (grid, cx, cy) of width 2**grid that they lie in."""
    side = F.pow(F.lit(2.0), F.col("grid"))
    cell = lambda c: F.floor(F.col(c) / side)
    return rows.withColumn("grid", grid).withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))


def overlap_pairs(boxes: DataFrame, time_window: float = math.inf, strict: bool = False, apart: str | None = None) -> DataFrame:
    """file_id, a and b (a < b) of all boxes of a file that overlap in x and y: touching counts unless `strict`.
    With a finite time_window they must overlap in z too, each widened by half the (rounded) window. Boxes that
    share a value of the column `apart` are no pairs. Boxes with a null or non-finite side, or whose sides are in the wrong
    order, overlap nothing."""
    more = ["z0", "z1"] if math.isfinite(time_window) else []
    rows = proper(boxes.select("file_id", "id", *SIDES, *more, *([apart] if apart else []))).dropna(subset=more)
    extent = rows.groupBy("file_id").agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("_extent"))
    rows = rows.join(extent, "file_id").withColumn("_size", size_class(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.col("_extent"))).drop("_extent")
    rows = materialize(rows, "boxes")
    sizes = rows.groupBy("file_id").agg(F.collect_set("_size").alias("_sizes"))  # a few numbers a file
    names = [c for c in rows.columns if c != "file_id"]
    wider = in_cells(rows.join(sizes, "file_id"), F.explode(F.filter("_sizes", lambda v: v >= F.col("_size"))))
    a = wider.select("file_id", "grid", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in names])
    b = in_cells(rows, F.col("_size")).select("file_id", "grid", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in names])
    below = (lambda p, q: F.col(p) < F.col(q)) if strict else (lambda p, q: F.col(p) <= F.col(q))
    once = F.when(F.col("a__size") == F.col("b__size"), F.col("a_id") < F.col("b_id")).otherwise(F.col("a_id") != F.col("b_id"))
    keep = once & below("a_x0", "b_x1") & below("b_x0", "a_x1") & below("a_y0", "b_y1") & below("b_y0", "a_y1")
    side = F.pow(F.lit(2.0), F.col("grid"))
    keep = keep & (F.floor(F.greatest("a_x0", "b_x0") / side) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / side) == F.col("cy"))
    if more:
        half = math.floor(time_window / 2 + 0.5)
        keep = keep & (F.col("a_z0") - half <= F.col("b_z1") + half) & (F.col("b_z0") - half <= F.col("a_z1") + half)
    if apart:
        keep = keep & (F.col(f"a_{apart}") != F.col(f"b_{apart}"))
    met = a.join(b, ["file_id", "grid", "cx", "cy"]).filter(keep)
    return met.select("file_id", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def overlap_groups(boxes: DataFrame, time_window: float = math.inf) -> DataFrame:
    """file_id, id and group_id (the smallest id reachable by overlaps) of every box, also of those alone. Pairs are listed with a
    finite time_window only."""
    if not math.isfinite(time_window):
        return box_components(boxes)
    pairs = overlap_pairs(boxes, time_window)
    nodes = materialize(boxes.select("file_id", "id").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    x, y = nodes.toDF("file_id", "a", "na"), nodes.toDF("file_id", "b", "nb")
    found = connected_components(pairs.join(x, ["file_id", "a"]).join(y, ["file_id", "b"]), "na", "nb")
    reached = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = reached.groupBy("component").agg(F.min("id").alias("group_id"))
    return reached.join(lowest, "component").select("file_id", "id", "group_id")


def segment_overlaps(segments: DataFrame) -> DataFrame:
    """n_overlaps of every segment (file_id, track_id, segment, x0..y1): segments of other tracks of the file
    whose boxes overlap strictly."""
    rows = materialize(segments.withColumn("id", F.monotonically_increasing_id()), "segments")
    n = apart_counts(rows, "track_id").withColumnRenamed("n", "n_overlaps")
    return rows.join(n, "id", "left").na.fill({"n_overlaps": 0}).drop("id")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest left; fewer than three where all points
    lie on a line."""
    points = np.unique(np.column_stack([x, y]), axis=0)
    if len(points) < 3:
        return points
    points = points.tolist()

    def chain(rows: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def ring_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = (corners - corners[0]).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


#: Points of a group that one task takes the hull of; larger groups are dealt into parts first.
HULL = 100_000


def hull_corners(points: DataFrame, by: list[str]) -> DataFrame:
    """Corners (ord, x, y) of the convex hull of each group of points. The corners of parts of a group are found
    first, so that no task holds all points of a large one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by).schema)
    rows = points.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    sizes = materialize(rows.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    # groups are few bytes and much work: their tasks are not to be merged
    runs = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("_n")).first()[0] or 0) // HULL))
    parts = sizes.select(*by, F.ceil(F.col("_n") / HULL).cast("int").alias("_parts"))
    rows = rows.join(parts, by).withColumn("_part", F.pmod(F.xxhash64("x", "y"), "_parts").cast("int"))

    def corners(batches):
        batches = list(batches)
        if not batches:
            return
        groups = pa.Table.from_batches(batches).group_by([*by, "_parts", "_part"]).aggregate([("x", "list"), ("y", "list")])
        found = [hull(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(groups.column("x_list"), groups.column("y_list"))]
        of = groups.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
        place = np.concatenate([np.arange(1, len(f) + 1, dtype=np.int32) for f in found])
        at = np.concatenate([np.asarray(f, np.float64).reshape(-1, 2) for f in found])
        yield from pa.table({**{c: of.column(c) for c in (*by, "_parts")}, "ord": place, "x": at[:, 0], "y": at[:, 1]}).to_batches()

    hulls = lambda some: some.select(*by, "_parts", "_part", "x", "y").repartition(runs, *by, "_part").mapInArrow(corners, f"{schema}, _parts int, ord int, x double, y double")
    first = hulls(rows)
    if parts.filter("_parts > 1").isEmpty():
        return first.drop("_parts")
    first = materialize(first, "hulls")
    return first.filter("_parts = 1").unionByName(hulls(first.filter("_parts > 1").withColumn("_part", F.lit(0)))).drop("_parts")


def hull_areas(points: DataFrame, by: list[str]) -> DataFrame:
    """area of the convex hull of each group; 0 for fewer than three points and points on a line."""
    ring = Window.partitionBy(*by).orderBy("ord")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = hull_corners(points, by).withColumn("nx", F.coalesce(F.lead("x").over(ring), F.first("x").over(whole))).withColumn("ny", F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)))
    return c.groupBy(*by).agg(F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def track_boxes(tracks: DataFrame, radius_factor: float = 1.3) -> DataFrame:
    """Boxes of tracks (file_id, id = track_id): the centroid and around it the radius of a circle with the area of
    the track's convex hull, times a factor; z0 and z1 are the first and last frame. Tracks of fewer than three
    rows have none."""
    key = ["file_id", "track_id"]
    t = tracks.groupBy(*key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("frame").alias("z0"), F.max("frame").alias("z1"), F.count("*").alias("n")).filter("n >= 3")
    r = F.sqrt(F.col("area") / F.pi()) * radius_factor
    t = t.join(hull_areas(tracks, key), key)
    return t.select("file_id", F.col("track_id").alias("id"), *[(F.col(c[0]) + s * r).alias(c) for c, s in (("x0", -1), ("x1", 1), ("y0", -1), ("y1", 1))], "z0", "z1")


def nastic(tracks: DataFrame, radius_factor: float = 1.0, min_tracks: int = 1, time_window: float = math.inf) -> DataFrame:
    """Clusters of tracks whose boxes overlap, directly or through others: file_id, group_id, area of the convex
    hull of all their rows, diameter of a circle of that area, n tracks, mean x and y of all rows."""
    groups = overlap_groups(track_boxes(tracks, radius_factor), time_window)
    members = materialize(tracks.join(groups.withColumnRenamed("id", "track_id"), ["file_id", "track_id"]), "members")
    key = ["file_id", "group_id"]
    t = members.groupBy(*key).agg(F.count_distinct("track_id").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).filter(F.col("n") >= min_tracks)
    return t.join(hull_areas(members, key), key).select(*key, "area", F.sqrt(4 * F.col("area") / F.pi()).alias("diameter"), "n", "x", "y")


def _busy_segments(tracks: DataFrame, radius_factor: float, overlaps: int) -> tuple[DataFrame, DataFrame]:
    """The segments (id, file_id, track_id, frame, xa, ya, xb, yb) of tracks in overlap groups, and the boxes of those that
    strictly overlap more than `overlaps` segments of other tracks of their group, how many in n_overlaps."""
    groups = overlap_groups(track_boxes(tracks, radius_factor)).withColumnRenamed("id", "track_id")
    w = Window.partitionBy("file_id", "track_id").orderBy("frame")
    s = tracks.join(groups, ["file_id", "track_id"]).select("file_id", "track_id", "group_id", "frame", F.col("x").alias("xa"), F.col("y").alias("ya"), F.lead("x").over(w).alias("xb"), F.lead("y").over(w).alias("yb"))
    sides = {"x0": F.least("xa", "xb"), "x1": F.greatest("xa", "xb"), "y0": F.least("ya", "yb"), "y1": F.greatest("ya", "yb")}
    s = materialize(s.filter("xb IS NOT NULL").withColumns(sides).withColumn("id", F.monotonically_increasing_id()), "segments")
    # a group of tracks is what a file is to the counts
    of_group = s.select(F.xxhash64("file_id", "group_id").alias("file_id"), "id", "track_id", *SIDES)
    busy = apart_counts(of_group, "track_id").withColumnRenamed("n", "n_overlaps").filter(F.col("n_overlaps") > overlaps)
    return s, materialize(of_group.join(busy, "id"), "busy")


def busy_segments(tracks: DataFrame, radius_factor: float = 1.0, overlaps: int = 2) -> DataFrame:
    """file_id, track_id, frame and n_overlaps of the segments that seg_nastic keeps."""
    s, busy = _busy_segments(tracks, radius_factor, overlaps)
    return s.join(busy.select("id", "n_overlaps"), "id").select("file_id", "track_id", "frame", "n_overlaps")


def seg_nastic(tracks: DataFrame, radius_factor: float = 1.0, overlaps: int = 2) -> DataFrame:
    """Clusters of track segments: within a group of overlapping tracks, segments that strictly overlap more than
    `overlaps` segments of other tracks are grouped by their boxes; a group of at least two segments makes a
    convex hull. file_id, cluster, area, diameter of a circle of that area, n (centroids of all tracks of the file
    inside), x and y of the hull's centroid; clusters with fewer than two centroids are dropped."""
    s, busy = _busy_segments(tracks, radius_factor, overlaps)
    cluster = overlap_groups(busy).select("id", F.col("group_id").alias("cluster"))
    big = cluster.groupBy("cluster").count().filter("count > 1").select("cluster")
    ends = s.join(cluster.join(big, "cluster"), "id").select("file_id", "cluster", F.explode(F.array(F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y")))).alias("p"))
    rings = materialize(hull_corners(ends.select("file_id", "cluster", "p.x", "p.y"), ["file_id", "cluster"]).withColumnRenamed("cluster", "poly_id"), "rings")
    centres = tracks.groupBy("file_id", F.col("track_id").alias("point_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    n = points_in_polygons(centres, rings).groupBy("file_id", "poly_id").agg(F.count("*").alias("n")).filter("n >= 2")
    found = polygon_summary(rings).join(n, ["file_id", "poly_id"])
    return found.select("file_id", F.col("poly_id").alias("cluster"), "area", F.sqrt(4 * F.col("area") / F.pi()).alias("diameter"), "n", "x", "y")


def in_groups(tracks: DataFrame, groups: DataFrame) -> DataFrame:
    """file_id, track_id and whether a track of at least three rows shares an overlap group with another."""
    shared = groups.groupBy("file_id", "group_id").count().filter("count > 1")
    inside = groups.join(shared, ["file_id", "group_id"]).select("file_id", F.col("id").alias("track_id"), F.lit(True).alias("inside"))
    t = tracks.groupBy("file_id", "track_id").agg((F.count("*") >= 3).alias("enough"))
    return t.join(inside, ["file_id", "track_id"], "left").select("file_id", "track_id", (F.col("enough") & F.coalesce("inside", F.lit(False))).alias("in_group"))
