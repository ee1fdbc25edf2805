"""Views of the benchmark tables as tracks, points, localizations, pixels and boxes.

Each view has a DataFrame form and the same in DuckDB SQL, so that operators can be checked on the
driver's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, track_id, frame, x, y: a track for each user, without gaps."""
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    y = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("file_id"), F.col("user_id").alias("track_id"), frame.alias("frame"), F.col("value").alias("x"), y.alias("y"))


TRACKS = """SELECT CAST(0 AS BIGINT) AS file_id, user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame,
  value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events"""


def gapped_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the hour since 2024 as frame and the first event of an hour, so with gaps."""
    hour = F.floor(F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("int") + 1
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", hour.alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    rows = rows.groupBy("user_id", "frame").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p"))
    return rows.select(F.lit(0).cast("long").alias("file_id"), F.col("user_id").alias("track_id"), "frame", "p.x", "p.y")


GAPPED_TRACKS = """SELECT CAST(0 AS BIGINT) AS file_id, user_id AS track_id, frame, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y FROM (
  SELECT user_id, event_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS INTEGER) + 1 AS frame, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events)
  GROUP BY user_id, frame"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, point_id, x, y and class: the first two dimensions of each embedding, in thousandths."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("file_id"), F.col("vec_id").alias("point_id"), (1000 * e[0].cast("double")).alias("x"), (1000 * e[1].cast("double")).alias("y"), F.col("label").alias("class"))


POINTS = "SELECT CAST(0 AS BIGINT) AS file_id, vec_id AS point_id, 1000 * CAST(embedding[1] AS DOUBLE) AS x, 1000 * CAST(embedding[2] AS DOUBLE) AS y, label AS class FROM embeddings"


def localizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, frame, x_nm, y_nm, psf_nm, photons, background, precision_nm from order lines."""
    rows = table(spark, sf_dir, "lineitem")
    frame = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return rows.select(
        F.lit(0).cast("long").alias("file_id"),
        frame.alias("frame"),
        (F.col("l_partkey") % 10007).cast("double").alias("x_nm"),
        (F.col("l_suppkey") % 10007 + F.col("l_quantity")).alias("y_nm"),
        F.col("l_quantity").alias("psf_nm"),
        F.col("l_extendedprice").alias("photons"),
        (F.col("l_tax") + 0.0).alias("background"),
        (F.col("l_discount") + 0.0).alias("precision_nm"),
    )


LOCALIZATIONS = """SELECT CAST(0 AS BIGINT) AS file_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame, CAST(l_partkey % 10007 AS DOUBLE) AS x_nm,
  l_suppkey % 10007 + l_quantity AS y_nm, l_quantity AS psf_nm, l_extendedprice AS photons, l_tax + 0e0 AS background, l_discount + 0e0 AS precision_nm FROM lineitem"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, frame, row, col, adu: orders as frames of 32 by 32 pixels."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit(0).cast("long").alias("file_id"), F.floor(k / 1024).cast("int").alias("frame"), (F.floor(k / 32) % 32).cast("int").alias("row"), (k % 32).cast("int").alias("col"), F.col("o_totalprice").alias("adu")
    )


PIXELS = """SELECT CAST(0 AS BIGINT) AS file_id, CAST(o_orderkey // 1024 AS INTEGER) AS frame, CAST((o_orderkey // 32) % 32 AS INTEGER) AS row, CAST(o_orderkey % 32 AS INTEGER) AS col, o_totalprice AS adu FROM orders"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, id, x0..z1: bounding boxes of ten frames of each compact track."""
    part = F.floor((F.col("frame") - 1) / 10).cast("long")
    t = compact_tracks(spark, sf_dir).groupBy("file_id", (F.col("track_id") * 1000 + part).alias("id"))
    return t.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("frame").alias("z0"), F.max("frame").alias("z1"))


def compact_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, track_id, frame, x, y: the tracks of users shrunk around places of their own, in two files."""
    t = tracks(spark, sf_dir)
    x, y = F.col("track_id") * 61 % 397 + F.col("x") / 64, F.col("track_id") * 89 % 397 + F.col("y") / 8
    return t.select((F.col("track_id") % 2).alias("file_id"), "track_id", "frame", x.alias("x"), y.alias("y"))


COMPACT_TRACKS = f"SELECT track_id % 2 AS file_id, track_id, frame, track_id * 61 % 397 + x / 64 AS x, track_id * 89 % 397 + y / 8 AS y FROM ({TRACKS})"
BOXES = f"""SELECT file_id, track_id * 1000 + (frame - 1) // 10 AS id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(frame) AS z0, max(frame) AS z1
  FROM ({COMPACT_TRACKS}) GROUP BY file_id, track_id * 1000 + (frame - 1) // 10"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, frame, loc_id, x, y: events as localizations in frames of six hours, in two files whose loc_ids
    overlap."""
    hour = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    rows = table(spark, sf_dir, "events")
    return rows.select((F.col("event_id") % 2).alias("file_id"), F.floor(hour / 6).cast("int").alias("frame"), F.floor(F.col("event_id") / 2).cast("long").alias("loc_id"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


POSITIONS = """SELECT event_id % 2 AS file_id, CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) // 6 AS INTEGER) AS frame, event_id // 2 AS loc_id,
  value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events"""


def file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points in two files whose point_ids overlap."""
    p = points(spark, sf_dir)
    return p.select((F.col("point_id") % 2).alias("file_id"), F.floor(F.col("point_id") / 2).cast("long").alias("point_id"), "x", "y", "class")


FILE_POINTS = f"SELECT point_id % 2 AS file_id, point_id // 2 AS point_id, x, y, class FROM ({POINTS})"
#: Corners of a polygon with a dent, around its place.
DENTED = ((-40, -35), (40, -35), (40, 35), (0, 5), (-40, 35))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, poly_id, ord, x, y: a dented polygon for every nation, in two files."""
    k = F.col("n_nationkey").cast("long")
    corners = F.posexplode(F.array(*[F.struct(F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy")) for x, y in DENTED])).alias("i", "c")
    rows = table(spark, sf_dir, "nation").select((k % 2).alias("file_id"), k.alias("poly_id"), ((k * 7 % 25 - 12) * 20).alias("cx"), ((k * 11 % 25 - 12) * 20).alias("cy"), corners)
    return rows.select("file_id", "poly_id", (F.col("i") + 1).alias("ord"), (F.col("cx") + F.col("c.dx")).alias("x"), (F.col("cy") + F.col("c.dy")).alias("y"))


POLYGONS = f"""SELECT CAST(n_nationkey AS BIGINT) % 2 AS file_id, CAST(n_nationkey AS BIGINT) AS poly_id, CAST(i AS INTEGER) AS ord, (n_nationkey * 7 % 25 - 12) * 20 + dx AS x, (n_nationkey * 11 % 25 - 12) * 20 + dy AS y
  FROM nation, (VALUES {', '.join(f'({i}, {x}e0, {y}e0)' for i, (x, y) in enumerate(DENTED, 1))}) v(i, dx, dy)"""
