"""An adaptive partition of points: blocks of as many places each, wherever the points lie, and a tree over them.

Places are put in the order of a space-filling curve over their file's box and cut into runs of equal size, so that a
dense spot is many small blocks and an empty region none. A block knows its box; FAN blocks that follow each
other share a node of the next level, which knows the box around theirs. A search goes down the tree by equi-joins on
the node and leaves out what lies too far away.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotflow.operators.ordered import ordinals
from spotflow.session import materialize

#: Places in a block, and children of a node.
SIZE, FAN = 256, 64
#: Searches that a task compares with a block at a time.
ASKS = 4096
#: Bits of the curve's steps along an axis.
STEPS = 31


def _spread(v: Column) -> Column:
    """The bits of a number below 2**31 at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def box_distance(x: Column, y: Column, box: str = "") -> Column:
    """Distance of a point from the box x0, x1, y0, y1 (0 inside)."""
    x0, x1, y0, y1 = (F.col(f"{box}{c}") for c in ("x0", "x1", "y0", "y1"))
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - x, x - x1, zero), F.greatest(y0 - y, y - y1, zero))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over as many tasks as `spark.sql.shuffle.partitions` says. Points are few bytes and much work: by their
    bytes, adaptive execution would put them all into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass
class Blocks:
    """places: the rows with `block` and `blocks`, how many their file has; levels: file_id, node, parent, x0, x1, y0, y1 and n of the blocks, then of the
    nodes above them, up to at most FAN nodes a file."""

    places: DataFrame
    levels: list[DataFrame]

    def meet(self, asks: DataFrame, near: Callable[[], Column]) -> DataFrame:
        """asks with `block` for every block of their file for whose box (columns x0, x1, y0, y1) near() holds;
        it must hold for a box around another one if it does for that."""
        top = self.levels[-1].drop("parent", "n").withColumnRenamed("node", "_node")
        top = F.broadcast(top) if top.count() <= 10_000 else top
        found = asks.join(top, "file_id").filter(near()).select(*asks.columns, "_node")
        for level in self.levels[-2::-1]:
            below = level.select("file_id", F.col("node").alias("_child"), F.col("parent").alias("_node"), "x0", "x1", "y0", "y1")
            found = found.join(below, ["file_id", "_node"]).filter(near()).select(*asks.columns, F.col("_child").alias("_node"))
        return found.withColumnRenamed("_node", "block")


    def close(self, radius: float) -> tuple[DataFrame, DataFrame]:
        """Which nodes lie near the blocks of a file: file_id, a (a block), level and node of nodes no point of which is farther
        than radius from any point of the block (the highest such nodes), and file_id, a and b of the blocks that have
        points nearer and may have others. A dense region is few nodes to its blocks, however many blocks it is."""
        box = ("x0", "x1", "y0", "y1")
        own = self.levels[0].select("file_id", F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in box])
        span = lambda lo, hi: F.greatest(F.col(f"{lo}") - F.col(f"a{hi}"), F.col(f"a{lo}") - F.col(f"{hi}"), F.lit(0.0))
        whole = lambda lo, hi: F.greatest(F.col(f"{hi}") - F.col(f"a{lo}"), F.col(f"a{hi}") - F.col(f"{lo}"))
        least, most = F.hypot(span("x0", "x1"), span("y0", "y1")), F.hypot(whole("x0", "x1"), whole("y0", "y1"))
        inside, found = None, None
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth].select("file_id", F.col("node").alias("_node"), F.col("parent").alias("_parent"), *box)
            if found is None:
                top = F.broadcast(level) if level.count() <= 10_000 else level
                met = own.join(top, "file_id")
            else:
                met = found.join(level, ["file_id", "_parent"])
            met = met.withColumn("_in", most <= radius * (1 - 1e-12)).filter(least <= radius * (1 + 1e-12))
            met = materialize(met.select("file_id", "a", *[f"a{c}" for c in box], "_node", "_in"), "close")
            some = met.filter("_in").select("file_id", "a", F.lit(depth).alias("level"), F.col("_node").alias("node"))
            inside = some if inside is None else inside.unionByName(some)
            found = met.filter("NOT _in").drop("_in").withColumnRenamed("_node", "_parent")
        return inside, found.select("file_id", "a", F.col("_parent").alias("b"))


def blocks_of(places: DataFrame, size: int = SIZE) -> Blocks:
    """Blocks of the rows of places (file_id, x, y and others; finite and distinct by file_id, x and y): `size` to twice as
    many rows each, fewer only in a file that has fewer."""
    ends = places.groupBy("file_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_extent"), F.count("*").alias("_n"))
    step = lambda c: F.floor((F.col(c) - F.col(f"_{c}")) / F.nullif(F.col("_extent"), F.lit(0.0)) * float((1 << STEPS) - 1)).cast("long")
    curve = F.coalesce(_spread(step("x")).bitwiseOR(F.shiftleft(_spread(step("y")), 1)), F.lit(0))
    coded = places.join(ends, "file_id").withColumn("_curve", curve)
    last = F.greatest(F.floor(F.col("_n") / size) - 1, F.lit(0))
    numbered = ordinals(coded, ["file_id"], ["_curve", "x", "y"], "_i").withColumn("block", F.least(F.floor((F.col("_i") - 1) / size), last))
    rows = materialize(numbered.select(*places.columns, "block", (last + 1).alias("blocks")), "blocks")
    box = (F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"))
    level = rows.select("file_id", F.col("block").alias("node"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"), F.lit(1).alias("n"))
    levels = []
    while True:
        level = level.groupBy("file_id", "node").agg(*box).withColumn("parent", F.floor(F.col("node") / FAN))
        level = materialize(level, "level")
        levels.append(level)
        if level.filter(F.col("node") >= FAN).isEmpty():
            return Blocks(rows, levels)
        level = level.drop("node").withColumnRenamed("parent", "node")


def at_level(rows: DataFrame, depth: int) -> DataFrame:
    """rows (with block) with level and node, the node of that level above their block."""
    return rows.withColumn("node", F.floor(F.col("block") / FAN**depth)).withColumn("level", F.lit(depth))


def dealt(asks: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `part`: the searches of a block (file_id, block) dealt into parts of about ASKS by a hash, and the rows of
    the block repeated for each part."""
    n = materialize(asks.groupBy("file_id", "block").agg((F.floor(F.count("*") / ASKS) + 1).alias("_parts")), "asks")
    hashed = F.pmod(F.xxhash64(*[c for c, t in asks.dtypes if not t.startswith("array")]), F.col("_parts"))
    return asks.join(n, ["file_id", "block"]).withColumn("part", hashed).drop("_parts"), rows.join(n, ["file_id", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
