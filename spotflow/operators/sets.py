"""Sets whose order counts, edges that occur once, smallest rows, rows near others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spotflow.operators.ordered import ordinals


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Every value once with its number i by its first occurrence."""
    first = rows.groupBy(value).agg(F.min(order).alias("_first"))
    return ordinals(first, [], ["_first", value], "i").select(value, "i")


def difference_in_order(rows: DataFrame, others: DataFrame, value: str, order: str) -> DataFrame:
    """Values of rows that others don't have, numbered by their first occurrence."""
    return distinct_in_order(rows.join(others.select(value).distinct(), value, "left_anti"), value, order)


def common_in_order(rows: DataFrame, others: DataFrame, value: str, order: str) -> DataFrame:
    """Values of rows that others have too, numbered by their first occurrence in rows."""
    return distinct_in_order(rows.join(others.select(value).distinct(), value, "left_semi"), value, order)


def border_edges(edges: DataFrame, *by: str) -> DataFrame:
    """Edges (a, b), whichever way round, that occur exactly once; the smaller end first."""
    both = edges.groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count()
    return both.filter("count = 1").drop("count")


def smallest(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group in an order, numbered by k. Spark keeps k rows a group before it shuffles."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= k)


def near_rows(rows: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """Rows whose x and y are both within a tolerance of those of some other row: an equi-join on cells of the
    tolerance, on the keys of which rows are kept once."""
    cell = [F.floor(F.col(c) / tolerance) for c in ("x", "y")]
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    o = others.select(F.col("x").alias("_x"), F.col("y").alias("_y"), cell[0].alias("_cx"), cell[1].alias("_cy"), F.explode(ring).alias("_to")).distinct()
    o = o.select("_x", "_y", (F.col("_cx") + F.col("_to.i")).alias("_cx"), (F.col("_cy") + F.col("_to.j")).alias("_cy"))
    near = (cell[0] == F.col("_cx")) & (cell[1] == F.col("_cy")) & (F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance)
    return rows.join(o, near, "left_semi")
