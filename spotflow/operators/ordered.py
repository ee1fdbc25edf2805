"""Ranks and medians of ordered values without a task that holds a whole group.

Rows are dealt by range of their order; the rows of a range are numbered in one task, and what the ranges
before it hold, a small table, is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spotflow.session import materialize


def running_total(rows: DataFrame, by: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """rows with `name`: the sum of the whole numbers `weight` over the rows of the group up to this one,
    itself included. `order` must tell the rows of a group apart."""
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))  # a row a group and range
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by]
    joined = dealt.join(sums.toDF(*[f"_s_{c}" for c in by], "_s_range", "_before"), [*keys, F.col("_range") == F.col("_s_range")])
    return joined.withColumn(name, (F.sum(weight).over(own) + F.col("_before")).cast("long")).select(*rows.columns, name)


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 in the order of their group."""
    return running_total(rows.withColumn("_one", F.lit(1)), by, order, "_one", name).drop("_one")


def medians(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row a group with the exact median of each column, null and NaN left out: equal values are counted first,
    then the middle ranks are picked from the running total of the counts."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns])
    values = rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.name", "p.value").filter("value IS NOT NULL")
    counted = values.groupBy(*by, "name", "value").agg(F.count("*").alias("n"))
    ranked = running_total(counted, [*by, "name"], ["value"], "n", "upto")
    sizes = counted.groupBy(*by, "name").agg(F.sum("n").alias("m")).toDF(*[f"_m_{c}" for c in by], "_m_name", "m")
    on = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in by] + [F.col("name") == F.col("_m_name")]
    met = ranked.join(sizes, on).select(*by, "name", "value", "n", "upto", "m")
    low, high = F.floor((F.col("m") + 1) / 2), F.floor(F.col("m") / 2) + 1
    middle = met.filter((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high))
    found = middle.groupBy(*by).pivot("name", columns).agg(F.avg("value"))
    return rows.select(*by).distinct().join(found.toDF(*[f"_f_{c}" for c in by], *columns), [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in by], "left").select(*by, *columns)
