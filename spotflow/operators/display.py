"""What plots need: closed outlines, padded faces, scale bars, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Lengths that a scale bar may have, exponents of its units and their names.
NEAT = (1, 2, 5, 10, 20, 50, 100, 200, 500)
UNITS = ((3, "km"), (0, "m"), (-3, "mm"), (-6, "µm"), (-9, "nm"), (-12, "pm"))
#: Colours that colour-blind people tell apart, red, green and blue from 0 to 255.
DISTINCT = (
    ("red", 230, 25, 75), ("green", 60, 180, 75), ("yellow", 255, 225, 25), ("blue", 0, 130, 200), ("orange", 245, 130, 48),
    ("cyan", 70, 240, 240), ("magenta", 240, 50, 230), ("teal", 0, 128, 128), ("lavender", 220, 190, 255), ("maroon", 128, 0, 0),
)
#: Eight anchors of each colour map, evenly spaced.
ANCHORS = {
    "inferno": ((0, 0, 4), (40, 11, 84), (101, 21, 110), (159, 42, 99), (212, 72, 66), (245, 125, 21), (250, 193, 39), (252, 255, 164)),
    "plasma": ((13, 8, 135), (84, 2, 163), (139, 10, 165), (185, 50, 137), (219, 92, 104), (244, 136, 73), (254, 188, 43), (240, 249, 33)),
}


def patch_edges(polygons: DataFrame) -> DataFrame:
    """Closed outlines: the corners of each ring (file_id, poly_id, ord, x, y) in order, the first again behind the last,
    and a separator without coordinates."""
    key = ("file_id", "poly_id")
    corners = polygons.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("ord")).alias("ord"), "x", "y")
    ends = corners.groupBy(*key).agg(F.count("*").cast("int").alias("n"), F.min_by(F.struct("x", "y"), "ord").alias("p"))
    none = F.lit(None).cast("double")
    closing = ends.select(*key, (F.col("n") + 1).alias("ord"), "p.x", "p.y")
    return corners.unionByName(closing).unionByName(ends.select(*key, (F.col("n") + 2).alias("ord"), none.alias("x"), none.alias("y")))


def patch_faces(polygons: DataFrame) -> DataFrame:
    """A row a ring with its corners' numbers `ord` in order, padded with nulls to the most corners of a ring in the
    file. A ring's corners are one row, as a drawing needs them."""
    rings = polygons.groupBy("file_id", "poly_id").agg(F.array_sort(F.collect_list("ord")).alias("face"))
    most = rings.groupBy("file_id").agg(F.max(F.size("face")).alias("most"))
    pad = F.array_repeat(F.lit(None).cast("int"), F.col("most") - F.size("face"))
    return rings.join(most, "file_id").select("file_id", "poly_id", F.concat("face", pad).alias("face"))


def scale_bars(axes: DataFrame, unit_exponent: int) -> DataFrame:
    """file_id, length and unit of a scale bar for axes (file_id, x_low, x_high, y_low, y_high), its width and its
    rectangle's place: of the three neat lengths nearest to a tenth to three tenths of the width (in steps of half
    a hundredth), the one nearest to a fifth. Axes without a width have none."""
    units = F.array(*[F.struct(F.lit(e).alias("exponent"), F.lit(u).alias("unit")) for e, u in UNITS])
    a = axes.withColumn("w", F.col("x_high") - F.col("x_low")).withColumn("h", F.col("y_high") - F.col("y_low")).filter("w > 0")
    a = a.withColumn("u", F.explode(units)).withColumn("length", F.explode(F.array(*map(F.lit, NEAT)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(40))))
    a = a.select("file_id", "x_low", "x_high", "y_low", "y_high", "w", "h", "u.*", "length", "step")
    off = F.abs((0.1 + F.col("step") * 0.005) * F.col("w") * F.pow(F.lit(10.0), unit_exponent - F.col("exponent")) / F.col("length") - 1)
    a = a.withColumn("off", F.round(off, 9)).withColumn("share", F.col("length") * F.pow(F.lit(10.0), F.col("exponent") - unit_exponent) / F.col("w"))
    near = Window.partitionBy("file_id").orderBy("off", "length", F.desc("exponent"), "step")
    three = a.withColumn("near", F.row_number().over(near)).filter("near <= 3")
    one = three.withColumn("pick", F.row_number().over(Window.partitionBy("file_id").orderBy(F.round(F.abs(F.col("share") - 0.2), 9), "near"))).filter("pick = 1")
    width, margin = F.col("share") * F.col("w"), 0.07
    return one.select("file_id", "length", "unit", width.alias("width"), (0.015 * F.col("h")).alias("height"), (F.col("x_high") - margin * F.col("w") - width).alias("x"), (F.col("y_high") - (margin + 0.015) * F.col("h")).alias("y"))


def distinct_colors(spark: SparkSession, names: str | None = None, cycle: int | None = None) -> DataFrame:
    """i, name, r, g and b (0 to 1) of the distinct colours: the first `cycle`, those of `names` like "red/cyan" in
    their order (unknown ones are left out), or all."""
    table = spark.createDataFrame([(i, n, float(r), float(g), float(b)) for i, (n, r, g, b) in enumerate(DISTINCT, 1)], "i int, name string, r double, g double, b double")
    table = table.select("i", "name", *[(F.col(c) / 255).alias(c) for c in "rgb"])
    if cycle is not None:
        return table.filter(F.col("i") <= cycle)
    if names is None:
        return table
    asked = spark.range(1).select(F.posexplode(F.split(F.lit(names), "/")).alias("at", "name"))
    return asked.join(table.drop("i"), "name").select((F.col("at") + 1).alias("i"), "name", "r", "g", "b")


def color_map(spark: SparkSession, name: str, rows: int = 256, reverse: bool = False) -> DataFrame:
    """i (from 1), r, g and b (0 to 1): a colour map by linear interpolation between its anchors; black and white are
    maps of one colour."""
    i = F.col("id").cast("int")
    at = F.lit(rows - 1) - i if reverse else i
    table = spark.range(rows)
    if name in ("black", "white"):
        one = F.lit(float(name == "white"))
        return table.select((i + 1).alias("i"), *[one.alias(c) for c in "rgb"])
    anchors, step = ANCHORS[name], (rows - 1) / (len(ANCHORS[name]) - 1)
    k = F.least(F.floor(at / step), F.lit(len(anchors) - 2)).cast("int")
    t = at / step - k

    def channel(c: int) -> Column:
        values = F.array(*[F.lit(a[c] / 255) for a in anchors])
        return F.get(values, k) * (1 - t) + F.get(values, k + 1) * t

    return table.select((i + 1).alias("i"), *[channel(c).alias(n) for c, n in enumerate("rgb")])


def wavelength_colors(spark: SparkSession) -> DataFrame:
    """nm (380 to 780), r, g and b (0 to 1): a colour for each wavelength, linear between the nodes violet 380, blue 440,
    cyan 490, green 510, yellow 580 and red 645, and dimmed to three tenths towards both ends from 420 and 700 on."""
    nm = F.col("id")
    ramp = lambda a, b: (nm - a) / float(b - a)
    r = F.when(nm < 440, 1 - ramp(380, 440)).when(nm < 510, 0.0).when(nm < 580, ramp(510, 580)).otherwise(1.0)
    g = F.when(nm < 440, 0.0).when(nm < 490, ramp(440, 490)).when(nm < 580, 1.0).when(nm < 645, 1 - ramp(580, 645)).otherwise(0.0)
    b = F.when(nm < 490, 1.0).when(nm < 510, 1 - ramp(490, 510)).otherwise(0.0)
    dim = F.when(nm < 420, 0.3 + 0.7 * ramp(380, 420)).when(nm > 700, 0.3 + 0.7 * (1 - ramp(700, 780))).otherwise(1.0)
    return spark.range(380, 781).select(nm.cast("int").alias("nm"), *[(c * dim).alias(n) for c, n in zip((r, g, b), "rgb")])
