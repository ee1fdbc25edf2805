"""Mean squared displacement, diffusion fits and track features: joins, groups and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotflow.session import materialize

TRACK = ("file_id", "track_id")
#: Rows of a track that one part of its self-join holds.
PART = 4_096


def valid_tracks(tracks: DataFrame, min_track_length: int = 1) -> DataFrame:
    """Tracks with their number of rows, span of frames and whether they are long enough for displacements:
    the span reaches min_track_length and there are at least three rows."""
    span = (F.max("frame") - F.min("frame") + 1).cast("long")
    t = tracks.groupBy(*TRACK).agg(F.count("*").alias("n"), span.alias("span"))
    return t.withColumn("is_valid", (F.col("span") >= min_track_length) & (F.col("n") >= 3))


def displacement_pairs(tracks: DataFrame, min_track_length: int = 1) -> DataFrame:
    """file_id, track_id, lag and squared displacement in square micrometres of all pairs of a track's
    rows (coordinates in nanometres). Rows without a frame or coordinate are left out. The validity of a track
    comes from the same partitioning as the self-join, so tracks are shuffled once. The second side of a track of
    more than PART rows is dealt into parts, so that no task meets all pairs of a long track."""
    by = Window.partitionBy(*TRACK)
    rows = tracks.filter("frame IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumn("rows", F.count("*").over(by)).withColumn("span", F.max("frame").over(by) - F.min("frame").over(by) + 1)
    rows = rows.filter((F.col("rows") >= 3) & (F.col("span") >= min_track_length)).withColumn("parts", F.ceil(F.col("rows") / PART).cast("int"))
    a = rows.select(*TRACK, F.col("frame").alias("fa"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = rows.select(*TRACK, F.col("frame").alias("fb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.pmod(F.xxhash64("frame"), "parts").cast("int").alias("part"))
    dx, dy = (F.col("xb") - F.col("xa")) / 1000, (F.col("yb") - F.col("ya")) / 1000
    return a.join(b, [*TRACK, "part"]).filter("fa < fb").select(*TRACK, (F.col("fb") - F.col("fa")).alias("lag"), (dx * dx + dy * dy).alias("d2"))


def msd(tracks: DataFrame, frame_rate: float = 50.0, min_track_length: int = 1) -> DataFrame:
    """file_id, track_id, lag, lag_s, msd, sd (of the population) and n."""
    curves = displacement_pairs(tracks, min_track_length).groupBy(*TRACK, "lag").agg(F.avg("d2").alias("msd"), F.stddev_pop("d2").alias("sd"), F.count("*").alias("n"))
    return curves.withColumn("lag_s", F.col("lag") / frame_rate)


def mean_msd(curves: DataFrame) -> DataFrame:
    """Over all tracks of a file: weighted mean, its standard deviation with reliability weights, effective
    degrees of freedom and standard error. Lags that a single track has are left out (no deviation)."""
    n, m = F.col("n").cast("double"), F.col("msd")
    curves = materialize(curves.select("file_id", "lag", "lag_s", "msd", "n"), "curves")  # read twice
    sums = curves.groupBy("file_id", "lag", "lag_s").agg(F.sum(n).alias("w"), F.sum(n * n).alias("ww"), F.sum(n * m).alias("wm"))
    means = sums.withColumn("mean", F.col("wm") / F.col("w"))
    back = curves.join(means.select("file_id", "lag", "mean"), ["file_id", "lag"])
    spread = back.groupBy("file_id", "lag").agg(F.sum(n * (m - F.col("mean")) ** 2).alias("s"))
    out = means.join(spread, ["file_id", "lag"])
    sd = F.sqrt(F.col("s") / F.nullif(F.col("w") - F.col("ww") / F.col("w"), F.lit(0.0)))
    out = out.select("file_id", "lag", "lag_s", "mean", sd.alias("sd"), (F.col("w") * F.col("w") / F.col("ww")).alias("dof"))
    return out.filter("sd IS NOT NULL").withColumn("sem", F.col("sd") / F.sqrt("dof"))


def linear_regression(rows: DataFrame, by: list[str], x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """c0, c1 of the weighted least squares line of each group, and adj_r2 from the unweighted residuals."""
    X, Y, W = (F.col(c).cast("double") for c in (x, y, w))
    s = rows.groupBy(*by).agg(
        F.sum(W).alias("sw"), F.sum(W * X).alias("sx"), F.sum(W * Y).alias("sy"), F.sum(W * X * X).alias("sxx"), F.sum(W * X * Y).alias("sxy"),
        F.count("*").alias("n_points"), F.avg(Y).alias("mean_y"),
    )
    det = F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    s = s.withColumn("c1", (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).withColumn("c0", (F.col("sy") - F.col("c1") * F.col("sx")) / F.col("sw"))
    # residuals in a second pass over the rows, which are partitioned by group already
    back = rows.select(*by, X.alias("_x"), Y.alias("_y")).join(s.select(*by, "c0", "c1", "mean_y", "n_points"), by)
    res, tot = F.sum((F.col("_y") - F.col("c0") - F.col("c1") * F.col("_x")) ** 2), F.sum((F.col("_y") - F.col("mean_y")) ** 2)
    line = back.groupBy(*by, "c0", "c1", "n_points").agg((1 - res / F.nullif(tot, F.lit(0.0))).alias("r2"))
    n = F.col("n_points")
    return line.select(*by, "c0", "c1", F.when(n > 2, 1 - (1 - F.col("r2")) * (n - 1) / (n - 2)).alias("adj_r2"), "n_points")


def fit_msd(curves: DataFrame, first: int = 2, last: int = 4, tracks: DataFrame | None = None) -> DataFrame:
    """d, adj_r2, c0, c1 and is_fitted of each track from the points first..last of its curve, weighted by
    their counts. A curve is fitted if it has no gap up to `last`; else is_fitted is false and the rest 0."""
    points = curves.filter(F.col("lag") <= last)
    whole = points.groupBy(*TRACK).agg((F.count("*") == last).alias("whole"))
    used = points.filter(F.col("lag") >= first).select(*TRACK, F.col("lag_s").alias("x"), F.col("msd").alias("y"), F.col("n").alias("w"))
    line = linear_regression(used, [*TRACK])
    ok = F.coalesce(F.col("whole") & F.col("c1").isNotNull(), F.lit(False))
    value = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    out = whole.join(line, [*TRACK], "left")
    return out.select(*TRACK, (value("c1") / 4).alias("d"), value("adj_r2").alias("adj_r2"), value("c0").alias("c0"), value("c1").alias("c1"), ok.alias("is_fitted"))


def valid_diffusion(fits: DataFrame, adj_r2: float = 0.4) -> DataFrame:
    """Fits with a positive, finite coefficient and a good enough line, with log10 of the coefficient."""
    return fits.filter((F.col("d") > 0) & (F.col("adj_r2") >= adj_r2) & (F.col("d") < float("inf"))).withColumn("log_d", F.log10("d"))


def log_d_stats(valid: DataFrame, split: float = -1.75) -> DataFrame:
    """Per file: n, mu and sigma of log10 D (sample deviation), D at mu, and the share at or below split."""
    return valid.groupBy("file_id").agg(
        F.count("*").alias("n"), F.avg("log_d").alias("mu"), F.stddev_samp("log_d").alias("sigma"), F.pow(F.lit(10.0), F.avg("log_d")).alias("d1"),
        F.avg((F.col("log_d") <= split).cast("double")).alias("slow_fraction"),
    )


def track_features(tracks: DataFrame, frame_rate: float = 50.0) -> DataFrame:
    """n, duration_s, displacement (first to last row) and range (diagonal of the bounds) of each track. Rows without a
    finite coordinate or a frame count in n only; a track of such rows has no displacement or range."""
    fine = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("frame").isNotNull(), F.lit(False))
    p, frame, x, y = F.struct("x", "y"), *(F.when(fine, F.col(c)) for c in ("frame", "x", "y"))
    t = tracks.groupBy(*TRACK).agg(
        F.count("*").alias("n"), ((F.max("frame") - F.min("frame") + 1) / frame_rate).alias("duration_s"), F.min_by(p, frame).alias("a"), F.max_by(p, frame).alias("b"),
        (F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h"),
    )
    return t.select(*TRACK, "n", "duration_s", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("displacement"), F.hypot("w", "h").alias("range"))


def filter_features(features: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Tracks whose features lie in all limits, borders included."""
    keep: Column = F.lit(True)
    for name, (low, high) in limits.items():
        keep = keep & F.col(name).between(low, high)
    return features.filter(keep)


def track_centroids(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*TRACK).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def track_means(tracks: DataFrame, columns: list[str]) -> DataFrame:
    return tracks.groupBy(*TRACK).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def track_bounds(tracks: DataFrame) -> DataFrame:
    """Bounds of each track in x, y and frame."""
    return tracks.groupBy(*TRACK).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "frame") for n, f in (("min", F.min), ("max", F.max))])


def track_segments(tracks: DataFrame) -> DataFrame:
    """A row for each two successive rows of a track, gaps ignored: segment number and the box of the two."""
    by = Window.partitionBy(*TRACK).orderBy("frame")
    rows = tracks.withColumn("xb", F.lead("x").over(by)).withColumn("yb", F.lead("y").over(by)).withColumn("segment", F.row_number().over(by)).filter("xb IS NOT NULL")
    box = {"x0": F.least("x", "xb"), "x1": F.greatest("x", "xb"), "y0": F.least("y", "yb"), "y1": F.greatest("y", "yb")}
    return rows.select(*TRACK, "segment", *[c.alias(k) for k, c in box.items()])


def track_polylines(tracks: DataFrame) -> DataFrame:
    """Rows of each track in order, and behind the last a separator without coordinates."""
    by = Window.partitionBy(*TRACK).orderBy("frame")
    rows = tracks.select(*TRACK, F.row_number().over(by).alias("ord"), "x", "y")
    none = F.lit(None).cast("double")
    ends = tracks.groupBy(*TRACK).agg((F.count("*") + 1).cast("int").alias("ord")).select(*TRACK, "ord", none.alias("x"), none.alias("y"))
    return rows.unionByName(ends)


def track_colors(tracks: DataFrame, scheme: str, curves: DataFrame | None = None, frame_rate: float = 50.0, split: float = -1.75, seed: int = 1, first: int = 2, last: int = 4) -> DataFrame:
    """file_id, track_id and color: a number by one of the schemes

    binary; random4, random6, random8, random10; n, duration, displacement, range; mean <column>;
    mobility (D), mobility (log D), immobile/mobile. A track without a valid fit has a null colour.
    """
    if scheme == "binary":
        return tracks.select(*TRACK).distinct().withColumn("color", F.lit(1.0))
    if scheme.startswith("random"):
        number = F.pmod(F.col("track_id") * 7919 + seed, F.lit(int(scheme[6:]))) + 1
        return tracks.select(*TRACK).distinct().withColumn("color", number.cast("double"))
    if scheme.startswith("mean "):
        return track_means(tracks, [scheme[5:]]).select(*TRACK, F.col(f"mean_{scheme[5:]}").alias("color"))
    if scheme in ("n", "duration", "displacement", "range"):
        column = F.col("duration_s" if scheme == "duration" else scheme).cast("double")
        return track_features(tracks, frame_rate).select(*TRACK, column.alias("color"))
    fits = fit_msd(curves if curves is not None else msd(tracks, frame_rate), first, last)
    good = F.col("is_fitted") & (F.col("d") > 0)
    log_d = F.log10(F.when(good, F.col("d")))
    color = {"mobility (D)": F.when(good, F.col("d")), "mobility (log D)": log_d, "immobile/mobile": (log_d > split).cast("double")}[scheme]
    return tracks.select(*TRACK).distinct().join(fits.select(*TRACK, color.alias("color")), [*TRACK], "left")
