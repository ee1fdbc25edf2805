"""Result tables of a batch of files, in long form and as wide sheets, and their text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotflow.operators.ordered import ordinals


def _files_first(files: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each file, zeros where nothing was counted."""
    return files.select("file_id").distinct().join(counts, "file_id", "left").na.fill(0)


def metadata_sheet(files: DataFrame) -> DataFrame:
    """file_id, name (the last part of a path), folder, stem, width, height and frames."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select("file_id", name.alias("name"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), stem.alias("stem"), "width", "height", "n_frames")


def localization_sheet(flags: DataFrame, filtered: DataFrame) -> DataFrame:
    """Rows of each file before and after the outlier flags, and after the limits."""
    f = flags.groupBy("file_id").agg(
        F.count("*").alias("n"), F.count_if("not_positive").alias("n_not_positive"), F.count_if("extreme").alias("n_extreme"), F.count_if("rounded").alias("n_rounded"), F.count_if(~F.col("is_outlier")).alias("n_remaining")
    )
    return f.join(filtered.groupBy("file_id").agg(F.count("*").alias("n_filtered")), "file_id", "left").na.fill({"n_filtered": 0})


def tracking_sheet(features: DataFrame, filtered: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """Tracks of each file, after the limits and inside the mask (as after the limits where there is none)."""
    count = lambda t, n: t.groupBy("file_id").agg(F.count("*").alias(n))
    rows = count(features, "n_tracks").join(count(filtered, "n_filtered"), "file_id", "left").na.fill({"n_filtered": 0})
    if masked is None:
        return rows.withColumn("n_masked", F.col("n_filtered"))
    return rows.join(count(masked, "n_masked"), "file_id", "left").na.fill({"n_masked": 0})


def wide_msd(means: DataFrame, file_ids: list[int]) -> DataFrame:
    """lag, lag_s and for each named file its mean and standard error side by side; file_ids are columns, so that
    their number is the width of a sheet."""
    return means.groupBy("lag", "lag_s").pivot("file_id", file_ids).agg(F.first("mean").alias("msd"), F.first("sem").alias("sem"))


def wide_lists(values: DataFrame, column: str, file_ids: list[int]) -> DataFrame:
    """i and a column for each named file with its values in ascending order, shorter lists padded with nulls."""
    ranked = ordinals(values.select("file_id", column, "track_id"), ["file_id"], [column, "track_id"], "i")
    return ranked.groupBy("i").pivot("file_id", file_ids).agg(F.first(column))


def population_sheet(fits: DataFrame, valid: DataFrame, split: float = -1.75) -> DataFrame:
    """file_id, n, D at the mean of log D, D of the slower and faster population, the slower fraction by the split
    value and by the fit, and the fit's error code (2: no fit, the rest null)."""
    one = valid.groupBy("file_id").agg(F.count("*").alias("n"), F.pow(F.lit(10.0), F.avg("log_d")).alias("d"), F.avg((F.col("log_d") <= split).cast("double")).alias("slow_by_split"))
    two = fits.select("file_id", F.pow(F.lit(10.0), "mu1").alias("d_slow"), F.pow(F.lit(10.0), "mu2").alias("d_fast"), F.col("fraction1").alias("slow_by_fit"), "error_code")
    return one.join(two, "file_id", "left")


def cluster_sheet(files: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of each file with the area in square micrometres; a file without clusters has one row of zeros."""
    rows = clusters.select("file_id", (F.col("area") / 1e6).alias("area_um2"), "diameter", "n", "x", "y")
    return _files_first(files, rows)


def localization_text(locs: DataFrame) -> DataFrame:
    """Localizations under the column names of the text file."""
    names = {"frame": "frame", "x_nm": "posX_nm", "y_nm": "posY_nm", "psf_nm": "sdvPSF_nm", "photons": "photons", "background": "background", "precision_nm": "locprec_nm"}
    return locs.select("file_id", *[F.col(a).alias(b) for a, b in names.items()])


def track_text(tracks: DataFrame) -> DataFrame:
    """Tracks under the column names of the text file, numbered from 1 in each file."""
    ids = tracks.groupBy("file_id", "track_id").agg(F.count("*").alias("rows"))
    numbers = ordinals(ids, ["file_id"], ["track_id"], "trackID").select("file_id", "track_id", "trackID")
    return tracks.join(numbers, ["file_id", "track_id"]).select("file_id", "trackID", "frame", F.col("x").alias("posX_nm"), F.col("y").alias("posY_nm"))


def write_text(rows: DataFrame, path: str) -> None:
    """Tab-separated text with a header, a folder for each file_id."""
    rows.write.mode("overwrite").partitionBy("file_id").option("sep", "\t").option("header", True).csv(path)
