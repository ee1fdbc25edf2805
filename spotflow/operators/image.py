"""Image operators in pixel form (file_id, frame, row, col, adu) and frame form (one row a frame).

Stencils in pixel form are joins with small offset tables, which Catalyst broadcasts; in frame form
they are numpy on whole frames inside Arrow batches, the faster way for real movies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FRAME_SCHEMA = "file_id long, frame int, height int, width int, pixels array<float>"
PIXEL = ("file_id", "frame", "row", "col")


def to_photons(pixels: DataFrame, offset: float = 100.0, conversion: float = 0.48) -> DataFrame:
    return pixels.withColumn("photons", (F.col("adu") - offset) * conversion)


def frames_to_photons(frames: DataFrame, offset: float = 100.0, conversion: float = 0.48) -> DataFrame:
    return frames.withColumn("pixels", F.transform("pixels", lambda p: ((p - offset) * conversion).cast("float")))


def frame_min(pixels: DataFrame, value: str = "adu") -> DataFrame:
    return pixels.groupBy("file_id", "frame").agg(F.min(value).alias("low"))


def max_projection(pixels: DataFrame, value: str = "adu") -> DataFrame:
    return pixels.groupBy("file_id", "row", "col").agg(F.max(value).alias("peak"))


def variance_map(pixels: DataFrame) -> DataFrame:
    """variance of each pixel over a noise movie's frames and the movie's mean as offset. A file of one
    frame is a map already: its pixels are the variances and it has no offset."""
    each = pixels.groupBy("file_id", "row", "col").agg(F.var_samp("adu").alias("v"), F.first("adu").alias("a"))
    whole = pixels.groupBy("file_id").agg(F.avg("adu").alias("mean"), F.count_distinct("frame").alias("frames"))
    one = F.col("frames") == 1
    rows = each.join(whole, "file_id")
    return rows.select("file_id", "row", "col", F.when(one, F.col("a")).otherwise(F.col("v")).alias("variance"), F.when(~one, F.col("mean")).alias("offset"))


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    """A size x size Gaussian that sums to 1; values under the precision of its maximum are 0."""
    at = np.arange(size) - (size - 1) / 2
    g = np.exp(-(at[:, None] ** 2 + at[None, :] ** 2) / (2 * sigma**2))
    g[g < np.finfo(float).eps * g.max()] = 0
    return g / g.sum()


def dog_kernel(sigma: float = 1.3) -> np.ndarray:
    """Difference of two Gaussians, the wide one 2.5 times (at least 1) as wide, on a square of six sigma and
    one pixel (at least 3), even or odd."""
    size = max(math.ceil(6 * sigma + 1), 3)
    return gaussian_kernel(size, sigma) - gaussian_kernel(size, max(1.0, 2.5 * sigma))


def convolve(pixels: DataFrame, kernel: np.ndarray, value: str = "adu") -> DataFrame:
    """Sum of kernel times value around each pixel of a frame, zero outside: the pixel form. Every pixel is
    sent to the positions it adds to, which a partial aggregation gathers; no pixel is joined with another."""
    h, w = kernel.shape
    offsets = [(i - h // 2, j - w // 2, float(kernel[i, j])) for i in range(h) for j in range(w)]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(v).alias("v")) for i, j, v in offsets])
    sent = pixels.select("file_id", "frame", "row", "col", F.col(value).alias("value"), F.explode(table).alias("k"))
    sent = sent.select("file_id", "frame", (F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col"), (F.col("value") * F.col("k.v")).alias("part"))
    return sent.groupBy(*PIXEL).agg(F.sum("part").alias("filtered")).join(pixels.select(*PIXEL), [*PIXEL], "left_semi")


def local_maxima(pixels: DataFrame, value: str, least: float, margin: int = 1) -> DataFrame:
    """Pixels of at least `least` that are greater than all eight neighbours, `margin` away from the border.
    Only those pixels ask for their neighbours, by an equi-join; equal neighbours are no peak."""
    v = F.col(value)
    size = pixels.groupBy("file_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    inside = F.col("row").between(margin, F.col("last_row") - margin) & F.col("col").between(margin, F.col("last_col") - margin)
    high = pixels.filter(v >= least).join(size, "file_id").filter(inside).select(*PIXEL, v.alias("peak"))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    asks = high.withColumn("k", F.explode(ring)).select("file_id", "frame", F.col("row").alias("r"), F.col("col").alias("c"), "peak", (F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col"))
    met = asks.join(pixels.select(*PIXEL, v.alias("v")), [*PIXEL]).filter("v < peak")
    found = met.groupBy("file_id", "frame", F.col("r").alias("row"), F.col("c").alias("col"), "peak").count().filter("count = 8")
    return found.select(*PIXEL, "peak")


def trim_border(peaks: DataFrame, width: int, height: int, roi: int, strict: bool = True) -> DataFrame:
    """Peaks (x, y from 1) whose window of `roi` pixels lies inside the image. strict also drops the last
    row and column that would fit."""
    h = roi // 2
    last = 0 if strict else 1
    return peaks.filter((F.col("x") > h) & (F.col("x") < width - h + last) & (F.col("y") > h) & (F.col("y") < height - h + last))


def crop(peaks: DataFrame, pixels: DataFrame, roi: int, value: str = "adu") -> DataFrame:
    """For each peak (file_id, frame, row, col) the window around it: dr, dc and value of every pixel. Peaks
    are sent to the positions of their window, an equi-join fetches the pixels."""
    h = roi // 2
    offsets = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-h, h + 1) for j in range(-h, h + 1)])
    asked = peaks.select("file_id", "frame", F.col("row").alias("peak_row"), F.col("col").alias("peak_col"), F.explode(offsets).alias("k"))
    asked = asked.select("file_id", "frame", "peak_row", "peak_col", "k.dr", "k.dc", (F.col("peak_row") + F.col("k.dr")).alias("row"), (F.col("peak_col") + F.col("k.dc")).alias("col"))
    return asked.join(pixels.select(*PIXEL, F.col(value).alias("value")), [*PIXEL]).select("file_id", "frame", "peak_row", "peak_col", "dr", "dc", "value")


def find_peaks(image: np.ndarray, least: float, margin: int) -> np.ndarray:
    """(row, col) from 0 of the strict local maxima of one image."""
    inner = image[1:-1, 1:-1]
    ok = inner >= least
    for i in range(3):
        for j in range(3):
            if (i, j) != (1, 1):
                ok &= inner > image[i : image.shape[0] - 2 + i, j : image.shape[1] - 2 + j]
    found = np.argwhere(ok) + 1
    low, high = margin, np.array(image.shape) - margin
    return found[((found >= low) & (found < high)).all(axis=1)]


def convolve_image(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Zero-padded convolution of the image's size."""
    h, w = kernel.shape
    padded = np.pad(image, ((h - 1 - h // 2, h // 2), (w - 1 - w // 2, w // 2)))
    out = np.zeros(image.shape)
    for i in range(h):
        for j in range(w):
            out += kernel[h - 1 - i, w - 1 - j] * padded[i : i + image.shape[0], j : j + image.shape[1]]
    return out


def variance_frames(maps: DataFrame, height: int, width: int) -> DataFrame:
    """noise_id and variance: the maps (noise_id, row, col, variance) as one array each, row by row, 0 where a map has no pixel."""
    packed = to_frames(maps.select(F.col("noise_id").alias("file_id"), F.lit(0).alias("frame"), "row", "col", "variance"), height, width, "variance")
    return packed.select(F.col("file_id").alias("noise_id"), F.col("pixels").alias("variance"))


def with_variance_frames(frames: DataFrame, routes: DataFrame, maps: DataFrame) -> DataFrame:
    """frames with `variance`, the array of variance_frames of their file's map by routes (file_id, noise_id); null for a file
    without one. Frames are joined by file, not by pixel; the maps are one row a camera."""
    of = routes.join(maps, "noise_id").select(F.col("file_id").cast("long").alias("file_id"), "variance")
    return frames.join(of, "file_id", "left")


def detect(frames: DataFrame, sigma: float = 1.3, cutoff: float = 3.0, roi: int = 7) -> DataFrame:
    """Peaks of photon frames with their windows: file_id, frame, x, y (from 1) and roi (row by row). Frames with a column
    `variance` give roi_variance as well, the same window of it (zeros where it is null or of another size).

    A frame's minimum is taken off, the difference of Gaussians is applied and strict maxima of at least
    `cutoff` are kept where a whole window fits. A frame is a row, so this never shuffles.
    """
    kernel, half, noisy = dog_kernel(sigma), roi // 2, "variance" in frames.columns
    columns = ["file_id", "frame", "x", "y", "roi", *(["roi_variance"] if noisy else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f in batch.itertuples(index=False):
                image = np.asarray(f.pixels, dtype=np.float64).reshape(f.height, f.width)
                if min(image.shape) < max(3, roi):
                    continue
                noise = np.zeros(image.shape)
                if noisy and f.variance is not None and len(f.variance) == image.size:
                    noise = np.asarray(f.variance, dtype=np.float64).reshape(image.shape)
                for i, j in find_peaks(convolve_image(image - image.min(), kernel), cutoff, half):
                    at = slice(i - half, i + half + 1), slice(j - half, j + half + 1)
                    windows = [m[at].ravel().astype(np.float32) for m in (image, noise)]
                    out.append((f.file_id, f.frame, j + 1, i + 1, *windows[: 1 + noisy]))
            yield pd.DataFrame(out, columns=columns)

    return frames.mapInPandas(run, "file_id long, frame int, x int, y int, roi array<float>" + ", roi_variance array<float>" * noisy)


def to_pixels(frames: DataFrame) -> DataFrame:
    """The pixel form of frames (row and col from 0)."""
    rows = frames.select("file_id", "frame", "width", F.posexplode("pixels").alias("at", "adu"))
    return rows.select("file_id", "frame", F.floor(F.col("at") / F.col("width")).cast("int").alias("row"), (F.col("at") % F.col("width")).cast("int").alias("col"), F.col("adu").cast("double").alias("adu"))


def to_frames(pixels: DataFrame, height: int, width: int, value: str = "adu") -> DataFrame:
    """Frames of a fixed size from pixels; positions without a pixel, or with a null one, are 0. Pixels outside the size are
    left out, and of pixels that repeat the greatest counts. A frame is put together in one task, each pixel at its
    place."""

    def fill(group: pa.Table) -> pa.Table:
        at, v = group.column("at").to_numpy(), group.column("v").to_numpy()
        order = np.argsort(v, kind="stable")
        image = np.full(height * width, -np.inf, np.float32)
        image[at[order]] = v[order]
        image[image == -np.inf] = 0
        image = pa.ListArray.from_arrays(pa.array([0, len(image)], pa.int32()), pa.array(image))
        one = lambda n: pa.array([n], pa.int32())
        return pa.table({"file_id": group.column("file_id")[:1], "frame": group.column("frame")[:1], "height": one(height), "width": one(width), "pixels": image})

    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    at = F.when(inside, F.col("row") * width + F.col("col")).otherwise(0).cast("int")  # a frame with no pixel inside is a frame too
    v = F.when(inside, F.col(value).cast("double"))
    rows = pixels.select(F.col("file_id").cast("long").alias("file_id"), F.col("frame").cast("int").alias("frame"), at.alias("at"), F.coalesce(v, F.lit(float("-inf"))).alias("v"))
    return rows.groupBy("file_id", "frame").applyInArrow(fill, FRAME_SCHEMA)


def filter_frames(frames: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Every frame convolved with a kernel, zero outside. A frame is a row, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shaped = (np.asarray(f.pixels, dtype=np.float64).reshape(f.height, f.width) for f in batch.itertuples(index=False))
            yield batch.assign(pixels=[convolve_image(image, kernel).ravel() for image in shaped])

    return frames.select("file_id", "frame", "height", "width", "pixels").mapInPandas(run, FRAME_SCHEMA.replace("float", "double"))
