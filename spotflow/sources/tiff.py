"""Uncompressed multipage TIFF movies as frames, classic ones and those with 64-bit offsets, of any size.

Spark's binaryFile source lists the files, and their contents stay where they are: a task opens a file in its store and
reads the tags of the pages, a few hundred bytes each. Frames are then dealt over tasks by ranges of bytes,
so that a movie larger than a task, or than a row can be, is read by many. Files in a store that only Spark opens
come through the content column, whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spotflow.session import materialize

#: Tags of the format, the sizes of its types, and the types of whole numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, PER_STRIP, COUNTS, FORMAT = 256, 257, 258, 259, 273, 278, 279, 339
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
WHOLE = {1: "B", 3: "H", 4: "I", 16: "Q"}
FRAMES = "path string, frame int, height int, width int, pixels array<float>"
#: Stores that tasks open by themselves, and bytes of pixels that a task reads.
STORES, RANGE = ("file", "s3", "s3a", "gs", "abfs", "hdfs"), 64 << 20
#: Bytes read at a time while tags are looked for.
LOOK = 4096

Read = Callable[[int, int], bytes]  # from an offset so many bytes, fewer at the end


@dataclass
class Page:
    width: int
    height: int
    kind: np.dtype
    strips: list[tuple[int, int]]


def opened(path: str) -> tuple[Read, int]:
    """How to read a file of a store, and its size."""
    path = re.sub("^file:/+", "file:///", path.replace("s3a://", "s3://", 1))
    store, name = fs.FileSystem.from_uri(path)
    file = store.open_input_file(name)
    return lambda at, n: file.read_at(n, at), file.size()


def pages(data: bytes) -> list[Page]:
    """The pages of a file at hand; ValueError says what cannot be read."""
    return pages_of(lambda at, n: data[at : at + n], len(data))


def pages_of(read: Read, size: int) -> list[Page]:
    """The pages of a file by reading its tags only. A table of tags is read in one piece with what stands behind it,
    which mostly holds the lists it points to."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
    version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if version not in (42, 43) or (version == 43 and (len(head) < 16 or head[4:8] != struct.pack(order + "HH", 8, 0))):
        raise ValueError("not a TIFF file")
    wide = version == 43
    number, few, tag_size, inline = ("Q", "Q", 20, 8) if wide else ("I", "H", 12, 4)
    at = struct.unpack_from(order + number, head, 8 if wide else 4)[0]
    out: list[Page] = []
    seen: set[int] = set()
    start, piece = 0, b""

    def take(place: int, n: int) -> bytes:
        nonlocal start, piece
        if not start <= place <= place + n <= start + len(piece):
            start, piece = place, read(place, max(n, LOOK))
        found = piece[place - start : place - start + n]
        if len(found) < n:
            raise ValueError("broken chain of pages")
        return found

    while at:
        if at in seen or at + 2 > size:
            raise ValueError("broken chain of pages")
        seen.add(at)
        count = struct.calcsize(order + few)
        (n,) = struct.unpack(order + few, take(at, count))
        table = take(at + count, n * tag_size + struct.calcsize(order + number))
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, values = struct.unpack_from(order + "HH" + number, table, tag_size * k)
            if kind in WHOLE and tag in (WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, COUNTS, FORMAT):
                raw = table[tag_size * k + tag_size - inline :][:inline]
                length = SIZES[kind] * values
                if length > inline:
                    raw = take(struct.unpack(order + number, raw)[0], length)
                tags[tag] = struct.unpack_from(f"{order}{values}{WHOLE[kind]}", raw, 0)
        if tags.get(COMPRESSION, (1,))[0] != 1:
            raise ValueError("compressed")
        bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
        if (form, bits) not in ((1, 8), (1, 16), (1, 32), (3, 32)):
            raise ValueError(f"sample format {form} of {bits} bits")
        kind = np.dtype(f"{order}{'f' if form == 3 else 'u'}{bits // 8}")
        out.append(Page(tags[WIDTH][0], tags[HEIGHT][0], kind, list(zip(tags[OFFSETS], tags[COUNTS]))))
        (at,) = struct.unpack_from(order + number, table, n * tag_size)
    return out


def image(data: bytes, page: Page) -> np.ndarray:
    raw = b"".join(data[a : a + n] for a, n in page.strips)
    return np.frombuffer(raw, page.kind, page.width * page.height).reshape(page.height, page.width)


def files(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def _openable() -> Column:
    scheme = F.regexp_extract("path", "^([A-Za-z0-9+.-]+):", 1)
    return (scheme == "") | scheme.isin(*STORES)


def _whole(found: DataFrame) -> DataFrame | None:
    """The files that only Spark opens, if there are any: reading their contents would read those of all files."""
    rows = found.filter(~_openable())
    return None if rows.select("path").isEmpty() else rows


BROKEN = (ValueError, KeyError, IndexError, struct.error)
META = "path string, modified timestamp, width int, height int, bits int, is_float boolean, n_frames int, status string"


def read_metadata(found: DataFrame) -> DataFrame:
    """path, modified, width, height, bits, is_float, n_frames and status (ok, or why a file cannot be read) of each
    file; a broken file is a row like any other. Only tags are read."""

    def described(look: Callable) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for f in batch.itertuples(index=False):
                    try:
                        p = look(f)
                        rows.append((f.path, f.modificationTime, p[0].width, p[0].height, p[0].kind.itemsize * 8, p[0].kind.kind == "f", len(p), "ok"))
                    except BROKEN as e:
                        rows.append((f.path, f.modificationTime, None, None, None, None, 0, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in META.split(", ")])

        return run

    near = found.filter(_openable()).select("path", "modificationTime").mapInPandas(described(lambda f: pages_of(*opened(f.path))), META)
    if (whole := _whole(found)) is None:
        return near
    return near.unionByName(whole.select("path", "modificationTime", "content").mapInPandas(described(lambda f: pages(f.content)), META))


def movies(metadata: DataFrame) -> DataFrame:
    """Files that can be read and have more than one frame (a single one is a mask or a map)."""
    return metadata.filter("status = 'ok' AND n_frames > 1")


def read_pages(found: DataFrame) -> DataFrame:
    """path, frame (from 1), height, width, kind (of a pixel, as numpy names it), at and size (of the strips, in bytes) of
    every page of the files that tasks can open; broken files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    own = pages_of(*opened(path))
                except BROKEN:
                    continue
                for i in range(0, len(own), 1000):
                    some = own[i : i + 1000]
                    rows = [(path, i + k, p.height, p.width, p.kind.str, [a for a, _ in p.strips], [n for _, n in p.strips]) for k, p in enumerate(some, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["path", "frame", "height", "width", "kind", "at", "size"]
    return found.select("path").mapInArrow(run, "path string, frame int, height int, width int, kind string, at array<long>, size array<long>")


def frames_at(rows: DataFrame) -> DataFrame:
    """path, frame, height, width and pixels (row by row) of the pages of read_pages. Pages that follow each other are
    read by the task of their range of RANGE bytes."""
    rows = materialize(rows.withColumn("bytes", F.aggregate("size", F.lit(0).cast("long"), lambda s, v: s + v)), "pages")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    dealt = rows.repartition(max(1, -(-total // RANGE)), "path", F.floor(F.element_at("at", 1) / RANGE)).sortWithinPartitions("path", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, (read, _) = r["path"], opened(r["path"])
                raw = b"".join(read(a, n) for a, n in zip(r["at"], r["size"]))
                if len(raw) < r["width"] * r["height"] * np.dtype(r["kind"]).itemsize:
                    continue  # the file ends within the frame
                pixels = np.frombuffer(raw, r["kind"], r["width"] * r["height"]).astype(np.float32)
                image = pa.ListArray.from_arrays(pa.array([0, len(pixels)], pa.int32()), pa.array(pixels))
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), *[pa.array([r[c]], pa.int32()) for c in ("frame", "height", "width")], image], names=["path", "frame", "height", "width", "pixels"])

    return dealt.select("path", "frame", "height", "width", "kind", "at", "size").mapInArrow(run, FRAMES)


def read_frames(found: DataFrame, only: int | None = None) -> DataFrame:
    """path, frame (from 1), height, width and pixels (row by row) of every frame of the files, or of one frame. Broken
    files have none, nor has a frame beyond a file's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                try:
                    own = pages(f.content)
                except BROKEN:
                    continue
                for k, page in enumerate(own, 1):
                    if (only is None or k == only) and sum(len(f.content[a : a + n]) for a, n in page.strips) >= page.width * page.height * page.kind.itemsize:
                        pixels = image(f.content, page).astype(np.float32).ravel()
                        yield pd.DataFrame({"path": [f.path], "frame": [k], "height": [page.height], "width": [page.width], "pixels": [pixels]})

    rows = read_pages(found.filter(_openable()))
    near = frames_at(rows if only is None else rows.filter(F.col("frame") == only))
    whole = _whole(found)
    return near if whole is None else near.unionByName(whole.select("path", "content").mapInPandas(run, FRAMES))


def masks_of(metadata: DataFrame) -> DataFrame:
    """path and mask_path of each movie: of readable files named like it with _mask behind, of its size, a TIFF first,
    then the first by name; null without one."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    rows = metadata.withColumn("stem", stem)
    is_mask = F.col("stem").endswith("_mask")
    mask = rows.filter(is_mask & (F.col("status") == "ok")).select(F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"), "width", "height")
    met = movies(rows.filter(~is_mask)).select("path", "stem", "width", "height").join(mask, ["stem", "width", "height"], "left")
    first = Window.partitionBy("path").orderBy(F.lower("mask_path").rlike(r"\.tiff?$").desc(), "mask_path")
    return met.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("path", "mask_path")
