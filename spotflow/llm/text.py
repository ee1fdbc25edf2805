"""Words, folds and Arrow helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from spotflow.session import materialize

#: A word is a run of characters other than space and the controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: str.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())


def words(text: str) -> list[str]:
    return WORD.findall(text)


def word_count(text: Column) -> Column:
    """Number of words of a string column as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def carried(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but those that are read under a name of its own (_c and its place), so that no
    operator's own column can take the place of one of docs; and the columns of docs to select at the end."""
    inner = [c if c in read else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), [F.col(i).alias(c) for i, c in zip(inner, docs.columns)]


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with a long column `_key` and a boolean `_again`: where a doc_id is not null and one row's alone
    it is the key; other rows (_again) get a hash of the whole row, so that only equal rows share a key."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.count("*").alias("_n"))
    again = materialize(counted.filter("_n > 1 OR _id IS NULL").select("_id", F.lit(True).alias("_again")), "again")
    own = F.col("doc_id").cast("long")
    if again.isEmpty():
        return docs.withColumn("_key", own).withColumn("_again", F.lit(False))
    marked = docs.join(again, own.eqNullSafe(again["_id"]), "left").drop("_id").withColumn("_again", F.coalesce("_again", F.lit(False)))
    return marked.withColumn("_key", F.when(F.col("_again"), F.xxhash64(*docs.columns)).otherwise(own))


def give_back() -> None:
    """Return memory that a task has freed to the system: the worker process outlives the task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches at row borders so that a piece holds about `chars` bytes of text (or one row)."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).tolist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


#: bytes.translate table for the same; bytes.split() without arguments then splits at the same six bytes as WORD.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased; none for null."""
    return text.encode().translate(LOWER_BYTES).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(text: bytes, size: int = 4_000_000, ends: bytes = b" ") -> Iterator[bytes]:
    """A text in pieces of about `size` bytes, each cut behind one of the bytes `ends`, so that the words of a
    very long text never all exist at once."""
    start = 0
    while len(text) - start > size:
        found = [i for i in (text.find(bytes([e]), start + size) for e in ends) if i >= 0]
        if not found:
            break
        yield text[start : min(found) + 1]
        start = min(found) + 1
    yield text[start:]
