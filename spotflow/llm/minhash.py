"""Near-duplicate groups of documents by one-permutation MinHash.

Every document's shingles are hashed once into `bands * rows` bins; a bin keeps the smallest hash
that fell into it. Empty bins borrow from a bin that a hash of (own number, attempt) names, tried
until one is filled (optimal densification), so every bin agrees between two documents with the
probability of their Jaccard similarity. `rows` adjacent bins make a band, and documents that agree
in a band share a bucket.

Candidates of a bucket form a star around its smallest document instead of all pairs, and links are
confirmed on the full sets of shingles, for each document first with the hub it shares most bands
with. Buckets whose members are still in different components after that are open: members of different
components are compared block by block inside tasks that return links only. No bucket is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.text import UPPER, carried, lower_words, mix64, row_keys, slices
from spotflow.operators.components import connected_components
from spotflow.session import materialize

#: Documents in a block of the comparison of open buckets, and shingles that are compared at a time.
TILE, SHINGLES = 256, 8_192
#: Bits of the largest filter of document ids.
FILTER = 1 << 27
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Scheme:
    """words a shingle, least similarity in percent, and the bands and rows that follow from it."""

    words: int = 5
    percent: int = 80
    rows: int = 8
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        """So many that a pair of just the least similarity shares no bucket with probability `miss`."""
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of a text with fewer words, its whole sequence."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of `bins` minima for each non-empty set, empty bins filled by optimal densification."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = mix64(np.concatenate(sets) + np.uint64(0x5851F42D4C957F2D))
    at = (flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    sig = np.full(len(sets) * bins, EMPTY)
    np.minimum.at(sig, doc * bins + at.astype(np.int64), flat)
    hole = np.flatnonzero(sig == EMPTY)
    out, attempt = sig.copy(), 0
    while len(hole):
        attempt += 1
        own = (hole % bins).astype(np.uint64)
        probe = mix64(own * np.uint64(0x2545F4914F6CDD1D) + np.uint64(attempt)) % np.uint64(bins)
        value = sig[hole - hole % bins + probe.astype(np.int64)]
        out[hole] = value
        hole = hole[value == EMPTY]
    return out.reshape(len(sets), bins)


def bucket_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def _sketch(docs: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            sets = [shingle_set(t, scheme.words) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for k in range(0, len(full), 500):
                some = full[k : k + 500]
                rows = bucket_keys(signatures([sets[i] for i in some], scheme.bands * scheme.rows), scheme.bands, scheme.rows)
                for i, row in zip(some, rows):
                    keys[i] = row
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents named in ids: all their shingle hashes as bytes. Some others may come
    along, which joins on id then leave out.

    Texts are not shuffled to find those that are named: a bitmap of hashed ids, of at most FILTER bits
    whatever the input, goes to the tasks that read them. More ids than it can tell apart are joined.
    """
    named = materialize(ids.select("id").distinct(), "ids")
    n = named.count()
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    size = max(64, 1 << (16 * n).bit_length())
    if size > FILTER:
        text, bitmap = text.join(named, "id", "left_semi").withColumn("h", F.lit(0).cast("long")), None
    else:
        at = F.pmod(F.xxhash64("id"), F.lit(size))
        text = text.withColumn("h", at)
        marks = named.groupBy(F.floor(at / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("bits")).toPandas()
        bitmap = np.zeros(size // 32, dtype=np.uint32)
        bitmap[marks["word"].to_numpy(dtype=np.int64)] = marks["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                h = batch.column("h").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((shared.value[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)))
            for part in slices(iter([batch]), "text", 2_000_000):
                found = [shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], names=["id", "shingles"])

    return materialize(text.filter("id IS NOT NULL").mapInArrow(sets, "id long, shingles binary"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(linked, "a long, b long").distinct(), "links")


def tile_links(ids: np.ndarray, comps: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components among the documents of a tile, as many as connect what can be
    connected. Within one block all pairs are compared; of two blocks the pairs across."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    doc, column = doc[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, len(shared), SHINGLES):  # some columns at a time
        i, j = np.searchsorted(column, [lo, lo + SHINGLES])
        m = np.zeros((n, min(SHINGLES, len(shared) - lo)), dtype=np.float32)
        m[doc[i:j], column[i:j] - lo] = 1
        common += m @ m.T
    link = 100.0 * common >= percent * (size[:, None] + size[None, :] - common.astype(np.float64))
    link &= comps[:, None] != comps[None, :]
    if blocks.min() != blocks.max():
        link &= blocks[:, None] != blocks[None, :]
    out, root = [], {c: c for c in comps.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for a, b in np.argwhere(np.triu(link, 1)):
        x, y = find(int(comps[a])), find(int(comps[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _compare_open(open_members: DataFrame, sizes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) between members of open buckets that are still in different components.

    open_members: key, id and c (component); sizes: id and n. Of buckets with the same members one is
    compared. Its members are dealt into blocks of about TILE documents by the band of their set size and
    by component: a component of TILE members and more has blocks of its own. Only blocks whose bands are
    neighbours, as sets of enough similarity have, and that can hold different components meet, so the
    members of one large component meet those of the others and never each other. One task compares
    two blocks and returns links, never pairs. This holds for buckets of every size.
    """
    h = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    one = open_members.groupBy("key").agg(F.count("*").alias("m"), *h).groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    wide = math.log(100 / scheme.percent) * (1 - 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / wide).cast("int") if scheme.percent < 100 else F.lit(0)
    rows = open_members.select("key", "id", "c").join(materialize(one, "distinct"), "key", "left_semi").join(sizes, "id")
    rows = materialize(rows.select("key", "id", "c", band.alias("band")).distinct(), "members")
    of_comp = rows.groupBy("key", "band", "c").agg(F.count("*").alias("of"))
    small = F.sum(F.when(F.col("of") < TILE, F.col("of")).otherwise(0))
    rest = of_comp.groupBy("key", "band").agg(small.alias("rest"))
    big = F.when(F.col("of") >= TILE, F.col("c"))
    of_comp = of_comp.join(rest, ["key", "band"])
    spread = F.when(big.isNotNull(), F.ceil(F.col("of") / TILE)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("rest") / TILE)))
    plan = materialize(of_comp.select("key", "band", "c", big.alias("big"), spread.cast("long").alias("spread")), "plan")
    number = F.pmod(F.xxhash64(F.when(F.col("big").isNotNull(), F.col("id")).otherwise(F.col("c"))), F.col("spread"))
    dealt = materialize(rows.join(plan, ["key", "band", "c"]).select("key", "id", "c", "band", "big", F.xxhash64("band", "big", number).alias("block")), "dealt")
    blocks = dealt.groupBy("key", "block").agg(F.min("band").alias("band"), F.min("big").alias("big"), F.min("c").alias("low"), F.max("c").alias("high"))
    x, y = blocks.toDF("key", "lo", "band_x", "big_x", "low_x", "high_x"), blocks.toDF("key", "hi", "band_y", "big_y", "low_y", "high_y")
    tiles = x.join(y, "key").filter("lo <= hi AND abs(band_x - band_y) <= 1 AND least(low_x, low_y) < greatest(high_x, high_y)").select("key", "lo", "hi")
    tiles = materialize(tiles, "tiles")
    ends = tiles.select("key", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    met = ends.join(dealt.select("key", "block", "id", "c"), ["key", "block"])
    sets = _full_sets(docs, rows, scheme.words)

    def link(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("id", "c", "block")}
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        found = tile_links(cols["id"], cols["c"], cols["block"], sets, scheme.percent)
        return pa.table({k: pa.array([f[i] for f in found], pa.int64()) for i, k in enumerate("ab")})

    return materialize(met.join(sets, "id").groupBy("key", "lo", "hi").applyInArrow(link, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and kept
    (doc_id = component_id) for every row of docs (doc_id, text; other columns are not read).

    A null or empty text has no shingles and links with nothing. Documents with equal sets are one
    vertex, represented by the smallest doc_id. Rows that repeat a doc_id get the same component each;
    a null doc_id has a null component and is not kept.
    """
    sketch = materialize(_sketch(docs, scheme), "sketch")
    named = sketch.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    same = named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copied = materialize(same.filter("copies > 1").select("set_id", "rep"), "copied")
    rep_of = sketch.filter("doc_id IS NOT NULL").join(copied, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    rep_of = materialize(rep_of, "reps")
    firsts = named.join(copied, "set_id", "left").filter("rep IS NULL OR rep = doc_id")
    members = firsts.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last")
    buckets = materialize(members.join(materialize(hubs.select("key", "hub"), "hubs"), "key"), "buckets")

    star = buckets.filter("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("bands"))
    n = rep_of.filter("doc_id = rep").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    star = star.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").filter(f"100 * least(na, nb) >= {scheme.percent} * greatest(na, nb)")
    best = star.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("a"))).alias("top")).select((-F.col("top.a")).alias("a"), "b")
    best = materialize(best, "best")
    links = _confirm(best, _full_sets(docs, best.select(F.explode(F.array("a", "b")).alias("id")), scheme.words), scheme.percent)
    comps = connected_components(links, "a", "b")

    held = buckets.join(comps.select(F.col("node").alias("id"), F.col("component")), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    held = materialize(held, "held")
    mixed = held.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    left = materialize(held.join(materialize(mixed, "mixed"), "key", "left_semi").select("key", "id", "c").distinct(), "open")
    if not left.limit(1).isEmpty():
        comps = connected_components(links.unionByName(_compare_open(left, n, docs, scheme)), "a", "b")

    reached = comps.select(F.col("node").alias("rep"), "component")
    whole = rep_of.join(reached, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    lost = sketch.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return whole.unionByName(lost).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """docs without near duplicates: of each group one row stays, that with the smallest doc_id.

    Every row is a document of its own, also rows without a doc_id and those that share one; in a group
    with such rows the one that stays follows from a hash of the rows. Rows without words stay all. Columns of docs are
    handed on as they are, whatever their names.
    """
    inner, own = carried(docs, "doc_id", "text")
    keyed = row_keys(inner)
    groups = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), scheme)
    kept = materialize(groups.filter("kept").select(F.col("doc_id").alias("_key"), (F.col("n_shingles") > 0).alias("_words")).distinct(), "kept")
    rows = keyed.join(kept, "_key")
    alone = rows.filter("NOT _again OR NOT _words").select(*own)
    return alone.unionByName(rows.filter("_again AND _words").dropDuplicates(["_key"]).select(*own))


def oracle(words: int, percent: int) -> str:
    """near_duplicates over the table documents by all pairs that share a shingle, as DuckDB SQL."""
    shingle = "array_to_string(w[i : i + {}], ' ')".format(words - 1)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {shingle} AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {words - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS low FROM ends UNION SELECT e.b, r.low FROM reach r JOIN ends e ON e.a = r.doc_id WHERE r.low < e.b),
c AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
