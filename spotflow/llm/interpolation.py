"""Language-model scores by deleted interpolation.

The probability of a token mixes maximum-likelihood estimates of its bigram, its unigram and the
uniform distribution. The weights depend on the bucket of the context's frequency and are learned by
expectation-maximisation on counts from which the token's own document has been deleted, so every
training document is held out from the estimates it is predicted with.

Counts are exchanged by chunks of documents. A chunk sends its distinct n-grams, sorted by hash and
cut into ranges, each once however often it occurs; the task of a range adds up what all chunks sent
and answers each with the corpus totals of its own n-grams. A chunk writes to the ranges that it has
n-grams of, so that messages are never more than the n-grams in them, whatever the size of the corpus.
Nothing grows in one place: neither the vocabulary nor the bigrams are ever gathered in one task or on
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from spotflow.llm.text import lower_words, mix64
from spotflow.session import materialize

#: Tokens of a chunk, and tokens of the corpus for each range of hashes.
CHUNK, RANGE = 1_500_000, 1_000_000
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Buckets of context frequencies (powers of two) and bins of the logarithms of ratios.
BUCKETS, BINS, STEP, LOWEST = 40, 240, 0.25, -20.0


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, their low bytes first, then the next, and compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)
    return zstandard.compress(raw.T.tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _bigram_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(0x165667B19E3779F9) + mix64(token + np.uint64(1)))


class _Chunk:
    """Tokens of some documents as places in their sorted distinct hashes."""

    def __init__(self, keys: np.ndarray, token: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.keys, self.token, self.sizes, self.train = keys, token, sizes, train
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.context = np.empty(len(token), dtype=np.int64)  # one beyond the keys: the begin of a text
        self.context[1:] = token[:-1]
        self.context[first] = len(keys)
        self.first = first
        codes = self.context * (len(keys) + 1) + token
        distinct, place = np.unique(codes, return_inverse=True)
        extended = np.append(keys, BEGIN)
        hashes = _bigram_keys(extended[distinct // (len(keys) + 1)], extended[distinct % (len(keys) + 1)])
        order = np.argsort(hashes)
        self.pair_keys = hashes[order]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.pair = back[place]

    @classmethod
    def of(cls, row: dict) -> _Chunk:
        return cls(unpack(row["keys"], np.uint64), unpack(row["tokens"], np.int32).astype(np.int64), np.array(row["sizes"], dtype=np.int64), np.array(row["train"], dtype=bool))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the keys and of the pair keys."""
        use = self.train[self.doc]
        return np.bincount(self.token[use], minlength=len(self.keys)), np.bincount(self.pair[use], minlength=len(self.pair_keys))

    def own(self, place: np.ndarray, kinds: int) -> np.ndarray:
        """For each token, how often its n-gram occurs in its own document."""
        _, at, often = np.unique(self.doc * kinds + place, return_inverse=True, return_counts=True)
        return often[at]


def _chunks(docs: DataFrame, train: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, flags, hashes, room = [], [], [], CHUNK

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(hashes)
            keys, token = np.unique(flat, return_inverse=True)
            row = {"chunk": number, "doc_ids": ids, "train": flags, "sizes": [len(h) for h in hashes], "keys": pack(keys), "tokens": pack(token.astype(np.int32))}
            return pa.RecordBatch.from_pylist([row], schema=kind)

        kind = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary()), ("tokens", pa.binary())])
        for batch in batches:
            for i, flag, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text").to_pylist()):
                own = np.array([xxhash.xxh3_64_intdigest(w) for w in lower_words(text)], dtype=np.uint64)
                ids.append(i)
                flags.append(flag)
                hashes.append(np.append(own, END))
                room -= len(own) + 1
                if room <= 0:
                    yield flush()
                    number, ids, flags, hashes, room = number + 1, [], [], [], CHUNK
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), train.alias("train"), "text")
    return rows.mapInArrow(run, "chunk long, doc_ids array<long>, train array<boolean>, sizes array<long>, keys binary, tokens binary")


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the ranges of sorted keys with equal top bits."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, dtype=np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _totals(chunks: DataFrame, bits: int) -> DataFrame:
    """(chunk, part, words, pairs, vocabulary, n): corpus totals of each chunk's n-grams, a row a range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk.of(row)
                words, pairs = c.counts()
                a, b = _ranges(c.keys, bits), _ranges(c.pair_keys, bits)
                for p in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
                    w, q = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                    out = {"chunk": row["chunk"], "part": p, "word_keys": c.keys[w].tobytes(), "words": pack(words[w].astype(np.int32)), "pair_keys": c.pair_keys[q].tobytes(), "pairs": pack(pairs[q].astype(np.int32))}
                    yield pa.RecordBatch.from_pylist([out], schema=asked)

    asked = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("word_keys", pa.binary()), ("words", pa.binary()), ("pair_keys", pa.binary()), ("pairs", pa.binary())])

    def add(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        parts = [np.frombuffer(k, np.uint64) for k in keys]
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unpack(c, np.int32) for c in counts])).astype(np.int64)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return [pack(total[x]) for x in np.split(place, cuts)], total

    def answer(table: pa.Table) -> pa.Table:
        words, total = add(table.column("word_keys").to_pylist(), table.column("words").to_pylist())
        pairs, _ = add(table.column("pair_keys").to_pylist(), table.column("pairs").to_pylist())
        n = len(table)
        return pa.table(
            {"chunk": table.column("chunk"), "part": table.column("part"), "words": pa.array(words, pa.binary()), "pairs": pa.array(pairs, pa.binary()),
             "vocabulary": pa.array([int((total > 0).sum())] * n, pa.int64()), "n": pa.array([int(total.sum())] * n, pa.int64())}
        )

    asks = chunks.mapInArrow(ask, "chunk long, part int, word_keys binary, words binary, pair_keys binary, pairs binary")
    return asks.groupBy("part").applyInArrow(answer, "chunk long, part int, words binary, pairs binary, vocabulary long, n long")


def _counted(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """Every chunk's tokens with their corpus counts and the counts in their own document."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_ids": [], "train": [], "sizes": [], "c2": [], "c12": [], "o2": [], "o12": []}
        answers = sorted(right.to_pylist(), key=lambda r: r["part"])
        for row in left.to_pylist():
            c = _Chunk.of(row)
            words = np.concatenate([unpack(r["words"], np.int64) for r in answers])
            pairs = np.concatenate([unpack(r["pairs"], np.int64) for r in answers])
            for k in ("doc_ids", "train", "sizes"):
                out[k].append(row[k])
            out["c2"].append(pack(words[c.token].astype(np.int64)))
            out["c12"].append(pack(pairs[c.pair].astype(np.int64)))
            out["o2"].append(pack(c.own(c.token, len(c.keys)).astype(np.int32)))
            out["o12"].append(pack(c.own(c.pair, len(c.pair_keys)).astype(np.int32)))
        kinds = {"doc_ids": pa.list_(pa.int64()), "train": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    schema = "doc_ids array<long>, train array<boolean>, sizes array<long>, c2 binary, c12 binary, o2 binary, o12 binary"
    return chunks.groupBy("chunk").cogroup(totals.select("chunk", "part", "words", "pairs").groupBy("chunk")).applyInArrow(meet, schema)


def _shift(values: np.ndarray, sizes: np.ndarray, first: int | np.ndarray) -> np.ndarray:
    """The value of the token before; `first` at the beginning of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = first
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def learn_weights(cells: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, unigram and uniform by bucket from rows (bucket, ratio of bigram to unigram bin,
    ratio of unigram to uniform bin, n); bin 0 says that the upper estimate is zero."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    for b in np.unique(cells[:, 0]).astype(int):
        _, r2, r1, n = cells[cells[:, 0] == b].T
        one = np.where(r1 > 0, 2.0 ** (LOWEST + STEP * (r1 - 0.5)), 0.0)  # in units of the uniform estimate
        p = np.column_stack([np.where(r2 > 0, 2.0 ** (LOWEST + STEP * (r2 - 0.5)), 0.0) * one, one, np.ones(len(n))])
        w = weights[b]
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) + [0.0, 0.0, 1e-3]  # the uniform part never vanishes
            w /= w.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text);
    `train` is a boolean column that says which rows the model learns from.

    Tokens are the lower-cased words and one end a text; a null or empty text is one end. base_score is
    the add-one-half unigram score; score is the log10 probability of the text under the interpolated
    model, in which all unknown tokens are one. Without training rows both are those of the uniform
    distribution. Rows that repeat are scored each.
    """
    chunks = materialize(_chunks(docs, train), "chunks")
    tokens = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, (max(1, tokens // RANGE) - 1).bit_length())
    totals = materialize(_totals(chunks, bits), "totals")
    sums = totals.groupBy("part").agg(F.first("vocabulary").alias("v"), F.first("n").alias("n")).agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n = int(sums.v or 0), int(sums.n or 0)
    texts = chunks.select(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0  # how often a text begins
    counted = materialize(_counted(chunks, totals), "counted")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, flags = np.array(row["sizes"], dtype=np.int64), np.array(row["train"], dtype=bool)
                c2, c12, o2, o12 = unpack(row["c2"], np.int64), unpack(row["c12"], np.int64), unpack(row["o2"], np.int32), unpack(row["o12"], np.int32)
                use = np.repeat(flags, sizes)
                rest = np.repeat(n - sizes, sizes)[use]
                context = (_shift(c2, sizes, texts) - _shift(o2, sizes, 1))[use]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p1 = (c2 - o2)[use] / np.maximum(rest, 1)
                    p2 = (c12 - o12)[use] / np.maximum(context, 1)
                    r2 = np.where(p2 > 0, np.clip((np.log2(p2 / p1) - LOWEST) / STEP + 1, 1, BINS - 1), 0).astype(np.int64)
                    r1 = np.where(p1 > 0, np.clip((np.log2(p1 * (v + 1)) - LOWEST) / STEP + 1, 1, BINS - 1), 0).astype(np.int64)
                cell, often = np.unique((bucket_of(context) * BINS + r2) * BINS + r1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(often)], names=["cell", "n"])

    # at most BUCKETS * BINS * BINS rows come to the driver, whatever the input
    held = counted.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell = held["cell"].to_numpy(dtype=np.int64)
    weights = learn_weights(np.column_stack([cell // BINS // BINS, cell // BINS % BINS, cell % BINS, held["n"].to_numpy(dtype=np.int64)]))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                c2, c12 = unpack(row["c2"], np.int64), unpack(row["c12"], np.int64)
                context = _shift(c2, sizes, texts)
                w = weights[bucket_of(context)]
                p = w[:, 0] * c12 / np.maximum(context, 1) + w[:, 1] * c2 / max(n, 1) + w[:, 2] / (v + 1) if n else np.full(len(c2), 1 / (v + 1))
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(np.add.reduceat((c2 > 0).astype(np.int64), first))]
                out += [pa.array([n] * len(sizes), pa.int64()), pa.array(np.add.reduceat(np.log10((c2 + 0.5) / (n + 0.5 * (v + 1))), first)), pa.array(np.add.reduceat(np.log10(p), first))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.select("doc_ids", "sizes", "c2", "c12").mapInArrow(scores, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
