"""Byte-level BPE encoding and decoding.

The merge loop of a word keeps the ranks of its adjacent pairs in a segment tree. The root of the
tree is the lowest rank and, among equal ranks, the leftmost position; a merge changes at most
three leaves, each of which is carried up in a logarithmic number of steps. Words of one size are
merged together, one numpy operation for a step of all of them; a word longer than LONG symbols
walks its own tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.text import slices

LONG = 64
#: Words whose encoding a worker remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 60_000
#: Rows of pairs merged together in one go.
TOGETHER = 8_000
#: The split of the byte-level scheme (fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 62


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, shift = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], shift = chr(shift), shift + 1
    return [names[b] for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file, built once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        names = _byte_names()
        self.byte_id = np.array([vocab[c] for c in names], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        first = np.unique(keys, return_index=True)  # of a repeated pair the first rank counts
        self.pair_key, self.pair_rank = first[0], first[1].astype(np.int64)
        self.rank_of = dict(zip(self.pair_key.tolist(), self.pair_rank.tolist()))
        byte_of = {c: b for b, c in enumerate(names)}
        raw = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            known = i not in self.special.values() and all(c in byte_of for c in token)
            raw[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.raw_len = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile(r"(?<=\S)\s")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {m: k for k, m in enumerate(self.special)}
        self.at = [np.arange(len(self.special), dtype=np.int64)]
        self.len = [np.ones(len(self.special), dtype=np.int64)]
        self.ids = [np.array(list(self.special.values()), dtype=np.int32)]
        self.filled = len(self.special)

    # -- merging ---------------------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[i] == key) & (left >= 0) & (right >= 0), self.pair_rank[i], -1)

    def _merge_rows(self, ids: np.ndarray, width: int) -> np.ndarray:
        """ids: one word a row, -1 behind its end, `width` (a power of two) columns. Merges in place."""
        n, bits = len(ids), width.bit_length() - 1
        col = np.arange(width, dtype=np.int64)
        nxt = np.broadcast_to(np.append(col[1:], -1), (n, width)).copy()
        prv = np.broadcast_to(col - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(rank >= 0, (rank << bits) | col[:-1], NONE)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at = best & (width - 1)
            gone = nxt[live, at]
            ids[live, at] = self.merged[best >> bits]
            ids[live, gone] = -1
            after = nxt[live, gone]
            nxt[live, at] = after
            has = after >= 0
            prv[live[has], after[has]] = at[has]
            right = np.where(has, ids[live, after], -1)
            before = prv[live, at]
            left = np.where(before >= 0, ids[live, before], -1)
            here = ids[live, at]
            for leaf, a, b, ok in ((at, here, right, None), (before, left, here, before >= 0), (gone, None, None, None)):
                rows = live if ok is None else live[ok]
                pos = leaf if ok is None else leaf[ok]
                if a is None:
                    value = NONE
                else:
                    r = self._ranks(a if ok is None else a[ok], b if ok is None else b[ok])
                    value = np.where(r >= 0, (r << bits) | pos, NONE)
                node = pos + width
                tree[rows, node] = value
                for _ in range(bits):
                    node >>= 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        return ids

    def _merge_one(self, ids: list[int]) -> list[int]:
        """The same for one long word, on lists."""
        n, ranks, none = len(ids), self.rank_of, int(NONE)
        bits = max(1, (n - 1).bit_length())
        width, mask = 1 << bits, (1 << bits) - 1
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            r = ranks.get(ids[i] * self.size + ids[nxt[i]]) if nxt[i] >= 0 else None
            return none if r is None else r << bits | i

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        tree[width : width + n] = map(leaf, range(n))
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            at, rank = tree[1] & mask, tree[1] >> bits
            gone = nxt[at]
            ids[at], ids[gone] = int(self.merged[rank]), -1
            nxt[at] = nxt[gone]
            if nxt[at] >= 0:
                prv[nxt[at]] = at
            put(gone, none)
            put(at, leaf(at))
            if prv[at] >= 0:
                put(prv[at], leaf(prv[at]))
        return [i for i in ids if i >= 0]

    def _learn(self, new: list[str]) -> None:
        """Encode words not seen before and remember them."""
        raw = [w.encode() for w in new]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        width = np.where(size > 1, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64), 1)
        for w in np.unique(width):
            all_of = np.flatnonzero(width == w)
            for k in range(0, len(all_of), TOGETHER):
                of = all_of[k : k + TOGETHER]
                flat = self.byte_id[np.frombuffer(b"".join(raw[i] for i in of), dtype=np.uint8)]
                if w == 1:
                    ids, lens = flat, np.ones(len(of), dtype=np.int64)
                elif w > LONG:
                    ends = np.cumsum(size[of])
                    parts = [self._merge_one(flat[e - s : e].tolist()) for e, s in zip(ends, size[of])]
                    lens = np.array([len(p) for p in parts], dtype=np.int64)
                    ids = np.concatenate([np.array(p, dtype=np.int64) for p in parts])
                else:
                    rows = np.full((len(of), int(w)), -1, dtype=np.int64)
                    rows[np.arange(w) < size[of][:, None]] = flat
                    rows = self._merge_rows(rows, int(w))
                    lens, ids = (rows >= 0).sum(axis=1), rows[rows >= 0]
                at = self.filled + np.concatenate([[0], np.cumsum(lens)[:-1]])
                base = sum(map(len, self.len))
                self.slot.update((new[i], base + j) for j, i in enumerate(of.tolist()))
                self.at.append(at)
                self.len.append(lens)
                self.ids.append(ids.astype(np.int32))
                self.filled += len(ids)
        self.at, self.len, self.ids = [np.concatenate(self.at)], [np.concatenate(self.len)], [np.concatenate(self.ids)]

    def _pieces(self, text: str, limit: int = 1_000_000) -> Iterator[str]:
        """A text in pieces that the split never crosses: cut where a space follows a non-space."""
        start = 0
        while len(text) - start > limit:
            m = self.cut.search(text, start + limit)
            if not m:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def _tokens(self, text: str) -> Iterator[list[str]]:
        if not self.marks or not self.marks.search(text):
            for piece in self._pieces(text):
                yield self.split.findall(piece)
            return
        at = 0
        for m in self.marks.finditer(text):
            yield from map(self.split.findall, self._pieces(text[at : m.start()]))
            yield [m.group()]
            at = m.end()
        yield from map(self.split.findall, self._pieces(text[at:]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        words: list[str] = []
        ends = []
        for text in texts:
            for part in self._tokens(text or ""):
                words += part
            ends.append(len(words))
        new = [w for w in dict.fromkeys(words) if w not in self.slot]
        if new:
            if len(self.slot) + len(new) > REMEMBERED:
                self.forget()
                new = [w for w in dict.fromkeys(words) if w not in self.slot]
            self._learn(new)
        codes = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
        n = self.len[0][codes] if len(codes) else codes
        before = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(self.at[0][codes] - before[:-1], n) + np.arange(before[-1]) if len(codes) else codes
        return self.ids[0][flat] if len(codes) else codes.astype(np.int32), np.diff(before[np.array([0, *ends])])

    def decode(self, ids: np.ndarray) -> str:
        """Text of a row of ids; ids outside the vocabulary are skipped, broken UTF-8 becomes U+FFFD."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        n = self.raw_len[ids]
        at = np.repeat(self.raw_at[ids] - np.concatenate([[0], np.cumsum(n)[:-1]])[: len(n)], n) + np.arange(n.sum())
        return self.raw[at].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with a column `ids` (array<int>) of the BPE ids of every whole text, and if `decoded` names one
    with a column of the text decoded from them again in the same pass; input columns of these names are
    replaced. A null text is encoded as an empty one (no ids). Special tokens written in a text get their
    own id. `vocabulary` is a file that every executor can open."""
    kept = df.drop(ids, *filter(None, [decoded]))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        try:
            for batch in slices(batches, text, 2_000_000):
                flat, lens = c.encode(batch.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(lens)])
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    columns.append(pa.array([c.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)
        finally:
            c.forget()  # the worker process outlives this task

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a string column `text` decoded from `ids`; a null array gives a null text."""
    kept = df.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            column = batch.column(ids)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [c.decode(flat[a:b]) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs, and behind them the ids if wanted."""
    coded = encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
