"""Passages of a benchmark in documents, by one Aho-Corasick automaton.

The letters of the automaton are words: every word of the benchmark is a letter of its own, all other words are one
letter that no pattern holds. Its patterns are the windows of the items, `words` consecutive words each (an item of fewer
words is one window). A document's words are read once; each match says which words it covers, and word
positions are mapped back to code points of the original text.

The corpus is never shuffled. Windows are counted by Spark, and the automaton is sent to the tasks only in blocks
of a fixed size: a benchmark of more windows is scanned for in several passes whose matches are united.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spotflow.llm.text import UPPER, segments, slices
from spotflow.session import materialize

#: Pairs of a window and an item in one automaton: about 0.1 GB in a worker, fewer letters than there are code points.
BLOCK = 100_000
#: Lower-cases A-Z and makes a space of every ASCII character that is neither letter nor digit.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
OTHER = "\0"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(words: list[bytes], size: int) -> list[bytes]:
    """The windows of an item, words joined by a space; none without words."""
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def letter(i: int) -> str:
    """The i-th letter for words, from 0: code points from 1 without the surrogates."""
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


class Automaton:
    """Windows of items as patterns over words."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        self.letters: dict[bytes, str] = {}
        found: dict[str, tuple[int, list[str]]] = {}
        for window, item in pairs:
            words = window.split(b" ")
            key = "".join(self.letters.setdefault(w, letter(len(self.letters))) for w in words)
            items = found.setdefault(key, (len(words), []))[1]
            if item is not None:
                items.append(item)
        self.trie = ahocorasick.Automaton()
        for key, value in found.items():
            self.trie.add_word(key, value)
        self.trie.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words of a text, the stretches of words (first, one beyond the last) that matches cover and
        the items matched."""
        get, parts = self.letters.get, []
        for some in segments(text.translate(NORMAL)):
            parts.append("".join(map(get, some.split(), repeat(OTHER))))
        line = "".join(parts)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.letters:
            for end, (size, of) in self.trie.iter(line):
                items.update(of)
                spans.append((end + 1 - size, end + 1))
        return len(line), united(spans), items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that neither overlap nor touch, in order, which cover the same."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as stretches of code points of the original text."""
    at = [m.span() for m in WORD.finditer(text)] if spans else []
    return [(at[first][0], at[end - 1][1]) for first, end in spans]


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, sent) -> Automaton:
    """The automaton of a broadcast block, built once in a worker, which holds one at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(sent.value)
    return _BUILT[name]


def item_windows(benchmark: DataFrame, words: int) -> DataFrame:
    """item (item_id as text) and window of every window of the benchmark, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(set(windows(normal_words(text.encode()), words)))
                for i in range(0, len(found), 10_000):
                    some = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.binary())], names=["item", "window"])

    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "item string, window binary").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids of the items with occurring windows
    as text, sorted) and spans (start and end of the stretches of hit words in code points of the text) for every
    row of docs (doc_id, text).

    Both sides are lower-cased (A-Z), words are runs of letters, digits and non-ASCII characters. A null or empty text has no
    words and no hits; rows that repeat, or share a doc_id, are scanned each. Rows of the benchmark that share an
    item_id are texts of one item; those without an item_id hit words but name no item; null texts have no windows.
    Other columns of either table play no part.
    """
    spark = docs.sparkSession
    pairs = materialize(item_windows(benchmark, words), "windows")
    blocks = max(1, -(-pairs.count() // BLOCK))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    spans = "array<struct<first:long, end:long>>"
    rows = docs.select("doc_id", "text")
    for number in range(blocks):
        # by a hash of window and item: a block has about BLOCK pairs even if one window is in very many items
        block = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == number) if blocks > 1 else pairs
        sent = spark.sparkContext.broadcast([(bytes(r.window), r.item) for r in block.toLocalIterator()])
        final = number == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], name=uuid.uuid4().hex, sent=sent, final=final) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, sent)
            for batch in slices(batches, "text"):
                texts, seen = batch.column("text"), batch.schema.names
                before = [[(s["first"], s["end"]) for s in row] for row in batch.column("spans").to_pylist()] if "spans" in seen else [[]] * len(batch)
                named = batch.column("items").to_pylist() if "items" in seen else [[]] * len(batch)
                counts, hits, all_spans, all_items = [], [], [], []
                for i, text in enumerate(pc.cast(texts, pa.binary()).to_pylist()):
                    n, found, items = automaton.scan(text) if text else (0, [], set())
                    found = united([*before[i], *found]) if before[i] else found
                    counts.append(n)
                    hits.append(sum(end - first for first, end in found))
                    all_items.append(sorted({*named[i], *items}))
                    all_spans.append([{"first": a, "end": b} for a, b in (places(text.decode(), found) if found and final else found)])
                columns = {"doc_id": batch.column("doc_id"), "text": texts, "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "items": pa.array(all_items, pa.list_(pa.string()))}
                columns["spans"] = pa.array(all_spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
                if final:
                    del columns["text"]
                yield pa.RecordBatch.from_pydict(columns)

        text = "" if final else "text string, "
        rows = rows.mapInArrow(run, f"{kind}, {text}n_words long, n_hit long, items array<string>, spans {spans}")
        rows = rows if final else materialize(rows, "scanned")
    return rows.withColumn("spans", F.transform("spans", lambda s: F.struct(s["first"].alias("start"), s["end"].alias("end"))))


def oracle(words: int) -> str:
    """DuckDB SQL for the query: every window of the documents joined with those of the items."""
    of = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {of} AS w FROM documents),
b AS (SELECT item_id, {of} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({words}, len(w)) AS size, array_to_string(w[i : i + least({words}, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS s FROM (SELECT DISTINCT size FROM iw), d, unnest(range(1, len(w) + 1)) t(i) WHERE i + size - 1 <= len(w)),
m AS (SELECT doc_id, i, size, item_id FROM dw JOIN iw USING (size, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + size)) t(k) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""
