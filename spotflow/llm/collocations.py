"""Phrases that stand together more often than chance, by Apriori level-wise passes.

Each pass reads the texts and counts the phrases of one length. From the second on, a phrase is emitted only if
both phrases of one word less in it, without its last and without its first word, are frequent. The frequent ones are
sent to the tasks as a table of bits over their hashes, which has a fixed largest size whatever the corpus: a bit that is set by
another phrase lets a few infrequent phrases through, which the exact count after the shuffle removes, and never
stops a frequent one. The tables of the levels then give the counts of the two parts of every cut.

Tasks add up a million words before they send anything. Sums are dealt by language and phrase, so that no
task holds a language; the best of a language are found in rounds over salted groups of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from spotflow.llm.text import UPPER, mix64, segments, slices
from spotflow.session import materialize

#: Words that a task adds up before it sends; bits of the largest and the smallest table of frequent phrases; bits for each.
CHUNK, MOST_BITS, LEAST_BITS, SPARE = 1_000_000, 30, 16, 16
#: Bits in a page of such a table, and rows of a group that a round of the ranking sorts.
PAGE, GROUP = 16, 10_000
#: Lower-cases A-Z, makes a line break of what ends a piece and a space of a tab.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases that go on with a word, from the hashes of both."""
    return mix64(phrase * np.uint64(0x165667B19E3779F9) + mix64(word + np.uint64(1)))


def phrase_hash(phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases of one length, words joined by spaces."""
    split = [p.split(b" ") for p in phrases]
    columns = [word_hash(list(c)) for c in zip(*split)]
    out = columns[0] if columns else np.zeros(0, np.uint64)
    for c in columns[1:]:
        out = longer_hash(out, c)
    return out


class Bits:
    """A set of hashes as a table of bits at their first `width` bits."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.width)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def frequent_bits(level: DataFrame) -> Bits:
    """The table of bits of the phrases of a level: at most 2**MOST_BITS bits (128 MB) on the driver, whatever the level."""
    n = level.count()
    width = min(MOST_BITS, max(LEAST_BITS, (SPARE * n - 1).bit_length() if n else 0))
    low = min(PAGE, width)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = phrase_hash(pc.cast(batch.column(0), pa.binary()).to_pylist()) >> np.uint64(64 - width)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(low)).astype(np.int64)), pa.array((at & np.uint64((1 << low) - 1)).astype(np.int32))], names=["page", "at"])

    def page(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(1 << low, np.uint8)
        own[table.column("at").to_numpy()] = 1
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    pages = level.select("phrase").mapInArrow(places, "page long, at int").groupBy("page").applyInArrow(page, "page long, bits binary")
    data = np.zeros(1 << width >> 3, np.uint8)
    for r in pages.toLocalIterator():
        start = r.page << low >> 3
        data[start : start + (1 << low >> 3)] = np.frombuffer(bytes(r.bits), np.uint8)
    return Bits(data, width)


class _Buffer:
    """Texts of several languages as numbers of their words, pieces apart."""

    def __init__(self) -> None:
        self.numbers: list[np.ndarray] = []
        self.known: dict[str, defaultdict] = {}
        self.next = count(1).__next__
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        """Add part of a text that begins and ends with whole words."""
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = defaultdict(self.next, {b"\n": 0, b"": -1})
        words = text.replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        self.numbers.append(numbers[numbers >= 0])
        self.size += len(self.numbers[-1])

    def end(self) -> None:
        self.numbers.append(np.zeros(1, np.int32))

    def tail(self, lang: str, size: int) -> bytes:
        """The last `size` words of the piece at hand, which the next buffer begins with."""
        last = np.concatenate(self.numbers)[-size:].tolist() if size else []
        while 0 in last:
            last = last[last.index(0) + 1 :]
        named = {number: word for word, number in self.known[lang].items() if number in last}
        return b" ".join(named[i] for i in last)

    def words(self) -> tuple[list[bytes], np.ndarray, list[str]]:
        """Word and language (as a place in the list of languages) of each number, from 1."""
        words, at, of, langs = [], [], [], list(self.known)
        for i, lang in enumerate(langs):
            known = self.known[lang]
            del known[b"\n"], known[b""]
            words += known
            at.append(np.fromiter(known.values(), np.int64, len(known)))
            of.append(np.full(len(known), i))
        order = np.argsort(np.concatenate(at)) if at else np.zeros(0, int)
        return [words[i] for i in order.tolist()], np.concatenate(of)[order] if of else order, langs


def count_phrases(buffer: _Buffer, size: int, frequent: list[Bits]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[str]]:
    """Of the phrases of `size` words in a buffer whose parts are frequent: their words (a row of numbers from 0
    each), counts and languages; and the words and languages that those numbers name."""
    words, of, langs = buffer.words()
    line = np.concatenate(buffer.numbers).astype(np.int64) - 1
    n = len(words)
    if size == 1:
        counts = np.bincount(line[line >= 0], minlength=n)
        return np.arange(n)[:, None], counts, of, words, langs
    hashes = word_hash(words)
    own, held, rows = hashes, line, np.arange(n)[:, None]  # hashes and words of the distinct phrases; the phrase at each place
    counts = np.zeros(0, np.int64)
    for step in range(1, size):
        allowed = np.append(frequent[step - 1].has(own), False)  # -1 is the break
        at = np.flatnonzero(allowed[held[:-1]] & allowed[held[1:]])
        codes = held[at] * n + line[at + step]
        distinct, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
        before, last = distinct // max(n, 1), distinct % max(n, 1)
        own, rows = longer_hash(own[before], hashes[last]), np.column_stack([rows[before], last])
        held = np.full(len(held) - 1, -1)
        held[at] = place
    return rows, counts, of[rows[:, 0]], words, langs


def count_level(docs: DataFrame, size: int, frequent: list[Bits], least: int) -> DataFrame:
    """lang, phrase and n of the phrases of `size` words with at least `least` occurrences in a language whose
    parts are frequent. On the first level, a row without a phrase has the number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer()
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), pc.cast(batch.column("text"), pa.binary()).to_pylist()):
                for some in segments(text.translate(PIECES), ends=b" \n"):
                    buffer.add(lang, some)
                    if buffer.size >= CHUNK:
                        tail = buffer.tail(lang, size - 1)
                        yield from send(buffer)
                        buffer = _Buffer()
                        buffer.add(lang, tail)
                buffer.end()
        if buffer.size:
            yield from send(buffer)

    def send(buffer: _Buffer) -> Iterator[pa.RecordBatch]:
        rows, counts, of, words, langs = count_phrases(buffer, size, frequent)
        names, spelled = pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string())
        for i in range(0, len(rows), 100_000):
            some = slice(i, i + 100_000)
            columns = [spelled.take(pa.array(c)) for c in rows[some].T]
            phrase = pc.binary_join_element_wise(*columns, " ") if size > 1 else columns[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[some])), phrase, pa.array(counts[some].astype(np.int64))], names=["lang", "phrase", "n"])
        if size == 1:
            total = np.bincount(of, weights=counts, minlength=len(langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(langs), pa.string()), pa.array(total)], names=["lang", "phrase", "n"])

    # dealt out before the sum: within a task phrases are distinct already, so that a partial sum would only cost
    sent = docs.mapInArrow(run, "lang string, phrase string, n long").repartition("lang", "phrase")
    return sent.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


def best_of_each(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """rows with `rank`: the first `most` of each key. Groups are cut by a hash into parts of about GROUP rows, of
    which the first `most` go on, until a key is one part."""
    salts = -(-rows.count() // max(GROUP, 2 * most))
    while salts > 1:
        w = Window.partitionBy(key, "_salt").orderBy(*order)
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
        rows = materialize(salted.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most).drop("_salt", "_place"), "best")
        salts = -(-salts * most // max(GROUP, 2 * most))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)


def mine(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of the first `most` collocations of every language by score and
    a descending, then phrase by its UTF-8 bytes.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line breaks, and those into words at spaces and tabs; a
    null language is `und`, a null or empty text has no words. n counts the words of the language and a all
    occurrences of the phrase in it, overlaps and rows that repeat included. Candidates are phrases of 2 to `longest` words with a >=
    `least`. Of the cuts of a candidate into two parts with l and r occurrences the one with the lowest floor(1000000 * a *
    a / (l * r)) counts, of equal ones that with the shortest first part. A candidate that stands in a longer one with
    at least `inside` percent of its occurrences is left out. Arithmetic is in whole numbers of 38 digits. Other
    columns play no part.
    """
    texts = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    levels, frequent = [], []
    for size in range(1, longest + 1):
        level = materialize(count_level(texts, size, frequent, least), f"level{size}")
        levels.append(level)
        if size < longest:
            frequent.append(frequent_bits(level.filter("phrase IS NOT NULL")))
    totals = levels[0].filter("phrase IS NULL").select("lang", F.col("n").alias("n"))
    counts, candidates = levels[0].filter("phrase IS NOT NULL"), levels[1]
    for level in levels[1:-1]:
        counts = counts.unionByName(level)
    for level in levels[2:]:
        candidates = candidates.unionByName(level)

    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut"))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("cut"))).withColumn("rest", part(F.col("cut") + 1, F.size(words) - F.col("cut")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(1000000 AS DECIMAL(38, 0)) * a * a DIV (CAST(l AS DECIMAL(38, 0)) * r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # the phrases of at least two words in each longer candidate
    size = F.size(words)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: part(i, k))))
    wider = candidates.filter(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("wide"))
    wider = wider.groupBy("lang", "phrase").agg(F.max("wide").alias("wide"))
    own = scored.join(wider, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("wide") < inside * F.col("a"), F.lit(True))).drop("wide")
    best = best_of_each(materialize(own, "scored"), "lang", [F.desc("score"), F.desc("a"), "phrase"], most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, most: int = 2000) -> str:
    """DuckDB SQL for the query with phrases of two and three words: all phrases counted, no levels."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {least}),
cut AS (SELECT c.*, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS u, array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS v FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
scored AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * cut.a * cut.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON cut.lang = x.lang AND u = x.phrase JOIN f y ON cut.lang = y.lang AND v = y.phrase),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
wide AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(a) AS wide FROM c, (VALUES (1), (2)) t(i) WHERE k = 3 GROUP BY ALL),
own AS (SELECT low.* FROM low LEFT JOIN wide USING (lang, phrase) WHERE wide IS NULL OR 100 * wide < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own) JOIN n USING (lang) WHERE rank <= {most}"""
