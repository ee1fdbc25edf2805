"""Language identification by interpolated Kneser-Ney character models.

A word is a run of letters of the lower-cased text, framed by a begin and an end mark; its
characters are predicted from up to ORDER - 1 characters before them inside the word. All languages
share sorted arrays of gram hashes whose rows hold each language's interpolated log probability, so
that one search serves every language; a context array holds the weights left to lower orders.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.text import mix64, slices
from spotflow.session import materialize

ORDER = 4
BEGIN, END = "\x02", "\x03"
#: Runs of letters and of numbers that are no digits (like a half); the latter are taken out by letter_words.
WORDS = re.compile(r"[^\W\d_]+")
#: Words a worker remembers before it starts anew.
REMEMBERED = 60_000


def letter_words(text: str) -> list[str]:
    """Runs of letters of a text."""
    words = WORDS.findall(text)
    if "".join(words).isalpha():
        return words
    return [part for w in words for part in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split()]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the framed words in a row, each one's place in its word, and where words start."""
    codes = np.frombuffer("".join(f"{BEGIN}{w}{END}" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    return codes, np.arange(len(codes)) - np.repeat(start, size), start


def _rolling(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1..ORDER characters that end at each place (those that reach past a word are unused)."""
    out, total, power = [], np.zeros(len(codes), dtype=np.uint64), np.ones(1, dtype=np.uint64)
    for m in range(1, ORDER + 1):
        back = np.zeros(len(codes), dtype=np.uint64)
        back[m - 1 :] = codes[: len(codes) - m + 1]
        total = total + (back + np.uint64(1)) * power
        power = power * np.uint64(0x9E3779B97F4A7C15)
        out.append(mix64(total + np.uint64(m)))
    return out


def _gram_key(grams: list[str], m: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(-1, m)
    total, power = np.zeros(len(codes), dtype=np.uint64), np.ones(1, dtype=np.uint64)
    for k in range(m):
        total = total + (codes[:, m - 1 - k] + np.uint64(1)) * power
        power = power * np.uint64(0x9E3779B97F4A7C15)
    return mix64(total + np.uint64(m))


@dataclass
class LanguageModel:
    langs: list[str]
    keys: list[np.ndarray]  # by order: sorted gram hashes
    logp: list[np.ndarray]  # by order: natural log of the full probability, a column a language
    context_keys: list[np.ndarray]  # by order: sorted hashes of contexts of that many characters
    context_log: list[np.ndarray]  # by order: log of the weight they leave to the lower order
    unseen: np.ndarray  # log probability of a character never seen
    sharpness: tuple[float, float] = (1.0, 0.5)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # a language a row: variance of a text, variance of a character
    cut: float = float("inf")

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each framed word, a column a language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        codes, place, start = _codes(words)
        hashes = _rolling(codes)
        total = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
        todo = np.flatnonzero(place > 0)
        for m in range(ORDER, 0, -1):
            fits = place[todo] >= m - 1
            here, later = todo[fits], todo[~fits]
            at = np.minimum(np.searchsorted(self.keys[m], hashes[m - 1][here]), len(self.keys[m]) - 1)
            hit = self.keys[m][at] == hashes[m - 1][here]
            total[here[hit]] += self.logp[m][at[hit]]
            missed = here[~hit]
            if m > 1 and len(missed):
                context = hashes[m - 2][missed - 1]
                at = np.minimum(np.searchsorted(self.context_keys[m - 1], context), len(self.context_keys[m - 1]) - 1)
                known = self.context_keys[m - 1][at] == context
                total[missed[known]] += self.context_log[m - 1][at[known]]
            todo = np.sort(np.concatenate([missed, later]))
        total[todo] += self.unseen
        return np.add.reduceat(total, start, axis=0)

    def judge(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From log probabilities and numbers of predicted characters: best language, confidence,
        cross-entropy in bits a character, rejected."""
        entropy = -sums / np.maximum(n, 1)[:, None] / np.log(2)
        best = entropy.argmin(axis=1)
        t, e = self.sharpness
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * t * np.maximum(n, 1)[:, None] ** e
        confidence = 1 / np.exp(z).sum(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        far = np.zeros(len(best))
        if self.mean is not None:
            far = (lowest - self.mean[best]) / np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
        return best, confidence, lowest, far


class _Scorer:
    """Scores texts, remembering words between them."""

    def __init__(self, model: LanguageModel):
        self.model, self.slot, self.table = model, {}, np.zeros((0, len(model.langs)), dtype=np.float32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        ends, sizes = [], []
        for text in texts:
            own = letter_words(text.lower()) if text else []
            words += own
            ends.append(len(words))
            sizes.append(sum(map(len, own)) + len(own))
        fresh = [w for w in dict.fromkeys(words) if w not in self.slot]
        if fresh:
            if len(self.slot) + len(fresh) > REMEMBERED:
                self.slot, self.table = {}, self.table[:0]
                fresh = list(dict.fromkeys(words))
            base = len(self.table)
            self.table = np.concatenate([self.table, self.model.word_scores(fresh).astype(np.float32)])
            self.slot.update(zip(fresh, range(base, base + len(fresh))))
        codes = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
        running = np.concatenate([np.zeros((1, len(self.model.langs))), np.cumsum(self.table[codes], axis=0, dtype=np.float64)])
        return np.diff(running[[0, *ends]], axis=0), np.array(sizes, dtype=np.int64)


def _cut(m: int):
    return lambda i: F.substring(F.col("word"), i, F.lit(m))


def _gram_counts(texts: DataFrame) -> pd.DataFrame:
    """lang, gram, n over the framed words of texts (lang, text): counted by Spark, merged by words first."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.update((lang, w) for w in letter_words((text or "").lower()))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([f"{BEGIN}{k[1]}{END}" for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = texts.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    parts = [F.transform(F.sequence(F.lit(1), F.length("word") - m + 1), _cut(m)) for m in range(1, ORDER + 1)]
    grams = F.flatten(F.array(*[F.when(F.length("word") >= m, p).otherwise(F.array().cast("array<string>")) for m, p in enumerate(parts, 1)]))
    return counted.select("lang", "n", F.explode(grams).alias("gram")).filter(F.col("gram") != BEGIN).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


def _estimate(counts: pd.DataFrame) -> LanguageModel:
    """Interpolated Kneser-Ney over the counted grams, one model a language on shared arrays."""
    langs = sorted(counts["lang"].unique())
    counts = counts.assign(order=counts["gram"].str.len())
    alphabet = counts.loc[counts["order"] == 1, "gram"].nunique() + 1
    keys, logp, context_keys, context_log = [None], [None], [None], [None]
    below: pd.DataFrame | None = None  # probabilities one order lower, a column a language
    for m in range(1, ORDER + 1):
        own = counts[counts["order"] == m]
        grams = pd.Index(sorted(own["gram"].unique()))
        prob = np.zeros((len(grams), len(langs)))
        heads = pd.Index(sorted({g[:-1] for g in grams}))
        left_over = np.ones((len(heads), len(langs)))
        head_at = heads.get_indexer([g[:-1] for g in grams])
        lower = below.reindex([g[1:] for g in grams]).to_numpy() if below is not None else np.full((len(grams), len(langs)), 1 / alphabet)
        above = counts[counts["order"] == m + 1]
        for k, lang in enumerate(langs):
            mine = own[own["lang"] == lang].set_index("gram")["n"]
            if m < ORDER:  # lower orders count what precedes; nothing precedes the begin mark
                tails = above.loc[above["lang"] == lang, "gram"].str[1:].value_counts()
                framed = mine.index.str.startswith(BEGIN)
                mine = pd.Series(np.where(framed, mine, tails.reindex(mine.index).fillna(0)), index=mine.index)
            c = mine.reindex(grams).fillna(0).to_numpy(dtype=float)
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, once / (once + 2 * twice)) if once else 0.5
            total = np.bincount(head_at, weights=c, minlength=len(heads))
            kinds = np.bincount(head_at, weights=c > 0, minlength=len(heads))
            left_over[:, k] = np.where(total > 0, d * kinds / np.maximum(total, 1e-300), 1.0)
            seen = np.where(total[head_at] > 0, np.maximum(c - d, 0) / np.maximum(total[head_at], 1e-300), 0.0)
            prob[:, k] = seen + left_over[head_at, k] * lower[:, k]
        below = pd.DataFrame(prob, index=grams)
        order = np.argsort(_gram_key(list(grams), m))
        keys.append(_gram_key(list(grams), m)[order])
        logp.append(np.log(prob[order]).astype(np.float32))
        if m == 1:
            unseen = np.log(left_over[0] / alphabet)
        else:
            order = np.argsort(_gram_key(list(heads), m - 1))
            context_keys.append(_gram_key(list(heads), m - 1)[order])
            context_log.append(np.log(left_over[order]).astype(np.float32))
    return LanguageModel(langs, keys, logp, context_keys, context_log, unseen.astype(np.float32))


def fit(docs: DataFrame, sample_chars: int = 2_000_000) -> LanguageModel | None:
    """Learn from docs (text, lang). None if no row has a language and a letter.

    The model is fitted on a bounded sample: of each language's rows a share that a hash of the text
    picks, so that about `sample_chars` characters are expected; equal texts count once. Four in five
    sampled rows give the counts, the fifth calibrates confidence and rejection.
    """
    rows = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()  # a row a language, as the model has
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample_chars / r.chars))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    picked = materialize(rows.filter(place < share[F.col("lang")]).dropDuplicates(["lang", "text"]), "sample")
    held = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(5)) == 0
    counts = _gram_counts(picked.filter(~held))
    if counts.empty:
        return None
    model = _estimate(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in slices(batches, "text"):
            sums, n = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], names=["lang", "n", "sums"])

    seen = picked.filter(held).mapInArrow(score, "lang string, n long, sums array<double>").filter("n > 0").toPandas()
    shared.destroy()
    seen = seen[seen["lang"].isin(model.langs)]
    if len(seen):
        sums, n = np.stack(seen["sums"].to_list()).reshape(-1, k), seen["n"].to_numpy()
        truth = np.array([model.langs.index(x) for x in seen["lang"]])
        entropy = -sums / n[:, None] / np.log(2)

        def loss(t: float, e: float) -> float:
            z = -(entropy - entropy.min(axis=1, keepdims=True)) * t * n[:, None] ** e
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(n)), truth]))

        model.sharpness = min(((t, e) for t in (0.25, 0.5, 1, 2, 4, 8, 16) for e in (0.0, 0.5, 1.0)), key=lambda x: loss(*x))
        model.mean, model.spread = np.zeros(k), np.zeros((k, 2))
        own = entropy[np.arange(len(n)), truth]
        for j in range(k):
            x, m = own[truth == j], n[truth == j]
            if len(x) < 5:  # too few to tell: as wide as may be
                model.mean[j], model.spread[j] = own.mean(), (own.var() + 1.0, 4.0)
                continue
            model.mean[j] = np.average(x, weights=m)
            long = m >= np.median(m)
            model.spread[j, 0] = ((x[long] - model.mean[j]) ** 2).mean() + 1e-4
            model.spread[j, 1] = max(0.5, (m * (x - model.mean[j]) ** 2)[~long].mean() if (~long).any() else 0.5)
        far = (own - model.mean[truth]) / np.sqrt(model.spread[truth, 0] + model.spread[truth, 1] / n)
        model.cut = 3.0 * max(5.0, float(np.quantile(far, 0.999)))
    return model


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected (input columns of these names are replaced).

    lang_pred is the language with the lowest cross-entropy a character, `und` if the text is null or
    has no letter; score is the calibrated confidence in it (0 for und). rejected holds for und and
    where the cross-entropy is further above its language's mean than calibration texts ever were.
    Of languages with equal entropy the first by name counts.
    """
    names = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "rejected": T.BooleanType()}
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in names.items()]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = _Scorer(m) if m else None
        for batch in slices(batches, text, 2_000_000):
            if not scorer:
                lang, score, entropy, out = ["und"] * len(batch), np.zeros(len(batch)), [None] * len(batch), [True] * len(batch)
            else:
                sums, n = scorer.score(batch.column(text).to_pylist())
                best, confidence, lowest, far = m.judge(sums, n)
                lang = [m.langs[b] if k else "und" for b, k in zip(best, n)]
                score, entropy = np.where(n > 0, confidence, 0.0), pa.array(lowest, mask=n == 0)
                out = (n == 0) | (far > m.cut)
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)
