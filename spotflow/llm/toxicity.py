"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the classes of a clause's words: negation and targets open a scope of a
few words, reported speech one that lasts to the clause's end, a threat needs an intention, a verb of
violence and a target in that order, and a host counts the words around a cue. Their composition is one
automaton. Its final state accepts the clause or not: a cue is a match only in a clause of at least HOST
words or aimed at someone, so that a word that stands alone matches nothing. A match has a pattern:
an insult or threat, plain or aimed at someone, negated or reported. Cues that clean texts use too are weak:
their clauses match by the same grammar, and what they add is the log likelihood ratio of their number in
clauses of that length; negated and reported ones add nothing. A text's score is a logistic function of
the weights of its matched clauses. Weights start from a prior and are learned from labels, as are cues.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.text import slices
from spotflow.session import materialize

#: A word is a run of letters, apostrophes inside it included.
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: A clause ends at one of these marks (several in a row are emphasis or noise) or at the end of a line.
CLAUSE = re.compile(r"(?<![.!?;])[.!?;](?![.!?;])|\n")
#: Stems that can be learned as cues have so many letters and begin so many different words, else whole words
#: are learned; END marks a whole word.
SHORTEST, LONGEST, STEM_WORDS, END = 4, 8, 4, "$"
#: Words of a clause that hosts a cue.
HOST = 3
#: Words whose class a worker remembers before it starts anew.
REMEMBERED = 60_000
CLASSES = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, WEAK = range(8)

INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile bastard jerk dumb fool vermin filth dummkopf abschaum imbécile ordure idiota imbécil escoria basura"
THREATS = "kill hurt destroy beat shoot stab burn murder attack punch strangle töten umbringen verletzen tuer frapper brûler matar golpear quemar"
TARGETS = "you your youre ya he she they them him her his their man men woman women guy guys people person boy girl kid kids everyone mann frau leute homme femme gens hombre mujer gente du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes ellos ellas"
NEGATIONS = "not never no isnt arent wasnt dont doesnt didnt wont cant nobody hardly nicht kein keine niemals pas jamais aucun nunca tampoco"
REPORTS = "said says wrote writes called calls claimed quoted quote reported sagte schrieb nannte écrit appelé dijo escribió llamó"
INTENTS = "will gonna shall must should going ill werde werden vais allons voy vamos"

#: Patterns that arcs emit, in the order of the weights, and the weights before any label is seen.
PATTERNS = ("insult", "insult aimed", "insult negated", "insult reported", "threat", "threat aimed", "threat negated", "threat reported", "weak")
PRIOR = np.array([2.5, 3.5, 0.2, 0.5, 0.3, 4.0, 0.1, 0.4, 0.5])
PRIOR_BIAS = -3.0
#: Rates of weak cues a pair of words in toxic and in clean texts, before any label is seen; a rate is never below LEAST_RATE.
PRIOR_RATES, LEAST_RATE = (0.01, 0.001), 1e-4


def lowered(text: str | None) -> str:
    """A text in lower case with one kind of apostrophe."""
    return (text or "").lower().replace("’", "'")


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + END]


def scope(opener: int, length: int) -> dict:
    """A transducer that is open for `length` words after each `opener`; its output is being open."""
    return {"start": 0, "step": lambda s, c: length if c == opener else max(0, s - 1), "out": lambda s: s > 0}


def at_least(words: int) -> dict:
    """A transducer that is open from the given number of words on."""
    return {"start": 0, "step": lambda s, c: min(words, s + 1), "out": lambda s: s >= words}


def until_end(opener: int) -> dict:
    """A transducer that stays open from the first `opener` on."""
    return {"start": 0, "step": lambda s, c: 1 if c == opener else s, "out": lambda s: s > 0}


def compose(parts: list[dict]) -> tuple[list[list[int]], list[tuple[bool, ...]]]:
    """The product automaton of transducers that read the same classes: arcs[state][class] and, for each
    state, what every part puts out in it. Only reachable states are built; state 0 is the start."""
    start = tuple(p["start"] for p in parts)
    number, arcs, todo = {start: 0}, [], [start]
    while todo:
        row = []
        for c in CLASSES:
            to = tuple(p["step"](s, c) for p, s in zip(parts, todo[0]))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        arcs.append(row)
        todo.pop(0)
    return arcs, [tuple(p["out"](s) for p, s in zip(parts, state)) for state in number]


class _Classes(dict):
    """Class of every word met; the learned cues are stems, or whole words with END behind."""

    def __init__(self, known: dict[str, int], learned: frozenset[str], weak: frozenset[str]):
        super().__init__(known)
        self.known, self.learned, self.weak = known, learned, weak

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.forget()
        self[word] = c = self.known.get(word) or (self._joined(word) if "'" in word else OTHER) or self._learned(beginnings(word))
        return c

    def _joined(self, word: str) -> int:
        """Class of a word with an apostrophe: n't and n' deny, 'll intends, else that of its first part or its last."""
        first, last = word.split("'", 1)
        if word.endswith("n't") or first == "n":
            return NEGATION
        return INTENT if last == "ll" else self.known.get(first) or self.known.get(last) or OTHER

    def forget(self) -> None:
        self.clear()
        self.update(self.known)

    def _learned(self, cues: list[str]) -> int:
        if not self.learned.isdisjoint(cues):
            return INSULT
        return OTHER if self.weak.isdisjoint(cues) else WEAK


@dataclass
class ToxicityModel:
    learned: frozenset[str] = frozenset()
    weak: frozenset[str] = frozenset()
    rates: tuple[float, float] = PRIOR_RATES
    bias: float = PRIOR_BIAS
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    @cached_property
    def classes(self) -> _Classes:
        known: dict[str, int] = {}
        for kind, text in ((INTENT, INTENTS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)):
            known |= dict.fromkeys(text.split(), kind)
        return _Classes(known, self.learned, self.weak)

    @cached_property
    def automaton(self) -> tuple[list[list[int]], list[tuple[int, int]], list[bool]]:
        """arcs; for each state the patterns of an insult and of a threat met in it; whether a clause that ends
        in it is a host."""
        arcs, outs = compose([scope(NEGATION, 4), scope(TARGET, 6), until_end(REPORT), scope(INTENT, 4), at_least(HOST)])
        emits = []
        for negated, aimed, reported, intent, _ in outs:
            insult = 3 if reported else 2 if negated else 1 if aimed else 0
            emits.append((insult, (7 if reported else 6 if negated else 4) if intent else -1))
        return arcs, emits, [out[-1] for out in outs]

    def clause(self, met: list[int]) -> list[tuple[int, int]]:
        """(place of the cue, pattern) of each match in a clause whose words have the classes met."""
        arcs, emits, hosts = self.automaton
        state, found = 0, []
        for i, c in enumerate(met):
            if c == INSULT or c == WEAK:
                found.append((i, emits[state][0]))
            elif c == THREAT and emits[state][1] >= 0:
                found.append((i, emits[state][1]))
            elif c == TARGET and found and found[-1][1] == 4:  # the threat has found whom it is for
                found[-1] = found[-1][0], 5
            state = arcs[state][c]
        return found if hosts[state] else [m for m in found if m[1] in (1, 5)]

    def matches(self, text: str | None) -> np.ndarray:
        """How many clauses match each pattern (of insults plain or aimed, how many different ones after the first), how many
        different weak cues (with the word before) match plainly or aimed, and how many different pairs of words a text with
        such matches has."""
        counts = np.zeros(len(PATTERNS) + 1)
        low = lowered(text)
        classes = self.classes
        words = LETTERS.findall(low)
        met = [classes[w] for w in words]
        if INSULT not in met and THREAT not in met and WEAK not in met:
            return counts
        at, weak, named = 0, set(), set()
        for clause in CLAUSE.split(low):
            n = len(LETTERS.findall(clause))
            kinds, first = met[at : at + n], at
            at += n
            if INSULT not in kinds and THREAT not in kinds and WEAK not in kinds:
                continue
            found = self.clause(kinds)
            counts[list({pattern for i, pattern in found if kinds[i] != WEAK and pattern})] += 1
            named.update(words[first + i] for i, pattern in found if kinds[i] == INSULT and pattern < 2)
            weak.update((words[first + i], words[first + i - 1] if first + i else "") for i, pattern in found if kinds[i] == WEAK and pattern < 2)
        counts[0] = max(0, len(named) - 1)
        if weak:
            counts[-2:] = len(weak), len(set(zip(words, ["", *words])))
        return counts

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Of rows that matches() gives: logarithms of the counts, and for weak cues the log likelihood ratio."""
        high, low = self.rates
        ratio = counts[:, -2] * np.log(high / low) - counts[:, -1] * (high - low)
        return np.column_stack([np.log2(1 + counts[:, :-2]), np.maximum(0, ratio)])

    def probability(self, counts: np.ndarray) -> np.ndarray:
        z = self.bias + self.features(counts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Newton's method for y of n positive at features x, drawn to the prior; weights stay at least 0."""
    a = np.column_stack([np.ones(len(x)), x])
    prior = np.concatenate([[PRIOR_BIAS], PRIOR])
    ridge = np.full(len(prior), 1.0)
    ridge[0] = 1e-3
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (y - n * p) - ridge * (w - prior)
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.diag(ridge), grad)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def _learn_cues(rows: DataFrame, contexts: int, texts: int, share: float, purity: float) -> tuple[frozenset[str], frozenset[str]]:
    """Cues that only toxic texts use, and weak ones."""

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            for text in batch.column("text").to_pylist():
                words = LETTERS.findall(lowered(text))
                found = list(set(zip(words, ["", *words])))
                own = xxhash.xxh3_64_intdigest((text or "").encode()) >> 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * len(found), pa.int64()), pa.array([w for w, _ in found], pa.string()), pa.array([b for _, b in found], pa.string()), pa.array([beginnings(w) for w, _ in found], pa.list_(pa.string()))],
                    names=["own", "word", "before", "cues"],
                )

    met = rows.filter("toxic").select("text").mapInArrow(of_toxic, "own long, word string, before string, cues array<string>")
    met = materialize(met.select("own", "word", "before", F.explode("cues").alias("cue")), "cues")
    wide = met.groupBy("cue", "word", "before").agg(F.lit(1)).groupBy("cue", "word").agg(F.count("*").alias("n")).groupBy("cue").agg(F.sum("n").alias("bad"), F.count("*").alias("words"))
    often = met.select("cue", "own").distinct().groupBy("cue").agg(F.count("*").alias("texts")).filter(F.col("texts") >= texts)
    fit_for_it = (F.col("bad") >= contexts) & (F.col("cue").endswith(END) | (F.col("words") >= STEM_WORDS))
    bad = materialize(wide.filter(fit_for_it).join(often, "cue").select("cue", "bad"), "candidates")
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(r.cue for r in bad.select("cue").collect()))

    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            pairs: set = set()
            for text in batch.column("text").to_pylist():
                words = LETTERS.findall(lowered(text))
                pairs.update(zip(words, ["", *words]))
            found: Counter = Counter()
            for word, n in Counter(w for w, _ in pairs).items():
                for cue in beginnings(word):
                    if cue in wanted.value:
                        found[cue] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["cue", "n"])

    good = rows.filter("NOT toxic").select("text").mapInArrow(of_clean, "cue string, n long").groupBy("cue").agg(F.sum("n").alias("good"))
    both = bad.join(good, "cue", "left").select("cue", "bad", F.coalesce("good", F.lit(0)).alias("good"))
    n = F.col("bad") + F.col("good")
    low = (F.col("bad") / n + 1.92 / n - 1.96 * F.sqrt(F.col("bad") * F.col("good") / (n * n * n) + 0.96 / (n * n))) / (1 + 3.84 / n)
    found = both.filter(low > share).select("cue", "bad", "good", (F.col("bad") >= purity * n).alias("pure")).collect()  # fewer than the sample has stems
    wanted.destroy()
    # of a stem and those that begin with it the one counts that tells most
    gain = {r.cue: r.bad * float(np.log((r.bad + 0.5) / (r.good + 0.5))) for r in found}
    taken: dict[str, bool] = {}
    for r in sorted(found, key=lambda r: (-gain[r.cue], r.cue)):
        below = any(other.startswith(r.cue) for other in taken)
        if not below and not any(r.cue[:k] in taken for k in range(SHORTEST, len(r.cue))):
            taken[r.cue] = r.pure
    return frozenset(c for c, p in taken.items() if p), frozenset(c for c, p in taken.items() if not p)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, contexts: int = 8, texts: int = 5, share: float = 0.65, purity: float = 0.97) -> ToxicityModel:
    """Learn cues and weights from docs (doc_id, text) that labels (doc_id, toxic) marks.

    A bounded sample of about `sample_rows` labelled rows is used, equal texts once and picked by a hash of
    the text. A word, or a stem that begins several words, becomes a cue if it is met in at least `contexts`
    different pairs of words and `texts` different texts marked toxic, and the lower end of a 95 % interval of
    its share of toxic contexts is over `share`: an insult if the share itself is at least `purity`, else a
    weak cue. Contexts, not rows, count, so copies of one text teach no more than the text. Of several labels
    of a document (or of equal texts) the highest counts. Without labelled rows the prior stands.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = docs.select("doc_id", "text").join(marks, "doc_id")
    total = marked.count()
    if not total:
        return ToxicityModel()
    if total > sample_rows:
        picked = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30))
        marked = docs.filter(picked).select("doc_id", "text").join(marks, "doc_id")
    rows = materialize(marked.groupBy("text").agg((F.max("toxic") == 1).alias("toxic")), "labelled")
    model = ToxicityModel(*_learn_cues(rows, contexts, texts, share, purity))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            seen: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[(tuple(shared.value.matches(text)), toxic)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(k[0]) for k in seen], pa.list_(pa.float64())), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())],
                names=["counts", "toxic", "n"],
            )

    seen = rows.mapInArrow(features, "counts array<double>, toxic boolean, n long").groupBy("counts", "toxic").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    counts, n, toxic = np.array(seen["counts"].to_list()).reshape(-1, len(PATTERNS) + 1), seen["n"].to_numpy(dtype=float), seen["toxic"].to_numpy(dtype=bool)
    rates = []
    for of in (toxic, ~toxic):  # of texts that have a weak cue, what comes after the first
        of = of & (counts[:, -2] > 0)
        rates.append(max(LEAST_RATE, float((n * (counts[:, -2] - 1))[of].sum() / max(1.0, (n * counts[:, -1])[of].sum()))))
    model = ToxicityModel(model.learned, model.weak, (max(rates[0], 2 * rates[1]), rates[1]) if model.weak else PRIOR_RATES)
    model.bias, model.weights = _logistic(model.features(counts), n * toxic, n)
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1, the probability of being toxic) and `predicted` (1 from 0.5 on); input
    columns of these names are replaced. Null and empty texts get the score of a text without matches."""
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1_000_000):
            counts = np.array([shared.value.matches(t) for t in batch.column(text).to_pylist()]).reshape(-1, len(PATTERNS) + 1)
            p = shared.value.probability(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])
        shared.value.classes.forget()  # the worker process outlives this task

    return kept.mapInArrow(run, schema)
