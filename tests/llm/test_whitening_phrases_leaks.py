"""Whitening, collocations and benchmark passages against brute force, with nulls, ties, copies, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotflow.llm import collocations, contamination, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x array<long>, component int, n long, i int"
DOCS = "doc_id long, text string, lang string, source string, phrase string, n long, rank int, n_words int, items string, spans string, _salt int, cut int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, [7], 7, 7, 7) for i, v in rows], VECTORS)


def vector_rows(d=12, n=400, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)) * np.linspace(2.0, 0.5, d)
    out = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(m)]
    out += [(1000 + i, out[3][1]) for i in range(200)] + [out[7], (None, out[8][1])]  # copies, a repeated row, no id
    return out + [(2000, None), (2001, []), (2002, [float("nan")] * d), (2003, [1.0] * (d - 1) + [None]), (2004, [float("inf")] * d), (2005, [0.0] * d)]


@pytest.mark.parametrize("d", [3, 12, 40])
def test_whitening_equals_numpy(spark, d):
    rows = vector_rows(d)
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    use = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(np.array(v)).all()]
    fit = np.unique(np.array([x for _, x in use]), axis=0)
    c = fit - fit.mean(axis=0)
    value, vector = np.linalg.eigh(c.T @ c / len(fit))
    value, vector = value[::-1], vector[:, ::-1]
    k = min(4, d)
    assert len(got) == k * len(use) and set(got.n) == {len(fit)} and got.identity_error.max() < 1e-12
    assert (got.residual < 1e-11 * value[0]).all()
    sums = [int(s) for s in fit.sum(axis=0)]
    for j in range(k):
        some = got[got.component == j + 1]
        want = sorted((i if i is not None else -1, sum((len(fit) * int(a) - s) ** 2 for a, s in zip(x, sums)), float((x - fit.mean(axis=0)) @ vector[:, j] / math.sqrt(value[j]))) for i, x in use)
        sign = np.sign(vector[np.abs(vector[:, j]).argmax(), j])
        found = sorted((-1 if math.isnan(i) else int(i), a, b * sign) for i, a, b in zip(some.vec_id, some.deviation, some.whitened))
        assert [r[:2] for r in found] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in found], [r[2] for r in want], atol=1e-9)
        assert abs(some.explained.iloc[0] - value[j] / value.sum()) < 1e-12


def test_whitening_without_variance_of_two_lengths_and_of_large_entries(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    flat = [(i, [float(i), 1.0, 2.0]) for i in range(6)] + [(10, [1.0]), (11, [3.0])]  # one direction; another length
    got = {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, flat)).collect()}
    assert sorted(got) == sorted([(i, 1) for i in range(6)] + [(10, 1), (11, 1)])
    assert got[11, 1].whitened == 1.0 and got[10, 1].deviation == 256**2 * 4
    assert all(abs(r.explained - 1) < 1e-12 for r in got.values())
    large = [(0, [1e13, 0.0]), (1, [-1e13, 0.0]), (2, [0.0, 0.0])]
    rows = whitening.whiten(vectors(spark, large)).collect()
    assert {r.vec_id: r.deviation for r in rows} == {0: (1 << 63) - 1, 1: (1 << 63) - 1, 2: 0}
    assert {round(r.whitened * math.sqrt(2), 9) for r in rows} == {round(math.sqrt(3), 9), -round(math.sqrt(3), 9), 0.0}


def test_equal_eigenvalues_and_a_small_block(monkeypatch):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    for value in (np.ones(60), np.r_[[5.0] * 10, np.ones(50)], np.linspace(1, 1.001, 60), np.r_[1.0, np.zeros(59)]):
        a = (q * value) @ q.T
        monkeypatch.setattr(whitening, "ROUNDS", 3)
        found, v, residual, trace = whitening.lobpcg(lambda b: (a @ b, np.diag(a)), 60, 4)
        assert np.allclose(found, np.sort(value)[::-1][: len(found)], rtol=1e-12) and len(found) == min(4, (value > 0).sum())
        assert np.allclose(v.T @ v, np.eye(len(found)), atol=1e-13) and (residual < 1e-12 * value.max()).all() and np.isclose(trace, value.sum())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "p", 1, 2, 3, "i", "s", 4, 5) for i, t, lang in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def mined(rows, longest, least, most):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w, lang = re.findall("[^ \t]+", piece), lang or "und"
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cands.items():
        within = [u for (o, u), b in cands.items() if o == lang and len(u) > len(w) and any(u[i : i + len(w)] == w for i in range(len(u))) and 100 * b >= 50 * a]
        cut = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        if not within:
            out.append((lang, -cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]], total[lang]))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= most:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    words = ["new", "york", "city", "the", "a", "ñu", "of", "ﬁn", "x-y"]
    out = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "? "]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "es", None])) for i in range(60)]
    out += [(100 + i, "New York City is New York City, new york", "en") for i in range(12)] + [(200, None, "en"), (201, "", None), (202, " .,\n", "fr"), (203, "\x00 one \x00 one", "en"), (203, "\x00 one \x00 one", "en"), (None, "w " * 30_000, "en")]
    return out


@pytest.mark.parametrize("longest,most", [(3, 2000), (4, 5), (2, 3)])
def test_phrases_equal_plain_counts(spark, prose, longest, most, monkeypatch):
    monkeypatch.setattr(collocations, "GROUP", 4)
    got = collocations.mine(docs(spark, prose), longest=longest, least=4, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(mined(prose, longest, 4, most))


def test_phrases_across_buffers_and_with_full_tables_of_bits(spark, prose):
    one = [("en", t) for _, t, _ in prose if t]
    for size in (1, 2, 3):
        whole, parts = Counter(), Counter()
        for chunk, into in ((10**9, whole), (7, parts)):
            buffer = collocations._Buffer()
            every = [collocations.Bits(np.full(1 << 13, 255, np.uint8), 16)] * 3

            def send():
                rows, counts, of, words, langs = collocations.count_phrases(buffer, size, every)
                for r, n in zip(rows, counts):
                    into[b" ".join(words[i] for i in r)] += int(n)

            for lang, text in one:
                for some in collocations.segments(text.encode().translate(collocations.PIECES), 5, b" \n"):
                    buffer.add(lang, some)
                    if buffer.size >= chunk:
                        tail = buffer.tail(lang, size - 1)
                        send()
                        buffer = collocations._Buffer()
                        buffer.add(lang, tail)
                buffer.end()
            send()
        assert +whole == +parts and sum(whole.values()) == sum(len(p.split()) - size + 1 for _, t in one for p in t.encode().translate(collocations.PIECES).split(b"\n") if len(p.split()) >= size)


def test_bits_hold_every_frequent_phrase(spark):
    phrases = [f"w{i} v{i % 7}" for i in range(3000)]
    bits = collocations.frequent_bits(spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert bits.has(collocations.phrase_hash([p.encode() for p in phrases])).all()
    assert bits.has(collocations.phrase_hash([f"u{i} v" .encode() for i in range(3000)])).mean() < 0.2
    none = collocations.frequent_bits(spark.createDataFrame([], "phrase string"))
    assert not none.has(collocations.phrase_hash([b"a b"])).any()


def test_no_phrases(spark):
    assert collocations.mine(docs(spark, [])).count() == 0
    assert collocations.mine(docs(spark, [(1, None, None), (2, "", "en"), (3, "one two three", "en")])).count() == 0


BENCHMARK = "item_id long, text string, window string, doc_id long"


def leaks(rows, items, size):
    wanted = {}
    for item, text in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(item)
    for doc, text, _ in rows:
        w, hit, named = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text)), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    named |= found
        yield (doc, len(w), len(hit), sorted(str(x) for x in named if x is not None))


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(2)
    words = ["uno", "Zwei", "three", "été", "4", "½", "x"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n", "\x00", "_"]) for _ in range(n))
    items = [(i, say(rng.randint(1, 9))) for i in range(40)] + [(40, None), (41, ""), (42, "?!"), (None, "only here named"), (7, "a second text of seven"), (8, "a second text of seven")]
    rows = [(i, say(rng.randint(0, 60)), "en") for i in range(80)] + [(400 + i, f"Quote: {items[i][1].upper()}!", "en") for i in range(20)]
    rows += [(300, None, "en"), (301, "", None), (302, "..", "en"), (303, "So: ONLY here-named.", "en"), (304, "of seven a second text of  seven", "en"), (304, say(3000), "en"), (None, say(10), "en")]
    return rows, items


@pytest.mark.parametrize("size,block", [(4, 100_000), (3, 10), (10, 100_000)])
def test_passages_equal_plain_search(spark, leaked, size, block, monkeypatch):
    rows, items = leaked
    monkeypatch.setattr(contamination, "BLOCK", block)
    bench = spark.createDataFrame([(i, t, "w", 9) for i, t in items], BENCHMARK)
    got = contamination.scan(docs(spark, rows), bench, size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=key) == sorted(leaks(rows, items, size), key=key)
    texts = {i: t for i, t, _ in rows if i != 304}
    for r in got:
        if r.doc_id in texts:
            parts = [texts[r.doc_id][s.start : s.end] for s in r.spans]
            assert sum(len(contamination.WORD.findall(p)) for p in parts) == r.n_hit
            assert all(contamination.WORD.match(p) and contamination.WORD.match(p[-1]) for p in parts)


def test_offsets_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "Wie heißt der Fluß", "w", 9)], BENCHMARK)
    text = "😀 Na, wie HEIßT… wie heißt - der\tFluß?"
    r = contamination.scan(docs(spark, [(1, text, "de")]), bench, 3).first()
    assert [text[s.start : s.end] for s in r.spans] == ["wie heißt - der\tFluß"] and (r.n_words, r.n_hit) == (8, 4)
    assert contamination.scan(docs(spark, [(1, text, "de")]), bench.filter("false"), 3).first().n_hit == 0
    assert contamination.scan(docs(spark, []), bench).count() == 0


def test_letters_are_no_surrogates():
    found = [contamination.letter(i) for i in (0, 0xD7FE, 0xD7FF, 1_000_000)]
    assert len(set(found)) == 4 and contamination.OTHER not in found and not any(0xD800 <= ord(c) < 0xE000 for c in found)
    "".join(found).encode()
