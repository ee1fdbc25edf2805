"""Operators on documents against brute force, with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import itertools
import json
import re
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotflow.llm import bpe, html, interpolation, langid, licenses, minhash, mixing, toxicity

SYLLABLES = {"en": "the and ing on at re er ly st an".split(), "es": "ción que los ar ez ó ñ do as bo".split()}
COLUMNS = "doc_id long, text string, lang string, source string, score double, ids string, key long, n long, rank int"


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def make(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 0.5, "x", 7, 8, 9) for i, t, lang, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, "en" if i % 2 else "es", rng.randint(1, 60)), "en" if i % 2 else "es", f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[5][1], "en", "s0") for i in range(4)]  # copies
    long = prose(rng, "en", 400).split()
    for i in range(5):
        changed = list(long)
        changed[i * 50] = f"changed{i}"
        out.append((200 + i, " ".join(changed), "en", "s1"))  # near copies
    out += [(300, None, None, None), (301, "", "en", None), (302, "  \n\t ", "es", "s2"), (303, "7 7 !", "en", "s2"), (304, "One", "en", "s2"), (305, "one TWO", "en", "s2")]
    out += [(306, prose(rng, "en", 20_000), "en", "s0"), (307, "x" * 100_000, "en", "s1"), (5, out[5][1], "en", "s2")]  # long, and a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")


def tokens_of(text):
    return [w for w in words_of(text) if w]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_minhash_equals_all_pairs(docs, rows, words, percent):
    sets = {}
    for i, text, _, _ in rows:
        w = tokens_of(text)
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = minhash.near_duplicates(docs, minhash.Scheme(words=words, percent=percent)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_minhash_without_rows_and_ids(spark, none):
    assert minhash.near_duplicates(none).count() == 0
    got = minhash.near_duplicates(make(spark, [(None, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, False), (1, 1, True)}


def test_tiles_find_each_link_once(rng=np.random.default_rng(5)):
    base = np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64))
    sets = [base, base[:95], base[5:], np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64))]
    links = minhash.tile_links(np.arange(4), np.arange(4), np.zeros(4, int), sets, 90)
    assert links == [(0, 1), (0, 2)]


def test_densification_fills_every_bin():
    sig = minhash.signatures([np.array([1], np.uint64), np.arange(1000, dtype=np.uint64)], 64)
    assert (sig != minhash.EMPTY).all() and len(set(sig[0].tolist())) == 1


def test_interpolation_counts(docs, rows):
    got = {(r.doc_id, r.n_tokens): r for r in interpolation.score(docs, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))).collect()}
    counts = Counter(t for i, text, _, _ in rows if i % 5 != 1 for t in [*tokens_of(text), None])
    n, v = sum(counts.values()), len(counts)
    for i, text, _, _ in rows:
        t = [*tokens_of(text), None]
        r = got[i, len(t)]
        assert r.n_known == sum(counts[x] > 0 for x in t) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_interpolation_beats_unigrams_and_survives_nothing(spark, none):
    rng = random.Random(1)
    docs = make(spark, [(i, " ".join(rng.choice(["red hot sun", "cold blue sea", "old green tree"]) for _ in range(50)), "en", "s") for i in range(40)])
    r = interpolation.score(docs, F.col("doc_id") % 4 != 0).filter("doc_id % 4 = 0").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b + 100
    assert interpolation.score(none, F.lit(True)).count() == 0
    untrained = interpolation.score(docs, F.lit(False)).first()
    assert untrained.train_tokens == 0 and math.isfinite(untrained.score)


def test_weights_follow_the_counts():
    cells = np.array([[3, 100, 100, 50], [3, 0, 100, 50]])
    w = interpolation.learn_weights(cells)[3]
    assert math.isclose(w.sum(), 1) and 0.3 < w[0] < 0.7


def test_mix_meets_targets(docs, rows, none):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    source_of = {i: s for i, _, _, s in rows}
    assert {(r.doc_id, r.size) for r in got} == {(i, len(tokens_of(t))) for i, t, _, _ in rows}
    for r in got:
        s = source_of[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    longest = 3 * max(r.size for r in got)
    for s in target:
        assert target[s] <= 3 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= longest
    assert mixing.mix(none).count() == 0


def test_mix_shares_what_a_bound_leaves(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), (None, 490)], "source string, source_size long")
    assert {r.source: round(r.target, 6) for r in mixing.targets(sizes).collect()} == {"a": 30.0, "b": round(970 * 2 / 3, 6), None: round(970 / 3, 6)}


def test_fit_counts_against_all_choices(rng=np.random.default_rng(2)):
    for _ in range(30):
        length = rng.choice(np.arange(1, 30), 3, replace=False)
        n = rng.integers(0, 4, 3)
        budget = int(rng.integers(0, (length * n).sum() + 1))
        best = min(abs(budget - int(np.dot(length, k))) for k in itertools.product(*[range(x + 1) for x in n]))
        taken = mixing.fit_counts(length.astype(np.int64), n.astype(np.int64), budget)
        assert (taken <= n).all() and abs(budget - int((length * taken).sum())) == best


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("byte_bpe_50k.json"))


def test_bpe_equals_the_tokenizers_library(docs, rows, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    own.no_truncation()
    own.no_padding()
    got = bpe.digest(docs, vocabulary()).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _, _ in rows}
    for r in got:
        ids = own.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(none, vocabulary()).count() == 0


def test_bpe_odd_texts_and_round_trip(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    texts = ["  a  b ", "naïve café 東京 🙂🙂", "it's we'll 'S", "\n\n\t x", "<|endoftext|> a", "a" * 5000, "0123456789 ½²", "a b　c", "\x00\x01\x02", "é ééé"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()
    for r in back:
        assert r.ids == own.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == texts[r.doc_id]


def test_language_of_held_out_texts(docs, rows, none):
    model = langid.fit(docs.filter("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    lang = {i: x for i, _, x, _ in rows}
    text = {i: t for i, t, _, _ in rows}
    for i, r in got.items():
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text[i] or ""):
            assert r.lang_pred == "und" and r.rejected
        elif i % 3 == 1 and len(text[i]) > 30 and i < 300:
            assert r.lang_pred == lang[i] and not r.rejected
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_kneser_ney_probabilities_sum_to_one(docs):
    counts = langid._gram_counts(docs.filter("lang IS NOT NULL"))
    model = langid._estimate(counts)
    letters = {*counts.loc[counts["gram"].str.len() == 1, "gram"], "一"}  # and one that was never seen
    for seen in ("", "t", "the", "xyz"):
        after = [model.word_scores([seen])[0] if c == langid.END else _prefix(model, seen + c) for c in letters]
        assert np.allclose(np.exp(np.array(after) - _prefix(model, seen)).sum(axis=0), 1, atol=1e-4)


def _prefix(model, word):
    """Log probability of a word's characters without its end."""
    whole = model.word_scores([word])[0]
    ends = np.zeros(len(model.langs))
    context = (langid.BEGIN + word)[-(langid.ORDER - 1) :]
    for m in range(len(context) + 1, 0, -1):
        key = langid._gram_key([(context + langid.END)[-m:]], m)
        at = min(np.searchsorted(model.keys[m], key)[0], len(model.keys[m]) - 1)
        if model.keys[m][at] == key[0]:
            ends = ends + model.logp[m][at]
            break
        if m > 1:
            key = langid._gram_key([context[-(m - 1) :]], m - 1)
            at = min(np.searchsorted(model.context_keys[m - 1], key)[0], len(model.context_keys[m - 1]) - 1)
            if model.context_keys[m - 1][at] == key[0]:
                ends = ends + model.context_log[m - 1][at]
    return whole - ends


def test_toxic_clauses_not_words():
    m = toxicity.ToxicityModel()
    p = lambda t: float(m.probability(m.matches(t)[None])[0])
    assert p("You are an idiot.") > 0.5 > p("You are not an idiot.")
    assert p("I will kill you.") > 0.5 > p("They kill time.")
    assert p("He said you are an idiot.") < 0.5
    assert p(None) == p("") == p("fine words")


def test_toxicity_learns_cues(spark, none):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(200):
        words = prose(rng, "en", 40).split()
        if i % 5 == 0:
            for k in range(4):
                words[k * 9] = f"zork{rng.choice('abcdefgh')}"
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 0, int(i % 5 == 0)))
    docs = make(spark, [*rows, (500, None, None, None), (501, "", None, None)])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.filter("doc_id % 4 <> 0"), marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(0, 200, 4))
    assert got[500].score == got[501].score and 0 <= got[500].score < 0.5
    assert toxicity.fit(none, marks).weights.tolist() == toxicity.PRIOR.tolist()
    assert toxicity.score(none, model).count() == 0


def test_licences_equal_sql(spark, rows):
    import duckdb

    texts = ["Released under the MIT License.", "a\n\nLicensed under the Apache License, Version 2.0.\nb", "RELEASED under the mit\nLicense", "released under license", *(t for _, t in licenses.TEMPLATES)]
    pdf = spark.createDataFrame([*((1000 + i, t) for i, t in enumerate(texts)), *((i, t) for i, t, _, _ in rows)], "doc_id long, text string")
    got = licenses.scan(pdf).toPandas()
    con = duckdb.connect()
    con.register("documents", pdf.toPandas())
    want = con.execute(licenses.oracle()).df()
    norm = lambda f: sorted(tuple(str(None if x != x else float(x) if isinstance(x, (int, float)) else x) for x in r) for r in f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False))
    assert norm(got) == norm(want)
    assert got.loc[got.doc_id == 1000, "license"].iloc[0] == "MIT"
    assert licenses.scan(pdf.filter("false")).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in [licenses.scan(pdf)._jdf.queryExecution().toString()])


def test_whole_licence_texts(spark):
    body = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", *licenses.LONG)}
    wrapped = [(i, f"{name} licence\n\nCopyright (c) 2020 Someone\n\n" + re.sub(r"((?:\S+ ){12})", r"\1\n", text)) for i, (name, text) in enumerate(body.items())]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(wrapped, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(body))
    assert all(len(text.split()) > 100 for text in body.values())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/x>Menu one</a></nav><div class="ad">Buy now, it is cheap and good for you and all.</div>
<article><h1>Head &amp; line</h1><p>First   paragraph with <b>bold
text</b> and &eacute;.<p>Second one.</p><div class="comments"><p>A reader says something here.</p></div></article><footer>&copy; 2020 someone</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_html_main_text(spark):
    plain = "<body><div id=menu><a href=a>A</a></div><p>" + "A long paragraph of plain text without any article element. " * 4 + "</p><p>" + "More of it follows here, also long enough. " * 4 + "</p></body>"
    pages = [(1, "u", PAGE, "x", 1), (2, "u", None, "x", 1), (3, "u", "", "x", 1), (4, "u", "<div></div>", "x", 1), (5, "u", plain, "x", 1), (6, "u", "<p>" + "word " * 100_000, "x", 1), (1, "u", PAGE, "x", 1), (7, None, "<p unclosed <b", "x", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.text) for r in html.extract(df).collect()]
    assert len(got) == 8 and got.count((1, "Head & line First paragraph with bold text and é. Second one.")) == 2
    text = dict(got)
    assert text[2] == text[3] == text[4] == ""
    assert text[5].startswith("A long paragraph") and text[5].endswith("long enough.") and "A A" not in text[5]
    assert text[6] == " ".join(["word"] * 100_000)
    assert html.extract(df.filter("false")).count() == 0


def test_article_and_main_do_not_hide_other_text():
    def found(page):
        return html.main_lines(html.lines_of(page))

    body, cards = "A sentence of the body of this page. " * 6, "".join(f"<article><a href=/{i}>Card {i}</a><p>Short teaser.</p></article>" for i in range(3))
    assert found(f"<body><div><p>{body}</p></div>{cards}</body>") == [body.strip()]
    assert found(f"<body><div><p>{body}</p></div><main><p>Not much.</p></main></body>") == [body.strip()]
    comment = f"<article class='comment-body'><p>{body}</p></article><article id=advert><p>{body}</p></article>"
    assert found(f"<body><article class='post comments-open has-sidebar'><h1>Head</h1><p>{body}</p></article>{comment}</body>") == ["Head", body.strip()]
    links = "".join(f"<p><a href=/{i}>Another page {i}</a></p>" for i in range(4))
    assert found(f"<main><h1><a href=/>Head</a></h1><p>{body}</p>{links}</main>") == ["Head", body.strip()]


def test_dense_lines_between_surge_and_dive():
    lines = [html.Line(text, linked, int(linked > 0), (0,), False, False) for text, linked in (("Home", 4), ("x" * 200, 0), ("short", 0), ("y" * 150, 0), ("Imprint", 7), ("Contact", 7), ("Terms", 5))]
    assert html.main_lines(lines) == ["x" * 200, "short", "y" * 150]
    assert json.dumps(html.main_lines([])) == "[]"


def test_sql_of_minhash_equals_the_operator(spark, docs, rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t, _, _ in {(r[0], r[1]): r for r in rows}.values()], columns=["doc_id", "text"]))
    want = con.execute(minhash.oracle(3, 85)).fetchall()
    got = minhash.near_duplicates(docs, minhash.Scheme(words=3, percent=85)).distinct().collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == set(want)


def test_interpolated_score_against_plain_python(spark, docs, rows):
    """Counts without the token's own document, weights by expectation-maximisation by bucket, then the mix."""
    train = [i is not None and i % 5 != 1 for i, *_ in rows]
    texts = [[*tokens_of(t), None] for _, t, _, _ in rows]
    one, two = Counter(), Counter()
    for use, t in zip(train, texts):
        if use:
            one.update(t)
            two.update(zip(["<s>", *t], t))
    n, v, starts = sum(one.values()), len(one), sum(train)
    bin_of = lambda p, q: int(min(max((math.log2(p / q) - interpolation.LOWEST) / interpolation.STEP + 1, 1), interpolation.BINS - 1)) if p > 0 else 0
    bucket = lambda c: int(min(math.log2(c + 1), interpolation.BUCKETS - 1))
    cells = Counter()
    for use, t in zip(train, texts):
        if use:
            own1, own2 = Counter(t), Counter(zip(["<s>", *t], t))
            for a, b in zip(["<s>", *t], t):
                context = (starts - 1) if a == "<s>" else one[a] - own1[a]
                p1 = (one[b] - own1[b]) / max(1, n - len(t))
                p2 = (two[a, b] - own2[a, b]) / max(1, context)
                cells[bucket(context), bin_of(p2, p1) if p2 > 0 else 0, bin_of(p1, 1 / (v + 1))] += 1
    weights = {}
    for k in {c[0] for c in cells}:
        w = [0.3, 0.6, 0.1]
        mine = [(c[1], c[2], m) for c, m in cells.items() if c[0] == k]
        up = lambda b: 2.0 ** (interpolation.LOWEST + interpolation.STEP * (b - 0.5)) if b else 0.0
        for _ in range(200):
            total = [0.0, 0.0, 1e-3]
            for r2, r1, m in mine:
                p = [w[0] * up(r2) * up(r1), w[1] * up(r1), w[2]]
                for j in range(3):
                    total[j] += m * p[j] / sum(p)
            w = [x / sum(total) for x in total]
        weights[k] = w
    got = {(r.doc_id, r.n_tokens): r.score for r in interpolation.score(docs, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))).collect()}
    for (i, *_), t in zip(rows, texts):
        want = 0.0
        for a, b in zip(["<s>", *t], t):
            context = starts if a == "<s>" else one[a]
            w = weights.get(bucket(context), [0.3, 0.6, 0.1])
            want += math.log10(w[0] * two[a, b] / max(1, context) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(got[i, len(t)], want, rel_tol=1e-6), (i, got[i, len(t)], want)
