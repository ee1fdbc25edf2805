"""Kneser-Ney and the clause grammar against plain Python."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from spotflow.llm import langid, toxicity

SYLLABLES = {"en": "the and ing on at re er ly st an".split(), "es": "ción que los ar ez ó ñ do as bo".split(), "de": "sch ein ung ich ä ö der und ge".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def letters_of(text):
    """Runs of characters of the categories of letters."""
    out = [""]
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            out[-1] += c
        else:
            out.append("")
    return [w for w in out if w]


class PlainKneserNey:
    """The interpolated model of one language by its textbook formulas, on dictionaries."""

    def __init__(self, counts, alphabet):
        self.c = {m: defaultdict(float) for m in range(1, langid.ORDER + 1)}
        for gram, n in counts.items():
            self.c[len(gram)][gram] = n
        for m in range(1, langid.ORDER):  # lower orders count kinds of what precedes
            before = Counter(g[1:] for g in self.c[m + 1])
            for gram in self.c[m]:
                if not gram.startswith(langid.BEGIN):
                    self.c[m][gram] = before[gram]
        self.alphabet, self.d, self.total, self.kinds = alphabet, {}, {}, {}
        for m in self.c:
            once, twice = sum(n == 1 for n in self.c[m].values()), sum(n == 2 for n in self.c[m].values())
            self.d[m] = min(0.95, once / (once + 2 * twice)) if once else 0.5
            self.total[m], self.kinds[m] = Counter(), Counter()
            for gram, n in self.c[m].items():
                self.total[m][gram[:-1]] += n
                self.kinds[m][gram[:-1]] += n > 0

    def p(self, context, char):
        m = len(context) + 1
        lower = self.p(context[1:], char) if m > 1 else 1 / self.alphabet
        total = self.total[m][context]
        if not total:
            return lower
        return max(self.c[m].get(context + char, 0) - self.d[m], 0) / total + self.d[m] * self.kinds[m][context] / total * lower


def test_cross_entropy_and_prediction_equal_the_plain_formulas(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, 30), lang) for i, lang in enumerate(["en", "es", "de"] * 12)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "½ ② Ⅷ 7", "es"), (102, "ünïcödé 東京", None)], "doc_id long, text string, lang string")
    counts = langid._gram_counts(docs.filter("lang IS NOT NULL AND doc_id < 30"))
    model = langid._estimate(counts)
    alphabet = counts.loc[counts["gram"].str.len() == 1, "gram"].nunique() + 1
    plain = {lang: PlainKneserNey(dict(zip(part["gram"], part["n"])), alphabet) for lang, part in counts.groupby("lang")}
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text, _ in [*rows, (102, "ünïcödé 東京", None)]:
        bits, n = Counter(), 0
        for w in letters_of(text):
            framed = langid.BEGIN + w + langid.END
            n += len(w) + 1
            for at in range(1, len(framed)):
                for lang in plain:
                    bits[lang] -= math.log2(plain[lang].p(framed[max(0, at - langid.ORDER + 1) : at], framed[at]))
        best = min(sorted(bits), key=lambda lang: bits[lang])
        assert got[i].lang_pred == best and math.isclose(got[i].cross_entropy, bits[best] / n, rel_tol=1e-4)
    assert got[100].lang_pred == got[101].lang_pred == "und"


@pytest.mark.parametrize("text,words", [("½ ²", []), ("Ⅷ ①", []), ("٣ 7 _", []), ("", []), ("!?", []), ("a½b c²d Ⅷe 東京 naïve_x9y", ["a", "b", "c", "d", "e", "東京", "naïve", "x", "y"])])
def test_numbers_are_no_letters(text, words):
    assert langid.letter_words(text) == letters_of(text) == words


def p(model, text):
    return float(model.probability(model.matches(text)[None])[0])


def test_a_word_needs_its_clause():
    m = toxicity.ToxicityModel()
    assert not m.matches("idiot").any() and not m.matches("Idiot! Moron! Clown!").any()
    assert m.matches("you idiot").any()
    for text in ("what an idiot came by", "take out the trash please", "the trash day is on monday", "take the trash out. then the trash is gone. no trash is left."):
        assert not m.matches(text)[:2].any() and p(m, text) < 0.1
    assert m.matches("only an idiot or a moron does so").any()
    assert p(m, "idiot") < 0.5 < p(m, "You are an idiot.")


def test_negation_reports_and_intentions_change_the_pattern():
    m = toxicity.ToxicityModel()
    name = lambda text: [toxicity.PATTERNS[i] for i in m.matches(text).nonzero()[0]]
    assert name("This man is an idiot") == ["insult aimed"]
    assert name("An idiot, a moron, a clown") == ["insult"]
    assert name("He isn't an idiot at all") == name("He isn’t an idiot at all") == name("He isnt an idiot at all") == ["insult negated"]
    assert name("They don't call him an idiot") == name("Ce n'est pas un imbécile") == ["insult negated"]
    assert name("You're an idiot") == name("you’ve been an idiot") == ["insult aimed"]
    assert name("I'll kill you tonight") == name("i will kill you tonight") == name("we’ll kill you") == ["threat aimed"]
    assert name("I won't kill you") == name("O'Brien's clock") == []
    assert name("You are an idiot") == ["insult aimed"]
    assert name("You are not an idiot") == ["insult negated"]
    assert name("She said that man is an idiot") == ["insult reported"]
    assert name("They kill the time") == []
    assert name("We will burn the wood") == ["threat"]
    assert name("I will kill you") == ["threat aimed"]
    assert name("I will never kill you") == ["threat negated"]


def test_automaton_equals_scopes_written_out():
    """The composed automaton against a direct reading of each clause."""
    m, rng = toxicity.ToxicityModel(), random.Random(5)
    words = "idiot not you said kill will wood".split()
    for _ in range(400):
        clause = rng.choices(words, k=rng.randint(1, 9))
        want = []
        for i, w in enumerate(clause):
            negated, aimed, intent = (any(x in clause[max(0, i - k) : i] for x in (word,)) for word, k in (("not", 4), ("you", 6), ("will", 4)))
            reported = "said" in clause[:i]
            if w == "idiot":
                want.append(3 if reported else 2 if negated else 1 if aimed else 0)
            elif w == "kill" and intent:
                want.append(7 if reported else 6 if negated else 4)
            elif w == "you" and want and want[-1] == 4:
                want[-1] = 5
        want = want if len(clause) >= toxicity.HOST else [x for x in want if x in (1, 5)]
        assert [pattern for _, pattern in m.clause([m.classes[w] for w in clause])] == want, clause


def test_learned_cues_are_whole_words_or_stems_of_several(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        words = prose(rng, "en", 40).split()
        if i % 4 == 0:
            words[5::9] = [rng.choice(["brakolu", *(f"zork{c}ed" for c in "abcdefgh")]) for _ in words[5::9]]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "zork" in model.learned and "brakolu$" in model.learned
    assert all(len(c) >= toxicity.SHORTEST for c in model.learned | model.weak)
    assert not model.matches("brakolusion is another word").any()
    clause, negated = "some people are brakolu today", "some people are not brakolu today"
    assert p(model, clause) > p(model, negated)
