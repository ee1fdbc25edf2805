"""The pipeline's stages against plain Python, with rows that have no doc_id, share one, or repeat."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spotflow.llm import bpe, langid, minhash, mixing, toxicity
from spotflow.llm.queries import bpe_vocabulary

SYLLABLES = {"en": "the and ing on at re er ly st an".split(), "es": "ción que los ar ez ó ñ do as bo".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(4), [], []
    for i in range(240):
        lang = "en" if i % 2 else "es"
        words = prose(rng, lang, rng.randint(20, 80)).split()
        bad = i % 6 == 0
        if bad:
            for k in range(4):
                words[k * 4] = f"zork{rng.choice('abcdefgh')}"
        rows.append((i, " ".join(words), lang, f"s{i % 4}", 1))
        labels.append((i, 1, int(bad)))
    rows += [(300 + i, rows[1][1], "en", "s1", 1) for i in range(5)]  # copies
    long = prose(rng, "en", 300).split()
    for i in range(4):
        changed = [*long]
        changed[i * 40] = f"changed{i}"
        rows.append((320 + i, " ".join(changed), "en", "s2", 1))  # near copies
    rows += [(None, prose(rng, "en", 60), "en", "s0", 1), (None, prose(rng, "es", 60), "es", None, 1), (None, rows[3][1], "en", "s0", 1)]
    rows += [(5, prose(rng, "en", 50), "en", "s3", 1), (5, rows[5][1], "en", "s3", 1)]  # share an id
    rows += [(330, None, None, "s0", 1), (331, "", "en", "s0", 1), (332, "12 34 !", "en", "s0", 1), (7, rows[7][1], "en", "s3", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def groups_of(rows):
    """Number of each row's group by all pairs of five-word shingles at 0.8 or more."""
    sets = []
    for r in rows:
        w = (r.text or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))]


def test_every_stage_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    first = corpus_pipeline.materialize(corpus_pipeline.keep_languages(spark, docs, folder), "t")
    model = langid.fit(docs)
    scorer = langid._Scorer(model)
    want = Counter()
    for r in docs.collect():
        sums, n = scorer.score([r.text])
        if n[0] and model.judge(sums, n)[3][0] <= model.cut:
            want[tuple(r)] += 1
    assert bag(first.collect()) == want and first.columns == columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {330, 331, 332}

    second = corpus_pipeline.materialize(corpus_pipeline.drop_toxic(spark, first, folder), "t")
    judge = toxicity.fit(first, spark.read.parquet(f"{folder}/labels.parquet"))
    want = bag(r for r in first.collect() if judge.probability(judge.matches(r.text)[None])[0] < 0.5)
    assert bag(second.collect()) == want and second.columns == columns
    toxic = {r.doc_id for r in first.collect()} - {r.doc_id for r in second.collect()}
    assert len(toxic ^ {i for i in range(0, 240, 6)}) <= 4

    third = corpus_pipeline.materialize(corpus_pipeline.drop_near_duplicates(spark, second, folder), "t")
    rows = second.collect()
    group, kept = groups_of(rows), third.collect()
    assert third.columns == columns and len(kept) == len(set(group))
    of = {}
    for r, g in zip(rows, group):
        of.setdefault(tuple(r), g)
    assert len({of[tuple(r)] for r in kept}) == len(kept)  # one of every group
    members = {}
    for r, g in zip(rows, group):
        members.setdefault(g, []).append(r.doc_id)
    for r in kept:  # the smallest id, where all ids of the group are single rows'
        ids = members[of[tuple(r)]]
        if None not in ids and not {5, 7} & set(ids):
            assert r.doc_id == min(ids)
    assert sum(r.doc_id is None for r in kept) >= 2 and len([r for r in kept if r.doc_id == 5]) >= 2

    fourth = corpus_pipeline.materialize(corpus_pipeline.mix_sources(spark, third, folder), "t")
    keys = mixing.row_keys(third)
    copies = {r.doc_id: r.copies for r in mixing.mix(keys.select(keys["_key"].alias("doc_id"), "text", "source")).collect()}
    want = Counter()
    for r in keys.collect():
        want[tuple(r)[: len(columns)]] += copies[r["_key"]]
    assert bag(fourth.collect()) == +want and fourth.columns == columns

    last = corpus_pipeline.encode_tokens(spark, fourth, folder)
    codec, want = bpe.Codec(bpe_vocabulary()), Counter()
    for r in fourth.collect():
        want[r.doc_id, tuple(codec.encode([r.text])[0].tolist())] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == want
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns)


def test_run_equals_its_stages_and_takes_an_empty_table(spark, folder, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "bpe"]
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keep_one_keeps_rows_without_words(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, "", "en", "s", 1), (None, "", "en", "s", 1), (None, None, "en", "s", 1), (2, "g h", "en", "s", 1)]
    got = minhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.text for r in got) == {"a b c d e f": 1, "": 2, None: 1, "g h": 1}


#: Names that the operators use for columns of their own.
HELPERS = ("_key", "_again", "_id", "_n", "_words", "_copies", "_copy", "score", "predicted", "lang_pred", "cross_entropy", "rejected", "ids", "copies", "key", "size", "toxic", "n_tokens", "_c0")


def test_no_stage_overwrites_a_column(spark, folder):
    """Columns with the operators' own names come out of every stage as they went in."""
    plain = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 200")
    docs = plain.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in HELPERS])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in HELPERS), name
        assert bag(r[:5] for r in rows) == bag(stage(spark, plain, folder).collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
