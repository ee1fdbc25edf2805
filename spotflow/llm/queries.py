"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.llm.text import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import html

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import multi_index

    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import interpolation

    held = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = interpolation.score(_table(spark, sf_dir, "documents"), ~held)
    columns = [c for c in scored.columns if c != "doc_id"]
    return scored.select("doc_id", held.alias("held_out"), *columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import bpe

    return bpe.digest(_table(spark, sf_dir, "documents"), bpe_vocabulary())


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Scheme(words=3, percent=85))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import langid

    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held))
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.filter(~held), _table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import whitening

    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import collocations

    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm import contamination

    found = contamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html": op1_html, "op2_embedding": op2_embedding, "op3_lm_score": op3_lm_score, "op4_mixing": op4_mixing, "op5_license": op5_license, "op6_bpe": op6_bpe, "op7_topk": op7_topk, "op8_langid": op8_langid, "op9_minhash": op9_minhash, "op10_toxicity": op10_toxicity, "op11_whitening": op11_whitening, "op12_collocations": op12_collocations, "op13_contamination": op13_contamination}


def oracle_sql() -> dict[str, str]:
    from spotflow.llm import collocations, contamination, licenses, minhash

    whole = "WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    return {
        "op5_license": licenses.oracle(),
        "op9_minhash": minhash.oracle(3, 85),
        "op12_collocations": collocations.oracle(),
        "op13_contamination": contamination.oracle(10),
        "op7_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings {whole}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
        "op2_embedding": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings {whole} AND label IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    }
