"""From raw documents to token ids in five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.llm import bpe, langid, minhash, mixing, toxicity
from spotflow.llm.queries import bpe_vocabulary
from spotflow.llm.text import carried
from spotflow.session import materialize

#: None of the stages can be said in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter (or text) and those that fit no language go."""
    inner, own = carried(docs, "text")
    return langid.predict(inner, langid.fit(docs)).filter(~F.col("rejected")).select(*own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are less than even odds to be toxic, learned from the labels of those at hand."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, own = carried(docs, "text")
    return toxicity.score(inner, model).filter("predicted = 0").select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more, that with the
    smallest doc_id. Rows without a doc_id and rows that share one are documents of their own."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target takes it. Rows without a doc_id and rows that
    share one are documents of their own; those without words are never taken."""
    return mixing.repeat(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoding of every document that is left, and its token ids."""
    return bpe.digest(docs, bpe_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
