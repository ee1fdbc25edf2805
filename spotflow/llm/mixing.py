"""Mixing sources to target weights by fitting word budgets.

Targets share the corpus's words by weight, bounded by a multiple of each source's own words. A
source's target is met by whole copies of all its documents and, for the rest, by one more copy of
some: documents are counted by exact length, every length takes its even share of the rest but REACH
words, and a bounded-knapsack dynamic program over the documents left in each length fits those to the
word. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotflow.llm.text import carried, row_keys, word_count
from spotflow.session import materialize

#: Documents of one source and length that one task ranks; larger groups are dealt into so many.
RANKED = 256
#: Words of a budget that are left to the dynamic program; fits the sum of a few of the longest documents.
REACH = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with `target`: all words shared by weight, none above `most` times its size.

    Sources by code point, null last, take the weights in turn. Words that a bound leaves over are shared
    by weight among the others until none is above its bound. One row a source goes through one window.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    # sources reach their bounds in the order of bound by weight; the first that doesn't sets the level,
    # which is the share of a unit of weight
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("words", F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("words") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("bound") > F.col("level") * F.col("weight"), F.col("level"))).over(every)
    return rows.withColumn("settled", level).select("source", "source_size", F.least("bound", F.col("weight") * F.col("settled")).alias("target"))


def fit_counts(length: np.ndarray, available: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near `budget` as can be.

    length: distinct and positive; budget: at most the words there are. Lengths share the budget beyond
    REACH words evenly; the last REACH words are fitted, which for a smaller budget is all of it.
    """
    words = int((length * available).sum())
    share = available * (max(0, budget - REACH) / max(1, words))
    taken = np.floor(share).astype(np.int64)
    rest, share = budget - int((length * taken).sum()), share - taken
    for i in np.argsort(-share, kind="stable"):  # the largest remainders first
        if length[i] <= rest - REACH and taken[i] < available[i]:
            taken[i] += 1
            rest -= int(length[i])
    order = np.argsort(-length, kind="stable")
    for i in order:
        k = min(int(available[i] - taken[i]), max(0, (rest - REACH) // int(length[i])))
        taken[i] += k
        rest -= k * int(length[i])
    if rest <= 0:
        return taken
    # sums that can be reached, as bits of an integer; the counts of a length are split into powers of two
    width = rest + int(min(REACH, length.max()))
    mask, reach, steps = (1 << (width + 1)) - 1, 1, []
    for i in order:
        left, unit = min(int(available[i] - taken[i]), width // int(length[i])), 1
        while left > 0 and not reach >> rest & 1:
            k = min(unit, left)
            steps.append((i, k, reach))
            reach |= reach << (k * int(length[i])) & mask
            left, unit = left - k, unit * 2
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    over = (above & -above).bit_length() if above else 0  # how far the next sum lies above
    total = rest + over if over and over < rest - below else below
    for i, k, was in reversed(steps):
        if not was >> total & 1:
            taken[i] += k
            total -= k * int(length[i])
    return taken


def _key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size * copies) for every row of docs (doc_id,
    text, source; other columns are not read).

    size is the number of words, 0 for null; a document without words is never taken. Null sources are
    one source. Rows that repeat are documents of their own. The same rows, seed and weights give the
    same mix.
    """
    pick = F.xxhash64("doc_id", F.lit(seed))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", _key()), "sized")
    lengths = materialize(sized.groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")), "lengths")
    sources = lengths.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(sources.select("source", "source_size"), weights, most).withColumn("key", _key()).drop("source")
    goal = goal.withColumn("whole", F.least(F.lit(most), F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    goal = materialize(goal.na.fill({"whole": 0, "rest": 0}), "goal")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        taken = fit_counts(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["rest"].iloc[0]))
        return pd.DataFrame({"key": group["key"], "size": group["size"], "extra": taken})

    wanted = lengths.filter("size > 0").join(goal.filter("rest > 0").select("key", "rest"), "key").select("key", "size", "n", "rest")
    extra = wanted.groupBy("key").applyInPandas(fit, "key string, size long, extra long")
    plan = materialize(lengths.select("key", "size", "n").join(extra, ["key", "size"], "left").na.fill({"extra": 0}), "plan")

    # written out, so that the join may split a length that many documents share; ranks are then dealt by part
    dealt = materialize(sized.join(plan, ["key", "size"]).withColumn("part", F.pmod(pick, F.ceil(F.col("n") / RANKED)).cast("long")), "dealt")
    some = dealt.filter("extra > 0 AND extra < n")
    parts = some.groupBy("key", "size", "part").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = materialize(parts.select("key", "size", "part", F.least("m", F.greatest(F.lit(0), F.col("extra") - before)).alias("quota")), "quota")
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    ranked = some.join(quota, ["key", "size", "part"]).repartition("key", "size", "part").withColumn("more", (rank <= F.col("quota")).cast("long"))
    plain = dealt.filter("extra <= 0 OR extra >= n").withColumn("more", (F.col("extra") > 0).cast("long"))
    every = plain.select("doc_id", "key", "size", "more").unionByName(ranked.select("doc_id", "key", "size", "more"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("long")
    return every.join(goal, "key").withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the mix takes it (not at all to three times).
    Rows without a doc_id and rows that share one are documents of their own; equal rows share their
    copies. Columns of docs are handed on as they are, whatever their names."""
    inner, own = carried(docs, "doc_id", "text", "source")
    keyed = row_keys(inner)
    mixed = mix(keyed.select(F.col("_key").alias("doc_id"), "text", "source"), seed=seed)
    copies = materialize(mixed.groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").alias("_copies")).filter("_copies > 0"), "copies")
    rows = keyed.filter("NOT _again").unionByName(keyed.filter("_again").dropDuplicates(["_key"]))
    often = rows.join(copies, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return often.select(*own)
