"""Connected components over an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spotflow.session import materialize

#: Edges that one task may finish; more are contracted by Spark first.
FEW = 200_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the edges a - b, sorted, and the smallest end that each one reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
        left = root[x] != root[y]
        x, y = x[left], y[left]
    return nodes, nodes[root]


def _finish(pairs: DataFrame) -> DataFrame:
    """(node, parent) with the roots of few edges, from one task."""

    def run(batches):
        ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if ends:
            nodes, roots = smallest_reachable(np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "parent"])

    return materialize(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, parent long"), "roots")


def _follow(parents: DataFrame) -> DataFrame:
    """Replace every parent by the root above it; doubles the steps taken with each round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = materialize(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            ),
            "jump",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").limit(1).isEmpty():
            return parents


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reachable.

    Each round hooks every node onto its smallest neighbour (one partial aggregation), follows the
    hooks to their roots by pointer doubling and contracts the edges. Only local minima survive a
    round, so the edge table at least halves and star-shaped input is done in two rounds. As soon as
    at most FEW edges are left, one task finishes them. Nodes are whole numbers. Rows with a null end
    are ignored; self loops give a component of one; repeated edges change nothing.
    """
    lo: Column = F.least(src, dst).cast("long")
    hi: Column = F.greatest(src, dst).cast("long")
    named = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(lo.alias("a"), hi.alias("b"))
    pairs = materialize(named.distinct(), "edges")
    labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    pairs = pairs.filter("a < b")
    while left := pairs.count():
        few = left <= FEW
        roots = _finish(pairs) if few else _follow(materialize(pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks"))
        of = roots.select(F.col("node").alias("component"), "parent")
        labels = labels.join(of, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        if few:
            break
        ra, rb = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra")), roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        ends = pairs.join(ra, "a", "left").join(rb, "b")
        ends = ends.select(F.coalesce("ra", "a").alias("x"), F.col("rb").alias("y")).filter("x <> y")
        pairs = materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return materialize(labels, "components")
