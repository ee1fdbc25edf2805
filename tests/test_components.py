"""Connected components against a plain union-find, with few and with contracted edges."""

import numpy as np
import pytest

from spotflow.operators import components


def brute(edges):
    root = {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is None or b is None:
            continue
        root.setdefault(a, a)
        root.setdefault(b, b)
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in root}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (500, 500), (3, None), (None, None), (41, 40), (41, 40)]
    edges += [tuple(map(int, e)) for e in rng.integers(200, 300, (60, 2))]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst int"))
    assert {tuple(r) for r in got.collect()} == brute(edges) and got.count() == len(brute(edges))
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
