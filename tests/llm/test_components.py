"""Components against union-find, with a hot node, chains, loops and repeated edges."""

import random

import pytest

from siltstone.llm.components import components


def roots(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("local", [200_000, 100])
def test_components(spark, local):
    """In one task, and beyond its bound in rounds."""
    rng = random.Random(7)
    edges = [(500_000, k) for k in range(1000, 4000)] + [(k, k + 1) for k in range(5000, 5060)] + [(rng.randrange(7000, 7400), rng.randrange(7000, 7400)) for _ in range(250)] + [(1, 2), (2, 1), (1, 2)]
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame([*edges, (9, 9)], "a long, b long"), "test", local=local).collect()
    assert {r["node"]: r["root"] for r in got} == roots(edges) and len(got) == len(roots(edges))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
