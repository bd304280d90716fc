"""Connected components against a plain union-find."""

import random

import pytest
from vecloom.llm import graph


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def cases():
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(400)]
    yield "chain", chain
    yield "star", [(0, i) for i in range(1, 300)]
    yield "random", [(rng.randrange(500), rng.randrange(500)) for _ in range(260)]
    yield "odd", [(1, 1), (-5, 7), (7, -9), (7, -9), (-9, 7), (2**62, -(2**62))]
    yield "none", [(3, 3)]


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_components(spark, monkeypatch, chunk):
    """Also where tasks contract a few links at a time, so that rounds do the work."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    for name, edges in cases():
        df = spark.createDataFrame(edges, "u long, v long").repartition(4)
        assert {r.id: r.root for r in graph.components(df).df.collect()} == brute(edges), name


def test_links_that_are_left_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 3)
    monkeypatch.setattr(graph, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="come together"):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"))
