import random

import numpy as np
import pytest

from tesserae.llm import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def graph(seed, n=300):
    r = random.Random(seed)
    path = [(1000 + i, 1001 + i) for i in range(40)]
    clique = [(5000 + i, 5000 + j) for i in range(20) for j in range(i)]
    return [(r.randrange(n), r.randrange(n)) for _ in range(n // 2)] + path + clique + [(-5, -7), (8, 8), (2**62, -(2**62))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, monkeypatch, seed):
    monkeypatch.setattr(components, "EDGES", 50)
    edges = [e for e in graph(seed) if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.label for r in components.components(df).collect()} == brute(edges)
    assert components._starred(df.coalesce(1).where("a >= 5000 AND a < 6000")).count() <= 40  # a clique of 190 edges


def test_stars_keep_components():
    edges = [e for e in graph(3) if e[0] != e[1]]
    a, b = components.stars(*(np.array([e[k] for e in edges]) for k in (0, 1)))
    assert brute(zip(a.tolist(), b.tolist(), strict=True)) == brute(edges) and (b < a).all()
