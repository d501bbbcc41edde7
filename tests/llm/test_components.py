"""Components against union-find on chains, stars, cliques, repeated links; with and without dealt-out centres."""

import random

import pytest

from tidewatch.llm import components as module
from tidewatch.llm.common import Scratch


@pytest.mark.parametrize("salted", [1 << 22, 300])
def test_components_equal_union_find(spark, monkeypatch, salted):
    monkeypatch.setattr(module, "SALTED", salted)
    r = random.Random(salted)
    names = r.sample(range(-(10**12), 10**12), 3000)
    links = [(names[i], names[i + 1]) for i in range(200)]  # a chain
    links += [(names[300], names[300 + i]) for i in range(1, 900)]  # a star, its centre of any rank
    links += [(names[1300 + i], names[1300 + j]) for i in range(20) for j in range(20)]  # a clique with loops
    links += [(names[r.randrange(1400, 3000)], names[r.randrange(1400, 3000)]) for _ in range(900)]
    links += links[:50]
    root = {n: n for pair in links for n in pair if pair[0] != pair[1]}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    d = spark.createDataFrame(links, "u long, v long").repartition(7)
    found = [(x.node, x.component) for x in module.components(d, Scratch(spark, "t")).collect()]
    assert len(found) == len(root) and dict(found) == {n: find(n) for n in root}


def test_no_links(spark):
    assert module.components(spark.createDataFrame([(1, 1)], "u long, v long"), Scratch(spark, "t")).collect() == []
