import random

import pytest

from sandpiper.llm import graph


@pytest.mark.parametrize("few", [0, 500_000])
def test_components_of_stars_chains_and_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_NODES", few)
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    rng = random.Random(8)
    edges = [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2040)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(-5, 2020), (1059, 1059)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(x, top(x)) for x in up} and len(got) == len(up)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
