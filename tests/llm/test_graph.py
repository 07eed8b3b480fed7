"""Components against union-find."""

from __future__ import annotations

import random

from commitscope.llm._graph import components


def test_random_graphs_chains_and_hubs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(130)] + [(2000, 2001 + k) for k in range(500)] + [(7, 7), (None, 3), (4, None)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
