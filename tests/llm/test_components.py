"""Connected components against union-find."""

import random

import pytest

from stratum.llm.common import Scratch
from stratum.llm.components import components


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


@pytest.mark.parametrize("heavy", [256, 3])
@pytest.mark.parametrize("kind", ["chain", "hub", "random", "empty"])
def test_components(spark, monkeypatch, kind, heavy):
    monkeypatch.setattr("stratum.llm.components.HEAVY", heavy)
    rnd = random.Random(4)
    edges = {
        "chain": [(k, k + 1) for k in range(60)],
        "hub": [(500, k) for k in range(40)] + [(3, 3), (None, 4), (7, 500)],
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)],
        "empty": [],
    }[kind]
    rnd.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"))
    assert {r["node"]: r["component"] for r in got.collect()} == union_find(edges)
