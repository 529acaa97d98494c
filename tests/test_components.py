"""Components against union-find."""

import random

import pytest

from viaflux.operators.components import connected_components
from viaflux.storage import Scratch


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {n: find(n) for n in list(up)}


def shuffled(edges, n):
    rng, names = random.Random(3), random.Random(4).sample(range(10 * n), n)
    out = [(names[a], names[b]) for a, b in edges]
    rng.shuffle(out)
    return out


PATH = [(i, i + 1) for i in range(150)]
HUB = [(0, i) for i in range(1, 80)]
CLIQUE = [(i, j) for i in range(30) for j in range(30)]
GRAPHS = {
    "empty": [],
    "path": PATH,
    "path_any_order": shuffled(PATH, 151),
    "hub_with_a_large_name": [(1000, i) for i in range(80)],
    "hub_any_order": shuffled(HUB, 80),
    "clique_both_ways_and_loops": CLIQUE,
    "nulls_loops_repeats": [(None, 1), (2, None), (None, None), (5, 5), (7, 8), (8, 7), (7, 8), (-3, 8)],
    "random": [(random.Random(i).randrange(200), random.Random(-i - 1).randrange(200)) for i in range(110)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    scratch = Scratch(spark)
    edges = scratch.write(spark.createDataFrame(GRAPHS[name], "a long, b long"), "edges")
    got = connected_components(edges, scratch).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.label for r in got} == plain(GRAPHS[name])
