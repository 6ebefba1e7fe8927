import random
import sys

import pytest

from sieveline.operators.graph import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


rng = random.Random(3)
CHAIN = list(range(50))
rng.shuffle(CHAIN)


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (10, 11)],
        list(zip(CHAIN, CHAIN[1:])),
        [(i, i + 1) for i in range(60)],
        [(500, i) for i in range(300)] + [(300 + i, 301 + i) for i in range(30)],
        [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
    ],
)
def test_against_union_find(spark, edges):
    edges = [(a, b) for a, b in edges]
    got = connected_components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "src long, dst long"))
    assert {r.node: r.root for r in got.collect()} == plain([x for x in edges if x[0] != x[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    strings = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string"))
    assert {r.node: r.root for r in strings.collect()} == {"a": "a", "b": "a", "c": "a"}


def test_size_estimate_does_not_grow_with_rounds(spark):
    """It had twice the digits after each round, 7,242 in the last of this chain, and each plan of the driver held many such numbers."""
    sys.set_int_max_str_digits(0)
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
