import random

import pytest

from sieveline.operators import splitting

SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}
LABELS = ["a", "b", "c"]


def draw(rnd, kind):
    """Groups of a shape as lists of labels."""
    if kind == "few":
        sizes = [rnd.randint(1, 40) for _ in range(40)]
    elif kind == "heavy":
        sizes = [min(400, int(rnd.paretovariate(1.1))) for _ in range(2000)]
    elif kind == "pure":
        return [[rnd.choice("abc")] * rnd.randint(1, 30) for _ in range(300)]
    else:
        sizes = [1] * 400
    return [[rnd.choices("abc", [6, 3, 1])[0] for _ in range(n)] for n in sizes]


def table_of(groups):
    cells = {}
    for g in groups:
        n = [g.count(x) for x in LABELS]
        cell = cells.setdefault((len(g), LABELS[n.index(max(n))]), {"groups": 0, "rows": 0, "n": [0] * 3})
        cell["groups"] += 1
        cell["rows"] += len(g)
        cell["n"] = [x + y for x, y in zip(cell["n"], n)]
    return [{"part": None, "size": s, "main": m, **c} for (s, m), c in cells.items()]


@pytest.mark.parametrize("kind", ["few", "heavy", "pure", "ones"])
def test_parts_keep_their_limit(kind):
    """No part is over 1.02 times its target in sixty draws, and planned label shares stay even; every group is dealt once."""
    for seed in range(60):
        groups = draw(random.Random(seed), kind)
        table = table_of(groups)
        quotas = splitting.part_quotas(table, SHARES, LABELS)
        total = sum(map(len, groups))
        assert {k: sum(q) for k, q in quotas.items()} == {(r["size"], r["main"]): r["groups"] for r in table}
        for k, (part, share) in enumerate(SHARES.items()):
            rows = sum(q[k] * size for (size, _), q in quotas.items())
            assert rows <= max(1.02 * share * total, share * total + 1), (kind, seed, part, rows / (share * total))


def test_a_group_larger_than_its_part_goes_where_most_is_left():
    table = [{"part": None, "size": 500, "main": "a", "groups": 1, "rows": 500, "n": [500, 0, 0]}, {"part": None, "size": 1, "main": "b", "groups": 100, "rows": 100, "n": [0, 100, 0]}]
    quotas = splitting.part_quotas(table, SHARES, LABELS)
    assert quotas[500, "a"] == [1, 0, 0] and sum(quotas[1, "b"]) == 100 and quotas[1, "b"][0] == 0


def test_rows_are_dealt_as_planned(spark):
    rnd = random.Random(5)
    groups = draw(rnd, "heavy") + [["a"] * 900]
    rows = [(i, x, i % 97 == 0) for i, g in enumerate(groups) for x in g]
    df = spark.createDataFrame(rows, "g int, l string, mark boolean")
    feats = splitting.group_features(df, "g", "l", ["mark"], LABELS)
    got = {r.g: r.split for r in splitting.assign_parts(feats, "g", "c", ["mark"], labels=LABELS).collect()}
    assert got == {r.g: r.split for r in splitting.assign_parts(feats.repartition(7), "g", "c", ["mark"], labels=LABELS).collect()}
    assert set(got) == set(range(len(groups))) and all(got[i] == "test" for i in range(0, len(groups), 97))
    for part, share in SHARES.items():
        n = sum(len(g) for i, g in enumerate(groups) if got[i] == part)
        assert n <= 1.02 * share * len(rows), part
        for x in LABELS:
            here = sum(g.count(x) for i, g in enumerate(groups) if got[i] == part) / n
            assert abs(here - sum(r[1] == x for r in rows) / len(rows)) < 0.05
