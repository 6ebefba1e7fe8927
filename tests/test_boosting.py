import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sieveline.operators import boosting, heads
from sieveline.operators.boosting import Boosted, Boosting


def plain(bins, y, w, k, start, how):
    """The same learner by plain loops over rows, nodes, features and bins; trees as nested tuples."""
    n, d = bins.shape
    score = np.tile(np.array(start), (n, 1))
    rounds, losses = [], []
    for _ in range(how.rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        losses.append(-(w * np.log(p[np.arange(n), y])).sum() / w.sum())
        trees = []
        for c in range(k):
            g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])

            def grow(rows, level):
                value = -how.rate * g[rows].sum() / (h[rows].sum() + how.l2 + 1e-12)
                best = None
                if level < how.depth:
                    gain_of = lambda r: g[r].sum() ** 2 / (h[r].sum() + how.l2 + 1e-12)
                    for f in range(d):
                        for b in sorted(set(bins[rows, f])):
                            left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                            if min(len(left), len(right)) < how.min_rows or min(h[left].sum(), h[right].sum()) < how.min_hessian:
                                continue
                            gain = round(gain_of(left) + gain_of(right) - gain_of(rows), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, int(b), left, right)
                if best is None:
                    score[rows, c] += value
                    return value
                return (best[1], best[2], grow(best[3], level + 1), grow(best[4], level + 1))

            trees.append(grow(np.flatnonzero(w > 0), 0))
            for r in np.flatnonzero(w <= 0):
                t = trees[-1]
                while isinstance(t, tuple):
                    t = t[2] if bins[r, t[0]] <= t[1] else t[3]
                score[r, c] += t
        rounds.append(trees)
    return rounds, losses, score


def nested(tree, i=0):
    return tree.value[i] if tree.feature[i] < 0 else (tree.feature[i], tree.bin[i], nested(tree, 2 * i + 1), nested(tree, 2 * i + 2))


def same(a, b):
    if isinstance(a, tuple) or isinstance(b, tuple):
        return isinstance(a, tuple) and isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return abs(a - b) < 1e-9


def some_rows(n=200):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        k = i % 3
        x = [rnd.gauss(2 * math.cos(2 * k), 1), rnd.gauss(2 * math.sin(2 * k), 1), float(rnd.randrange(4)), 1.0]
        if i % 17 == 0:
            x[1] = float("nan")
        rows.append((i, ["b", "a", "c"][k], x, [1.0, 2.0, 0.5, 0.0][i % 4]))
    return rows


@pytest.mark.parametrize("how", [Boosting(rounds=4, depth=3, rate=0.3, bins=16, refresh=2), Boosting(rounds=2, depth=2, rate=1.0, bins=256, l2=0.0, min_rows=10, min_hessian=0.5)])
def test_equals_a_plain_version(spark, how, monkeypatch):
    rows = some_rows()
    df = spark.createDataFrame(rows, "i int, l string, features array<double>, w double").repartition(5)
    model = boosting.fit(df, "l", how=how, weight="w")
    x, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert model.labels == ["a", "b", "c"] and model.edges[3] == [1.0]
    y = np.array([model.labels.index(r[1]) for r in rows])
    bins = boosting.binned(x, model.edges)
    assert np.allclose(np.exp(model.start), [w[y == c].sum() / w.sum() for c in range(3)])
    want, losses, score = plain(bins, y, w, 3, model.start, how)
    assert all(same(nested(t), u) for a, b in zip(model.trees, want, strict=True) for t, u in zip(a, b, strict=True))
    assert np.allclose(model.losses, losses) and all(a > b for a, b in zip(losses, losses[1:]))
    got = {r.i: r.p for r in model.transform(df).collect()}
    assert np.allclose([got[r[0]] for r in rows], boosting.softmax(score))
    monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", 1)  # a feature at a time
    assert all(same(nested(t), u) for a, b in zip(boosting.fit(df, "l", how=how, weight="w").trees, want) for t, u in zip(a, b))


def test_edges_are_quantiles(spark):
    df = spark.createDataFrame([([float(i), float(i % 2), None],) for i in range(1000)], "x array<double>")
    assert boosting.quantile_edges(df, F.col("x"), 3, 4) == [[249.0, 499.0, 749.0], [0.0, 1.0], []]


def test_partitions_change_nothing(spark):
    """More rows than a quantile sketch keeps, and features that are copies of each other: edges are the exact quantiles, and trees and losses the same."""
    rnd = random.Random(2)
    rows = [(i % 3, [float(np.float32(rnd.gauss(i % 3, 2))), rnd.expovariate(1) - 0.3, rnd.choice([-0.0, 0.0, -1e300, 5e-324, math.inf, math.nan])]) for i in range(60_000)]
    df = spark.createDataFrame([(str(y), [*x, x[1]]) for y, x in rows], "l string, x array<double>").repartition(8)
    edges = boosting.quantile_edges(df, F.col("x"), 4, 64)
    for j in range(4):
        v = sorted(x for x in ([*r[1], r[1][1]][j] for r in rows) if not math.isnan(x))
        assert edges[j] == sorted({v[math.ceil(k * len(v) / 64) - 1] for k in range(1, 64)})
    how = Boosting(rounds=2, depth=3, rate=0.5)
    one, other = (boosting.fit(df.repartition(n), "l", "x", how) for n in (1, 7))
    assert one == other and one.edges == edges and one.losses[0] > one.losses[1]
    assert {f for trees in one.trees for t in trees for f in t.feature}.isdisjoint({3})


def test_no_row_leaves_its_partition(spark):
    """Below the histograms there is no exchange; what is exchanged are histogram rows, of which a task has a bounded number."""
    df = spark.createDataFrame(some_rows(), "i int, l string, features array<double>, w double").repartition(4)
    model = boosting.fit(df, "l", how=Boosting(rounds=1, depth=1))
    table = boosting.settle(boosting._bin_rows(df, "l", F.col("features"), F.lit(1.0), model))
    plan = boosting.best_splits(boosting.histograms(table, model, 0, [boosting.Tree.empty(2) for _ in "abc"], 0), Boosting())
    text = plan._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("MapInArrow") :]
    assert "Exchange" not in below and text.count("Exchange hashpartitioning") == 2
    # three labels, one node, four features of at most 64 bins, and the row of the loss, from each of four partitions
    assert boosting.histograms(table, model, 0, [boosting.Tree.empty(2) for _ in "abc"], 0).count() <= 4 * (3 * 4 * 64 + 1)


def test_odd_tables(spark, tmp_path):
    schema = "l string, features array<double>, l2 string, w double"
    with pytest.raises(ValueError, match="labelled"):
        boosting.fit(spark.createDataFrame([(None, [1.0], "x", 1.0)], schema), "l")
    one = boosting.fit(spark.createDataFrame([("a", [1.0], "x", 1.0), ("a", None, "x", 1.0), (None, [2.0], "y", 1.0)], schema), "l", how=Boosting(rounds=1))
    assert one.transform(spark.createDataFrame([([None],), (None,), ([5.0],)], "features array<double>")).select("p").distinct().collect()[0].p == [1.0]
    with pytest.raises(Exception, match="wide"):
        boosting.fit(spark.createDataFrame([("a", [1.0], "x", 1.0), ("b", [1.0, 2.0], "x", 1.0)], schema), "l", how=Boosting(rounds=1))
    df = spark.createDataFrame(some_rows(), "i int, l string, features array<double>, w double")
    model = boosting.fit(df, "l", how=Boosting(rounds=2, depth=2))
    model.save(spark, str(tmp_path / "m"))
    assert Boosted.load(spark, str(tmp_path / "m")) == model


def test_as_a_head(spark):
    df = spark.createDataFrame(some_rows(), "i int, l string, x array<double>, w double").withColumn("features", array_to_vector("x")).where("i % 17 <> 0")
    model = heads.fit(df, "l", head=heads.Head("boosted", trees=8, depth=2, balanced=True, extra={"rate": 0.5}), weight="w")
    got = heads.probabilities(model, df, ["c", "b", "a", "unseen"]).select("l", "p").collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.p[3] == 0 for r in got)
    assert sum(["c", "b", "a"][r.p.index(max(r.p))] == r.l for r in got) / len(got) > 0.85
