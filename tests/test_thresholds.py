import itertools
import random

import numpy as np
import pytest

from sieveline.operators import evaluation as ev
from sieveline.operators import thresholds as th
from sieveline.schemas import MAIN_SET

SCHEMA = "pred_label string, truth string, confidence double"


def some_rows(rnd, n, labels, good=0.6):
    out = []
    for _ in range(n):
        p, c = rnd.choice(labels), round(rnd.random(), 2)
        out.append((p, p if rnd.random() < good + (1 - good) * c * rnd.random() else "other_unknown", c))
    return out


def brute(rows, labels, cap):
    """(right, -wrong) of the best of all choices."""
    best = (0, 0)
    curves = []
    for p in labels:
        mine = [(c, t != p) for q, t, c in rows if q == p]
        curves.append({(0, 0)} | {(sum(c >= t for c, _ in mine), sum(w for c, w in mine if c >= t)) for t, _ in mine})
    for choice in itertools.product(*curves):
        a, w = sum(x[0] for x in choice), sum(x[1] for x in choice)
        if th.within(a, w, cap):
            best = max(best, (a - w, -w))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_optimum_of_all_choices(spark, seed):
    rnd = random.Random(seed)
    labels = MAIN_SET[: 2 + seed % 2]
    rows = some_rows(rnd, 90, labels, rnd.choice([0.3, 0.6, 0.9]))
    curves = ev.class_curves(spark.createDataFrame(rows, SCHEMA)).cache()
    for cap in (0.1, 0.3, 0.45):
        want = brute(rows, labels, cap)
        got = th.best_thresholds(curves, cap=cap)
        assert (got.filled - got.wrong, -got.wrong) == want and got.gap == 0, (cap, got, want)
        assert got.filled == sum(c >= got.thresholds[p] for p, _, c in rows) and got.wrong == sum(c >= got.thresholds[p] and t != p for p, t, c in rows)
        # with few points allowed the cluster's hulls and price come first
        reduced = th.best_thresholds(curves, cap=cap, points=12)
        right = reduced.filled - reduced.wrong
        assert right <= want[0] <= reduced.bound and th.within(reduced.filled, reduced.wrong, cap)


def test_reduction_keeps_the_optimum(spark):
    """Long curves: the cluster drops most points, and what is left has the optimum of all of them."""
    rnd = random.Random(3)
    rows = [(p, p if rnd.random() < 0.5 + 0.5 * c else "x", c) for p in MAIN_SET for c in (rnd.random() for _ in range(4000))]
    curves = ev.class_curves(spark.createDataFrame(rows, SCHEMA)).cache()
    n = th.least(curves).count()
    whole, reduced = th.best_thresholds(curves, cap=0.2), th.best_thresholds(curves, cap=0.2, points=n - 1)
    assert whole.gap == reduced.gap == 0
    assert (whole.filled, whole.wrong) == (reduced.filled, reduced.wrong)
    start = min(t for t in [i / 100 for i in range(100)] if th.within(*counts(rows, dict.fromkeys(MAIN_SET, t)), 0.2))
    a, w = counts(rows, dict.fromkeys(MAIN_SET, start))
    assert whole.filled - whole.wrong >= a - w  # no worse than the best threshold for all


def counts(rows, tau):
    mine = [(p, t) for p, t, c in rows if c >= tau.get(p, np.inf)]
    return len(mine), sum(t != p for p, t in mine)


def test_a_search_that_is_cut_says_so(spark):
    rnd = random.Random(4)
    rows = some_rows(rnd, 400, MAIN_SET)
    curves = ev.class_curves(spark.createDataFrame(rows, SCHEMA)).cache()
    full, cut = th.best_thresholds(curves, cap=0.3), th.best_thresholds(curves, cap=0.3, choices=2)
    assert full.gap == 0 and cut.filled - cut.wrong <= full.filled - full.wrong <= cut.bound


def test_hulls(spark):
    pts = spark.createDataFrame([("SLR", w, w + c, 0.1) for w, c in ((0, 3), (1, 4), (2, 9), (3, 10), (4, 10), (6, 12))], "pred string, W long, A long, threshold double")
    got = {(r.W, r.A - r.W) for r in th.hulls(pts.coalesce(1)).collect()}
    assert {(0, 3), (2, 9), (6, 12)} <= got


def test_empty_and_infeasible(spark):
    empty = ev.class_curves(spark.createDataFrame([], SCHEMA))
    assert th.best_thresholds(empty).thresholds == dict.fromkeys(MAIN_SET, float("inf"))
    bad = ev.class_curves(spark.createDataFrame([("SLR", "TLR", 0.5)] * 5, SCHEMA))
    got = th.best_thresholds(bad)
    assert (got.filled, got.wrong, got.bound) == (0, 0, 0)


def test_grid_curves(spark):
    rnd = random.Random(1)
    rows = [*some_rows(rnd, 200, MAIN_SET[:2]), ("SLR", "SLR", 1.0), ("SLR", "SLR", None), ("other_unknown", "SLR", 0.9)]
    got = {(r.pred, round(r.threshold, 9)): (r.A, r.W) for r in th.grid_curves(spark.createDataFrame(rows, SCHEMA), 11).collect()}
    for p in MAIN_SET[:2]:
        for i in range(11):
            mine = [t for q, t, c in rows if q == p and c is not None and c >= i / 10]
            assert got.get((p, round(i / 10, 9)), (0, 0)) == (len(mine), sum(t != p for t in mine))
