"""Thresholds by label for the most right fills of all labels together, at their optimum and with a certificate.

The upper Wilson bound of W wrong among A filled rows is within a cap exactly if ``W <= cap * A - s * sqrt(A)``, with ``s = z * sqrt(cap * (1 - cap))``. Between two
values of A the root lies above its chord, so there the condition implies a linear one. At a price for that one labels are independent, and what they get at most is
a bound on every choice whose A lies in between. Prices and ranges of A are tried on the labels' concave hulls, which the cluster finds partition by partition. Points of a curve whose loss
at the price exceeds what bound and best choice so far leave can't be in a better choice; the cluster drops them. The rest is searched to the end, label by label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.schemas import AER_CAP, MAIN_SET, Z2, Z
from sieveline.storage import settle

#: Curves of at most so many points are searched as they are; partial choices that the search holds at most.
POINTS = 100_000
CHOICES = 2_000_000
#: Wrong rows by which a range's linear condition may be weaker than the true one; wider ranges of A are halved.
SLOPPY = 0.25


@dataclass(frozen=True)
class Chosen:
    """``thresholds`` by label (inf: abstain), their filled and wrong rows, and a number of right fills that no choice exceeds."""

    thresholds: dict[str, float]
    filled: int
    wrong: int
    bound: int

    @property
    def gap(self) -> int:
        return self.bound - (self.filled - self.wrong)


def within(a, w, cap: float):
    """Whether the upper bound of w wrong among a filled rows is within the cap; nothing filled is."""
    n = np.maximum(a, 1)
    p = w / n
    high = (p + Z2 / (2 * n) + Z * np.sqrt((p * (1 - p) + Z2 / (4 * n)) / n)) / (1 + Z2 / n)
    return (np.minimum(1.0, high) <= cap) | (np.asarray(a) == 0)


def least(curves: DataFrame) -> DataFrame:
    """The points of ``curves(pred, threshold, A, W)`` with the most filled rows for their wrong ones, the lowest threshold of equal ones."""
    return curves.groupBy("pred", "W").agg(F.max("A").alias("A"), F.max_by("threshold", F.struct("A", (-F.col("threshold")).alias("t"))).alias("threshold"))


def hulls(points: DataFrame) -> DataFrame:
    """``pred, W, A, threshold`` of the points on the upper concave hulls of partitions' points (right fills over wrong ones): all that any price picks is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, hull = None, []
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["pred", "W", "A", "threshold"])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if row[0] != label:
                    done += hull
                    label, hull = row[0], []
                while len(hull) > 1 and _turns_up(hull[-2], hull[-1], row):
                    hull.pop()
                hull.append(row)
        done += hull
        yield out()

    ranged = points.repartitionByRange("pred", "W").sortWithinPartitions("pred", "W").select("pred", F.col("W").cast("long"), F.col("A").cast("long"), F.col("threshold").cast("double"))
    return ranged.mapInArrow(run, "pred string, W long, A long, threshold double")


def _turns_up(a, b, c) -> bool:
    """Whether b lies on or below the line from a to c, in right fills over wrong ones. Rows are (label, W, A, ..)."""
    return ((b[2] - b[1]) - (a[2] - a[1])) * (c[1] - a[1]) <= ((c[2] - c[1]) - (a[2] - a[1])) * (b[1] - a[1])


def _gain(a: np.ndarray, w: np.ndarray, price: float, slope: float) -> np.ndarray:
    """Right fills less the price of what the condition is missed by."""
    return (a - w) + price * (slope * a - w)


@dataclass(frozen=True)
class _Range:
    """A range of filled rows, the linear condition ``W <= slope * A + shift`` that holds in it, the best price and the bound at it."""

    low: int
    high: int
    slope: float
    shift: float
    price: float
    bound: float


def _bounded(low: int, high: int, curves: Sequence[tuple[np.ndarray, np.ndarray]], cap: float) -> _Range:
    s = Z * math.sqrt(cap * (1 - cap))
    roots = math.sqrt(low), math.sqrt(max(high, 1))
    slope, shift = cap - s / sum(roots), -s * roots[0] * roots[1] / sum(roots) + 1e-6
    bound = lambda price: sum(float(_gain(a, w, price, slope).max()) for a, w in curves) + price * shift
    # the bound is convex in the price
    left, right = 0.0, 1.0
    while bound(right * 2) < bound(right) and right < 1e9:
        right *= 2
    right *= 2
    for _ in range(80):
        third = (right - left) / 3
        left, right = (left, right - third) if bound(left + third) <= bound(right - third) else (left + third, right)
    price = (left + right) / 2
    return _Range(low, high, slope, shift, price, bound(price))


def _ranges(curves: Sequence[tuple[np.ndarray, np.ndarray]], cap: float, best: int) -> list[_Range]:
    """Ranges of A in which a choice of more than ``best`` right fills isn't ruled out."""
    most = int(sum(a.max() for a, _ in curves))
    s = Z * math.sqrt(cap * (1 - cap))
    todo, out = [(0, most)], []
    while todo:
        low, high = todo.pop()
        r = _bounded(low, high, curves, cap)
        if r.high <= best or math.floor(r.bound + 1e-6) <= best:
            continue
        roots = math.sqrt(low), math.sqrt(high)
        if high - low > 1 and s * (roots[1] - roots[0]) ** 2 / (4 * sum(roots)) > SLOPPY:
            mid = (low + high) // 2
            todo += [(low, mid), (mid, high)]
        else:
            out.append(r)
    return out


def _first_choice(curves: Sequence[tuple[np.ndarray, np.ndarray]], cap: float) -> list[int]:
    """A choice within the cap: what a price picks, then label by label the point that leaves the others within it."""
    picks, price = [0] * len(curves), 1e9
    for price in np.geomspace(1e9, 1e-3, 200):
        some = [int(_gain(a, w, price, cap).argmax()) for a, w in curves]
        a, w = sum(int(c[0][i]) for c, i in zip(curves, some)), sum(int(c[1][i]) for c, i in zip(curves, some))
        if within(a, w, cap) and a - w > sum(int(c[0][i] - c[1][i]) for c, i in zip(curves, picks)):
            picks = some
    gained = True
    while gained:
        gained = False
        for k, (a, w) in enumerate(curves):
            rest = [sum(int(c[j][i]) for n, (c, i) in enumerate(zip(curves, picks)) if n != k) for j in (0, 1)]
            right = np.where(within(a + rest[0], w + rest[1], cap), a - w, -1)
            i = int(right.argmax())
            if right[i] > a[picks[k]] - w[picks[k]]:
                picks[k], gained = i, True
    return picks


def _search(curves: Sequence[tuple[np.ndarray, np.ndarray]], r: _Range, cap: float, best: tuple[int, int], choices: int) -> tuple[tuple[int, int, list[int]] | None, int]:
    """The choice with A in the range that is better than ``best`` (right fills, less the wrong ones), and a bound on all that were left out (0: none were).

    Partial choices are extended label by label; one goes if the bound at the range's price for the labels that follow can't lift it to ``best``, or
    if another has as many right fills and no more wrong ones.
    """
    follow = [0.0]
    for a, w in reversed(curves[1:]):
        follow.append(follow[-1] + float(_gain(a, w, r.price, r.slope).max()))
    follow.reverse()
    front_a, front_w, lost = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (a, w) in enumerate(curves):
        parts = []
        for low in range(0, len(front_a), max(1, choices // len(a))):
            high = low + max(1, choices // len(a))
            na, nw = (front_a[low:high, None] + a).ravel(), (front_w[low:high, None] + w).ravel()
            ok = np.flatnonzero(_gain(na, nw, r.price, r.slope) + follow[k] + r.price * r.shift + 1e-6 >= best[0])
            parts.append((na[ok], nw[ok], ok + low * len(a)))
        na, nw, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((-(na - nw), nw))
        right = (na - nw)[order]
        top = np.maximum.accumulate(np.concatenate(([-1], right[:-1]))) if len(right) else right
        keep = order[right > top]
        if len(keep) > choices:
            value = _gain(na[keep], nw[keep], r.price, r.slope) + follow[k] + r.price * r.shift
            by = np.argsort(-value)
            lost = max(lost, math.floor(value[by[choices]] + 1e-6))
            keep = np.sort(keep[by[:choices]])
        front_a, front_w = na[keep], nw[keep]
        history.append((at[keep] // len(a), at[keep] % len(a)))
        if not len(front_a):
            return None, lost
    good = np.flatnonzero(within(front_a, front_w, cap))
    if not len(good):
        return None, lost
    i = good[np.lexsort((front_w[good], -(front_a - front_w)[good]))[0]]
    if (int(front_a[i] - front_w[i]), -int(front_w[i])) <= best:
        return None, lost
    a, w, picks = int(front_a[i]), int(front_w[i]), []
    for parent, pick in reversed(history):
        picks.append(int(pick[i]))
        i = parent[i]
    return (a, w, picks[::-1]), lost


def _columns(rows, main: Sequence[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[list[float]]]:
    """Points by label as (A, W), with abstention first, and their thresholds."""
    curves, names = [], []
    for c in main:
        mine = sorted(((r["W"], r["A"], r["threshold"]) for r in rows if r["pred"] == c), key=lambda x: x[:2])
        curves.append((np.array([0, *[x[1] for x in mine]], np.int64), np.array([0, *[x[0] for x in mine]], np.int64)))
        names.append([math.inf, *[x[2] for x in mine]])
    return curves, names


def best_thresholds(curves: DataFrame, main: Sequence[str] = MAIN_SET, cap: float = AER_CAP, points: int = POINTS, choices: int = CHOICES) -> Chosen:
    """The choice of most right fills, and of these the fewest wrong ones, whose pooled upper bound is within the cap. ``curves(pred, threshold, A, W)`` is settled.

    A label takes a point of its curve or abstains. The optimum is found (``gap`` 0) unless more than ``choices`` partial choices are left after all bounds, which then say how far it
    may be away. Curves of more than ``points`` points are searched after the cluster has dropped those that can't matter; if more than ``points`` are still
    left (curves as good as straight for long), only hull points are searched, and the gap says so. Labels that don't occur abstain.
    """
    useful = least(curves.where(F.col("pred").isin(list(main))))
    rows = useful.limit(points + 1).collect()
    lost = 0
    if len(rows) > points:
        useful = settle(useful)
        corners, names = _columns(hulls(useful).collect(), main)
        picks = _first_choice(corners, cap)
        best = sum(int(a[i] - w[i]) for (a, w), i in zip(corners, picks))
        open_ = _ranges(corners, cap, best)
        enough = [(c, r.price, r.slope, float(_gain(a, w, r.price, r.slope).max()) - (r.bound - best) - 1e-6) for r in open_ for c, (a, w) in zip(main, corners)]
        limits = F.broadcast(curves.sparkSession.createDataFrame(enough, "label string, price double, slope double, enough double"))  # labels x ranges
        gain = (F.col("A") - F.col("W")) + F.col("price") * (F.col("slope") * F.col("A") - F.col("W"))
        kept = useful.join(limits, (F.col("pred") == F.col("label")) & (gain >= F.col("enough")), "left_semi")
        rows = kept.limit(points + 1).collect()
        if len(rows) > points:
            rows, lost = [], max((math.floor(r.bound + 1e-6) for r in open_), default=0)
        rows += [{"pred": c, "threshold": t, "A": int(a[j]), "W": int(w[j])} for c, (a, w), ts in zip(main, corners, names) for j, t in enumerate(ts) if j]
    found, names = _columns(rows, main)
    picks = _first_choice(found, cap)
    a, w = (sum(int(c[j][i]) for c, i in zip(found, picks)) for j in (0, 1))
    for r in sorted(_ranges(found, cap, a - w - 1), key=lambda r: -r.bound):
        if math.floor(r.bound + 1e-6) < a - w:
            continue
        better, missed = _search(found, r, cap, (a - w, -w), choices)
        lost = max(lost, missed)
        if better is not None:
            a, w, picks = better
    return Chosen({c: t[i] for c, t, i in zip(main, names, picks)}, a, w, max(a - w, lost))


def grid_curves(df: DataFrame, points: int, pred: str = "pred_label", truth: str = "truth", confidence: str = "confidence", main: Sequence[str] = MAIN_SET) -> DataFrame:
    """``pred, threshold, A, W`` at ``points`` even thresholds from 0 to 1: rows are first counted by label and cell, then summed from above."""
    at = [i / (points - 1) for i in range(points)]
    rows = df.where(F.col(pred).isin(list(main)) & F.col(confidence).isNotNull())
    cell = F.size(F.filter(F.array(*[F.lit(t) for t in at]), lambda t: t <= F.col(confidence))) - 1
    wrong = (~F.coalesce(F.col(truth) == F.col(pred), F.lit(False))).cast("long")
    counted = rows.groupBy(F.col(pred).alias("pred"), cell.alias("cell")).agg(F.count("*").alias("a"), F.sum(wrong).alias("w"))  # points + 1 rows a label
    each = counted.where("cell >= 0").select("pred", "a", "w", F.explode(F.sequence(F.lit(0), F.col("cell"))).alias("i"))
    return each.groupBy("pred", "i").agg(F.sum("a").alias("A"), F.sum("w").alias("W")).select("pred", F.element_at(F.array(*[F.lit(t) for t in at]), (F.col("i") + 1).cast("int")).alias("threshold"), "A", "W")
