"""Gradient boosting for several labels at once, on histograms of binned features.

A row is binned once, by quantiles of each feature, and stays in its partition. Every round fits one tree for each label to the gradients of the softmax loss,
level by level: each task sums gradients and Hessians of its rows by (label, node, feature, bin), the cluster adds these histograms up and finds
the best split of each node, and only splits come back, a row for each node of the level. Splits and leaf values take Hessians into account, as Newton steps do.

How rows are dealt to partitions changes nothing: quantiles are exact, and what is summed are multiples of one power of two, small enough that no sum is rounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.storage import settle

#: Rows that a task bins or sums at a time; bytes of the histograms that it holds; bits of a number that one pass for quantiles settles.
CHUNK = 4096
HISTOGRAM_BYTES = 128 << 20
DIGIT = 12
HIST = "cls int, node int, feature int, bin int, g double, h double, n long"


@dataclass(frozen=True)
class Boosting:
    """``rounds`` trees a label, of ``depth`` levels; a leaf has at least ``min_rows`` rows and ``min_hessian``. Scores are written out every ``refresh`` rounds."""

    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    l2: float = 1.0
    bins: int = 64
    min_rows: int = 1
    min_hessian: float = 1e-3
    refresh: int = 10


@dataclass
class Tree:
    """Nodes as in a heap: those below i are 2i + 1 (bin up to ``bin[i]``) and 2i + 2; feature -1: a leaf."""

    feature: list[int]
    bin: list[int]
    value: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree([-1] * n, [0] * n, [0.0] * n)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, edge = np.array(self.feature), np.array(self.bin)
        at = np.zeros(len(bins), np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            right = bins[inner, f[inner]] > edge[at[inner]]
            at[inner] = 2 * at[inner] + 1 + right


@dataclass
class Boosted:
    """A fitted model: labels in order, each feature's edges, the scores to begin with, and the rounds' trees by label."""

    labels: list[str]
    edges: list[list[float]]
    start: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def scores(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What rounds from ``first`` on add to the scores of binned rows."""
        out = np.zeros((len(bins), len(self.labels)))
        for trees in self.trees[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.leaf_of(bins)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.array(self.start) + self.scores(binned(x, self.edges)))

    def transform(self, df: DataFrame, features: str = "features", name: str = "p") -> DataFrame:
        """Adds the labels' probabilities as an array. A null row of features, as any null in it, counts as lower than all numbers."""
        width = len(self.edges)

        @F.pandas_udf("array<double>")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                x = np.array([np.full(width, np.nan) if v is None else np.asarray(v, dtype=np.float64) for v in s]).reshape(-1, width)
                yield pd.Series(list(self.probabilities(x)))

        return df.withColumn(name, scored(as_array(df, features)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        spec = json.loads(spark.read.parquet(path).first()[0])
        return Boosted(**(spec | {"trees": [[Tree(**t) for t in trees] for trees in spec["trees"]]}))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def whole_units(x: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(x / unit) * unit


def as_array(df: DataFrame, features: str) -> Column:
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")


def binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """How many edges of its feature each value is above; 0 for what is no number."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(np.asarray(e, dtype=np.float64), x[:, j], side="left"))
    return out


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles; where a double's last bits are zero so are its key's."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits).view(np.uint64) ^ np.uint64(1 << 63)


def _value(key: int) -> float:
    bits = (key ^ (1 << 63)) if key >> 63 else (1 << 64) - key
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digits(rows: DataFrame, cells: list[list[int]], high: int, low: int) -> DataFrame:
    """``feature, cell, digit, n``: how many of a feature's values have the bits of a cell above ``high`` and the digit below them; with feature -1 the bits in use.

    Features are taken in blocks if a task's counts of all of them would be larger than HISTOGRAM_BYTES.
    """
    width, size = len(cells), 1 << (high - low)
    block = max(1, min(width, HISTOGRAM_BYTES // (8 * size * max(map(len, cells)))))

    def of_block(first: int) -> DataFrame:
        known = [np.array(c, np.uint64) for c in cells[first : first + block]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, used = [np.zeros(len(c) * size, np.int64) for c in known], np.uint64(0)
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    x = whole.slice(at, CHUNK).column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                    for j, c in enumerate(known):
                        v = np.ascontiguousarray(x[:, first + j])
                        key = _keys(v[~np.isnan(v)])
                        used |= np.bitwise_or.reduce(key, initial=np.uint64(0))
                        top = key >> np.uint64(high) if high < 64 else np.zeros_like(key)
                        cell = np.minimum(np.searchsorted(c, top), len(c) - 1)
                        here = c[cell] == top
                        sums[j] += np.bincount(cell[here] * size + ((key[here] >> np.uint64(low)) & np.uint64(size - 1)).astype(np.int64), minlength=len(sums[j]))
            for j, n in enumerate([*sums, np.array([int(used) >> b & 1 for b in range(64)])]):
                there = np.flatnonzero(n)
                cell, digit = np.divmod(there, size)
                feature = np.full(len(there), first + j if j < len(known) else -1)
                yield pa.RecordBatch.from_arrays([*[pa.array(a.astype(np.int32)) for a in (feature, cell, digit)], pa.array(n[there].astype(np.int64))], names=["feature", "cell", "digit", "n"])

        return rows.mapInArrow(run, "feature int, cell int, digit int, n long")

    out = of_block(0)
    for first in range(block, width, block):
        out = out.unionByName(of_block(first))
    return out.groupBy("feature", "cell", "digit").agg(F.sum("n").alias("n"))


def quantile_edges(df: DataFrame, features: Column, width: int, bins: int) -> list[list[float]]:
    """Each feature's distinct quantiles over all rows, exactly: the least values with at least a share of the values up to them.

    Every pass over the rows counts the next ``DIGIT`` bits of the values that share the bits found so far with a quantile, and ends when no value has others;
    that is three passes for single precision, six at most. A task's counts have a bounded size, and a row for each quantile comes back.
    """
    spark, rows = df.sparkSession, df.select(features.alias("x")).where("x IS NOT NULL")
    cells, high, end, asked = [[0]] * width, 64, 0, None
    while width and high > end:
        low = max(0, high - DIGIT)
        counts = settle(_digits(rows, cells, high, low))
        if asked is None:
            end = counts.where("feature < 0").agg(F.min("digit")).first()[0] or 0
            totals = counts.where("feature >= 0").groupBy("feature").agg(F.sum("n")).collect()  # a row for each feature
            asked = [(j, 0, r) for j, n in totals for r in sorted({max(1, -(-i * n // bins)) for i in range(1, bins)})]
        wanted = F.broadcast(spark.createDataFrame(asked, "feature int, cell int, rank long"))  # a row for each quantile
        upto = F.sum("n").over(W.partitionBy("feature", "cell").orderBy("digit"))
        found = counts.withColumn("upto", upto).join(wanted, ["feature", "cell"]).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        found = [(r.feature, cells[r.feature][r.cell] << (high - low) | r.digit, r.rank - r.upto + r.n) for r in found.collect()]
        tops: list[set[int]] = [set() for _ in range(width)]
        for j, top, _ in found:
            tops[j].add(top)
        cells = [sorted(t) or [0] for t in tops]
        asked, high = [(j, cells[j].index(top), r) for j, top, r in found], low
    some = {j for j, *_ in asked or []}
    return [[_value(top << high) for top in cells[j]] if j in some else [] for j in range(width)]


def _bin_rows(df: DataFrame, label: str, features: Column, weight: Column, model: Boosted) -> DataFrame:
    """``y, w, bins, score``: a byte for each feature, and the scores so far."""
    width, labels, edges = len(model.edges), model.labels, model.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(labels)}
        for b in batches:
            for low in range(0, b.num_rows, CHUNK):
                part = b.slice(low, CHUNK)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                rows = [r.tobytes() for r in binned(x, edges)]
                yield pa.RecordBatch.from_arrays([pa.array([number[y] for y in part.column(0).to_pylist()], pa.int32()), part.column(1), pa.array(rows, pa.binary())], names=["y", "w", "bins"])

    rows = df.select(F.col(label).cast("string").alias("y"), weight.cast("double").alias("w"), features.alias("x")).mapInArrow(run, "y int, w double, bins binary")
    return rows.withColumn("score", F.array(*[F.lit(s) for s in model.start]))


def _read_rows(b: pa.RecordBatch, width: int, k: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, width)
    return b.column(0).to_numpy(), b.column(1).to_numpy(), bins, b.column(3).flatten().to_numpy().reshape(-1, k)


def _rescored(rows: DataFrame, model: Boosted, since: int) -> DataFrame:
    """The rows with the scores of rounds from ``since`` on added."""
    width, k = len(model.edges), len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, bins, score = _read_rows(b, width, k)
            new = pa.array(list(score + model.scores(bins, since)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], new], names=["y", "w", "bins", "score"])

    return rows.mapInArrow(run, "y int, w double, bins binary, score array<double>")


def histograms(rows: DataFrame, model: Boosted, since: int, growing: list[Tree], level: int, unit: float = 2.0**-32) -> DataFrame:
    """``HIST`` for the nodes of a level of the growing trees; with class -1 the loss (g) and the weight (h) of all rows.

    Gradients and Hessians are rounded to multiples of ``unit``, a power of two of which all rows have under 2 ** 53, so their sums are exact in any order.

    A task gives one row for each entry that isn't empty. Features are taken in blocks if the histograms of all of them would be larger than HISTOGRAM_BYTES.
    """
    width, k, n_bins = len(model.edges), len(model.labels), max((len(e) for e in model.edges), default=0) + 1
    first, n_nodes = (1 << level) - 1, 1 << level
    block = max(1, min(width, HISTOGRAM_BYTES // (24 * k * n_nodes * n_bins)))

    def of_block(low: int) -> DataFrame:
        high = min(low + block, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = n_nodes * (high - low) * n_bins
            sums = np.zeros((k, 3, size))
            loss = np.zeros(3)
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    y, w, bins, score = _read_rows(whole.slice(at, CHUNK), width, k)
                    p = softmax(score + model.scores(bins, since))
                    lost = -w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
                    loss += (whole_units(lost, 1024 * unit).sum(), whole_units(w, unit).sum(), len(y))
                    place = np.arange(high - low) * n_bins + bins[:, low:high]
                    for c, tree in enumerate(growing):
                        node = tree.leaf_of(bins) - first
                        here = np.flatnonzero((node >= 0) & (w > 0))
                        g, h = (whole_units(v, unit) for v in (w[here] * (p[here, c] - (y[here] == c)), w[here] * p[here, c] * (1 - p[here, c])))
                        index = (node[here, None] * (high - low) * n_bins + place[here]).ravel()
                        for i, v in enumerate((g, h, np.ones(len(here)))):
                            sums[c, i] += np.bincount(index, np.repeat(v, high - low), size)
            for c in range(k):
                there = np.flatnonzero(sums[c, 2])
                node, rest = np.divmod(there, (high - low) * n_bins)
                f, b = np.divmod(rest, n_bins)
                ints = [np.full(len(there), c), node + first, f + low, b]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in ints], *[pa.array(sums[c, i][there]) for i in (0, 1)], pa.array(sums[c, 2][there].astype(np.int64))], names=["cls", "node", "feature", "bin", "g", "h", "n"])
            if low == 0:
                yield pa.RecordBatch.from_pylist([{"cls": -1, "node": 0, "feature": 0, "bin": 0, "g": loss[0], "h": loss[1], "n": int(loss[2])}], schema=pa.schema([*[(x, pa.int32()) for x in ("cls", "node", "feature", "bin")], ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())]))

        return rows.mapInArrow(run, HIST)

    out = of_block(0)
    for low in range(block, width, block):
        out = out.unionByName(of_block(low))
    return out


def best_splits(hist: DataFrame, how: Boosting) -> DataFrame:
    """A row for each (cls, node): its sums g, h, n, and the split of most gain (``best``, null where none gains), the first feature and bin of equal ones.

    Histograms are dealt by feature once; adding them up and summing them from the left need no further shuffle.
    """
    whole = hist.repartition("cls", "node", "feature").groupBy("cls", "node", "feature", "bin").agg(*[F.sum(x).alias(x) for x in ("g", "h", "n")])
    part = W.partitionBy("cls", "node", "feature")
    left = part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rows = whole.select("cls", "node", "feature", "bin", *[F.sum(x).over(left).alias(f"{x}l") for x in ("g", "h", "n")], *[F.sum(x).over(part).alias(x) for x in ("g", "h", "n")])
    value = lambda g, h: g * g / (h + how.l2 + 1e-12)
    gr, hr, nr = (F.col(x) - F.col(f"{x}l") for x in ("g", "h", "n"))
    gain = F.round(value(F.col("gl"), F.col("hl")) + value(gr, hr) - value(F.col("g"), F.col("h")), 9)
    fits = (F.col("cls") >= 0) & (F.col("nl") >= how.min_rows) & (nr >= how.min_rows) & (F.col("hl") >= how.min_hessian) & (hr >= how.min_hessian)
    rows = rows.withColumn("gain", F.when(fits, gain))
    split = F.struct("feature", "bin", "gl", "hl", gr.alias("gr"), hr.alias("hr"))
    order = F.when(F.col("gain") > 0, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return rows.groupBy("cls", "node").agg(*[F.first(x).alias(x) for x in ("g", "h", "n")], F.max_by(F.when(F.col("gain") > 0, split), order).alias("best"))


def fit(train: DataFrame, label: str, features: str = "features", how: Boosting = Boosting(), weight: str | None = None) -> Boosted:
    """Boosted trees for the labels of ``train``, in order of their names.

    Features are an array or vector column of one width, dense. Defined cases: rows without a label are left out; nulls and NaNs in features are lower than all numbers;
    rows of weight 0 count for quantiles only; a single label gives probability 1; a table without labels is an error.
    """
    if not 2 <= how.bins <= 256:
        raise ValueError("2 to 256 bins")
    x = as_array(train, features)
    w = F.col(weight) if weight else F.lit(1.0)
    rows = train.where(F.col(label).isNotNull() & x.isNotNull())
    counts = {r[0]: r[1] or 0.0 for r in rows.groupBy(F.col(label).cast("string")).agg(F.sum(w.cast("double"))).collect()}  # a row for each label
    if not counts:
        raise ValueError("no labelled rows")
    total, labels = sum(counts.values()), sorted(counts)
    unit = 2.0 ** (int(np.ceil(np.log2(max(total, 1e-12)))) - 51)
    width, least = rows.agg(F.max(F.size(x)), F.min(F.size(x))).first()
    if least != width:
        raise ValueError(f"features aren't {width} wide everywhere")
    model = Boosted(labels, quantile_edges(rows, x, width, how.bins), [float(np.log(max(counts[c], 1e-12) / max(total, 1e-12))) for c in labels])
    table, since = settle(_bin_rows(rows, label, x, w, model)), 0
    for r in range(how.rounds):
        if r - since >= how.refresh:
            table, since = settle(_rescored(table, model, since)), r
        growing = [Tree.empty(how.depth) for _ in labels]
        for level in range(how.depth):
            found = best_splits(histograms(table, model, since, growing, level, unit), how).collect()  # labels x nodes of the level
            grown = False
            for f in found:
                if f["cls"] < 0:
                    if level == 0:
                        model.losses.append(f["g"] / max(f["h"], 1e-12))
                    continue
                tree, i = growing[f["cls"]], f["node"]
                tree.value[i] = -how.rate * f["g"] / (f["h"] + how.l2 + 1e-12)
                if (b := f["best"]) is not None:
                    tree.feature[i], tree.bin[i], grown = b["feature"], b["bin"], True
                    tree.value[2 * i + 1], tree.value[2 * i + 2] = (-how.rate * b[f"g{s}"] / (b[f"h{s}"] + how.l2 + 1e-12) for s in "lr")
            if not grown:
                break
        model.trees.append(growing)
    return model
