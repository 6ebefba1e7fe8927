"""Many multinomial logistic regressions on the same rows, fitted together.

Models differ in their C, in the weights of rows and in the rows they are trained on (folds, splits). Each iteration reads the rows once: every task sums the losses and gradients
of all models at the coefficients that each of them tries next, and the cluster adds these sums up. The driver holds coefficients and a short history of
each model (L-BFGS with a backtracking line search); a model that has converged is left out of the scans that follow. So scans don't grow with the number of models.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sieveline.storage import settle

#: Entries of features that a task multiplies at a time; steps that the direction remembers.
CHUNK = 1 << 18
MEMORY = 8


@dataclass(frozen=True)
class Spec:
    """``|b|^2 / 2 + c * weighted loss`` over the rows where ``where`` holds; the intercept isn't penalised. ``balanced``: weights times rows / (labels * rows of the label)."""

    c: float = 1.0
    weight: Column | None = None
    where: Column | None = None
    balanced: bool = False


@dataclass
class Linear:
    """A fitted model: coefficients by label and feature, intercepts (-inf: a label without training rows), the objective's gradient at the end and the scans that it took part in."""

    labels: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    gradient: float = 0.0
    scans: int = 0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.coefficients.T + self.intercepts)

    def transform(self, df: DataFrame, features: str = "features", name: str = "p") -> DataFrame:
        """Adds the labels' probabilities."""
        return predict([self], df, features, F.lit(0), name)

    def save(self, spark: SparkSession, path: str) -> None:
        spec = {"labels": self.labels, "coefficients": self.coefficients.tolist(), "intercepts": [x if np.isfinite(x) else None for x in self.intercepts], "gradient": self.gradient, "scans": self.scans}
        spark.createDataFrame([(json.dumps(spec),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Linear:
        spec = json.loads(spark.read.parquet(path).first()[0])
        return Linear(spec["labels"], np.array(spec["coefficients"]), np.array([-np.inf if x is None else x for x in spec["intercepts"]]), spec["gradient"], spec["scans"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class _Rows:
    """Rows of features, by their entries or as a matrix."""

    ends: np.ndarray
    index: np.ndarray
    value: np.ndarray
    width: int

    def parts(self) -> Iterator[tuple[int, int]]:
        """Row ranges of about CHUNK entries."""
        low, n = 0, len(self.ends) - 1
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.ends, self.ends[low] + CHUNK, "right")) - 1)
            yield low, min(high, n)
            low = min(high, n)

    def times(self, low: int, high: int, b: np.ndarray) -> np.ndarray:
        """rows x columns of b; b is features x columns."""
        a, z = self.ends[low], self.ends[high]
        if z - a == (high - low) * self.width:
            return self.value[a:z].reshape(high - low, self.width) @ b
        out = np.zeros((high - low, b.shape[1]))
        np.add.at(out, np.repeat(np.arange(high - low), np.diff(self.ends[low : high + 1])), self.value[a:z, None] * b[self.index[a:z]])
        return out

    def gathered(self, low: int, high: int, r: np.ndarray) -> np.ndarray:
        """features x columns of r; r is rows x columns."""
        a, z = self.ends[low], self.ends[high]
        if z - a == (high - low) * self.width:
            return self.value[a:z].reshape(high - low, self.width).T @ r
        row = np.repeat(np.arange(high - low), np.diff(self.ends[low : high + 1]))
        return np.stack([np.bincount(self.index[a:z], self.value[a:z] * r[row, c], self.width) for c in range(r.shape[1])], axis=1)


def _entries(column: pa.Array) -> tuple[pa.Array | None, pa.Array]:
    """(places, values) of the features of a batch: vectors come as structs, sparse or dense, arrays as they are."""
    if pa.types.is_struct(column.type):
        return column.field("indices"), column.field("values")
    return None, column


def _width(rows: DataFrame, features: str) -> int:
    """The widest row of features; a sparse vector says its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            sizes = [x for x in column.field("size").to_pylist() if x is not None] if pa.types.is_struct(column.type) else []
            lengths = _entries(column)[1].value_lengths().drop_null().to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([max([0, *sizes, *lengths])], pa.int32())], names=["n"])

    return rows.select(features).mapInArrow(run, "n int").agg(F.max("n")).first()[0] or 0


def _read(column: pa.Array, width: int) -> _Rows:
    index, value = _entries(column)
    sizes = value.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    x = value.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all() and (index is None or index.null_count == len(index)):
        return _Rows(ends, np.zeros(0, np.int64), x, width)
    told = [None] * len(sizes) if index is None else index.to_pylist()
    at = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) if t is None else np.asarray(t, np.int64) for t, n in zip(told, sizes)]])
    return _Rows(ends, at, x, width)


def _scan(rows: DataFrame, width: int, k: int, views: Sequence[int], at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses (a model each) and gradients (model, label, feature and intercept) at coefficients ``at``; ``views`` has the place of each model's weights. One job."""
    sent = rows.sparkSession.sparkContext.broadcast((list(views), at, mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, at, mask = sent.value
        m = len(views)
        b = at[:, :, :width].reshape(m * k, width).T
        shift = np.where(mask, at[:, :, width], -np.inf).reshape(m * k)
        grad, loss = np.zeros((m, k, width + 1)), np.zeros((m, k))
        for whole in batches:
            x = _read(whole.column(2), width)
            y, w = whole.column(0).to_numpy(), whole.column(1).flatten().to_numpy().reshape(whole.num_rows, -1)[:, views]
            for low, high in x.parts():
                n, here = high - low, np.arange(high - low)
                p = _softmax((x.times(low, high, b) + shift).reshape(n, m, k))
                own = np.maximum(p[here, :, y[low:high]], 1e-300)
                np.add.at(loss.T, y[low:high], -np.log(own) * w[low:high])
                p[here, :, y[low:high]] -= 1
                r = (p * w[low:high, :, None]).reshape(n, m * k)
                grad[:, :, :width] += x.gathered(low, high, r).T.reshape(m, k, width)
                grad[:, :, width] += r.sum(axis=0).reshape(m, k)
        for i in range(m):
            yield pa.RecordBatch.from_arrays([pa.array([i] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([np.append(grad[i, c], loss[i, c]) for c in range(k)], pa.list_(pa.float64()))], names=["m", "c", "v"])

    sums = rows.mapInArrow(run, "m int, c int, v array<double>").groupBy("m", "c").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()  # models x labels
    out = np.zeros((len(views), k, width + 2))
    for r in sums:
        out[r["m"], r["c"]] = r["v"]
    sent.unpersist()
    return out[:, :, -1].sum(axis=1), out[:, :, :-1]


class _Descent:
    """One model's L-BFGS. ``trial`` is where it wants the objective next."""

    def __init__(self, start: np.ndarray, tolerance: float):
        self.x, self.f, self.g = start, np.inf, None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.size, self.trial, self.tolerance, self.done = None, 1.0, start, tolerance, False

    def take(self, f: float, g: np.ndarray) -> None:
        """The objective and its gradient at ``trial``."""
        if self.g is not None and not f <= self.f + 1e-4 * self.size * float((self.direction * self.g).sum()):
            self.size *= 0.5
            if self.size < 1e-12:
                self.done = True
            self.trial = self.x + self.size * self.direction
            return
        if self.g is not None:
            s, y = self.trial - self.x, g - self.g
            if (s * y).sum() > 1e-12 * (y * y).sum():
                self.steps = [*self.steps, (s, y)][-MEMORY:]
        self.x, self.f, self.g = self.trial, f, g
        self.done = bool(np.abs(g).max() <= self.tolerance)
        self.direction, self.size = -self._scaled(g), 1.0 if self.steps else 1.0 / max(1.0, float(np.abs(g).sum()))
        self.trial = self.x + self.size * self.direction

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y in reversed(self.steps):
            a = (s * q).sum() / (s * y).sum()
            kept.append(a)
            q = q - a * y
        if self.steps:
            s, y = self.steps[-1]
            q = q * (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.steps, reversed(kept)):
            q = q + s * (a - (y * q).sum() / (s * y).sum())
        return q


def fit_many(df: DataFrame, label: str, specs: Mapping[str, Spec], features: str = "features", tolerance: float = 1e-6, max_scans: int = 300) -> dict[str, Linear]:
    """A model for each spec, at its optimum: no entry of the gradient of the mean loss (objective / (c * weight)) is over ``tolerance``.

    Features are dense or sparse vectors, or arrays, of one width. Labels are those of all rows, in order of their names; one without a row in a spec's training rows has
    probability 0 there. Rows without a label or features are left out. A spec without training rows is an error. The driver and every task hold the
    coefficients of all models (models x labels x features numbers), whatever the number of rows.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    views: list[tuple] = []
    place = {}
    for name, s in specs.items():  # specs that differ in C alone share their weights
        key = (str(s.weight), str(s.where), s.balanced)
        place[name] = next((i for i, v in enumerate(views) if v[0] == key), len(views))
        if place[name] == len(views):
            views.append((key, s))
    plain = [F.when(F.lit(True) if s.where is None else s.where, F.lit(1.0) if s.weight is None else s.weight.cast("double")).otherwise(0.0) for _, s in views]
    rows = rows.select(F.col(label).cast("string").alias("__y"), F.array(*[F.coalesce(w, F.lit(0.0)) for w in plain]).alias("__w"), F.col(features).alias("__x"))
    if not isinstance(df.schema[features].dataType, VectorUDT):
        rows = rows.withColumn("__x", F.col("__x").cast("array<double>"))
    width = _width(rows, "__x")
    counts = rows.groupBy("__y").agg(*[F.sum(F.col("__w")[i]).alias(f"w{i}") for i in range(len(views))], *[F.count_if(F.col("__w")[i] > 0).alias(f"n{i}") for i in range(len(views))]).collect()  # a row for each label
    labels = sorted(r["__y"] for r in counts)
    by = {r["__y"]: r for r in counts}
    number = np.array([[by[c][f"n{i}"] for c in labels] for i in range(len(views))])
    weight = np.array([[by[c][f"w{i}"] for c in labels] for i in range(len(views))])
    if not labels or (number.sum(axis=1) == 0).any():
        raise ValueError("a model has no training rows")
    factor = np.ones_like(weight)
    for i, (_, s) in enumerate(views):
        if s.balanced:
            there = number[i] > 0
            factor[i, there] = number[i].sum() / (there.sum() * number[i, there])
    total = (weight * factor).sum(axis=1)
    code = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("__y")).cast("int") - 1
    times = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in factor])
    rows = settle(rows.select(code.alias("y"), F.zip_with("__w", times, lambda w, f: w * F.get(f, code)).alias("w"), "__x"))
    k, names = len(labels), list(specs)
    mask = number > 0
    descents = [_Descent(np.zeros((k, width + 1)), tolerance) for _ in names]
    used = [0] * len(names)
    for _ in range(max_scans):
        live = [i for i, d in enumerate(descents) if not d.done]
        if not live:
            break
        at = np.stack([descents[i].trial for i in live])
        seen = [place[names[i]] for i in live]
        losses, gradients = _scan(rows, width, k, seen, at, mask[seen])
        for j, i in enumerate(live):
            scale = 1.0 / total[seen[j]]
            ridge = scale / specs[names[i]].c
            b = at[j].copy()
            b[:, width] = 0.0
            used[i] += 1
            descents[i].take(losses[j] * scale + ridge * (b * b).sum() / 2, gradients[j] * scale + ridge * b)
    out = {}
    for i, name in enumerate(names):
        x = descents[i].x
        out[name] = Linear(labels, x[:, :width], np.where(mask[place[name]], x[:, width], -np.inf), float(np.abs(descents[i].g).max()), used[i])
    return out


def predict(models: Sequence[Linear], df: DataFrame, features: str = "features", which: Column | None = None, name: str = "p") -> DataFrame:
    """Adds the probabilities of the model that ``which`` numbers (null: none), or of all models as an array of arrays; models have the same labels. Null features have none."""
    rows = df.withColumn("__which", F.lit(-1) if which is None else F.coalesce(which.cast("int"), F.lit(-2)))
    if not isinstance(df.schema[features].dataType, VectorUDT):
        rows = rows.withColumn(features, F.col(features).cast("array<double>"))
    sent = df.sparkSession.sparkContext.broadcast(list(models))
    every, at, kind = which is None, rows.columns.index(features), pa.list_(pa.float64())
    schema = StructType([*[f for f in rows.schema.fields if f.name != "__which"], StructField(name, ArrayType(ArrayType(DoubleType())) if every else ArrayType(DoubleType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for b in batches:
            wanted, there = b.column(b.num_columns - 1).to_numpy(), b.column(at).is_valid().to_numpy(zero_copy_only=False)
            width = models[0].coefficients.shape[1] if models else 0
            x, out = _read(b.column(at), width), [[] if every else None for _ in range(b.num_rows)]
            for i, m in enumerate(models):
                for low, high in x.parts():
                    rows = [r for r in range(low, high) if there[r] and wanted[r] in (-1, i)]
                    if rows:
                        p = _softmax(x.times(low, high, m.coefficients.T) + m.intercepts)
                        for r in rows:
                            if every:
                                out[r].append(p[r - low])
                            else:
                                out[r] = p[r - low]
            out = [None if not there[r] else o for r, o in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(kind) if every else kind)], names=names)

    return rows.mapInArrow(run, schema)
