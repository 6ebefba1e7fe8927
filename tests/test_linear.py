import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sieveline.operators import features, heads, linear
from sieveline.operators.evaluation import business_metrics
from sieveline.schemas import ALL_LABELS

DENSE = StructType([StructField(n, t) for n, t in (("i", LongType()), ("l", StringType()), ("features", VectorUDT()), ("w", DoubleType()))])


def some_rows(n=240, width=5, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x = [rnd.gauss(math.cos(j + i % 3), 1.0) if rnd.random() < 0.6 else 0.0 for j in range(width)]
        out.append((i, "bac"[i % 3], x, [1.0, 0.5, 2.0, 0.0][i % 4]))
    return out


def frame(spark, rows, kind):
    if kind == "array":
        return spark.createDataFrame(rows, "i long, l string, features array<double>, w double").repartition(3)
    pack = {"dense": lambda x: Vectors.dense(x), "sparse": lambda x: Vectors.sparse(len(x), [(j, v) for j, v in enumerate(x) if v])}
    made = [(i, l, pack[kind if kind != "mixed" else ("dense", "sparse")[i % 2]](x), w) for i, l, x, w in rows]
    return spark.createDataFrame(made, DENSE).repartition(3)


def objective(model, rows, spec_c, weight):
    """|b|^2 / 2 + C * loss and its gradient, over the whole, by definition."""
    x, y = np.array([r[2] for r in rows]), np.array([model.labels.index(r[1]) for r in rows])
    w = np.array([weight(r) for r in rows])
    p = model.probabilities(x)
    loss = (model.coefficients**2).sum() / 2 + spec_c * -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    p[np.arange(len(y)), y] -= 1
    return loss, model.coefficients + spec_c * (p * w[:, None]).T @ x, spec_c * (p * w[:, None]).sum(axis=0)


SPECS = {"one": (1.0, False), "strong": (0.05, False), "weak": (50.0, False), "balanced": (1.0, True), "fold": (1.0, False)}


def specs():
    w = F.col("w")
    return {"one": linear.Spec(1.0, w), "strong": linear.Spec(0.05, w), "weak": linear.Spec(50.0, w), "balanced": linear.Spec(1.0, w, balanced=True), "fold": linear.Spec(1.0, w, F.col("i") % 5 != 0)}


@pytest.mark.parametrize("kind", ["array", "dense", "sparse", "mixed"])
def test_every_model_is_at_its_optimum(spark, kind):
    rows = [r for r in some_rows() if r[0] % 7]
    models = linear.fit_many(frame(spark, rows, kind), "l", specs(), tolerance=1e-8)
    used = [r for r in rows if r[3] > 0]
    n = {c: sum(r[1] == c for r in used) for c in "abc"}
    for name, (c, balanced) in SPECS.items():
        weight = lambda r: (r[3] * len(used) / (3 * n[r[1]]) if balanced else r[3]) * (name != "fold" or r[0] % 5 != 0)  # noqa: E731, B023
        _, g, g0 = objective(models[name], rows, c, weight)
        total = sum(weight(r) for r in rows)
        assert models[name].labels == ["a", "b", "c"]
        assert max(np.abs(g).max(), np.abs(g0).max()) / (c * total) < 1e-6, name
    assert not np.allclose(models["one"].coefficients, models["fold"].coefficients, atol=1e-3)


def test_equals_single_heads(spark):
    """Probabilities as by the head fitted alone, which stops a little before its optimum; the objective is not above its own by more than 1e-6 of it."""
    rows = some_rows()
    df = frame(spark, rows, "dense")
    for c in (0.3, 3.0):
        many = linear.fit_many(df, "l", {"x": linear.Spec(c, F.col("w"))}, tolerance=1e-9)["x"]
        alone = heads.fit(df, "l", head=heads.Head(c=c, max_iter=1000), weight="w").stages[-1]
        other = linear.Linear(many.labels, alone.coefficientMatrix.toArray(), alone.interceptVector.toArray())
        mine, theirs = (objective(m, rows, c, lambda r: r[3])[0] for m in (many, other))
        assert mine <= theirs * (1 + 1e-9) and abs(mine - theirs) / theirs < 1e-6
        x = np.array([r[2] for r in rows])
        assert np.abs(many.probabilities(x) - other.probabilities(x)).max() < 5e-3


def test_scans_do_not_grow_with_the_grid(spark):
    rows = frame(spark, some_rows(), "array")
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        spark.sparkContext.setJobGroup(f"grid-{n}", "")
        models = linear.fit_many(rows, "l", {str(i): linear.Spec(1.0 + i / 100, F.col("w")) for i in range(n)})
        spark.sparkContext.setJobGroup(None, None)
        return len(tracker.getJobIdsForGroup(f"grid-{n}")), max(m.scans for m in models.values())

    (few, scans), (many, more) = jobs(1), jobs(12)
    assert many <= few + 6 * max(0, more - scans) + 6


def test_predictions_and_saved_models(spark, tmp_path):
    rows = some_rows(60)
    df = frame(spark, rows, "mixed")
    models = linear.fit_many(df, "l", {"a": linear.Spec(1.0), "b": linear.Spec(0.01)})
    both = [models["a"], models["b"]]
    x = np.array([r[2] for r in rows])
    want = [m.probabilities(x) for m in both]
    every = {r.i: np.array(r.p) for r in linear.predict(both, df).collect()}
    assert all(np.allclose(every[r[0]], [want[0][j], want[1][j]]) for j, r in enumerate(rows))
    picked = {r.i: r.q for r in linear.predict(both, df, which=F.when(F.col("i") % 3 < 2, F.col("i") % 3), name="q").collect()}
    assert all(picked[r[0]] is None if r[0] % 3 == 2 else np.allclose(picked[r[0]], want[r[0] % 3][j]) for j, r in enumerate(rows))
    models["a"].save(spark, str(tmp_path / "m"))
    again = linear.Linear.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.coefficients, models["a"].coefficients) and again.labels == ["a", "b", "c"]


def test_odd_tables(spark):
    schema = "l string, features array<double>, f string"
    rows = [("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "x"), ("c", [5.0, 5.0], "y"), (None, [1.0, 1.0], "x"), ("a", None, "x"), ("a", [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, schema)
    m = linear.fit_many(df, "l", {"x": linear.Spec(1.0, where=F.col("f") == "x")})["x"]
    assert m.labels == ["a", "b", "c"] and m.intercepts[2] == -np.inf
    p = linear.predict([m], spark.createDataFrame([([1.0, 0.0],), (None,)], "features array<double>"), which=F.lit(0)).collect()
    assert p[0].p[2] == 0.0 and abs(sum(p[0].p) - 1) < 1e-12 and p[1].p is None
    with pytest.raises(ValueError, match="training rows"):
        linear.fit_many(df, "l", {"x": linear.Spec(1.0, where=F.lit(False))})


def test_grid_and_folds(spark):
    rnd = random.Random(5)
    rows = [(k, k // 2, ALL_LABELS[k % 6], [3 * math.cos(k % 6) + rnd.gauss(0, 0.3), 3 * math.sin(k % 6) + rnd.gauss(0, 0.3)], "val" if k % 4 == 0 else "train") for k in range(240)]
    df = spark.createDataFrame(rows, "item_id int, user int, truth string, e array<double>, split string").withColumn("features", array_to_vector("e"))
    grid = {f"c{c}": heads.Head(c=c) for c in (0.1, 1.0, 10.0)} | {"balanced": heads.Head(balanced=True), "forest": heads.Head("forest", trees=3)}
    got = {r["head"]: r for r in heads.run_grid(df, grid, "truth", business_metrics).collect()}
    assert set(got) == set(grid) and all(r.CAR > 0.5 for r in got.values())
    folded = heads.out_of_fold(df, "user", "truth", k=4).collect()
    assert len(folded) == 240 and all(abs(sum(r.p) - 1) < 1e-9 for r in folded)
    one = [r for r in folded if r.fold == 2]
    model = linear.fit_many(df, "truth", {"x": linear.Spec(1.0, where=~F.col("item_id").isin([r.item_id for r in one]))})["x"]
    p = model.probabilities(np.array([r.e for r in one]))
    order = [model.labels.index(x) for x in ALL_LABELS]
    assert np.abs(p[:, order] - np.array([r.p for r in one])).max() < 1e-4


def test_scale_and_packed_vectors(spark):
    df = spark.createDataFrame([([1.0, 5.0, float(i)],) for i in range(11)] + [(None,)], "x array<float>")
    means, spread = features.population_scale(df, "x", 3)
    assert np.allclose(means, [1.0, 5.0, 5.0]) and np.allclose(spread, [1.0, 1.0, np.sqrt(10.0)])
    assert features.population_scale(df.where("x IS NULL"), "x", 2) == ([0.0, 0.0], [1.0, 1.0])
    weights = spark.createDataFrame([(1, 3, 0.5), (1, 0, 2.0)], "k int, idx int, weight double")
    got = features.tfidf_vectors(spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string"), weights, "k", 5)
    assert {r.k: list(r.v) for r in got.select("k", vector_to_array("tfidf").alias("v")).collect()} == {1: [2.0, 0.0, 0.0, 0.5, 0.0], 2: [0.0] * 5}
