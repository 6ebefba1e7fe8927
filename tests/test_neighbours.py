import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import neighbours
from sieveline.storage import read


def brute(queries, rows, k, skip_self=True):
    unit = lambda v: np.array(v, dtype=float) / (np.linalg.norm(v) or 1.0)
    out = []
    for q, v in dict(queries).items():
        if v is None:
            continue
        have = [(-round(float(unit(v) @ unit(x)), 12) + 0.0, i) for i, x in rows if x is not None and not (skip_self and i == q)]
        out += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(sorted(have)[:k], 1)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.neighbour_id, r.similarity + 0.0, r["rank"]) for r in df.collect())


def assert_same(got, want):
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
    assert np.allclose([s for _, _, s, _ in got], [s for _, _, s, _ in want], atol=1e-9)


def some_rows(seed, n=400, dim=6, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = [(int(i), [float(x) for x in centres[i % clusters] + rng.normal(scale=0.15, size=dim)]) for i in range(n)]
    # ties: the same direction at other lengths, repeated ids, zeros, and rows without a vector
    rows += [(1000 + i, [3 * x for x in rows[i][1]]) for i in range(30)] + [rows[5], rows[5]]
    return rows + [(2000, [0.0] * dim), (2001, [0.0] * dim), (2002, None), (2003, [-x for x in rows[0][1]])]


@pytest.mark.parametrize("block,k", [(7, 5), (50, 1), (4096, 12)])
def test_equals_brute_force(spark, block, k, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 20)  # queries are salted
    rows = some_rows(block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = [r for r in rows if r[0] % 5 == 0 or r[0] >= 2000]
    q = spark.createDataFrame(queries, "vec_id long, embedding array<double>")
    assert_same(result(neighbours.nearest(q, df, k, block=block)), brute(queries, rows, k))
    others = [(5000 + i, [float(x) for x in np.random.default_rng(i).normal(size=6)]) for i in range(20)]
    q = spark.createDataFrame(others, "vec_id long, embedding array<double>")
    assert_same(result(neighbours.nearest(q, df, k, block=block, skip_self=False)), brute(others, rows, k, False))


def test_pairs_are_skipped(spark):
    """Among rows in clusters most cells can't have a query's neighbours."""
    rows = some_rows(1, 3000, 8, 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.build(df, block=100)
    share = neighbours.share_compared(df.where("vec_id % 20 = 0 AND vec_id < 2000"), index, 5)
    assert share < 0.25, share


def test_given_embeddings(spark, sf):
    e = read(spark, sf, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    assert_same(result(neighbours.nearest(e.where("vec_id % 20 = 0"), e, 7, block=64)), brute(queries, rows, 7))


def test_small_tables(spark):
    schema = "vec_id long, embedding array<double>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0, 0.0])], schema)
    assert neighbours.nearest(one, none, 3).collect() == [] and neighbours.nearest(none, one, 3).collect() == []
    assert neighbours.nearest(one, one, 3).collect() == []
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], schema)
    assert result(neighbours.nearest(zeros, zeros, 3)) == [(1, 2, 0.0, 1), (2, 1, 0.0, 1)]
    assert result(neighbours.nearest(zeros.where(F.col("vec_id") == 1), zeros.unionByName(one.withColumn("vec_id", F.lit(3).cast("long"))), 3)) == [(1, 2, 0.0, 1), (1, 3, 0.0, 2)]
