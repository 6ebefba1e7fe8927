import os
import signal
import subprocess
import sys
import textwrap
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.sources import buckets, calls

ROOT = str(Path(__file__).resolve().parent.parent)


def counting(folder):
    """A client that leaves a file for each call, and takes a little while."""

    def call(prompt):
        (Path(folder) / f"{prompt}-{time.time_ns()}-{os.getpid()}").touch()
        time.sleep(0.02)
        if prompt == "p13":
            raise OSError("refused")
        return prompt.upper()

    return call


def todo(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("x").alias("raw"))


def test_a_run_that_is_killed_goes_on(spark, tmp_path):
    """The driver of a run of 200 rows is killed after some batches. The next run asks for the rest; no batch that was finished is asked again."""
    seen = tmp_path / "calls"
    seen.mkdir()
    script = f"""
    import sys
    sys.path[:0] = [{ROOT!r}, {ROOT + "/tests"!r}]
    from test_sinks import counting, todo
    from sieveline.session import get_session
    from sieveline.sources import calls
    spark = get_session("killed", cpus=2)
    calls.answer_in_batches(todo(spark, 200), {str(tmp_path / "run")!r}, counting({str(seen)!r}), rows=25, parallel=2, tries=1)
    """
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.Popen([sys.executable, "-c", textwrap.dedent(script)], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    until = time.time() + 120
    while len(list(seen.iterdir())) < 90 and time.time() < until and run.poll() is None:
        time.sleep(0.05)
    os.kill(run.pid, signal.SIGKILL)
    run.wait()
    time.sleep(3)  # its workers end with it
    before = Counter(p.name.split("-")[0] for p in seen.iterdir())
    assert 90 <= sum(before.values()) < 200
    kept = calls.answers(spark, str(tmp_path / "run"))
    finished = {r.item_id for r in kept.collect()}
    assert finished
    got = calls.answer_in_batches(todo(spark, 200), str(tmp_path / "run"), counting(seen), rows=25, parallel=2, tries=1).collect()
    assert sorted(r.item_id for r in got) == sorted(str(i) for i in range(200))
    assert all(r.raw == f"P{r.item_id}" for r in got if r.item_id != "13") and next(r for r in got if r.item_id == "13").raw is None
    after = Counter(p.name.split("-")[0] for p in seen.iterdir())
    twice = {k for k, n in after.items() if n > 1}
    assert all(n <= 2 for n in after.values()) and len(twice) <= 60  # one batch
    assert not twice & {f"p{i}" for i in finished}
    # a third run asks for nothing
    assert calls.answer_in_batches(todo(spark, 200), str(tmp_path / "run"), counting(seen), rows=25).count() == 200
    assert sum(Counter(p.name.split("-")[0] for p in seen.iterdir()).values()) == sum(after.values())


def test_budget_is_held_between_batches(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    path, price = str(tmp_path / "run"), F.char_length("raw") * 0 + F.lit(1.0)
    with pytest.raises(calls.BudgetSpent):
        calls.answer_in_batches(todo(spark, 60), path, counting(seen), rows=15, cost=price, budget=20.0, parallel=2, tries=1)
    done = calls.answers(spark, path)
    spent = done.agg(F.sum("cost")).first()[0]
    assert 20 <= spent < 60 and done.count() == len(list(seen.iterdir()))
    assert calls.answer_in_batches(todo(spark, 60), path, counting(seen), rows=15, cost=price, budget=1000.0, parallel=2, tries=1).count() == 60
    assert len(list(seen.iterdir())) == 60


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_one_edit_writes_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"), F.lit("a").alias("__w"))
    assert buckets.create(df.unionByName(df.limit(3)), path, "id", 8) == 1
    first = buckets.read(spark, path)
    was = rows_of(df)
    assert rows_of(first) == was
    one = buckets.manifest(spark, path)
    assert buckets.edit(spark, path, 42, {"v": 99}) == 2
    two = buckets.manifest(spark, path)
    assert sum(one["folders"][b] != two["folders"][b] for b in one["folders"]) == 1 and one["folders"].keys() == two["folders"].keys()
    assert rows_of(buckets.read(spark, path)) == [(i, 99 if i == 42 else v, w) for i, v, w in was]
    # who began with the first version still reads it, and so does who asks for it
    assert rows_of(first) == rows_of(buckets.read(spark, path, 1)) == was
    # keys that are new, repeated and null; columns in another order
    new = spark.createDataFrame([("b", 1000, 5), ("c", 1000, 6), ("d", 42, 1), ("e", None, 3)], "__w string, id long, v long")
    assert buckets.upsert(new, path, ["v"]) == 3
    assert rows_of(buckets.read(spark, path)) == sorted([(i, v, w) for i, v, w in was if i != 42] + [(42, 1, "d"), (1000, 6, "c")])
    assert buckets.upsert(new.where("false"), path) == 3
    gone = buckets.vacuum(spark, path, keep=1)
    assert gone >= 1 and buckets.versions(spark, path) == [3] and buckets.read(spark, path).count() == 501
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, path, 1)


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two writers that began with the same version one is told, and the table is as the other left it."""
    path = str(tmp_path / "t")
    buckets.create(spark.range(50).withColumn("v", F.lit(0)), path, "id", 4)
    old = buckets.manifest(spark, path)
    buckets.upsert(spark.createDataFrame([(1, 1)], "id long, v int"), path)
    monkeypatch.setattr(buckets, "manifest", lambda *a: old)
    with pytest.raises(buckets.Conflict):
        buckets.upsert(spark.createDataFrame([(1, 2)], "id long, v int"), path)
    monkeypatch.undo()
    assert buckets.read(spark, path).where("id = 1").first().v == 1 and buckets.versions(spark, path) == [1, 2]


def test_empty_bucket_table(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(spark.createDataFrame([], "id long, v int"), path, "id")
    assert buckets.read(spark, path).collect() == []
    buckets.upsert(spark.createDataFrame([(1, 2)], "id long, v int"), path)
    assert rows_of(buckets.read(spark, path)) == [(1, 2)]


@pytest.mark.parametrize("batch,parts", [(1, 1), (7, 4), (64, 2)])
def test_encoders_in_one_pass(spark, batch, parts):
    """Any batch size and partitioning gives the rows of the model itself; two encoders, fused."""
    texts = [None, "", "a", *[f"text {i} " * (i % 5) for i in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(parts)
    models = {"small": (calls.hashing_encoder(8), 8), "large": (calls.hashing_encoder(20, 7), 20)}
    got = {r.i: r for r in calls.embed(df, models, "i", "t", batch, fuse=True).collect()}
    assert len(got) == len(texts)
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].small is None and got[i].large is None and got[i].fused is None
            continue
        want = {n: make()(np.array([t], dtype=object))[0] for n, (make, _) in models.items()}
        assert all(np.array_equal(np.float32(got[i][n]), want[n]) for n in models)
        assert np.allclose(got[i].fused, np.concatenate([unit(want[n].astype(float)) for n in models]), atol=1e-6)


def test_encoder_of_another_width(spark):
    df = spark.createDataFrame([(1, "a")], "i long, t string")
    with pytest.raises(Exception, match="width 3"):
        calls.embed(df, {"e": (calls.hashing_encoder(2), 3)}, "i", "t").collect()
