"""Sampling, splits, joins, profiles, streams, files, features and heads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.operators import features, heads, joins, neighbours, profiling, sampling, splitting
from sieveline.schemas import ALL_LABELS, ITEMS
from sieveline.sources import calls, files
from sieveline.storage import fits_broadcast, join_small, read
from sieveline.streaming import monitor


def test_quota_sample(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(600)] + [(1000, None), (1001, "d")], "k int, s string")
    got = sampling.quota_sample(df, "s", "k", {"a": 10, "b": 500, "d": 2})
    assert Counter(r.s for r in got.collect()) == {"a": 10, "b": 200, "d": 1}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.quota_sample(df.repartition(9), "s", "k", {"a": 10, "b": 500, "d": 2}).collect()))


def test_holdout(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i else None) for i in range(101)], "k int, s string")
    got = sampling.stratified_holdout(df, "s", "k", 0.3).collect()
    assert Counter((r.s, r.is_holdout) for r in got) == {("a", True): 15, ("a", False): 35, ("b", True): 15, ("b", False): 35, (None, False): 1}


def test_keep_and_upsert(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 5, None), (2, 1, "z"), (1, 4, "y")], "k int, o int, v string")
    assert {tuple(r) for r in sampling.keep_last(df, "k", ["o"]).collect()} == {(1, 5, None), (2, 1, "z")}
    assert {tuple(r) for r in sampling.keep_first(df, "k", ["o"]).collect()} == {(1, 3, "x"), (2, 1, "z")}
    new = spark.createDataFrame([(2, 9, "n"), (3, 1, "m")], "k int, o int, v string")
    assert Counter(r.k for r in sampling.upsert(df, new, "k").collect()) == {1: 3, 2: 1, 3: 1}


def test_budget(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 9)) for i in range(2000)]
    got = sampling.budget_prefix(spark.createDataFrame(rows, "k int, c long"), ["k"], F.col("c"), 500, cells=16).orderBy("k").collect()
    running, want = 0, []
    for k, c in rows:
        if running > 500:
            break
        running += c
        want.append((k, running))
    assert [(r.k, r.running) for r in got] == want


def test_groups_and_parts(spark):
    rng = random.Random(2)
    rows = [(i, f"u{rng.randrange(300)}" if i % 7 else None, f"t{rng.randrange(900)}", rng.choices(ALL_LABELS, [40, 2, 20, 20, 10, 30])[0], i % 97 == 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, u string, t string, l string, audit boolean")
    groups = splitting.leakage_groups(df, "k", ["u", "t"])
    named = df.join(groups, "k")
    feats = splitting.group_features(named, "leakage_group_id", "l", ["audit"])
    parts = splitting.assign_parts(feats, "leakage_group_id", "TLR", ["audit"])
    out = named.join(parts, "leakage_group_id")
    assert out.count() == 1500
    assert joins.overlaps(out, "split", ["u", "t"]).count() == 0
    assert {r.split for r in out.where("audit").select("split").distinct().collect()} == {"test"}
    small = spark.createDataFrame([(i, "ab"[i % 2] if i % 9 else "TLR") for i in range(4000)], "g int, l string")
    feats = splitting.group_features(small, "g", "l", labels=["a", "b", "TLR"])
    got = splitting.assign_parts(feats, "g", "TLR", labels=["a", "b", "TLR"])
    share = Counter(r.split for r in got.collect())
    assert abs(share["train"] / 4000 - 0.7) < 0.03 and abs(share["val"] / 4000 - 0.15) < 0.03


def test_parts_of_uneven_groups(spark):
    """Labels stay balanced whatever the sizes of groups: one very large, some large, many small."""
    rng = random.Random(7)
    sizes = [900, *[rng.randrange(60, 120) for _ in range(12)], *[rng.randrange(1, 9) for _ in range(900)]]
    rows = [(g, rng.choices("abc", [6, 3, 1])[0]) for g, n in enumerate(sizes) for _ in range(n)]
    labels = ["a", "b", "c"]
    feats = splitting.group_features(spark.createDataFrame(rows, "g int, l string"), "g", "l", labels=labels)
    got = {r.g: r.split for r in splitting.assign_parts(feats, "g", "c", labels=labels).collect()}
    again = {r.g: r.split for r in splitting.assign_parts(feats.repartition(5), "g", "c", labels=labels).collect()}
    assert got == again and set(got) == {g for g, _ in rows}
    every, total = Counter(x for _, x in rows), Counter((got[g], x) for g, x in rows)
    for split, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        for x in labels:
            assert abs(total[split, x] / every[x] - share) < 0.04, (split, x, total[split, x] / every[x])
    small = sorted((n, g) for g, n in enumerate(sizes) if any(r == (g, "c") for r in rows))
    assert got[small[0][1]] == "val" and total["val", "c"] >= 30


def test_folds(spark):
    df = spark.createDataFrame([(i % 200, "ab"[i % 200 % 2]) for i in range(1000)], "g int, l string")
    got = splitting.folds(df, "g", "l", 5).collect()
    assert len(got) == 200 and Counter((r.g % 2, r.fold) for r in got) == {(a, f): 20 for a in (0, 1) for f in range(5)}


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    twice = a.unionByName(a)
    with pytest.raises(ValueError, match="right"):
        joins.one_to_one(a, twice.withColumnRenamed("v", "w"), "k")
    assert joins.one_to_one(a, a.withColumnRenamed("v", "w"), "k").count() == 2
    with pytest.raises(ValueError):
        joins.same_rows(a, twice)
    table = spark.createDataFrame([("x", 3)], "key string, value int")
    assert {r.k: r.n for r in joins.lookup(a, table, "v", "n", 0).collect()} == {1: 3, 2: 0}
    assert fits_broadcast(a) and not fits_broadcast(a, rows=1) and not fits_broadcast(a, size=5)
    assert join_small(a, table.withColumnRenamed("key", "v"), ["v"]).count() == 2


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", " "), (2, None, "b"), (2, "a", None)], "k int, x string, y string")
    assert {r.column_name: r.n_null for r in profiling.null_profile(df).collect()} == {"k": 0, "x": 1, "y": 1}
    assert {r.column_name: r.n_blank for r in profiling.blank_profile(df).collect()} == {"x": 1, "y": 2}
    assert tuple(profiling.duplicate_profile(df, "k").first()) == (2, 1, 2, 2, round(2 / 3, 9))
    assert tuple(profiling.duplicate_profile(df.where("false"), "k").first()) == (0, 0, 0, 0, None)
    assert {tuple(r) for r in profiling.domain_violations(df, {"x": ["b"]}).collect()} == {("x", "a", 2)}


def test_neighbours_in_blocks(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0")
    one = sorted(map(tuple, neighbours.nearest(q, e.repartition(5), 7).collect()))
    assert one == sorted(map(tuple, neighbours.nearest(q, e, 7, block=3).collect())) and len(one) == 7 * q.count()


def test_stream_has_the_rows_of_the_table(spark, sf, tmp_path):
    events = read(spark, sf, "events")
    src = tmp_path / "in"
    events.repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    run = monitor.write_rates(stream, str(tmp_path / "out"), str(tmp_path / "check"), "1 hour", 3600)
    run.awaitTermination(120)
    got = {(str(r.window_start), r.event_type, r.n) for r in spark.read.schema("window_start timestamp, event_type string, n long, per_second double").parquet(str(tmp_path / "out")).select(F.col("window_start").cast("string"), "event_type", "n").collect()}
    want = {(str(r.window_start), r.event_type, r.n) for r in monitor.rates(events, "1 hour", 3600).select(F.col("window_start").cast("string"), "event_type", "n").collect()}
    # windows that the watermark hasn't passed are still open
    assert got <= want and len(got) > 0.9 * len(want)


def test_alert_runs_across_days(spark):
    on = [1, 1, 0, 1, 1, 1, 1, 1, 0, 0, 1]
    rows = [(f"2024-01-{1 + (20 + i) // 24:02d} {(20 + i) % 24:02d}:00:00", bool(x)) for i, x in enumerate(on)]
    df = spark.createDataFrame(rows, "t string, x boolean").select(F.to_timestamp("t").alias("window_start"), "x")
    got = sorted((str(r.run_start)[8:16], r.n_windows, r.alerted) for r in monitor.alert_runs(df, F.col("x"), 3).collect())
    assert got == [("01 20:00", 2, False), ("01 23:00", 5, True), ("02 06:00", 1, False)]


def test_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿item_id,user_id,microcat_name,title,description,image_id\n007,u,c,T,"two\nlines ""q""",5\n', encoding="utf-8")
    r = files.read_csv(spark, str(p), ITEMS).first()
    assert (r.item_id, r.description, r.image_id) == ("007", 'two\nlines "q"', 5)
    out = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(out)
    files.replace_parquet(spark.read.parquet(out).unionByName(spark.range(5, 6)), out)
    assert spark.read.parquet(out).count() == 4 and files.read_or_none(spark, out + "x") is None
    a, b = spark.range(50).withColumn("v", F.col("id") * 2), spark.range(50).repartition(7).withColumn("v", F.col("id") * 2)
    assert files.content_hash(a, "id", ["v"]).first() == files.content_hash(b, "id", ["v"]).first() != files.content_hash(a.where("id > 0"), "id", ["v"]).first()
    files.write_state(str(tmp_path / "s.json"), {"é": 1})
    assert files.read_state(str(tmp_path / "s.json"), {}) == {"é": 1} and files.read_state(str(tmp_path / "none"), 4) == 4
    files.log_run(spark, str(tmp_path / "runs"), "one", {"C": 1.0}, {"CAR": 0.5})
    files.log_run(spark, str(tmp_path / "runs"), "two", {"C": 2.0}, {"CAR": 0.6})
    wide = files.runs_wide(spark.read.parquet(str(tmp_path / "runs")), ["C"], ["CAR"])
    assert sorted((r.name, r.param_C, r.metric_CAR) for r in wide.collect()) == [("one", "1.0", 0.5), ("two", "2.0", 0.6)]
    assert files.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 | - |"


def test_images(spark, tmp_path):
    for i in (5, 1005):
        d = tmp_path / str(i % 1000)
        d.mkdir(exist_ok=True)
        (d / f"{i}.jpg").write_bytes(b"jpg%d" % i)
    got = files.images(spark, str(tmp_path))
    items = spark.createDataFrame([(5,), (1005,), (7,)], "image_id long")
    assert {r.image_id: r.image_error for r in files.with_images(items, got).collect()} == {5: None, 1005: None, 7: "image_not_found"}
    vectors = calls.embed(got, {"embedding": (lambda: lambda xs: [[len(x), 1.0] for x in xs], 2)})
    assert {r.image_id: list(r.embedding) for r in vectors.collect()} == {5: [4.0, 1.0], 1005: [7.0, 1.0]}


def test_calls(spark):
    tries = []

    def flaky(p):
        tries.append(p)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    waits = []
    assert calls.with_retries(flaky, "x", sleep=waits.append) == ("ok", None)
    assert len(waits) == 2 and 7 <= waits[0] <= 13 and 21 <= waits[1] <= 39
    todo = spark.createDataFrame([("a", "p1"), ("b", "p2")], "item_id string, prompt string")
    done = spark.createDataFrame([("a", True, True), ("b", True, False)], "item_id string, parsed_ok boolean, biz_ok boolean")
    assert [(r.item_id, r.raw) for r in calls.answer_rest(todo, done, lambda p: p + "!", parallel=2).collect()] == [("b", "p2!")]


def plain_ngrams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            out.append(w[:n])
            k = 0
            while k + n < len(w):
                k += 1
                out.append(w[k : k + n])
            if k == 0:
                break
    return Counter(out)


def test_ngrams(spark):
    values = ["a", "ab cde", "Hello, world", "", "  x  ", "ñandú éé"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    for r in df.select("i", features.char_ngrams(F.col("t")).alias("g")).collect():
        assert Counter(r.g) == plain_ngrams(values[r.i]), values[r.i]
    words = {r.i: r.g for r in df.select("i", features.word_ngrams(F.col("t")).alias("g")).collect()}
    assert words[1] == ["ab", "cde", "ab cde"] and words[0] == [] and words[2] == ["hello", "world", "hello world"]


def test_tfidf_vectors(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa"), (3, "zz")], "k int, t string")
    counts = features.term_counts(df, "k", features.word_ngrams(F.col("t"), 1, 1))
    vocab = features.vocabulary(counts, 3, min_df=1)
    rows = features.tfidf_vectors(df, features.tfidf(counts, vocab, "k"), "k", vocab.count()).orderBy("k").collect()
    assert all(abs(r.tfidf.norm(2) - 1) < 1e-9 for r in rows) and rows[1].tfidf.indices.tolist() == [0]


def test_logreg_is_at_its_optimum(spark):
    """The gradient of |b|^2 / 2 + C * weighted loss is zero."""
    import numpy as np

    rng = random.Random(3)
    rows = [(["SLR", "TLR", "instant"][k % 3], [rng.gauss(k % 3, 1), rng.gauss(-(k % 3), 1)], 1.0 + k % 2) for k in range(150)]
    df = spark.createDataFrame(rows, "l string, e array<double>, w double")
    df = features.assembler(["e_block"]).transform(features.with_block(df, df, "e", 2, "none"))
    model = heads.fit(df, "l", head=heads.Head(c=3.0, max_iter=500), weight="w")
    lr = model.stages[-1]
    b, a = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    x, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    y = np.array([heads.classes(model).index(r[0]) for r in rows])
    z = x @ b.T + a
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    assert np.abs(b + 3.0 * (p * w[:, None]).T @ x).max() < 0.05
    scored = heads.probabilities(model, df)
    assert scored.where("abs(aggregate(p, 0D, (s, v) -> s + v) - 1) > 1e-9").count() == 0


def test_heads_and_grid(spark):
    rng = random.Random(5)
    rows = [(k, ALL_LABELS[k % 6], [3 * math.cos(k % 6) + rng.gauss(0, 0.3), 3 * math.sin(k % 6) + rng.gauss(0, 0.3)], "val" if k % 4 == 0 else "train") for k in range(240)]
    df = spark.createDataFrame(rows, "item_id int, truth string, e array<double>, split string")
    df = features.assembler(["e_block"]).transform(features.with_block(df, df.where("split = 'train'"), "e", 2, "standard"))
    from sieveline.operators.evaluation import business_metrics, contract_violations

    grid = {"lr": heads.Head(max_iter=30), "rf": heads.Head("forest", trees=5), "gbt": heads.Head("boosted", trees=2, depth=2), "bal": heads.Head(balanced=True, max_iter=20)}
    got = {r["head"]: r for r in heads.run_grid(df, grid, "truth", business_metrics).collect()}
    assert set(got) == set(grid) and got["lr"].CAR > 0.5
    model = heads.fit(df, "truth", head=grid["gbt"])
    r = contract_violations(heads.as_predictions(heads.probabilities(model, df))).first()
    assert all(v == 0 for k, v in r.asDict().items() if k != "n_rows")
    with pytest.raises(ValueError):
        features.with_block(df, df, "e", 3)
