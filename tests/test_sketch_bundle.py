import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import bundle, linear
from sieveline.schemas import ABSTAIN, ALL_LABELS
from sieveline.streaming import monitor, sketch

QS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def events(spark, values):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=7 * i), v) for i, v in enumerate(values)], "ts timestamp, value double")


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_error_is_bounded(spark, error):
    rnd = random.Random(3)
    values = [rnd.choice([1, 1, -1]) * 10 ** rnd.uniform(-4, 6) for _ in range(2500)] + [0.0] * 40 + [None, float("nan"), float("inf"), 1e-300, 1e300]
    rnd.shuffle(values)
    df = events(spark, values)
    got = {r.window_start: r for r in sketch.quantiles(sketch.merged(sketch.sketch(df, "1 hour", error), "2 days"), QS, error).collect()}
    clean = df.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    by = {}
    for r in clean.select(F.window("ts", "2 days").start.alias("w"), "value").collect():
        by.setdefault(r.w, []).append(r.value)
    assert set(got) == set(by)
    for w, xs in by.items():
        xs = sorted(xs)
        for name, q in QS.items():
            at = q * (len(xs) - 1)
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            true = low + (high - low) * (at - math.floor(at))
            assert abs(got[w][name] - true) <= error * max(abs(low), abs(high)) * (1 + 1e-9) + 1e-6, (name, true, got[w][name])


def test_merging_loses_nothing(spark):
    df = events(spark, [math.exp(i % 17) for i in range(500)])
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(sketch.merged(sketch.merged(sketch.sketch(df, "10 minutes"), "1 hour"), "1 day")) == key(sketch.sketch(df, "1 day"))
    half = F.minute("ts") % 2 == 0
    apart = sketch.sketch(df.where(half), "1 day").unionByName(sketch.sketch(df.where(~half), "1 day"))
    assert key(sketch.merged(apart, "1 day")) == key(sketch.sketch(df, "1 day"))
    assert sketch.quantiles(sketch.sketch(df.where("false"), "1 day"), QS).collect() == []
    with pytest.raises(ValueError):
        sketch.sketch(df, "1 day", 0.0)


def test_close_to_the_exact_quantiles(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    exact = {r.window_start: r.p90 for r in monitor.exact_quantiles(e, "1 day", {"p90": 0.9}).collect()}
    got = {r.window_start: r.p90 for r in sketch.quantiles(sketch.sketch(e, "1 day", 0.01), {"p90": 0.9}, 0.01).collect()}
    assert exact.keys() == got.keys() and all(abs(got[w] - x) <= 0.011 * x + 0.2 for w, x in exact.items())


def some_items(n=60):
    rnd = random.Random(2)
    words = {"SLR": "zenit mirror", "TLR": "lubitel twin", ABSTAIN: "box case"}
    out = []
    for i in range(n):
        label = list(words)[i % 3]
        out.append((i, words[label].split()[i % 2], " ".join(rnd.choice([*words[label].split(), "film", "old"]) for _ in range(6)), [rnd.gauss(i % 3, 0.4), 1.0, float(i % 3)], label))
    return out


SCHEMA = "item_id long, title string, description string, e array<double>, truth string"


@pytest.mark.parametrize("scale", ["l2", "standard", "none"])
def test_a_loaded_bundle_answers_as_the_fitted_one(spark, tmp_path, scale):
    rows = spark.createDataFrame(some_items(), SCHEMA)
    made = bundle.fit(rows, "truth", "item_id", [bundle.Block("e", 3, scale, 0.5)], spec=linear.Spec(c=5.0), tau=0.4, min_df=2)
    bundle.save(made, spark, str(tmp_path / "b"))
    loaded = bundle.load(spark, str(tmp_path / "b"))
    assert loaded.width == made.width == made.vocabulary.count() + 3 and loaded.head.coefficients.shape == (3, made.width)
    a, b = ({r.item_id: r for r in bundle.score(rows, x, "item_id").collect()} for x in (made, loaded))
    assert len(a) == 60 and all(a[i].value == b[i].value and abs(a[i].confidence - b[i].confidence) < 1e-12 for i in a)
    assert sum(a[r[0]].value == r[4] for r in some_items()) >= 55
    for r in a.values():
        assert set(r.probabilities) == set(ALL_LABELS) and abs(sum(r.probabilities.values()) - 1) < 1e-9 and (r.decision == "abstain") == (r.value == ABSTAIN)
        assert np.isclose(r.confidence, max(r.probabilities.values()))


def test_rows_that_lack_something(spark):
    made = bundle.fit(spark.createDataFrame(some_items(), SCHEMA), "truth", "item_id", [bundle.Block("e", 3)], tau=0.0, min_df=2)
    odd = [(1, None, None, [0.0, 1.0, 0.0], None), (2, "zenit", "mirror", None, None), (3, "", "", [1.0, 2.0], None), (4, "never seen", "中文", [0.0, 0.0, 0.0], None), (5, "zenit", None, [1.0, None, 2.0], None)]
    got = {r.item_id: r for r in bundle.score(spark.createDataFrame(odd, SCHEMA), made, "item_id").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert all((got[i].value, got[i].decision, got[i].reason, got[i].confidence) == (ABSTAIN, "abstain", "input_unavailable", 0.0) for i in (2, 3, 5))
    assert got[1].confidence > 0 and got[4].confidence > 0
    assert bundle.score(spark.createDataFrame([], SCHEMA), made, "item_id").collect() == []
