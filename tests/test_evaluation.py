import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import evaluation as ev
from sieveline.operators import labelling, reports
from sieveline.schemas import ABSTAIN, ALL_LABELS, MAIN_SET, VALID_STATUS


def wilson(k, n):
    p, z2 = k / n, 1.96**2
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), 1.96 * math.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    return max(0, mid - half), min(1, mid + half)


def frame(spark, rows):
    return spark.createDataFrame(rows, "truth string, pred_label string, confidence double")


def test_published_counts(spark):
    rows = [("SLR", "SLR", 0.9)] * 157 + [("TLR", "SLR", 0.9)] * 4 + [("SLR", ABSTAIN, 0.1)] * 49
    r = ev.business_metrics(frame(spark, rows)).first()
    assert (r.N, r.A, r.C, r.W) == (210, 161, 157, 4)
    assert round(r.CAR, 4) == 0.7476 and round(r.AER, 4) == 0.0248 and round(r.AER_hi, 4) == 0.0621


@pytest.mark.parametrize("k, n", [(0, 10), (10, 10), (3, 7)])
def test_wilson(spark, k, n):
    r = ev.business_metrics(frame(spark, [("SLR", "SLR", 1.0)] * k + [("TLR", "SLR", 1.0)] * (n - k))).first()
    assert (r.CAR_lo, r.CAR_hi) == pytest.approx(wilson(k, n), abs=1e-9)
    assert r.CAR_lo <= k / n + 1e-9 and k / n <= r.CAR_hi + 1e-9


def test_nothing_filled(spark):
    r = ev.business_metrics(frame(spark, [("SLR", ABSTAIN, None)])).first()
    assert (r.A, r.AER, r.AER_hi, r.coverage) == (0, None, None, 0.0)
    r = ev.business_metrics(frame(spark, [])).first()
    assert (r.N, r.CAR, r.coverage) == (0, None, None)
    p = ev.operating_point(ev.threshold_sweep(frame(spark, [("SLR", ABSTAIN, None)]))).first()
    assert (p.tau, p.feasible) == (1.0, False)


def test_sweeps_against_counting(spark):
    rng = random.Random(4)
    rows = [(rng.choice(ALL_LABELS), rng.choice(ALL_LABELS), rng.choice([None, 0.0, 0.1, 0.3, 0.1 + 0.2, 0.57, 0.58, 1.0, rng.random()])) for _ in range(300)]
    df = frame(spark, rows)

    def at(tau):
        kept = [(t, p) for t, p, c in rows if p in MAIN_SET and (c or 0.0) >= tau]
        return len(kept), sum(t == p for t, p in kept)

    for curve in (ev.threshold_sweep(df), ev.exact_sweep(df)):
        got = curve.collect()
        assert {r.threshold: (r.A, r.C) for r in got} == {r.threshold: at(r.threshold) for r in got}
        assert all(r.N == len(rows) for r in got)
    assert {r.threshold for r in ev.threshold_sweep(df).collect()} == {i * 0.01 for i in range(101)}
    assert {r.threshold for r in ev.exact_sweep(df).collect()} == {c or 0.0 for *_, c in rows}
    for r in ev.class_curves(df).collect():
        mine = [(t, p) for t, p, c in rows if p == r.pred and c is not None and c >= r.threshold]
        assert (r.A, r.W) == (len(mine), sum(t != p for t, p in mine))


def test_ece_edges(spark):
    confs = [0.0, 0.1, 0.3, 0.1 + 0.2, 1.0, None, 1.5]
    rows = [("SLR" if i % 2 else "TLR", "SLR", c) for i, c in enumerate(confs)]
    edges = [i * 0.1 for i in range(1, 10)]
    bins = {}
    for t, p, c in rows:
        c = min(max(c or 0.0, 0), 1)
        bins.setdefault(sum(c > e for e in edges), []).append((c, t == p))
    want = sum(abs(sum(r for _, r in b) - sum(c for c, _ in b)) for b in bins.values()) / len(rows)
    got = ev.calibration(frame(spark, rows)).first()
    assert got.ece == pytest.approx(want, abs=1e-9) and got.n_auto == 7


def test_report_and_contract(spark):
    rows = [("SLR", "SLR", 1.0), ("TLR", "SLR", 1.0), ("TLR", "TLR", 1.0), ("instant", ABSTAIN, 1.0)]
    rep = {r.label: (r.precision, r.recall, r.f1, r.support) for r in ev.classification_report(frame(spark, rows)).collect()}
    assert rep["SLR"] == (0.5, 1.0, round(2 / 3, 9), 1) and rep["TLR"] == (1.0, 0.5, round(2 / 3, 9), 2) and rep["instant"] == (0, 0, 0, 1) and rep["compact_point_and_shoot"] == (0, 0, 0, 0)
    good = [(1, "SLR", 0.5, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]), (2, "TLR", 1.0, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    schema = "item_id int, pred_label string, confidence double, p array<double>"
    assert ev.require_contract(spark.createDataFrame(good, schema)).count() == 2
    bad = [*good, (2, "TLR", 0.5, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]), (3, "x", None, [0.1] * 6), (4, "SLR", 2.0, [float("nan")] + [0.0] * 5), (5, "SLR", 0.6, [0.5, 0.1, 0.1, 0.1, 0.1, 0.1])]
    r = ev.contract_violations(spark.createDataFrame(bad, schema)).first()
    assert (r.repeated_keys, r.bad_label, r.bad_confidence, r.bad_probability, r.bad_sum, r.bad_argmax, r.bad_max) == (1, 1, 2, 1, 1, 2, 2)
    with pytest.raises(ValueError, match="bad_label"):
        ev.require_contract(spark.createDataFrame(bad, schema))


def test_verdicts(spark):
    rows = [("SLR", "SLR", 1.0)] * 80 + [("SLR", ABSTAIN, 1.0)] * 20
    more = [("SLR", "SLR", 1.0)] * 90 + [("SLR", ABSTAIN, 1.0)] * 10
    base, up = frame(spark, rows), frame(spark, more)
    got = reports.compare({("base", "val"): base, ("base", "audit"): base, ("fit", "val"): up, ("fit", "audit"): base, ("good", "val"): up, ("good", "audit"): up})
    assert {r.scheme: r.verdict for r in reports.verdicts(got, "base", "val", "audit").collect()} == {"base": "no_change", "fit": "teacher_overfit", "good": "better"}


def test_priority_merge(spark):
    ids = spark.createDataFrame([(i,) for i in range(12)], "item_id int")
    gold = spark.createDataFrame([(0, "not_camera", None, ABSTAIN)], "item_id int, object_status string, body_type string, final_label string")
    kb = spark.createDataFrame([(i, "m", "SLR") for i in (0, 1, 2, 3, 4)], "item_id int, kb_model string, kb_label string")
    check = spark.createDataFrame([(1, VALID_STATUS, None, 0.99), (2, "not_camera", None, 0.85), (3, "not_camera", None, 0.849), (4, "not_camera", None, None)], "item_id int, pred_status string, pred_label string, confidence double")
    llm = spark.createDataFrame(
        [(5, VALID_STATUS, "TLR", "TLR", 0.7, True), (6, VALID_STATUS, "TLR", "TLR", 0.69, True), (7, VALID_STATUS, "TLR", "TLR", 0.9, False), (8, "digital_camera", None, ABSTAIN, 0.5, True), (9, VALID_STATUS, "TLR", "TLR", None, None)],
        "item_id int, pred_status string, pred_body string, pred_label string, confidence double, biz_ok boolean",
    )
    got = {r.item_id: (r.label_source, r.final_label, r.final_object_status, r.confidence, r.needs_review) for r in labelling.merge_sources(ids, gold, kb, llm, check).collect()}
    assert got[0] == ("human", ABSTAIN, "not_camera", 1.0, False)
    assert got[1] == got[3] == got[4] == ("kb", "SLR", VALID_STATUS, 1.0, False)
    assert got[2] == ("kb_overridden", ABSTAIN, "not_camera", 0.85, False)
    assert got[5] == ("llm", "TLR", VALID_STATUS, 0.7, False)
    assert got[6] == got[7] == got[9] == got[10] == ("abstain", ABSTAIN, "insufficient_info", 0.0, True)
    assert got[8] == ("abstain", ABSTAIN, "digital_camera", 0.0, True)
    without = labelling.merge_sources(ids, gold, kb, llm, None)
    assert {r.label_source for r in without.where("item_id IN (1, 2, 3, 4)").collect()} == {"kb"}


def test_answers(spark):
    ok = '{"object_status": "valid_single_film_camera", "body_type": "SLR", "final_label": "SLR", "confidence": 0.5}'
    rows = [
        ok,
        ok.replace('"body_type": "SLR"', '"body_type": null'),
        ok.replace('"final_label": "SLR"', '"final_label": "TLR"'),
        ok.replace("valid_single_film_camera", "not_camera"),
        '{"object_status": "not_camera", "body_type": null, "final_label": "SLR", "confidence": 0.5}',
        ok.replace("0.5", "1.2"),
        ok.replace('"final_label": "SLR"', '"final_label": "X"'),
        ok[:40],
        None,
        "[1]",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = [(r.parsed_ok, r.biz_ok, (r.biz_reason or "").split(":")[0], (r.error_msg or "").split(":")[0]) for r in df.select("i", labelling.parse_response(F.col("raw")).alias("r")).select("i", "r.*").orderBy("i").collect()]
    assert got[0] == (True, True, "", "")
    assert [g[2] for g in got[1:5]] == ["valid status without body type", "label differs from body type", "body type without valid status", "label without valid status"]
    assert [g[3] for g in got[5:]] == ["confidence", "final_label", got[7][3], "no answer", "not an answer"]
    assert not any(g[0] for g in got[5:])


def test_decisions(spark):
    df = spark.createDataFrame([("SLR", 0.5), ("SLR", 0.2), (ABSTAIN, 0.9), ("SLR", None)], "l string, c double")
    got = [tuple(r.d) for r in df.select(ev.decide(F.col("l"), F.col("c"), 0.3).alias("d")).collect()]
    assert [g[0] for g in got] == ["SLR", ABSTAIN, ABSTAIN, ABSTAIN] and [g[1] for g in got] == ["auto_fill"] + ["abstain"] * 3
    ways = spark.createDataFrame([("p", None), (None, "u"), (None, None)], "p string, u string")
    assert [r.w for r in ways.select(ev.route(F.col("p"), F.col("u")).alias("w")).collect()] == ["photo", "url", "photo_required"]
