"""Evaluation of predictions that may abstain.

A row is filled if its predicted label is one of the main set. CAR is rightly filled rows among all rows, AER wrongly
filled ones among the filled. Sums are taken per label or per cell of confidence first, so nothing here grows
with the table but the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions.stats import business, rounded, share, wilson
from sieveline.functions.vectors import rebias, top_label
from sieveline.schemas import ABSTAIN, AER_CAP, ALL_LABELS, MAIN_SET

GRID = 101


def with_abstention(pred: Column, confidence: Column, tau: Column | float) -> Column:
    """The label, or abstention below tau; no confidence counts as 0."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= tau, pred).otherwise(F.lit(ABSTAIN))


def class_thresholds(pred: Column, confidence: Column, tau: dict[str, float]) -> Column:
    """Abstention below the threshold of the predicted label; a label without one is kept."""
    of = F.lit(0.0)
    for label, t in tau.items():
        of = F.when(pred == label, F.lit(float(t))).otherwise(of)
    return with_abstention(pred, confidence, of)


def counts(truth: Column, pred: Column, main: Sequence[str] = MAIN_SET) -> dict[str, Column]:
    """Aggregates: all rows, filled rows, rightly filled rows."""
    auto = F.coalesce(pred.isin(list(main)), F.lit(False))
    right = auto & F.coalesce(pred == truth, F.lit(False))
    return {"n": F.count(F.lit(1)), "a": F.sum(auto.cast("long")), "c": F.sum(right.cast("long"))}


def _finished(df: DataFrame, keys: list[str]) -> DataFrame:
    n, a, c = (F.coalesce(F.col(x), F.lit(0)).cast("long") for x in ("n", "a", "c"))
    return df.select(*keys, *rounded(business(n, a, c)))


def business_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred_label", by: list[str] | None = None, main: Sequence[str] = MAIN_SET) -> DataFrame:
    """N, A, C, W, coverage, CAR and AER with bounds, in one row or one for each group."""
    agg = [v.alias(k) for k, v in counts(F.col(truth), F.col(pred), main).items()]
    return _finished(df.groupBy(*(by or [])).agg(*agg), by or [])


def _cell(conf: Column, n: int) -> Column:
    """Number of the last grid value ``i * step`` that isn't above conf."""
    step = 1.0 / (n - 1)
    i = F.floor(conf / step)
    return F.when((i + 1) * step <= conf, i + 1).when(i * step > conf, i - 1).otherwise(i).cast("int")


def threshold_sweep(df: DataFrame, truth: str = "truth", pred: str = "pred_label", conf: str = "confidence", n: int = GRID, main: Sequence[str] = MAIN_SET) -> DataFrame:
    """``threshold`` and the business metrics at each of n evenly spaced thresholds from 0 to 1.

    Rows are counted by the grid cell of their confidence; the sums above a threshold follow from the cells.
    """
    c = F.least(F.greatest(F.coalesce(F.col(conf), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    cells = df.groupBy(_cell(c, n).alias("i")).agg(*[v.alias(k) for k, v in counts(F.col(truth), F.col(pred), main).items()])
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    rows = grid.join(F.broadcast(cells), "i", "left").fillna(0, ["n", "a", "c"])
    above = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(F.lit(1))
    swept = rows.select((F.col("i") * (1.0 / (n - 1))).alias("threshold"), F.sum("n").over(whole).alias("n"), F.sum("a").over(above).alias("a"), F.sum("c").over(above).alias("c"))
    return _finished(swept, ["threshold"])


def exact_sweep(df: DataFrame, truth: str = "truth", pred: str = "pred_label", conf: str = "confidence", main: Sequence[str] = MAIN_SET, cells: int = 1024) -> DataFrame:
    """As ``threshold_sweep``, at each confidence that occurs.

    Sums run from above in two levels: over cells of confidence, and within each of them, so that no task
    orders all confidences.
    """
    c = F.coalesce(F.col(conf), F.lit(0.0))
    each = df.groupBy(c.alias("threshold")).agg(*[v.alias(k) for k, v in counts(F.col(truth), F.col(pred), main).items()])
    each = each.withColumn("cell", F.least(F.greatest(F.floor(F.col("threshold") * cells), F.lit(-1)), F.lit(cells)))
    sums = each.groupBy("cell").agg(*[F.sum(x).alias(f"s_{x}") for x in ("n", "a", "c")])
    higher = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("cell", F.sum("s_n").over(W.partitionBy(F.lit(1))).alias("all_n"), *[F.coalesce(F.sum(f"s_{x}").over(higher), F.lit(0)).alias(f"h_{x}") for x in ("a", "c")])
    here = W.partitionBy("cell").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    joined = each.join(F.broadcast(sums), "cell")  # cells + 2 rows at most
    swept = joined.select("threshold", F.col("all_n").alias("n"), *[(F.sum(x).over(here) + F.col(f"h_{x}")).alias(x) for x in ("a", "c")])
    return _finished(swept, ["threshold"])


def operating_point(curve: DataFrame, cap: float = AER_CAP, use_bound: bool = True) -> DataFrame:
    """The threshold of greatest CAR with AER (or its upper bound) within the cap, the lowest of equal ones.

    Where AER has no value it counts as 1. If no threshold will do, tau is 1 and feasible is false.
    """
    return _best(curve, [F.desc("CAR"), F.asc("threshold")], cap, use_bound)


def operating_point_tiebreak(curve: DataFrame, cap: float = AER_CAP) -> DataFrame:
    """The threshold of most right fills within the cap; then fewest wrong ones, then the least upper bound, then the lowest."""
    return _best(curve, [F.desc("C"), F.asc("W"), F.asc("AER_hi"), F.asc("threshold")], cap, True)


def _best(curve: DataFrame, order: list[Column], cap: float, use_bound: bool) -> DataFrame:
    limit = F.coalesce(F.col("AER_hi" if use_bound else "AER"), F.lit(1.0)) <= cap
    best = curve.where(limit).orderBy(*order).limit(1)
    one = curve.sparkSession.range(1).select(F.lit(1).alias("one"))
    found = one.join(F.broadcast(best.withColumn("one", F.lit(1))), "one", "left")
    return found.select(F.coalesce("threshold", F.lit(1.0)).alias("tau"), F.col("threshold").isNotNull().alias("feasible"), "CAR", "AER", "AER_hi", "coverage")


def class_curves(df: DataFrame, truth: str = "truth", pred: str = "pred_label", conf: str = "confidence", main: Sequence[str] = MAIN_SET, cells: int = 1024) -> DataFrame:
    """``pred, threshold, A, W`` for each main label and confidence that occurs: filled and wrong rows from there up.

    As in ``exact_sweep`` sums run from above in two levels, over cells of confidence and within each of them.
    """
    rows = df.where(F.col(pred).isin(list(main)) & F.col(conf).isNotNull())
    wrong = (~F.coalesce(F.col(truth) == F.col(pred), F.lit(False))).cast("long")
    each = rows.groupBy(F.col(pred).alias("pred"), F.col(conf).alias("threshold")).agg(F.count("*").alias("a"), F.sum(wrong).alias("w"))
    each = each.withColumn("cell", F.least(F.greatest(F.floor(F.col("threshold") * cells), F.lit(-1)), F.lit(cells)))
    sums = each.groupBy("pred", "cell").agg(F.sum("a").alias("s_a"), F.sum("w").alias("s_w"))
    higher = W.partitionBy("pred").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("pred", "cell", *[F.coalesce(F.sum(f"s_{x}").over(higher), F.lit(0)).alias(f"h_{x}") for x in "aw"])
    here = W.partitionBy("pred", "cell").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    joined = each.join(F.broadcast(sums), ["pred", "cell"])  # cells + 2 rows a label at most
    return joined.select("pred", "threshold", *[(F.sum(x).over(here) + F.col(f"h_{x}")).alias(x.upper()) for x in "aw"])


def capped_thresholds(curves: DataFrame, cap: float = AER_CAP) -> DataFrame:
    """For each label the threshold of most right fills whose own upper bound is within the cap, the lowest of equal ones."""
    fits = curves.where(wilson(F.col("W"), F.col("A"))[1] <= cap)
    best = F.max_by(F.struct("threshold", "A", "W"), F.struct((F.col("A") - F.col("W")).alias("c"), (-F.col("threshold")).alias("t")))
    return fits.groupBy("pred").agg(best.alias("b")).select("pred", F.col("b.threshold").alias("threshold"), F.col("b.A").alias("A"), F.col("b.W").alias("W"))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred_label", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """precision, recall, f1 and support of each label in order; a share without a base is 0."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    grid = _labels(df, labels)
    cell = pairs.select("n", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("x"), (F.col("t") == F.col("p")).alias("same"))
    sums = cell.groupBy("x.label").agg(
        F.sum(F.when(F.col("same") & (F.col("x.side") == "t"), F.col("n"))).alias("tp"),
        F.sum(F.when(F.col("x.side") == "t", F.col("n"))).alias("support"),
        F.sum(F.when(F.col("x.side") == "p", F.col("n"))).alias("predicted"),
    )
    rows = grid.join(F.broadcast(sums), "label", "left").fillna(0, ["tp", "support", "predicted"])
    zero = lambda k, n: F.coalesce(share(k, n), F.lit(0.0))
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return rows.select("label", F.round(zero(tp, p), 9).alias("precision"), F.round(zero(tp, s), 9).alias("recall"), F.round(zero(2 * tp, s + p), 9).alias("f1"), s.alias("support"))


def overall(df: DataFrame, truth: str = "truth", pred: str = "pred_label", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """accuracy and macro F1 over the fixed labels."""
    report = classification_report(df, truth, pred, labels).agg(F.round(F.avg("f1"), 9).alias("macro_f1")).withColumn("one", F.lit(1))
    right = F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).cast("long")
    acc = df.agg(F.round(share(F.sum(right), F.count("*")), 9).alias("accuracy")).withColumn("one", F.lit(1))
    return acc.join(report, "one").select("accuracy", "macro_f1")


def _labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in labels], "label string")


def confusion_grid(df: DataFrame, truth: str = "truth", pred: str = "pred_label", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """``truth, pred, n`` for every pair of labels, zeros included."""
    n = len(labels)
    names = F.array(*[F.lit(x) for x in labels])
    grid = df.sparkSession.range(n * n).select(F.element_at(names, (F.floor(F.col("id") / n) + 1).cast("int")).alias("truth"), F.element_at(names, (F.pmod("id", F.lit(n)) + 1).cast("int")).alias("pred"))
    pairs = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(pairs), ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns with their margins, named ``All``."""
    side = lambda c: F.when(F.grouping(c) == 1, F.lit("All")).otherwise(F.col(c).cast("string"))
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).agg(F.count("*").alias("n"), side(a).alias("row"), side(b).alias("col")).select("row", "col", "n")


def calibration(df: DataFrame, truth: str = "truth", pred: str = "pred_label", conf: str = "confidence", bins: int = 10, main: Sequence[str] = MAIN_SET) -> DataFrame:
    """One row: ece over right-closed bins of filled rows, and their number. Empty bins don't count."""
    c = F.least(F.greatest(F.coalesce(F.col(conf), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    edge = [i * (1.0 / bins) for i in range(1, bins)]
    number = sum((F.when(c > e, 1).otherwise(0) for e in edge), F.lit(0))
    right = F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).cast("double")
    rows = df.where(F.col(pred).isin(list(main))).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("conf"), F.avg(right).alias("acc"))
    return rows.agg(F.round(share(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n")), F.sum("n")), 9).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_auto"))


def brier(df: DataFrame, probs: str = "p", truth: str = "truth", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """One row: mean over rows of the squared distance between probabilities and truth; a truth outside the labels is all zeros."""
    terms = [F.pow(F.col(probs)[i] - F.coalesce((F.col(truth) == x).cast("double"), F.lit(0.0)), 2) for i, x in enumerate(labels)]
    return df.agg(F.round(F.avg(sum(terms[1:], terms[0])), 9).alias("brier"))


def weighted_precision(audit: DataFrame, everything: DataFrame, truth: str = "truth", label: str = "final_label") -> DataFrame:
    """One row: accuracy in the audit, macro precision, precision weighted by each label's share of everything, and the share covered.

    Only labels that occur in the audit count, and the weights aren't scaled to sum to one.
    """
    right = F.coalesce(F.col(truth) == F.col(label), F.lit(False)).cast("double")
    known = audit.where(F.col(truth).isNotNull())
    per = known.groupBy(F.col(label).alias("label")).agg(F.avg(right).alias("precision"), F.sum(right).alias("c"), F.count("*").alias("n"))
    total = everything.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("m"))
    total = total.withColumn("share", F.col("m") / F.sum("m").over(W.partitionBy(F.lit(1))))
    rows = per.join(total, "label", "left")
    s = F.coalesce("share", F.lit(0.0))
    return rows.agg(
        F.round(F.sum("c") / F.sum("n"), 9).alias("accuracy"),
        F.round(F.avg("precision"), 9).alias("macro_precision"),
        F.round(F.sum(F.col("precision") * s), 9).alias("weighted_precision"),
        F.round(F.sum(s), 9).alias("coverage"),
    )


def precision_by(audit: DataFrame, everything: DataFrame, by: str = "label_source", truth: str = "truth", label: str = "final_label") -> DataFrame:
    """precision and rows in the audit for each source, and the source's share of everything."""
    right = F.coalesce(F.col(truth) == F.col(label), F.lit(False)).cast("double")
    per = audit.where(F.col(truth).isNotNull()).groupBy(by).agg(F.round(F.avg(right), 9).alias("precision"), F.count("*").alias("n"))
    total = everything.groupBy(by).agg(F.count("*").alias("m"))
    total = total.withColumn("share", F.round(F.col("m") / F.sum("m").over(W.partitionBy(F.lit(1))), 9)).drop("m")
    return per.join(total, by, "left")


def hit_fractions(df: DataFrame, truth: str = "truth", pred: str = "pred_label") -> DataFrame:
    """``label, tp, n_pred, n_true, precision, recall`` for every label on either side; null where there is no base."""
    t, p = F.col(truth), F.col(pred)
    both = df.select(F.explode(F.array_distinct(F.array(t, p))).alias("label"), t.alias("t"), p.alias("p")).where("label IS NOT NULL")
    is_t, is_p = F.coalesce(F.col("t") == F.col("label"), F.lit(False)), F.coalesce(F.col("p") == F.col("label"), F.lit(False))
    sums = both.groupBy("label").agg(F.sum((is_t & is_p).cast("long")).alias("tp"), F.sum(is_p.cast("long")).alias("n_pred"), F.sum(is_t.cast("long")).alias("n_true"))
    return sums.select("*", F.round(share(F.col("tp"), F.col("n_pred")), 9).alias("precision"), F.round(share(F.col("tp"), F.col("n_true")), 9).alias("recall"))


def error_decomposition(df: DataFrame, truth: str = "truth", pred: str = "pred_label", main: Sequence[str] = MAIN_SET) -> DataFrame:
    """One row: wrongly filled rows that should have abstained, and those of another main label."""
    t = F.col(truth)
    auto = F.coalesce(F.col(pred).isin(list(main)), F.lit(False))
    wrong = auto & ~F.coalesce(t == F.col(pred), F.lit(False))
    abstain, kind = wrong & (t == ABSTAIN), wrong & t.isin(list(main))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    sums = df.agg(F.count("*").alias("n"), n(auto).alias("A"), n(wrong).alias("W"), n(abstain).alias("should_abstain"), n(kind).alias("wrong_type"))
    return sums.select("*", F.round(share(F.col("should_abstain"), F.col("W")), 9).alias("frac_should_abstain"), F.round(share(F.col("wrong_type"), F.col("W")), 9).alias("frac_wrong_type"))


def boundary(df: DataFrame, score: str, tau: float, truth: str = "truth", main: Sequence[str] = MAIN_SET) -> DataFrame:
    """One row on a gate that lets rows of the main set pass: false passes and false stops with their rates."""
    known = df.where(F.col(truth).isNotNull())
    real, passed = F.col(truth).isin(list(main)), F.coalesce(F.col(score) >= tau, F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = known.agg(n(real).alias("n_real"), n(~real).alias("n_other"), n(passed & ~real).alias("FP"), n(~passed & real).alias("FN"), n(passed & real).alias("TP"))
    rate = lambda a, b: F.round(share(F.col(a), b), 9)
    return s.select("n_real", "n_other", "FP", "FN", rate("FP", F.col("n_other")).alias("FP_rate"), rate("FN", F.col("n_real")).alias("FN_rate"), rate("TP", F.col("TP") + F.col("FP")).alias("precision"))


def slice_metrics(df: DataFrame, slices: Sequence[str], truth: str = "truth", pred: str = "pred_label") -> DataFrame:
    """Business metrics for each value of each slice column, in one pass over the rows."""
    each = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    rows = df.select(F.explode(each).alias("x"), F.col(truth).alias("t"), F.col(pred).alias("p")).select("x.*", "t", "p").where("value IS NOT NULL")
    return business_metrics(rows, "t", "p", ["slice", "value"])


def rebias_sweep(df: DataFrame, alphas: Sequence[float], probs: str = "p", truth: str = "truth", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """Business metrics for each factor on the abstention's probability; labels are picked anew."""
    tries = df.select(truth, F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"), probs)
    picked = tries.select("alpha", truth, top_label(rebias(F.col(probs), len(labels) - 1, F.col("alpha")), labels).alias("pred_label"))
    return business_metrics(picked, truth, "pred_label", ["alpha"])


def rescue(df: DataFrame, alpha: float, probs: str = "p", truth: str = "truth", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """One row: rows that abstain, and don't at alpha; how many of them are right; and how many could be at best."""
    base, best = (top_label(rebias(F.col(probs), len(labels) - 1, F.lit(a)), labels) for a in (1.0, float(alpha)))
    saved = (base == ABSTAIN) & (best != ABSTAIN)
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    s = df.agg(n(saved).alias("n"), n(saved & (best == F.col(truth))).alias("correct"), n((base == ABSTAIN) & (F.col(truth) != ABSTAIN)).alias("ceiling"))
    return s.select("*", F.round(share(F.col("correct"), F.col("n")), 9).alias("precision"))


def contract_violations(df: DataFrame, key: str = "item_id", pred: str = "pred_label", conf: str = "confidence", probs: str | None = "p", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """One row with a count for each rule that a table of predictions has to keep; all are 0 if it does."""
    bad = {
        "bad_label": ~F.coalesce(F.col(pred).isin(list(labels)), F.lit(False)),
        "bad_confidence": ~F.coalesce(F.col(conf).between(0.0, 1.0), F.lit(False)),
    }
    if probs is not None:
        p = F.col(probs)
        finite = F.coalesce(F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & (F.size(p) == len(labels))
        total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
        top = F.array_max(p)
        bad |= {
            "bad_probability": ~finite,
            "bad_sum": finite & (F.abs(total - 1.0) > 1e-4 + 1e-5),
            "bad_argmax": finite & ~F.coalesce(F.col(pred) == top_label(p, labels), F.lit(False)),
            "bad_max": finite & ~F.coalesce(F.abs(F.col(conf) - top) <= 1e-6 + 1e-5 * F.abs(top), F.lit(False)),
        }
    per_key = df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(v.cast("long")).alias(k) for k, v in bad.items()])
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(z("n").alias("n_rows"), z(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("repeated_keys"), *[z(F.col(k)).alias(k) for k in bad])


def require_contract(df: DataFrame, **how) -> DataFrame:
    """The table itself, or an error that names the rules it breaks."""
    row = contract_violations(df, **how).first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"predictions break their contract: {broken}")
    return df


def decide(label: Column, confidence: Column, tau: float) -> Column:
    """(value, decision, reason) for one prediction."""
    out = (confidence < tau) | (label == ABSTAIN)
    pick = lambda a, b: F.when(F.coalesce(out, F.lit(True)), F.lit(a)).otherwise(b)
    return F.struct(pick(ABSTAIN, label).alias("value"), pick("abstain", F.lit("auto_fill")).alias("decision"), pick("model_abstained", F.lit("model_argmax")).alias("reason"))


def route(photo: Column, url: Column) -> Column:
    """Which input a request is answered from, or why it can't be."""
    return F.when(photo.isNotNull(), F.lit("photo")).when(url.isNotNull(), F.lit("url")).otherwise(F.lit("photo_required"))
