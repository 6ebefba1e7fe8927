"""Comparisons of schemes and verdicts on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.evaluation import business_metrics, overall
from sieveline.schemas import AER_CAP


def compare(projections: Mapping[tuple[str, str], DataFrame], truth: str = "truth", pred: str = "pred_label") -> DataFrame:
    """``scheme, projection`` and business metrics; all projections are counted in one pass over their union."""
    rows = None
    for (scheme, projection), df in projections.items():
        one = df.select(F.lit(scheme).alias("scheme"), F.lit(projection).alias("projection"), F.col(truth).alias("truth"), F.col(pred).alias("pred_label"))
        rows = one if rows is None else rows.unionByName(one)
    return business_metrics(rows, by=["scheme", "projection"])


def verdicts(compared: DataFrame, baseline: str, proxy: str, audit: str, cap: float = AER_CAP, eps: float = 1e-9) -> DataFrame:
    """For each scheme: change of CAR against the baseline in both projections, whether it passes the cap, and the verdict.

    Better on the proxy without being better in the audit is overfit to the teacher.
    """
    side = lambda p: compared.where(F.col("projection") == p).select("scheme", F.col("CAR").alias(f"car_{p}"), F.col("AER_hi").alias(f"hi_{p}"))
    wide = side(proxy).join(side(audit), "scheme", "full")
    base = wide.where(F.col("scheme") == baseline).select(F.col(f"car_{proxy}").alias("b_proxy"), F.col(f"car_{audit}").alias("b_audit"), F.lit(1).alias("one"))
    rows = wide.withColumn("one", F.lit(1)).join(F.broadcast(base), "one").drop("one")  # one row
    d_proxy, d_audit = F.col(f"car_{proxy}") - F.col("b_proxy"), F.col(f"car_{audit}") - F.col("b_audit")
    passes = F.coalesce(F.col(f"hi_{audit}"), F.lit(1.0)) <= cap
    verdict = F.when((d_proxy > eps) & (d_audit <= eps), "teacher_overfit").when((d_audit > eps) & passes, "better").when(d_audit < -eps, "worse").otherwise("no_change")
    return rows.select("scheme", F.round(d_proxy, 9).alias("d_proxy"), F.round(d_audit, 9).alias("d_audit"), passes.alias("passes"), verdict.alias("verdict"))


def raw_and_decided(raw: DataFrame, decided: DataFrame) -> DataFrame:
    """``stage, metric, value``: scores before abstention and business metrics after it, side by side."""
    a = overall(raw).unpivot([], ["accuracy", "macro_f1"], "metric", "value").select(F.lit("raw").alias("stage"), "metric", "value")
    cols = ["coverage", "CAR", "AER", "AER_hi"]
    b = business_metrics(decided).select(*cols).unpivot([], cols, "metric", "value").select(F.lit("decided").alias("stage"), "metric", "value")
    return a.unionByName(b)


def flat(report: DataFrame, prefix: str) -> DataFrame:
    """A one-row report with prefixed names."""
    return report.select(*[F.col(c).alias(f"{prefix}_{c}") for c in report.columns])
