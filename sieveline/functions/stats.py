"""Statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sieveline.schemas import Z, Z2


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % bounds of the share k of n; null where n is 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    d = 1 + Z2 / n
    centre = (p + Z2 / (2 * n)) / d
    half = Z * F.sqrt((p * (1 - p) + Z2 / (4 * n)) / n) / d
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half))


def share(k: Column, n: Column) -> Column:
    """k / n; null where n is 0."""
    return F.when(n > 0, k.cast("double") / n)


def business(n: Column, a: Column, c: Column) -> dict[str, Column]:
    """Columns from the counts of all rows, filled rows and rightly filled rows.

    CAR is c / n and AER is (a - c) / a, both with Wilson bounds; coverage is a / n.
    """
    w = a - c
    car, aer = wilson(c, n), wilson(w, a)
    return {
        "N": n,
        "A": a,
        "C": c,
        "W": w,
        "coverage": share(a, n),
        "CAR": share(c, n),
        "CAR_lo": car[0],
        "CAR_hi": car[1],
        "AER": share(w, a),
        "AER_lo": aer[0],
        "AER_hi": aer[1],
    }


def rounded(cols: dict[str, Column], digits: int = 9) -> list[Column]:
    """Named columns; shares and bounds are rounded, so that order of summing doesn't show."""
    return [(F.round(v, digits) if k not in ("N", "A", "C", "W") else v).alias(k) for k, v in cols.items()]


def register(spark: SparkSession) -> None:
    n = "CAST(n AS DOUBLE)"
    p = f"CAST(k AS DOUBLE) / {n}"
    half = f"{Z} * sqrt(({p} * (1 - {p}) + {Z2} / (4 * {n})) / {n})"
    for name, sign, bound in (("wilson_lo", "-", "greatest(0D, "), ("wilson_hi", "+", "least(1D, ")):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k BIGINT, n BIGINT) RETURNS DOUBLE "
            f"RETURN CASE WHEN n > 0 THEN {bound}({p} + {Z2} / (2 * {n}) {sign} {half}) / (1 + {Z2} / {n})) END"
        )
