"""Vectors as arrays of doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def top_label(p: Column, labels: Sequence[str]) -> Column:
    """Label of the greatest probability, the first in order if several are."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def margin(p: Column) -> Column:
    """The greatest probability less the next."""
    s = F.sort_array(p, asc=False)
    return s[0] - s[1]


def entropy(p: Column) -> Column:
    return -F.aggregate(F.transform(p, lambda x: x * F.log(x + 1e-12)), F.lit(0.0), lambda s, x: s + x)


def rebias(p: Column, index: int, alpha: Column) -> Column:
    """One probability times alpha, the others as they are."""
    return F.transform(p, lambda x, i: F.when(i == index, x * alpha).otherwise(x))


def cascade(p_first: Column, p_given: Column) -> Column:
    """Probabilities of the classes behind a gate, and of not passing it, last."""
    return F.concat(F.transform(p_given, lambda x: x * p_first), F.array(1 - p_first))


def merge_tail(p: Column, keep: int) -> Column:
    """The first ``keep`` probabilities, and the sum of all others as the last."""
    rest = F.aggregate(F.slice(p, F.lit(keep + 1), F.greatest(F.size(p) - keep, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    return F.concat(F.slice(p, 1, keep), F.array(rest))


def disagreement(first: Column, others: Sequence[Column]) -> dict[str, Column]:
    """How top labels of several models agree: with the first, and among the others."""
    tops = F.array(*others)
    return {
        "agree": sum(((o == first).cast("int") for o in others[1:]), (others[0] == first).cast("int")),
        "n_distinct": F.size(F.array_distinct(tops)),
        "all_agree": (F.size(F.array_distinct(tops)) == 1).cast("int"),
    }
