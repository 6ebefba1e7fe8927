"""Quantiles from counts in buckets that grow by a fixed factor: a sketch of bounded relative error whose rows merge over windows.

A value's bucket is the power of the factor that it lies under, so the middle of a bucket is within ``error`` of every value in it, relative to the value. A sketch is a table of
counts, made and merged by sums alone, on tables and on streams; the number of its rows for a window depends on the range of the values, not on how many there are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _factor(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("an error between 0 and 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float) -> Column:
    """``sign`` and ``bucket`` of a number; 0 has sign 0. Null for null, NaN and what is infinite."""
    size = F.abs(value.cast("double"))
    usable = ~F.isnan(size) & (size < float("inf"))
    number = F.when(size > 0, F.ceil(F.log(size) / math.log(_factor(error)))).otherwise(0).cast("int")
    return F.when(usable, F.struct(F.signum(value.cast("double")).cast("int").alias("sign"), number.alias("bucket")))


def sketch(events: DataFrame, width: str, error: float = 0.01, value: str = "value", ts: str = "ts") -> DataFrame:
    """``window_start, sign, bucket, n`` of tumbling windows; values that are no finite numbers aren't counted. A stream needs a watermark first."""
    rows = events.withColumn("__b", bucket(F.col(value), error)).where("__b IS NOT NULL")
    rows = rows.groupBy(F.window(ts, width).alias("w"), "__b.sign", "__b.bucket").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "sign", "bucket", "n")


def merged(sketches: DataFrame, width: str) -> DataFrame:
    """The sketch of coarser windows, or of several tables' windows put together, from finer ones' rows."""
    rows = sketches.groupBy(F.window("window_start", width).alias("w"), "sign", "bucket").agg(F.sum("n").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "sign", "bucket", "n")


def quantiles(sketches: DataFrame, qs: Mapping[str, float], error: float = 0.01) -> DataFrame:
    """``window_start`` and a column for each of ``qs``, linear between the two values beside its rank, as ``monitor.exact_quantiles``; off by ``error`` times the larger of them at most.

    ``error`` is the one that the sketches were made with. Ranks are counted over a window's buckets, not over its values.
    """
    g = _factor(error)
    middle = F.col("sign") * 2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1)
    part = W.partitionBy("window_start")
    upto = F.sum("n").over(part.orderBy("sign", F.col("sign") * F.col("bucket")))
    rows = sketches.select("window_start", middle.alias("x"), upto.alias("upto"), F.sum("n").over(part).alias("all"))
    out = []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("all") - 1)
        low, high = (F.min(F.when(F.col("upto") > f(at), F.struct("upto", "x"))) for f in (F.floor, F.ceil))
        out += [low.alias(f"__l{name}"), high.alias(f"__h{name}")]
    found = rows.groupBy("window_start", "all").agg(*out)
    value = lambda name, q: F.col(f"__l{name}.x") + (F.col(f"__h{name}.x") - F.col(f"__l{name}.x")) * (q * (F.col("all") - 1) - F.floor(q * (F.col("all") - 1)))
    return found.select("window_start", *[F.round(value(name, F.lit(q)), 6).alias(name) for name, q in qs.items()])
