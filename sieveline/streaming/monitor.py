"""Service monitoring over an event log: rates, ratios, quantiles, gaps and alerts.

Functions on windows work on a stream as on a table; give a stream a watermark first. Those that need the windows
in order (spine, alerts) work on finished windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions.stats import share


def watermarked(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """A stream with a watermark, which needs a time with a zone; a table as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events


def rates(events: DataFrame, width: str, seconds: int, by: str = "event_type", ts: str = "ts") -> DataFrame:
    """``window_start, by, n, per_second`` in tumbling windows."""
    rows = events.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), by, "n", F.round(F.col("n") / seconds, 9).alias("per_second"))


def ratios(events: DataFrame, width: str, hit: Column, floor: float = 1.0, ts: str = "ts") -> DataFrame:
    """``window_start, n_hit, n, ratio``; the divisor is floor at least."""
    rows = events.groupBy(F.window(ts, width).alias("w")).agg(F.count_if(hit).alias("n_hit"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "n_hit", "n", F.round(F.col("n_hit") / F.greatest(F.col("n"), F.lit(floor)), 9).alias("ratio"))


def summaries(events: DataFrame, width: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """``window_start, total, n, mean, top`` in tumbling windows."""
    rows = events.groupBy(F.window(ts, width).alias("w")).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.max(value).alias("top"))
    return rows.select(F.col("w.start").alias("window_start"), F.round("s", 6).alias("total"), "n", F.round(share(F.col("s"), F.col("n")), 6).alias("mean"), "top")


def bucket_counts(events: DataFrame, width: str, edges: list[float], value: str = "value", ts: str = "ts") -> DataFrame:
    """``window_start, le_0 .. le_k, n``: values up to each edge, and all."""
    cols = [F.count_if(F.col(value) <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    rows = events.groupBy(F.window(ts, width).alias("w")).agg(*cols, F.count(value).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *[f"le_{i}" for i in range(len(edges))], "n")


def bucket_quantile(counted: DataFrame, q: float, edges: list[float]) -> DataFrame:
    """Quantile by window from bucket counts, linear within the bucket, from 0 in the first one; above the last edge it's that edge."""
    rank = F.col("n") * q
    out = F.lit(float(edges[-1]))
    for i in reversed(range(len(edges))):
        low, below = (edges[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = low + (edges[i] - low) * (rank - below) / F.nullif(F.col(f"le_{i}") - below, F.lit(0))
        out = F.when(F.col(f"le_{i}") >= rank, F.coalesce(inside, F.lit(float(low)))).otherwise(out)
    return counted.select("window_start", F.when(F.col("n") > 0, F.round(out, 6)).alias("quantile"))


def exact_quantiles(events: DataFrame, width: str, qs: dict[str, float], value: str = "value", ts: str = "ts") -> DataFrame:
    rows = events.groupBy(F.window(ts, width).alias("w")).agg(*[F.round(F.percentile(value, q), 6).alias(k) for k, q in qs.items()])
    return rows.select(F.col("w.start").alias("window_start"), *qs)


def spine(windows: DataFrame, step: str, fill: dict[str, float], start: str = "window_start", by: Sequence[str] = ()) -> DataFrame:
    """The windows with those that are missing between the first and the last, of each series if there are several, filled."""
    ends = windows.groupBy(*by).agg(F.min(start).alias("a"), F.max(start).alias("b"))
    times = ends.where("a IS NOT NULL").select(*by, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(start))
    return times.join(windows, [*by, start], "left").fillna(fill)


def alert_runs(windows: DataFrame, firing: Column, hold: int, start: str = "window_start", days: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """``by.., run_start, run_end, n_windows, alerted``: unbroken runs of windows in which a condition holds; alerted from ``hold`` windows on.

    A series of ``windows`` has no gaps. Runs are found within days; only those that touch an end of their day, two a day at most, are then
    joined across days, so no task orders all windows or all runs.
    """
    rows = windows.select(*by, F.col(start).alias("t"), F.coalesce(firing, F.lit(False)).alias("on"), F.date_trunc(days, start).alias("d"))
    day = W.partitionBy(*by, "d")
    rows = rows.withColumns({"island": F.sum((~F.col("on")).cast("int")).over(day.orderBy("t")), "first": F.min("t").over(day), "last": F.max("t").over(day)}).where("on")
    parts = rows.groupBy(*by, "d", "island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    at_end = (F.col("a") == F.col("first")) | (F.col("b") == F.col("last"))
    # runs that fill up to the end of a day go on in a run from the start of the next
    across = W.partitionBy(*by).orderBy("a")
    goes_on = (F.col("a") == F.col("first")) & (F.lag("b").over(across) == F.lag("last").over(across)) & (F.datediff("d", F.lag("d").over(across)) == 1)
    joined = parts.where(at_end).withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(across))
    over = joined.groupBy(*by, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).drop("run")
    runs = over.unionByName(parts.where(~at_end).select(*by, "a", "b", "n"))
    return runs.select(*by, F.col("a").alias("run_start"), F.col("b").alias("run_end"), F.col("n").alias("n_windows"), (F.col("n") >= hold).alias("alerted"))


def write_rates(events: DataFrame, path: str, checkpoint: str, width: str = "5 minutes", seconds: int = 300):
    """Rates of a stream to parquet files, window by window as the watermark passes; what comes later is dropped."""
    query = rates(watermarked(events), width, seconds).writeStream.outputMode("append").format("parquet")
    return query.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def response_log(responses: DataFrame) -> DataFrame:
    """Counters of responses by decision and reason; confidence counts only where the model ran."""
    ran = F.col("reason") == "model_argmax"
    return responses.groupBy("decision", "reason").agg(F.count("*").alias("n"), F.count_if(ran).alias("n_scored"), F.round(F.sum(F.when(ran, F.col("confidence"))), 9).alias("sum_confidence"))
