"""Deterministic sampling and keyed de-duplication.

Rows are sampled in the order of a hash of their key and a seed, so the same rows come out of any partitioning and
any engine with the same hash. Quotas per stratum are met in two steps: candidates by a bound on the hash that is
sure to be wide enough, then ranks among them; no task ranks a whole stratum.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.schemas import SEED


def shuffle_key(key: str | Column, seed: int | str = SEED) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def quota_sample(df: DataFrame, stratum: str, key: str, quota: int | Mapping[str, int], seed: int | str = SEED) -> DataFrame:
    """Up to ``quota`` rows of each stratum (by name if a mapping, whose absent strata give none).

    Rows are first ranked within 256 slices of the hash; a slice's rows beyond the quota can't be in the sample.
    """
    most = F.lit(quota) if isinstance(quota, int) else F.coalesce(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])[F.col(stratum)], F.lit(0))
    h = shuffle_key(key, seed)
    rows = df.withColumns({"__h": h, "__most": most, "__slice": F.substring(h, 1, 2)})
    near = rows.withColumn("__r", F.row_number().over(W.partitionBy(stratum, "__slice").orderBy("__h", key))).where("__r <= __most")
    ranked = near.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy("__h", key)))
    return ranked.where("__r <= __most").drop("__h", "__most", "__slice", "__r")


def head_per_group(df: DataFrame, group: str, n: int, order: list[str | Column]) -> DataFrame:
    """The first n rows of each group in an order that says which they are."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def simple_sample(df: DataFrame, key: str, n: int, seed: int | str = SEED) -> DataFrame:
    """n rows of all."""
    return df.withColumn("__h", shuffle_key(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def stratified_holdout(df: DataFrame, stratum: str, key: str, fraction: float, seed: int | str = SEED) -> DataFrame:
    """Adds ``is_holdout``: true for round(fraction * size) rows of each stratum, false for all others.

    Rows without a stratum are never held out. Ranks are counted in two levels, over slices of the hash and
    within them.
    """
    h = shuffle_key(key, seed)
    rows = df.withColumns({"__h": h, "__slice": F.substring(h, 1, 2)})
    sizes = rows.groupBy(F.col(stratum).alias("__s"), F.col("__slice").alias("__k")).agg(F.count("*").alias("__n"))
    w = W.partitionBy("__s")
    sizes = sizes.select("__s", "__k", (F.sum("__n").over(w.orderBy("__k")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__size"))
    rank = F.row_number().over(W.partitionBy(stratum, "__slice").orderBy("__h", key))
    ranked = rows.withColumn("__r", rank).join(sizes, (F.col(stratum) == F.col("__s")) & (F.col("__slice") == F.col("__k")), "left")
    held = F.coalesce(F.col("__before") + F.col("__r") <= F.floor(F.col("__size") * fraction + 0.5), F.lit(False))
    return ranked.withColumn("is_holdout", held).select(*df.columns, "is_holdout")


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; partly done before the shuffle, so a hot key costs no more than another."""
    return _keep(df, key, order, F.max_by)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return _keep(df, key, order, F.min_by)


def _keep(df: DataFrame, key: str, order: list[str], pick) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(pick(row, F.struct(*order)).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where keys meet, the new ones stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(keep_last(new, key, [key]))


def unfinished(todo: DataFrame, done: DataFrame, key: str, finished: Column) -> DataFrame:
    """Rows still to do, for a run that is taken up again."""
    return todo.join(done.where(finished).select(key).distinct(), key, "left_anti")


def budget_prefix(df: DataFrame, order: list[str], cost: Column, cap: float, cells: int = 1024) -> DataFrame:
    """The rows, in order, up to and with the one whose cost passes the cap; with ``running``, the sum so far.

    The first column of the order, a number, parts the rows into ranges; the sums of earlier ranges are added up first.
    """
    first = order[0]
    priced = df.withColumn("__cost", cost)
    cut = priced.stat.approxQuantile(first, [i / cells for i in range(1, cells)], 0.5 / cells) if cells > 1 else []
    edges = sorted(set(cut))
    parted = priced.withColumn("__cell", _cell(F.col(first), edges))
    sums = parted.groupBy("__cell").agg(F.sum("__cost").alias("__sum"))
    before = sums.select("__cell", F.coalesce(F.sum("__sum").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    here = F.sum("__cost").over(W.partitionBy("__cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = parted.join(F.broadcast(before), "__cell").withColumn("running", F.col("__before") + here)  # cells rows at most
    return rows.where(F.col("running") - F.col("__cost") <= cap).drop("__cost", "__cell", "__before")


def _cell(x: Column, edges: list[float]) -> Column:
    """How many of the ascending edges x reaches, by halving."""
    if not edges:
        return F.lit(0)
    table, steps = F.array(*[F.lit(e) for e in edges]), [1 << i for i in reversed(range(len(edges).bit_length()))]
    further = lambda at, step: F.when((at + step <= len(edges)) & (F.get(table, at + step - 1) <= x), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def token_cost(cached: Column, fresh: Column, written: Column, prices: tuple[float, float, float], extra: float = 0.0) -> Column:
    """Price of a call from its tokens by kind; prices are for a million tokens."""
    return (cached * prices[0] + fresh * prices[1] + written * prices[2]) / 1e6 + extra
