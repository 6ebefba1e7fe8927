"""Profiles of tables: nulls, blanks, domains, duplicates, agreement and skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.stats import share


def _long(one_row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("long").alias(value)) for c in columns])
    return one_row.select(F.explode(pairs).alias("x")).select("x.*")


def null_profile(df: DataFrame) -> DataFrame:
    """``column_name, n_null`` for every column, in one pass."""
    return _long(df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]), df.columns, "n_null")


def blank_profile(df: DataFrame) -> DataFrame:
    """``column_name, n_blank`` for every text column; null is blank."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return _long(df.agg(*[F.count_if(F.btrim(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(" \t\n\r")) == "").alias(c) for c in names]), names, "n_blank")


def domain_violations(df: DataFrame, allowed: Mapping[str, Sequence]) -> DataFrame:
    """``column_name, value, n``: values outside of each column's domain; null isn't a value."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), F.col(c).isin(list(v)).alias("ok")) for c, v in allowed.items()])
    rows = df.select(F.explode(each).alias("x")).select("x.*").where("value IS NOT NULL AND NOT ok")
    return rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share``, null as a value of its own."""
    rows = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 9))


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, keys that stand twice or more, rows of these, the most rows of a key, and the rows' share."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    s = groups.agg(
        F.count("*").alias("n_keys"),
        F.count_if(many).alias("n_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_rows_in_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_group"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"),
    )
    return s.select("n_keys", "n_groups", "n_rows_in_groups", "max_group", F.round(share(F.col("n_rows_in_groups"), F.col("all_rows")), 9).alias("share"))


def repeated_members(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key stands more than once. Counts are joined, so a hot key is split like any other."""
    many = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    return df.join(many, key, "left_semi")


def agreement(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row with the share of rows in which two columns agree, for each named pair."""
    return df.agg(*[F.round(F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")), 9).alias(k) for k, (a, b) in pairs.items()])


def group_size(df: DataFrame, key: str, name: str = "n_in_group") -> DataFrame:
    """Every row with its group's size, by a join of counts."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")


def skew_profile(df: DataFrame, group: str, top: int = 10) -> DataFrame:
    """One row: groups, median, p95, p99 and maximum of their sizes, and the share of the largest ``top``."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    q = lambda p: F.round(F.percentile("n", p), 6)
    whole = sizes.agg(F.count("*").alias("n_groups"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("n").alias("max"), F.sum("n").alias("rows")).withColumn("one", F.lit(1))
    head = sizes.orderBy(F.desc("n"), group).limit(top).agg(F.sum("n").alias("head")).withColumn("one", F.lit(1))
    return whole.join(head, "one").select("n_groups", "median", "p95", "p99", "max", F.round(share(F.col("head"), F.col("rows")), 9).alias("top_share"))


def shift_without_top(df: DataFrame, group: str, label: str, top: int = 10) -> DataFrame:
    """One row: total variation distance between label shares of all rows and of those without the largest groups."""
    largest = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(top).select(group)
    marked = df.join(F.broadcast(largest.withColumn("__top", F.lit(True))), group, "left")  # top rows
    per = marked.groupBy(label).agg(F.count("*").alias("a"), F.count_if(F.col("__top").isNull()).alias("b"))
    all_a, all_b = (F.sum(x).over(W.partitionBy(F.lit(1))) for x in ("a", "b"))
    shares = per.select((F.col("a") / all_a).alias("p"), F.coalesce(F.try_divide("b", all_b), F.lit(0.0)).alias("q"))
    return shares.agg(F.round(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), 9).alias("tvd"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """One row: the most and least frequent labels (the first of equal ones) and the ratio of their rows."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("x")).agg(F.count("*").alias("n"))
    first = n.agg(F.min_by("x", F.struct((-F.col("n")).alias("k"), "x")).alias("most"), F.min_by("x", F.struct("n", "x")).alias("least"), F.max("n").alias("a"), F.min("n").alias("b"))
    return first.select("most", "least", F.round(F.col("a") / F.col("b"), 9).alias("ratio"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, weight``: rows / (labels * rows of the label)."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(1))
    return n.select("label", F.round(F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")), 9).alias("weight"))


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """One row: for each named condition the rows that meet it and their share."""
    n = F.count(F.lit(1))
    out = []
    for k, c in steps.items():
        hit = F.count_if(F.coalesce(c, F.lit(False)))
        out += [hit.alias(f"n_{k}"), F.round(share(hit, n), 4).alias(f"share_{k}")]
    return df.agg(n.alias("n"), *out)
