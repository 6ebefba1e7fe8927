"""Joins and checks on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join whose key must be unique on both sides."""
    for side, df in (("left", left), ("right", right)):
        if not repeated_keys(df, key).isEmpty():
            raise ValueError(f"{key} isn't unique on the {side} side")
    return left.join(right, key, how)


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, if it has as many rows as ``before``."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{a} rows became {b}")
    return after


def not_covered(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Wanted keys that aren't given."""
    return wanted.select(key).distinct().join(given.select(key).distinct(), key, "left_anti")


def aligned(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """A row for each id, with nulls where df has none."""
    return ids.join(df, key, "left")


def lookup(df: DataFrame, table: DataFrame, column: str, name: str, default=None) -> DataFrame:
    """A column mapped through a table(key, value), with a default."""
    return df.join(table.select(F.col("key").alias(column), F.col("value").alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(default)) if default is not None else F.col(name))


def overlaps(df: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """``key, part_a, part_b, n``: how many values of each key two parts share; nulls don't count."""
    values = df.select(F.col(part).alias("part"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select("part", "x.*")
    sets = values.where("value IS NOT NULL AND part IS NOT NULL").groupBy("key", "value").agg(F.array_sort(F.collect_set("part")).alias("parts")).where("size(parts) > 1")
    pairs = F.flatten(F.transform("parts", lambda a: F.transform(F.filter("parts", lambda b: b > a), lambda b: F.struct(a.alias("part_a"), b.alias("part_b")))))
    return sets.select("key", F.explode(pairs).alias("p")).groupBy("key", "p.part_a", "p.part_b").agg(F.count("*").alias("n"))
