"""Readers and writers: CSV, parquet, images by path, manifests, runs and reports."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.text import image_path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, fields over several lines and doubled quotes; ids keep their zeros as the schema says so.

    A byte order mark before the header is taken for what it is.
    """
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table or some of its columns; only these are read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none: an optional label source."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.parquet(path) if exists else None


def replace_parquet(df: DataFrame, path: str) -> None:
    """Write beside the table and then take its place, so that a table can be computed from itself."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    place, new_place, old_place = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = place.getFileSystem(conf)
    had = fs.exists(place)
    if had and not fs.rename(place, old_place):
        raise OSError(f"can't move {path}")
    if not fs.rename(new_place, place):
        raise OSError(f"can't move {new}")
    if had:
        fs.delete(old_place, True)


def images(spark: SparkSession, root: str) -> DataFrame:
    """``image_id, path, content, sha256`` of the JPEG files below a folder; the id is the file's name."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.jpg").load(root)
    number = F.try_to_number(F.regexp_extract("path", r"([0-9]+)\.jpg$", 1), F.lit("9999999999999999999")).cast("long")
    return files.select(number.alias("image_id"), "path", "content", F.sha2("content", 256).alias("sha256"))


def with_images(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with their image and ``image_error`` where it's missing."""
    joined = items.withColumn("image_path", image_path(F.col("image_id"))).join(found.drop("path"), "image_id", "left")
    return joined.withColumn("image_error", F.when(F.col("content").isNull(), F.lit("image_not_found")))


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def read_state(path: str, default):
    """A small JSON file on the driver, or the default where there is none."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_state(path: str, value) -> None:
    """A small JSON file, whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, default=str)
    os.replace(part, path)


def content_hash(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: number of rows and a hash of their content that doesn't depend on their order.

    Rows' hashes are added up, so nothing is sorted or gathered.
    """
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [key, *columns]]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("hash"))


def manifest(tables: Mapping[str, tuple[DataFrame, str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """``name, n_rows, hash, parents`` for tables given as (table, key, columns, names of parents)."""
    rows = None
    for name, (df, key, columns, parents) in tables.items():
        one = content_hash(df, key, columns).select(F.lit(name).alias("name"), "n_rows", "hash", F.array(*[F.lit(p) for p in parents]).cast("array<string>").alias("parents"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def lineage(made: DataFrame) -> DataFrame:
    """``child, parent`` rows of a manifest."""
    return made.select(F.col("name").alias("child"), F.explode("parents").alias("parent"))


def log_run(spark: SparkSession, path: str, name: str, params: Mapping[str, object], metrics: Mapping[str, float], tags: Mapping[str, str] | None = None) -> str:
    """Appends a run to the table of runs; returns its id."""
    run = uuid.uuid4().hex
    schema = "run_id string, name string, params map<string,string>, metrics map<string,double>, tags map<string,string>"
    row = (run, name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()}, dict(tags or {}))
    spark.createDataFrame([row], schema).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    return run


def runs_wide(runs: DataFrame, params: Iterable[str], metrics: Iterable[str]) -> DataFrame:
    """A row for each run with named parameters and metrics as columns, for export."""
    slug = lambda x: re.sub("[^A-Za-z0-9]+", "_", x)
    return runs.select("run_id", "name", "at", *[F.col("params")[p].alias(f"param_{slug(p)}") for p in params], *[F.col("metrics")[m].alias(f"metric_{slug(m)}") for m in metrics])


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small result as a Markdown table; ``limit`` rows at most."""
    rows = df.limit(limit).collect()
    shown = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows])
