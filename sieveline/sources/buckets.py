"""A table in hash buckets that is edited copy-on-write.

A version is a manifest: a file with the folder of each bucket. An upsert rewrites the buckets that its keys fall into, in new folders, and then publishes the
next manifest, which is created once or not at all. Folders are never changed, so a reader goes on with the version it began with, and a writer that is lost
before its manifest leaves nothing but folders that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveline.operators.sampling import keep_last
from sieveline.storage import settle

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """``version, key, buckets, schema, folders`` (by bucket; one without rows has none) of a version, the last one if none is named."""
    have = versions(spark, path)
    if not have or version not in (None, *have):
        raise FileNotFoundError(f"no version {version or ''} of {path}")
    text = spark.read.text(f"{path}/versions/{have[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, found: Mapping) -> None:
    fs, at = _fs(spark, path)
    name = at(f"{path}/versions/{found['version']:012d}.json")
    fs.mkdirs(name.getParent())
    # written beside, then moved to its name, so that it is seen whole; its name is taken first, by one writer only
    taken = at(f"{path}/versions/{found['version']:012d}.taken")
    try:
        fs.create(taken, False).close()
    except Exception as e:
        raise Conflict(f"version {found['version']} of {path} is another writer's") from e
    whole = at(f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(whole, False)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if not fs.rename(whole, name):
        raise Conflict(f"version {found['version']} of {path} wasn't published")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """The rows in a new folder for each of their buckets; a bucket is one task's."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn("__bucket", _bucket(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    fs, at = _fs(rows.sparkSession, path)
    made = [f.getPath().getName() for f in fs.listStatus(at(folder))]
    return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in made if n.startswith("__bucket=")}


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """A new table's first version. Rows without a key are left out; of those that share one the greatest, in the order of all columns, stays."""
    rows = keep_last(rows.where(F.col(key).isNotNull()), key, rows.columns)
    found = {"version": 1, "key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": _write(rows, path, key, buckets)}
    _publish(rows.sparkSession, path, found)
    return 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at a version."""
    found = manifest(spark, path, version)
    return _folders(spark, found, found["folders"].values())


def _folders(spark: SparkSession, found: Mapping, folders) -> DataFrame:
    schema = StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).parquet(*folders) if (folders := list(folders)) else spark.createDataFrame([], schema)


def upsert(new: DataFrame, path: str, order: list[str] | None = None) -> int:
    """The next version, in which rows of ``new`` take the places of those with their keys, or are added; the version's number.

    Of rows of ``new`` that share a key the last by ``order`` stays (by default by all columns). Rows without a key are left out. Only buckets with a key of ``new`` are
    read and written. Raises ``Conflict`` if another writer was first; the table is then as that one left it. Nothing to write gives the version that is.
    """
    spark = new.sparkSession
    found = manifest(spark, path)
    key, buckets = found["key"], found["buckets"]
    columns = StructType.fromJson(json.loads(found["schema"])).names
    rows = settle(keep_last(new.select(columns).where(F.col(key).isNotNull()), key, order or columns))
    touched = {str(r[0]) for r in rows.select(_bucket(key, buckets)).distinct().collect()}  # at most one for each bucket
    if not touched:
        return found["version"]
    old = _folders(spark, found, [f for b, f in found["folders"].items() if b in touched])
    merged = old.join(rows.select(key), key, "left_anti").select(columns).unionByName(rows)
    written = _write(merged, path, key, buckets)
    _publish(spark, path, found | {"version": found["version"] + 1, "folders": found["folders"] | written})
    return found["version"] + 1


def edit(spark: SparkSession, path: str, key_value, values: Mapping) -> int:
    """One row's cells, by its key: the next version."""
    found = manifest(spark, path)
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit(key_value).cast(StructType.fromJson(json.loads(found["schema"]))[found["key"]].dataType)), F.lit(found["buckets"]))).first()[0]
    row = _folders(spark, found, [f for k, f in found["folders"].items() if k == str(b)]).where(F.col(found["key"]) == F.lit(key_value))
    return upsert(row.withColumns({c: F.lit(v).cast(row.schema[c].dataType) for c, v in values.items()}), path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all versions but the last ``keep``, and the folders that only they name; how many folders went. No writer may be at work."""
    fs, at = _fs(spark, path)
    have = versions(spark, path)
    named = {f.split("/data/")[1].split("/")[0] + "/" + f.rsplit("/", 1)[1] for v in have[-keep:] for f in manifest(spark, path, v)["folders"].values()}
    gone = 0
    for top in fs.listStatus(at(f"{path}/data")):
        inner = [f.getPath() for f in fs.listStatus(top.getPath()) if f.isDirectory()]
        old = [p for p in inner if f"{top.getPath().getName()}/{p.getName()}" not in named]
        for p in old:
            fs.delete(p, True)
        gone += len(old)
        if len(old) == len(inner):
            fs.delete(top.getPath(), True)
    for v in have[:-keep]:
        for kind in ("json", "taken"):
            fs.delete(at(f"{path}/versions/{v:012d}.{kind}"), False)
    return gone
