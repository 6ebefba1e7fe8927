"""Reading tables, cutting lineage, and choosing a join by the measured size of its small side."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured and has at most so many rows and, written as JSON, so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset and everything runs in one process (tests, notebooks) a folder is made here, and removed at the end.
    On a cluster it is an error, as executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
            path = tempfile.mkdtemp(prefix="sieveline-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; for narrow rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame) -> DataFrame:
    """Cut the lineage with a parquet table in the shared folder; for rows with texts, of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``write_out`` wrote for a table that is read no more. Tables from elsewhere are left alone."""
    spark = df.sparkSession
    jvm, top = spark._jvm, shared_dir(spark).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        here = jvm.org.apache.hadoop.fs.Path(top).toUri().getPath()
        if path.getParent().toUri().getPath() == here and re.fullmatch(r"[0-9a-f]{32}\.parquet", path.getName()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle_measured(df: DataFrame) -> DataFrame:
    """As ``settle``, for narrow rows, but the planner knows the size of the result.

    A checkpoint keeps the planner's estimate of the query it came from, and that of a join is the product of its sides'. A table that is made of itself again
    and again (rounds of a loop, chains of joins) gets a number of twice as many digits each time, which ends in megabytes for each node of each plan, all in the
    driver. Files have a size, so the rows go through a parquet table, which is deleted again.
    """
    written = write_out(df)
    kept = settle(written)
    discard(written)
    return kept


def sweep(spark: SparkSession) -> None:
    """Have shuffle files deleted that no table needs any more; else they stay until the driver happens to collect its garbage.

    For the ends of steps that shuffle much, where the tables they went through are out of scope.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to be sent to every executor; reads rows + 1 rows of it at most."""
    head = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return head[0] <= rows and head[1] <= size


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join to a side that is usually small: broadcast if it was measured to be, else a shuffle join.

    ``small`` should be settled, as it is read for its size first. The shuffle join relies on adaptive skew
    handling, so a hot key of ``big`` is split.
    """
    return big.join(F.broadcast(small) if fits_broadcast(small) else small.hint("merge"), on, how)
