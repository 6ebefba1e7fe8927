"""Calls to an outside model for each row, with retries, a budget and a run that can be taken up again.

The client is a function given by the caller; there is none here. It must be safe to call twice with the same row, as a
task that is lost is run again.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sieveline.operators.sampling import unfinished


def with_retries(call: Callable[[str], str], prompt: str, tries: int = 5, first: float = 10.0, factor: float = 3.0, jitter: tuple[float, float] = (0.7, 1.3), sleep=time.sleep) -> tuple[str | None, str | None]:
    """(answer, error): waits ``first * factor**k``, more or less, between tries."""
    error = None
    for k in range(tries):
        try:
            return call(prompt), None
        except Exception as e:  # whatever the client raises is an answer that didn't come
            error = f"{type(e).__name__}: {e}"[:200]
            if k + 1 < tries:
                sleep(first * factor**k * random.uniform(*jitter))
    return None, error


def answer(todo: DataFrame, call: Callable[[str], str], key: str = "item_id", prompt: str = "prompt", parallel: int = 25, **retry) -> DataFrame:
    """``key, raw, error_msg`` for each row; ``parallel`` tasks call at the same time at most."""
    kind = todo.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [with_retries(call, p, **retry) for p in b[prompt]]
            yield pd.DataFrame({key: b[key], "raw": [g[0] for g in got], "error_msg": [g[1] for g in got]})

    return todo.select(key, prompt).repartition(parallel).mapInPandas(run, f"`{key}` {kind}, raw string, error_msg string")


def answer_rest(todo: DataFrame, done: DataFrame, call: Callable[[str], str], key: str = "item_id", **how) -> DataFrame:
    """Answers for the rows that have no good one yet."""
    return answer(unfinished(todo, done, key, F.col("parsed_ok") & F.col("biz_ok")), call, key, **how)


class BudgetSpent(RuntimeError):
    """The next batch isn't asked, as finished ones have cost what may be spent; a run with a larger budget goes on with it."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    """``batch, key, raw, error_msg, cost`` of the batches that are finished; None if none is."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/answers")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath().toString() for f in fs.listStatus(top)] if fs.exists(top) else []
    finished = [f for f in folders if _exists(spark, f"{f}/_SUCCESS")]
    return spark.read.option("basePath", f"{path}/answers").parquet(*finished) if finished else None


def answer_in_batches(
    todo: DataFrame, path: str, call: Callable[[str], str], key: str = "item_id", prompt: str = "prompt", rows: int = 1000, cost: Column | None = None, budget: float | None = None, parallel: int = 25, **retry
) -> DataFrame | None:
    """``answers`` after asking for all rows of ``todo``, in batches of about ``rows`` rows whose answers are kept as soon as each is finished.

    ``todo`` is written to a queue in ``path`` once, dealt by the hash of its key; a stream over the queue's files, one a batch, remembers in its checkpoint which batches are
    done. A run that is lost, driver and all, is taken up by calling this again (``todo`` is then not looked at): what a finished batch was answered is never asked again, and at
    most one batch is asked twice. A batch writes to a folder with its own number, so running it again adds nothing. ``cost`` is an
    expression on ``raw`` and the prompt; before each batch the finished ones' sum is held against ``budget``, and BudgetSpent is raised if it has reached it.
    Answers that didn't come have a null ``raw`` and an error, and aren't asked again here (see ``unfinished``).
    """
    spark = todo.sparkSession
    queue = f"{path}/queue"
    if not _exists(spark, f"{queue}/_SUCCESS"):
        n = todo.count()
        todo.select(key, prompt).repartition(max(1, -(-n // rows)), key).write.mode("overwrite").parquet(queue)
    schema = spark.read.parquet(queue).schema
    spent: list[Exception] = []

    def ask(batch: DataFrame, number: int) -> None:
        folder = f"{path}/answers/batch={number}"
        if _exists(spark, f"{folder}/_SUCCESS"):  # written before the run was lost, but not yet remembered
            return
        if budget is not None:
            done = answers(spark, path)
            sofar = 0.0 if done is None else done.agg(F.sum("cost")).first()[0] or 0.0
            if sofar >= budget:
                spent.append(BudgetSpent(f"{sofar} of {budget} spent before batch {number}"))
                raise spent[0]
        got = answer(batch, call, key, prompt, parallel, **retry).join(batch, key)
        price = F.lit(0.0) if cost is None else F.coalesce(cost.cast("double"), F.lit(0.0))
        got.select(key, "raw", "error_msg", price.alias("cost")).write.mode("overwrite").parquet(folder)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(queue)
    try:
        stream.writeStream.foreachBatch(ask).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException:
        if spent:
            raise spent[0] from None
        raise
    return answers(spark, path)


def embed(files: DataFrame, models: Mapping[str, tuple[Callable[[], Callable], int]], key: str = "image_id", content: str = "content", batch: int = 64, fuse: bool = False) -> DataFrame:
    """``key`` and for each encoder of ``models`` a float array by its name, all in one pass over the rows; with ``fuse`` also ``fused``, all of them one after the other, each at length one.

    An encoder is (make, width): ``make`` builds the model, once in each worker, and gives a function from an array of contents to an array of vectors. Defined cases: the
    batch size changes no vector, as models see contents and not batches; null contents have null vectors; a vector of another width, or
    another number of vectors than contents, is an error; repeated rows are encoded each.
    """
    rows, names = files.select(key, content), list(models)
    for name, (make, width) in models.items():
        encode = predict_batch_udf(_checked_encoder(make, width), return_type=ArrayType(FloatType()), batch_size=batch)
        rows = rows.withColumn(name, F.when(F.col(content).isNotNull(), encode(F.coalesce(content, F.lit("").cast(files.schema[content].dataType)))))
    if fuse:
        there = F.lit(True)
        for n in names:
            there = there & F.col(n).isNotNull()
        rows = rows.withColumn("fused", F.when(there, F.concat(*[l2_normalised(F.col(n)) for n in names])))
    return rows.drop(content)


def l2_normalised(v: Column) -> Column:
    """A float array at length one; zeros stay."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(F.when(length > 0, length).otherwise(1.0), F.size(v)).alias("n")), lambda t: (t["x"] / t["n"]).cast("float"))


def _checked_encoder(make: Callable[[], Callable], width: int) -> Callable:
    def made():
        model = make()

        def predict(contents: np.ndarray) -> np.ndarray:
            out = np.asarray(model(contents), dtype=np.float32)
            if out.shape != (len(contents), width):
                raise ValueError(f"{out.shape} vectors for {len(contents)} contents of width {width}")
            return out

        return predict

    return made


def hashing_encoder(width: int, seed: int = 0) -> Callable[[], Callable]:
    """An encoder without weights, for offline use and tests: signed counts of a content's 3-byte windows, hashed to ``width`` places."""

    def make() -> Callable:
        def encode(contents: np.ndarray) -> np.ndarray:
            out = np.zeros((len(contents), width), dtype=np.float32)
            for i, c in enumerate(contents):
                raw = c.encode() if isinstance(c, str) else bytes(c)
                for j in range(max(1, len(raw) - 2)):
                    h = zlib.crc32(raw[j : j + 3], seed)
                    out[i, (h >> 1) % width] += 1.0 if h & 1 else -1.0
            return out

        return encode

    return make
