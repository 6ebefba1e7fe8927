"""Features for learners: character n-grams, scaled blocks and their assembly. Everything fitted is fitted on training rows only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sieveline.functions.text import bound

#: Features of a lexical block at most; with it the vocabulary that is joined to texts has a bounded size.
MAX_FEATURES = 50_000


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of low to high characters inside of words, each padded by a space; a word shorter than n gives itself once."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")

    def of_word(w: Column) -> Column:
        def of_size(n: Column) -> Column:
            whole = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
            # once a word is no longer than n, longer n add nothing
            return F.when((n == low) | (F.char_length(w) >= n), whole).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.array(*[F.lit(n) for n in range(low, high + 1)]), of_size))

    return F.flatten(F.transform(words, lambda w: bound(F.concat(F.lit(" "), w, F.lit(" ")), of_word)))


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def of_size(w: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: i + n - 1 <= F.size(w))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return bound(words, lambda w: F.flatten(F.array(*[of_size(w, n) for n in range(low, high + 1)])))


def term_counts(df: DataFrame, key: str, grams: Column) -> DataFrame:
    """``key, term, tf``."""
    return df.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 5, most: int = MAX_FEATURES) -> DataFrame:
    """``term, idx, df, idf``: the most frequent terms that enough documents have, numbered in order. idf is ``ln((1 + n) / (1 + df)) + 1``."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    kept = terms.orderBy(F.desc("cf"), "term").limit(most)
    return kept.select("term", (F.row_number().over(W.orderBy("term")) - 1).alias("idx"), "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``key, idx, weight``: (1 + ln tf) * idf, at length one for each key."""
    w = counts.join(F.broadcast(vocab), "term").select(key, "idx", ((1 + F.log("tf")) * F.col("idf")).alias("w"))  # MAX_FEATURES rows
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, key).select(key, "idx", (F.col("w") / F.col("length")).alias("weight"))


def tfidf_vectors(df: DataFrame, weights: DataFrame, key: str, size: int, name: str = "tfidf") -> DataFrame:
    """``df`` with its weights as a sparse vector, an empty one where no term is known. Vectors are packed batch by batch, as Arrow arrays."""
    packed = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("__xs"))
    rows = df.join(packed, key, "left").withColumns({"__i": F.coalesce(F.col("__xs.idx").cast("array<int>"), F.array().cast("array<int>")), "__w": F.coalesce(F.col("__xs.weight").cast("array<double>"), F.array().cast("array<double>"))}).drop("__xs")
    schema = StructType([*rows.schema.fields[:-2], StructField(name, VectorUDT())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            parts = [pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), b.column(b.num_columns - 2), b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], names=names)

    return rows.mapInArrow(run, schema)


def population_scale(train: DataFrame, column: str, width: int) -> tuple[list[float], list[float]]:
    """Means and population deviations of an array column over training rows; the deviation of a constant is 1. One aggregate for all coordinates, whatever their number."""
    rows = train.where(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    if rows.isEmpty():
        return [0.0] * width, [1.0] * width
    row = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    rest = (row["count"] - 1) / row["count"]  # of the sample's variance
    return [float(x) for x in row["mean"]], [float(x * rest) ** 0.5 or 1.0 for x in row["variance"]]


def scaled(column: str, means: Sequence[float], deviations: Sequence[float]) -> Column:
    m, d = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (means, deviations))
    return F.transform(F.arrays_zip(F.col(column).alias("x"), m.alias("m"), d.alias("d")), lambda t: (t["x"].cast("double") - t["m"]) / t["d"])


def with_block(df: DataFrame, train: DataFrame, column: str, width: int, scale: str = "l2", name: str | None = None) -> DataFrame:
    """An array column as a vector block: scaled by training rows (``standard``), to length one (``l2``), or as it is."""
    name = name or f"{column}_block"
    short = df.where(F.col(column).isNotNull() & (F.size(column) != width)).limit(1).count()
    if short:
        raise ValueError(f"{column} isn't {width} wide everywhere")
    if scale == "standard":
        return df.withColumn(name, array_to_vector(scaled(column, *population_scale(train, column, width))))
    plain = df.withColumn("__v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    if scale == "l2":
        return Normalizer(p=2.0, inputCol="__v", outputCol=name).transform(plain).drop("__v")
    return plain.withColumnRenamed("__v", name)


def weighted_block(df: DataFrame, block: str, width: int, weight: float) -> DataFrame:
    return ElementwiseProduct(scalingVec=Vectors.dense([weight] * width), inputCol=block, outputCol="__w").transform(df).drop(block).withColumnRenamed("__w", block)


def assembler(blocks: Sequence[str], name: str = "features") -> VectorAssembler:
    """Blocks side by side, in the order given."""
    return VectorAssembler(inputCols=list(blocks), outputCol=name)


def save_bundle(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_bundle(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
