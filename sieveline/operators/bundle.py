"""A fitted model with all that a row needs to be scored: vocabulary, blocks, head and threshold, in one folder."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorSizeHint
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import joined_text
from sieveline.operators import features, linear
from sieveline.operators.evaluation import decide
from sieveline.schemas import ALL_LABELS
from sieveline.storage import settle


@dataclass(frozen=True)
class Block:
    """An array column of one width: ``l2`` to length one, ``standard`` by training rows' means and deviations, ``none`` as it is; then times ``weight``."""

    column: str
    width: int
    scale: str = "l2"
    weight: float = 1.0


@dataclass(frozen=True)
class Bundle:
    """``vocabulary(term, idx, df, idf)`` of MAX_FEATURES terms at most, the blocks with their means and deviations, the head, and tau."""

    vocabulary: DataFrame
    terms: int
    blocks: Sequence[Block]
    scales: Mapping[str, tuple[list[float], list[float]]]
    head: linear.Linear | None
    tau: float

    @property
    def width(self) -> int:
        return self.terms + sum(b.width for b in self.blocks)


def _vectors(rows: DataFrame, bundle: Bundle, key: str, title: str, description: str) -> DataFrame:
    """``rows`` with ``features``: the weighted n-grams of their text and their blocks, side by side in the bundle's order. The key is unique."""
    counts = features.term_counts(rows, key, features.char_ngrams(joined_text(F.col(title), F.col(description))))
    out = features.tfidf_vectors(rows, features.tfidf(counts, bundle.vocabulary, key), key, bundle.terms, "__tfidf")
    names = ["__tfidf"]
    for i, b in enumerate(bundle.blocks):
        name = f"__block{i}"
        if b.scale == "standard":
            out = out.withColumn("__x", features.scaled(b.column, *bundle.scales[b.column]))
            out = features.with_block(out, out, "__x", b.width, "none", name).drop("__x")
        else:
            out = features.with_block(out, out, b.column, b.width, b.scale, name)
        out = out if b.weight == 1.0 else features.weighted_block(out, name, b.width, b.weight)
        names.append(name)
    # widths are told, as an empty table has no row to take them from
    for name, width in zip(names, [bundle.terms, *[b.width for b in bundle.blocks]]):
        out = VectorSizeHint(inputCol=name, size=width, handleInvalid="optimistic").transform(out)
    return features.assembler(names).transform(out).drop(*names)


def fit(train: DataFrame, label: str, key: str, blocks: Sequence[Block], title: str = "title", description: str = "description", spec: linear.Spec = linear.Spec(), tau: float = 0.0, min_df: int = 5, most: int = features.MAX_FEATURES) -> Bundle:
    """Everything is learned from ``train``, whose keys are unique and blocks of their widths; ``tau`` is kept as it is."""
    rows = settle(train)
    counts = settle(features.term_counts(rows, key, features.char_ngrams(joined_text(F.col(title), F.col(description)))))
    vocabulary = settle(features.vocabulary(counts, rows.count(), min_df, most))
    scales = {b.column: features.population_scale(rows, b.column, b.width) for b in blocks if b.scale == "standard"}
    bare = Bundle(vocabulary, vocabulary.count(), blocks, scales, None, tau)
    head = linear.fit_many(_vectors(rows, bare, key, title, description), label, {"head": spec})["head"]
    return Bundle(vocabulary, bare.terms, blocks, scales, head, tau)


def save(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Overwrites what is at ``path``."""
    spec = {"terms": bundle.terms, "blocks": [asdict(b) for b in bundle.blocks], "scales": bundle.scales, "tau": bundle.tau}
    bundle.vocabulary.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
    bundle.head.save(spark, f"{path}/head")
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def load(spark: SparkSession, path: str) -> Bundle:
    spec = json.loads(spark.read.parquet(f"{path}/spec").first()[0])
    scales = {k: tuple(v) for k, v in spec["scales"].items()}
    return Bundle(spark.read.parquet(f"{path}/vocabulary"), spec["terms"], [Block(**b) for b in spec["blocks"]], scales, linear.Linear.load(spark, f"{path}/head"), spec["tau"])


def score(rows: DataFrame, bundle: Bundle, key: str, title: str = "title", description: str = "description", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """``key, value, decision, reason, confidence, probabilities``: what is answered for each row.

    Defined cases: a row without a text has no n-grams and is scored by its blocks; one without a block's vector, or with a null
    in it, isn't scored: abstention for ``input_unavailable`` with confidence 0; a label that the head doesn't know has probability 0; of equally probable labels
    the first in order is taken; an empty table gives an empty result.
    """
    whole = F.lit(True)
    for b in bundle.blocks:
        whole = whole & F.coalesce((F.size(b.column) == b.width) & ~F.exists(b.column, lambda x: x.isNull()), F.lit(False))
    marked = rows.withColumn("__whole", whole)
    usable, rest = marked.where("__whole"), marked.where("NOT __whole").select(key)
    scored = linear.predict([bundle.head], _vectors(usable, bundle, key, title, description), which=F.lit(0), name="__p")
    learned = bundle.head.labels
    p = F.array(*[F.col("__p")[learned.index(x)] if x in learned else F.lit(0.0) for x in labels])
    found = scored.select(key, p.alias("p")).withColumn("confidence", F.array_max("p"))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position("p", F.col("confidence")).cast("int"))
    answered = found.select(key, decide(label, F.col("confidence"), bundle.tau).alias("d"), "confidence", _by_label(F.col("p"), labels).alias("probabilities"))
    answered = answered.select(key, "d.value", "d.decision", "d.reason", "confidence", "probabilities")
    refused = rest.select(key, F.lit(labels[-1]).alias("value"), F.lit("abstain").alias("decision"), F.lit("input_unavailable").alias("reason"), F.lit(0.0).alias("confidence"), F.lit(None).cast("map<string,double>").alias("probabilities"))
    return answered.unionByName(refused)


def _by_label(p: Column, labels: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p)
