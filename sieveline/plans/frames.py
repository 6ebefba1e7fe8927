"""Frames in the roles that the operators expect, derived from the standard tables by fixed rules.

Embeddings stand in for scored predictions: shares of the first six coordinates' absolute values are the
probabilities. Documents stand in for items, their sources for users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.vectors import top_label
from sieveline.schemas import ALL_LABELS
from sieveline.storage import read

LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in ALL_LABELS) + "]"

#: CTE of the same frame as ``scored``.
SCORED_SQL = f"""
e AS (SELECT vec_id, label, {", ".join(f"abs(embedding[{i + 1}]::DOUBLE) AS e{i}" for i in range(6))} FROM embeddings),
s AS (SELECT vec_id, label, {" + ".join(f"e{i}" for i in range(6))} AS t, {", ".join(f"e{i}" for i in range(6))} FROM e),
q AS (SELECT vec_id AS item_id, label, [{", ".join(f"e{i} / t" for i in range(6))}] AS p FROM s),
r AS (SELECT *, {LABELS_SQL}[list_position(p, list_max(p))] AS pred_label, list_max(p) AS confidence FROM q),
scored AS (
  SELECT item_id, label, p, pred_label, confidence,
    CASE WHEN item_id % 12 = 0 THEN {LABELS_SQL}[label % 6 + 1] ELSE pred_label END AS truth,
    'u' || (item_id % 37)::VARCHAR AS user_id, ['human', 'kb', 'llm'][(item_id % 3 + 1)::INT] AS label_source
  FROM r
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    size = [F.abs(F.col("embedding")[i].cast("double")) for i in range(6)]
    total = sum(size[1:], size[0])
    names = F.array(*[F.lit(x) for x in ALL_LABELS])
    rows = e.select(F.col("vec_id").alias("item_id"), "label", F.array(*[x / total for x in size]).alias("p"))
    rows = rows.withColumns({"pred_label": top_label(F.col("p"), ALL_LABELS), "confidence": F.array_max("p")})
    own = F.element_at(names, (F.pmod("label", F.lit(6)) + 1).cast("int"))
    source = F.element_at(F.array(*[F.lit(x) for x in ("human", "kb", "llm")]), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    return rows.withColumns(
        {
            "truth": F.when(F.col("item_id") % 12 == 0, own).otherwise(F.col("pred_label")),
            "user_id": F.concat(F.lit("u"), (F.col("item_id") % 37).cast("string")),
            "label_source": source,
        }
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("source").alias("user_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("description"), "lang")


ITEMS_SQL = "items AS (SELECT doc_id AS item_id, source AS user_id, substr(text, 1, 60) AS title, text AS description, lang FROM documents)"
