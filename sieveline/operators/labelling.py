"""Weak labelling: a dictionary of names, answers to be checked, and the merge of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import bound, is_ruled_out, names_pattern, normalise_name
from sieveline.operators import dictionary
from sieveline.schemas import ABSTAIN, ALL_LABELS, DEMOTE_AT, MAIN_SET, RESPONSE, STATUSES, TRUST_AT, VALID_STATUS
from sieveline.storage import join_small, settle


def build_dictionary(labelled: DataFrame, name: Column, label: Column, order: list[str], where: Column | None = None) -> DataFrame:
    """``name, label``: the first label of each normalised name, in the given order; rows without one are left out."""
    rows = labelled.where(F.lit(True) if where is None else where).select(normalise_name(name).alias("name"), label.alias("label"), F.struct(*order).alias("o"))
    return rows.where("name IS NOT NULL AND name <> '' AND label IS NOT NULL").groupBy("name").agg(F.min_by("label", "o").alias("label"))


def dictionary_hits(text: Column, names: list[str]) -> Column:
    """How many names stand in a normalised text; the same name twice counts twice."""
    return F.regexp_count(text, F.lit(names_pattern(names))) if names else F.lit(0)


def dictionary_find(text: Column, names: list[str]) -> Column:
    """The leftmost name in a normalised text, the longest if several begin there; null if none."""
    if not names:
        return F.lit(None).cast("string")
    found = F.regexp_extract(text, names_pattern(names), 0)
    return F.when(found != "", found)


def first_hit(hits: Column) -> Column:
    """The leftmost name of ``dictionary.with_hits``, the longest if several begin there; null if none."""
    return F.get(hits, 0)["name"]


def names_many(hits: Column) -> Column:
    """Whether ``dictionary_hits`` would count more than one name: another begins past the end of the first."""
    return F.coalesce(F.get(hits, F.size(hits) - 1)["pos"] >= F.get(hits, 0)["pos"] - F.get(hits, 0)["neg"], F.lit(False))


def find_by_join(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, name`` as by ``dictionary_find``, for dictionaries of any size; of rows that share a key the leftmost and longest name."""
    found = dictionary.with_hits(texts.select(key, text), key, text, names).select(key, F.get("hits", 0).alias("h"))
    return found.where("h IS NOT NULL").groupBy(key).agg(F.min("h").alias("h")).select(key, "h.name")


def apply_dictionary(items: DataFrame, names: DataFrame, key: str = "item_id", title: str = "title", description: str = "description") -> DataFrame:
    """``key, kb_model, kb_label, label_source, confidence``: dictionary labels of items.

    Titles that are ruled out, or name more than one thing, get none. Dictionaries of every size are matched by the same walk; items
    are shuffled only for one that is too large to be sent.
    """
    t, d = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(description), F.lit(""))
    names = settle(names)
    rows = items.select(key, t.alias("__t"), d.alias("__d")).withColumn("__nt", normalise_name(F.col("__t")))
    rows = dictionary.with_hits(rows, key, "__nt", names, "__in_title")
    skip = is_ruled_out(F.col("__t")) | names_many(F.col("__in_title"))
    rows = rows.select(key, normalise_name(F.when(skip, F.lit("")).otherwise(F.concat("__t", F.lit(" "), "__d"))).alias("__text"))
    hit = dictionary.with_hits(rows, key, "__text", names).select(key, first_hit(F.col("hits")).alias("kb_model"))
    found = join_small(hit, names.select(F.col("name").alias("kb_model"), F.col("label").alias("kb_label")), ["kb_model"])
    known = F.col("kb_label").isNotNull()
    return found.select(key, "kb_model", "kb_label", F.when(known, F.lit("kb")).alias("label_source"), F.when(known, F.lit(1.0)).alias("confidence"))


def invariant_reason(status: Column, body: Column, label: Column) -> Column:
    """Why status, body and label don't go together; null if they do. The first reason counts."""
    valid = status == VALID_STATUS
    return (
        F.when(valid & body.isNull(), F.lit("valid status without body type"))
        .when(valid & ~F.coalesce(label == body, F.lit(False)), F.lit("label differs from body type"))
        .when(~valid & body.isNotNull(), F.concat(F.lit("body type without valid status: "), body))
        .when(~valid & ~F.coalesce(label == ABSTAIN, F.lit(False)), F.lit("label without valid status"))
    )


def parse_response(raw: Column) -> Column:
    """Struct of the answer's fields, parsed_ok, biz_ok, biz_reason and error_msg (200 characters at most)."""
    return bound(F.struct(raw.alias("raw"), F.from_json(raw, RESPONSE, {"mode": "PERMISSIVE"}).alias("r")), lambda x: _checked(x["raw"], x["r"]))


def _checked(raw: Column, r: Column) -> Column:
    status, body, label, conf = (r[f] for f in ("object_status", "body_type", "final_label", "confidence"))
    error = (
        F.when(raw.isNull(), F.lit("no answer"))
        .when(r.isNull() | (status.isNull() & body.isNull() & label.isNull() & conf.isNull()), F.concat(F.lit("not an answer: "), raw))
        .when(~F.coalesce(status.isin(STATUSES), F.lit(False)), F.concat(F.lit("object_status: "), F.coalesce(status, F.lit("null"))))
        .when(body.isNotNull() & ~body.isin(MAIN_SET), F.concat(F.lit("body_type: "), body))
        .when(~F.coalesce(label.isin(ALL_LABELS), F.lit(False)), F.concat(F.lit("final_label: "), F.coalesce(label, F.lit("null"))))
        .when(~F.coalesce(conf.between(0.0, 1.0), F.lit(False)), F.concat(F.lit("confidence: "), F.coalesce(conf.cast("string"), F.lit("null"))))
    )
    ok = error.isNull()
    reason = F.when(ok, invariant_reason(status, body, label))
    return F.struct(
        *[F.when(ok, c).alias(n) for n, c in (("pred_status", status), ("pred_body", body), ("pred_label", label), ("confidence", conf))],
        ok.alias("parsed_ok"),
        (ok & reason.isNull()).alias("biz_ok"),
        reason.alias("biz_reason"),
        F.substring(error, 1, 200).alias("error_msg"),
    )


def with_source(items: DataFrame, source: DataFrame | None, key: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join of a label source under new names; a source that is absent gives nulls. columns: new name to (name, type)."""
    if source is None:
        return items.withColumns({new: F.lit(None).cast(kind) for new, (_, kind) in columns.items()})
    return items.join(source.select(key, *[F.col(old).cast(kind).alias(new) for new, (old, kind) in columns.items()]), key, "left")


def pick_final() -> Column:
    """The final label of a row from all its sources: people, then the dictionary, then the model, else abstention.

    A dictionary label gives way if the check of it says, surely enough, that the item isn't valid.
    """
    c = F.col
    checked = c("kb_check_status").isNotNull() & (c("kb_check_status") != VALID_STATUS) & (F.coalesce("kb_check_confidence", F.lit(0.0)) >= DEMOTE_AT)
    trusted = c("llm_label").isNotNull() & F.coalesce("llm_biz_ok", F.lit(False)) & (F.coalesce("llm_confidence", F.lit(0.0)) >= TRUST_AT)
    unsure = c("llm_object_status").isNotNull() & (c("llm_object_status") != "") & (c("llm_object_status") != VALID_STATUS)
    none = F.lit(None).cast("string")

    def out(status: Column, body: Column, label: Column, reason: Column, source: str, confidence: Column, review: bool = False) -> Column:
        return F.struct(
            status.alias("final_object_status"),
            body.alias("final_body_type"),
            label.alias("final_label"),
            reason.alias("final_reason"),
            F.lit(source).alias("label_source"),
            confidence.cast("double").alias("confidence"),
            F.lit(review).alias("needs_review"),
        )

    text = F.lit
    return (
        F.when(c("gold_label").isNotNull(), out(c("gold_object_status"), c("gold_body_type"), c("gold_label"), text("human-labeled"), "human", F.lit(1.0)))
        .when(
            c("kb_label").isNotNull() & checked,
            out(c("kb_check_status"), none, text(ABSTAIN), F.concat(text("kb demoted by llm-vision: "), "kb_check_status"), "kb_overridden", c("kb_check_confidence")),
        )
        .when(c("kb_label").isNotNull(), out(text(VALID_STATUS), c("kb_label"), c("kb_label"), F.concat(text("kb match: "), "kb_model"), "kb", F.lit(1.0)))
        .when(trusted, out(c("llm_object_status"), c("llm_body_type"), c("llm_label"), text("llm prediction"), "llm", c("llm_confidence")))
        .when(unsure, out(c("llm_object_status"), none, text(ABSTAIN), F.concat(text("llm_low_confidence_non_valid: "), "llm_object_status"), "abstain", F.lit(0.0), True))
        .otherwise(out(text("insufficient_info"), none, text(ABSTAIN), text("no confident source or unreliable valid claim"), "abstain", F.lit(0.0), True))
    )


def merge_sources(items: DataFrame, gold: DataFrame | None, kb: DataFrame | None, llm: DataFrame | None, check: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Items with their final label, its reason and source, and what each source said."""
    s = "string"
    rows = with_source(items, gold, key, {"gold_object_status": ("object_status", s), "gold_body_type": ("body_type", s), "gold_label": ("final_label", s)})
    rows = with_source(rows, kb, key, {"kb_model": ("kb_model", s), "kb_label": ("kb_label", s)})
    rows = with_source(rows, llm, key, {"llm_object_status": ("pred_status", s), "llm_body_type": ("pred_body", s), "llm_label": ("pred_label", s), "llm_confidence": ("confidence", "double"), "llm_biz_ok": ("biz_ok", "boolean")})
    rows = with_source(rows, check, key, {"kb_check_status": ("pred_status", s), "kb_check_label": ("pred_label", s), "kb_check_confidence": ("confidence", "double")})
    return rows.withColumn("__final", pick_final()).select("*", "__final.*").drop("__final", "gold_object_status", "gold_body_type")
