"""The registered queries, each with the DuckDB SQL that has the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.functions import vectors as vx
from sieveline.operators import evaluation as ev
from sieveline.operators import boosting, bundle, features, heads, joins, labelling, neighbours, profiling, reports, sampling, splitting, thresholds
from sieveline.plans.frames import ITEMS_SQL, LABELS_SQL, SCORED_SQL, items, scored
from sieveline.schemas import ABSTAIN, ALL_LABELS, MAIN_SET, VALID_STATUS
from sieveline.sources import buckets, files
from sieveline.storage import read, settle, shared_dir
from sieveline.streaming import alerts, monitor, sketch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MAIN_SQL = "(" + ", ".join(f"'{x}'" for x in MAIN_SET) + ")"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def wilson_sql(k: str, n: str, side: str) -> str:
    k, n = f"({k})::DOUBLE", f"nullif(({n})::DOUBLE, 0)"
    p = f"({k} / {n})"
    sign, clamp = ("-", "greatest(0.0::DOUBLE, ") if side == "lo" else ("+", "least(1.0::DOUBLE, ")
    mid = f"({p} + 3.8416::DOUBLE / (2 * {n})) / (1 + 3.8416::DOUBLE / {n})"
    half = f"1.96::DOUBLE * sqrt(({p} * (1 - {p}) + 3.8416::DOUBLE / (4 * {n})) / {n}) / (1 + 3.8416::DOUBLE / {n})"
    return f"CASE WHEN {n} IS NULL THEN NULL ELSE {clamp}{mid} {sign} {half}) END"


def business_sql(n: str = "n", a: str = "a", c: str = "c") -> str:
    r = lambda x: f"round({x}, 9)"
    return (
        f"({n})::BIGINT AS \"N\", ({a})::BIGINT AS \"A\", ({c})::BIGINT AS \"C\", ({a} - {c})::BIGINT AS \"W\", {r(f'{a} / nullif({n}, 0)::DOUBLE')} AS coverage, "
        f"{r(f'{c} / nullif({n}, 0)::DOUBLE')} AS \"CAR\", {r(wilson_sql(c, n, 'lo'))} AS \"CAR_lo\", {r(wilson_sql(c, n, 'hi'))} AS \"CAR_hi\", "
        f"{r(f'({a} - {c}) / nullif({a}, 0)::DOUBLE')} AS \"AER\", {r(wilson_sql(f'{a} - {c}', a, 'lo'))} AS \"AER_lo\", {r(wilson_sql(f'{a} - {c}', a, 'hi'))} AS \"AER_hi\""
    )


COUNTS = f"count(*) AS n, count(*) FILTER (pred_label IN {MAIN_SQL}) AS a, count(*) FILTER (pred_label IN {MAIN_SQL} AND pred_label = truth) AS c"

# ---------------------------------------------------------------- text

NAME_SQL = """list_transform(
  list_filter(string_split(regexp_replace(translate(lower({0}), 'ёэ', 'ее'), '[^a-zа-я0-9]+', ' ', 'g'), ' '), lambda x: x <> ''),
  lambda x: CASE
    WHEN length(regexp_replace(x, '[^а-я]', '', 'g')) > length(regexp_replace(x, '[^a-z]', '', 'g')) THEN translate(x, 'aceopxykbmtn', 'асеорхуквмтн')
    WHEN length(regexp_replace(x, '[^a-z]', '', 'g')) > length(regexp_replace(x, '[^а-я]', '', 'g')) THEN translate(x, 'асеорхуквмтн', 'aceopxykbmtn')
    ELSE x END)"""
FORM_SQL = """array_to_string(list_transform(
  list_filter(string_split(regexp_replace(regexp_replace(array_to_string(""" + NAME_SQL + """, ' '), '([a-zа-я])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zа-я])', '\\1 \\2', 'g'), ' '), lambda x: x <> ''),
  lambda x: CASE x WHEN 'iii' THEN '3' WHEN 'ii' THEN '2' WHEN 'i' THEN '1' ELSE x END), ' ')"""
DUP_SQL = "array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[а-яёa-z0-9]+'), ' ')"


@query(f"SELECT doc_id, {FORM_SQL.format('text')} AS name_form, md5({DUP_SQL.format('text')}) AS dup_md5, length({DUP_SQL.format('text')})::BIGINT AS dup_chars FROM documents")
def text_normalize(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    form = tx.duplicate_form(F.col("text"))
    return d.select("doc_id", tx.normalise_name(F.col("text")).alias("name_form"), F.md5(form).alias("dup_md5"), F.char_length(form).cast("long").alias("dup_chars"))


@query(f"""
WITH {ITEMS_SQL}, k AS (SELECT CASE WHEN length({DUP_SQL.format('description')}) >= 40 THEN md5({DUP_SQL.format('title')} || chr(0) || {DUP_SQL.format('description')}) END AS k FROM items),
g AS (SELECT count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY k)
SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_rows_in_groups, max(n) AS max_group, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE, 9) AS share FROM g
""")
def text_key_dups(spark, sf_dir):
    keyed = items(spark, sf_dir).select(F.md5(tx.text_key(F.col("title"), F.col("description"))).alias("k"))
    return profiling.duplicate_profile(keyed, "k")


@query("""
SELECT doc_id, regexp_matches(lower(text), 'the') AS has_the,
  coalesce(CASE WHEN regexp_matches(lower(text), 'ción|ñ') THEN 'es' END, CASE WHEN regexp_matches(lower(text), 'ß|ü|ö') THEN 'de' END, CASE WHEN regexp_matches(lower(text), 'ê|è|ç') THEN 'fr' END, 'unknown') AS bucket,
  trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  (doc_id % 1000)::VARCHAR || '/' || doc_id::VARCHAR || '.jpg' AS path,
  replace('Text: ' || text || ' of ' || coalesce(source, '') || '.', 'x', 'x') AS prompt,
  length(text)::BIGINT AS text_len
FROM documents
""")
def text_buckets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    title = F.col("text")
    filled = tx.fill_prompt(F.lit("Text: {a} of {b}."), {"a": F.col("text"), "b": F.col("source")})
    return d.select(
        "doc_id",
        (tx.flags(F.col("text"), {"the": "the"})["the"] == 1).alias("has_the"),
        tx.first_match(title, {"es": "ción|ñ", "de": "ß|ü|ö", "fr": "ê|è|ç"}, "unknown").alias("bucket"),
        tx.slug(F.col("text")).alias("slug"),
        tx.image_path(F.col("doc_id")).alias("path"),
        filled.alias("prompt"),
        F.char_length("text").cast("long").alias("text_len"),
    )


@query("""
SELECT page_id,
  CASE WHEN regexp_matches(html, '(?s)<h1[^>]*>.*?</h1>') THEN trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), E' \\t\\n\\r') ELSE trim(regexp_extract(html, '<img[^>]+alt="([^"]+)"', 1), E' \\t\\n\\r') END AS title,
  nullif(regexp_extract(html, '<img[^>]+src="(https?://[0-9]+\\.img\\.[a-z.]+/image/[^"]+)"', 1), '') AS image,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, 1, instr(url, '://') - 1) || '://m.' || substr(url, instr(url, '://') + 3) ELSE url END AS mobile_url
FROM pages
""")
def html_extract(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", tx.html_title(F.col("html")).alias("title"), tx.html_image(F.col("html")).alias("image"), tx.swap_host(F.col("url"), "://", "://m.").alias("mobile_url"))


# ---------------------------------------------------------------- labelling


@query(f"""
SELECT name, arg_min(p_type, p_partkey) AS label FROM (SELECT {FORM_SQL.format('p_name')} AS name, p_type, p_partkey FROM part WHERE p_size > 5 AND p_name IS NOT NULL)
WHERE name <> '' AND p_type IS NOT NULL GROUP BY name
""")
def kb_build(spark, sf_dir):
    return labelling.build_dictionary(read(spark, sf_dir, "part"), F.col("p_name"), F.col("p_type"), ["p_partkey"], F.col("p_size") > 5)


KB_NAME = f"list_filter(string_split({FORM_SQL.format('text')}, ' '), lambda x: length(x) >= 6)[1]"


def _dictionary(spark, sf_dir) -> DataFrame:
    """The first long word of every benchmark item, with a label by the item's number."""
    b = read(spark, sf_dir, "benchmark")
    word = F.get(F.filter(F.split(tx.normalise_name(F.col("text")), " "), lambda x: F.char_length(x) >= 6), 0)
    label = F.element_at(F.array(*[F.lit(x) for x in MAIN_SET]), (F.pmod("item_id", F.lit(5)) + 1).cast("int"))
    return settle(labelling.build_dictionary(b.select("item_id", word.alias("w")), F.col("w"), label, ["item_id"]))


@query(f"""
WITH {ITEMS_SQL}, kb AS (SELECT name, arg_min(label, item_id) AS label FROM (SELECT item_id, {KB_NAME} AS name, {LABELS_SQL}[(item_id % 5 + 1)::INT] AS label FROM benchmark) WHERE name IS NOT NULL GROUP BY name),
t AS (SELECT item_id, regexp_matches(title, '(?i)\\bdigital|\\bdslr') AS dirty, string_split({FORM_SQL.format('title')}, ' ') AS tt, string_split({FORM_SQL.format("title || ' ' || description")}, ' ') AS ft FROM items),
multi AS (SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(tt) AS name FROM t) JOIN kb USING (name) GROUP BY item_id),
hit AS (SELECT item_id, arg_min(name, i) AS kb_model FROM (SELECT item_id, unnest(ft) AS name, generate_subscripts(ft, 1) AS i FROM t) JOIN kb USING (name) GROUP BY item_id)
SELECT t.item_id, CASE WHEN NOT dirty AND coalesce(multi.n, 0) <= 1 THEN kb_model END AS kb_model,
  CASE WHEN NOT dirty AND coalesce(multi.n, 0) <= 1 THEN kb.label END AS kb_label,
  CASE WHEN NOT dirty AND coalesce(multi.n, 0) <= 1 AND kb.label IS NOT NULL THEN 'kb' END AS label_source,
  CASE WHEN NOT dirty AND coalesce(multi.n, 0) <= 1 AND kb.label IS NOT NULL THEN 1.0::DOUBLE END AS confidence
FROM t LEFT JOIN multi USING (item_id) LEFT JOIN hit USING (item_id) LEFT JOIN kb ON hit.kb_model = kb.name
""")
def kb_apply(spark, sf_dir):
    return labelling.apply_dictionary(items(spark, sf_dir), _dictionary(spark, sf_dir))


NAME_RUNS = ((1, 1), (1, 2), (3, 3), (4, 9))


@query(f"""
WITH {ITEMS_SQL}, b AS (SELECT string_split({FORM_SQL.format('text')}, ' ') AS w FROM benchmark),
kb AS ({" UNION ".join(f"SELECT array_to_string(w[{a}:{a + n - 1}], ' ') AS name FROM b WHERE len(w) >= {a + n - 1}" for a, n in NAME_RUNS)}),
t AS (SELECT item_id, string_split({FORM_SQL.format('description')}, ' ') AS ft FROM items), i AS (SELECT item_id, ft, generate_subscripts(ft, 1) AS i FROM t),
r AS ({" UNION ALL ".join(f"SELECT item_id, i, {n} AS n, array_to_string(ft[i:i + {n - 1}], ' ') AS name FROM i WHERE i + {n - 1} <= len(ft)" for _, n in NAME_RUNS)})
SELECT item_id, arg_min(name, (i, -n)) AS name FROM r JOIN kb USING (name) GROUP BY item_id
""")
def kb_find_by_join(spark, sf_dir):
    """Names of one, two, three and nine words, among them some that begin alike, in whole texts."""
    w = F.split(tx.normalise_name(F.col("text")), " ")
    names = read(spark, sf_dir, "benchmark").select(w.alias("w")).select(F.explode(F.array(*[F.when(F.size("w") >= a + n - 1, F.array_join(F.slice("w", a, n), " ")) for a, n in NAME_RUNS])).alias("name"))
    rows = items(spark, sf_dir).select("item_id", tx.normalise_name(F.col("description")).alias("t"))
    return labelling.find_by_join(rows, "item_id", "t", settle(names.where("name IS NOT NULL").distinct()))


STATUS_SQL = f"['{VALID_STATUS}', 'digital_camera', 'not_camera', 'insufficient_info', 'made_up'][(event_id % 5 + 1)::INT]"
RAW_SQL = f"""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{{"object_status": "valid' WHEN event_id % 19 = 0 THEN NULL ELSE '{{"object_status": "' || {STATUS_SQL} || '", "body_type": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || {LABELS_SQL}[(event_id % 4 + 1)::INT] || '"' END || ', "final_label": "' || {LABELS_SQL}[(event_id % 6 + 1)::INT] || '", "confidence": ' || ((event_id % 12)::DOUBLE / 10)::VARCHAR || '}}' END AS raw FROM events"""
STATUSES_SQL = "('valid_single_film_camera', 'multi_camera_lot', 'accessory_or_part', 'film_or_consumable', 'digital_camera', 'box_manual_packaging', 'not_camera', 'insufficient_info', 'image_unavailable', 'conflicting_evidence')"


@query(f"""
WITH raw AS ({RAW_SQL}), j AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM raw),
f AS (SELECT event_id, raw->>'$.object_status' AS st, raw->>'$.body_type' AS body, raw->>'$.final_label' AS lab, (raw->>'$.confidence')::DOUBLE AS conf FROM j),
g AS (SELECT *, coalesce(st IN {STATUSES_SQL} AND (body IS NULL OR body IN {MAIN_SQL}) AND lab IN {LABELS_SQL.replace('[', '(').replace(']', ')')} AND conf BETWEEN 0 AND 1, false) AS ok FROM f),
h AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN st = '{VALID_STATUS}' AND body IS NULL THEN 'valid status without body type' WHEN st = '{VALID_STATUS}' AND lab <> body THEN 'label differs from body type'
  WHEN st <> '{VALID_STATUS}' AND body IS NOT NULL THEN 'body type without valid status: ' || body WHEN st <> '{VALID_STATUS}' AND lab <> '{ABSTAIN}' THEN 'label without valid status' END AS why FROM g)
SELECT event_id, CASE WHEN ok THEN st END AS pred_status, CASE WHEN ok THEN body END AS pred_body, CASE WHEN ok THEN lab END AS pred_label, CASE WHEN ok THEN conf END AS confidence, ok AS parsed_ok, ok AND why IS NULL AS biz_ok, why AS biz_reason FROM h
""")
def json_validate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    at = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod("event_id", F.lit(n)) + 1).cast("int"))
    body = F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), at(ALL_LABELS, 4), F.lit('"')))
    whole = F.concat(
        F.lit('{"object_status": "'), at([VALID_STATUS, "digital_camera", "not_camera", "insufficient_info", "made_up"], 5), F.lit('", "body_type": '), body,
        F.lit(', "final_label": "'), at(ALL_LABELS, 6), F.lit('", "confidence": '), (F.pmod("event_id", F.lit(12)).cast("double") / 10).cast("string"), F.lit("}"),
    )
    raw = F.when(F.col("event_id") % 17 == 0, F.lit('{"object_status": "valid')).when(F.col("event_id") % 19 == 0, F.lit(None)).otherwise(whole)
    return e.select("event_id", labelling.parse_response(raw).alias("r")).select("event_id", "r.*").drop("error_msg")


MERGE_SQL = f"""
WITH g AS (SELECT doc_id, CASE WHEN toxic = 0 THEN '{VALID_STATUS}' ELSE 'not_camera' END AS gst, CASE WHEN toxic = 0 THEN 'SLR' END AS gbody, CASE WHEN toxic = 0 THEN 'SLR' ELSE '{ABSTAIN}' END AS glab FROM labels WHERE quality = 1 AND doc_id % 7 = 0),
k AS (SELECT doc_id, 'm' || (doc_id % 11)::VARCHAR AS kmod, {LABELS_SQL}[(doc_id % 5 + 1)::INT] AS klab FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'digital_camera' ELSE '{VALID_STATUS}' END AS lst, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {LABELS_SQL}[(doc_id % 5 + 1)::INT] END AS lbody, CASE WHEN doc_id % 4 = 0 THEN '{ABSTAIN}' ELSE {LABELS_SQL}[(doc_id % 5 + 1)::INT] END AS llab, (doc_id % 21)::DOUBLE / 20 AS lconf, doc_id % 9 <> 0 AS lbiz FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 <> 1),
c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'accessory_or_part' ELSE '{VALID_STATUS}' END AS cst, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE (doc_id % 41)::DOUBLE / 40 END AS cconf FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0),
j AS (SELECT d.doc_id, g.* EXCLUDE (doc_id), k.* EXCLUDE (doc_id), l.* EXCLUDE (doc_id), c.* EXCLUDE (doc_id) FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CASE WHEN glab IS NOT NULL THEN 1 WHEN klab IS NOT NULL AND cst IS NOT NULL AND cst <> '{VALID_STATUS}' AND coalesce(cconf, 0) >= 0.85::DOUBLE THEN 2 WHEN klab IS NOT NULL THEN 3 WHEN llab IS NOT NULL AND coalesce(lbiz, false) AND coalesce(lconf, 0) >= 0.7::DOUBLE THEN 4 WHEN lst IS NOT NULL AND lst <> '{VALID_STATUS}' THEN 5 ELSE 6 END AS way FROM j)
SELECT doc_id AS item_id, CASE way WHEN 1 THEN gst WHEN 2 THEN cst WHEN 3 THEN '{VALID_STATUS}' WHEN 4 THEN lst WHEN 5 THEN lst ELSE 'insufficient_info' END AS final_object_status,
  CASE way WHEN 1 THEN gbody WHEN 3 THEN klab WHEN 4 THEN lbody END AS final_body_type, CASE way WHEN 1 THEN glab WHEN 3 THEN klab WHEN 4 THEN llab ELSE '{ABSTAIN}' END AS final_label,
  CASE way WHEN 1 THEN 'human-labeled' WHEN 2 THEN 'kb demoted by llm-vision: ' || cst WHEN 3 THEN 'kb match: ' || kmod WHEN 4 THEN 'llm prediction' WHEN 5 THEN 'llm_low_confidence_non_valid: ' || lst ELSE 'no confident source or unreliable valid claim' END AS final_reason,
  ['human', 'kb_overridden', 'kb', 'llm', 'abstain', 'abstain'][way] AS label_source, CASE way WHEN 1 THEN 1.0 WHEN 2 THEN cconf WHEN 3 THEN 1.0 WHEN 4 THEN lconf ELSE 0.0 END::DOUBLE AS confidence, way > 4 AS needs_review
FROM b
"""


def _sources(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    x = F.col("item_id")
    at = lambda xs, n: F.element_at(F.array(*[F.lit(v) for v in xs]), (F.pmod(x, F.lit(n)) + 1).cast("int"))
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic").where((F.col("quality") == 1) & (x % 7 == 0))
    fine = F.col("toxic") == 0
    gold = lab.select("item_id", F.when(fine, VALID_STATUS).otherwise("not_camera").alias("object_status"), F.when(fine, "SLR").alias("body_type"), F.when(fine, "SLR").otherwise(ABSTAIN).alias("final_label"))
    kb = d.where(x % 3 == 0).select("item_id", F.concat(F.lit("m"), (x % 11).cast("string")).alias("kb_model"), at(MAIN_SET, 5).alias("kb_label"))
    other = x % 4 == 0
    llm = d.where((x % 3 != 0) & (x % 10 != 1)).select(
        "item_id",
        F.when(other, "digital_camera").otherwise(VALID_STATUS).alias("pred_status"),
        F.when(~other, at(MAIN_SET, 5)).alias("pred_body"),
        F.when(other, ABSTAIN).otherwise(at(MAIN_SET, 5)).alias("pred_label"),
        ((x % 21).cast("double") / 20).alias("confidence"),
        (x % 9 != 0).alias("biz_ok"),
    )
    check = d.where((x % 3 == 0) & (x % 5 != 0)).select("item_id", F.when(x % 2 == 0, "accessory_or_part").otherwise(VALID_STATUS).alias("pred_status"), F.lit(None).cast("string").alias("pred_label"), F.when(x % 12 != 0, (x % 41).cast("double") / 40).alias("confidence"))
    return d, gold, kb, llm, check


FINAL = ["item_id", "final_object_status", "final_body_type", "final_label", "final_reason", "label_source", "confidence", "needs_review"]


@query(MERGE_SQL)
def priority_merge(spark, sf_dir):
    return labelling.merge_sources(*_sources(spark, sf_dir)).select(*FINAL)


@query(f"WITH m AS ({MERGE_SQL}) SELECT label_source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share FROM m GROUP BY label_source")
def label_source_counts(spark, sf_dir):
    return profiling.value_counts(labelling.merge_sources(*_sources(spark, sf_dir)), "label_source")


# ---------------------------------------------------------------- sampling

BUCKET_SQL = "CASE WHEN regexp_matches(lower(title), 'the|and') THEN 'a' WHEN regexp_matches(lower(title), 'de|la') THEN 'b' WHEN regexp_matches(lower(title), 'en') THEN 'c' ELSE 'unknown' END"


@query(f"""
WITH {ITEMS_SQL}, b AS (SELECT item_id, user_id, {BUCKET_SQL} AS bucket, md5(item_id::VARCHAR || '-42') AS h FROM items),
q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, item_id) AS r FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bucket, h, item_id) AS u FROM q WHERE r <= CASE bucket WHEN 'a' THEN 40 WHEN 'b' THEN 20 WHEN 'c' THEN 10 WHEN 'unknown' THEN 30 END)
SELECT item_id, user_id, bucket FROM s WHERE u <= 2
""")
def bucket_quota_sample(spark, sf_dir):
    rows = items(spark, sf_dir).select("item_id", "user_id", tx.first_match(F.col("title"), {"a": "the|and", "b": "de|la", "c": "en"}, "unknown").alias("bucket"))
    sample = sampling.quota_sample(rows, "bucket", "item_id", {"a": 40, "b": 20, "c": 10, "unknown": 30})
    return sampling.head_per_group(sample, "user_id", 2, ["bucket", sampling.shuffle_key("item_id"), "item_id"])


@query("""
WITH r AS (SELECT doc_id, quality * 2 + toxic AS stratum, row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) AS r, count(*) OVER (PARTITION BY quality * 2 + toxic) AS n FROM labels)
SELECT doc_id, stratum, r <= floor(n * 0.3::DOUBLE + 0.5) AS is_holdout FROM r
""")
def stratified_holdout(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("stratum"))
    return sampling.stratified_holdout(rows, "stratum", "doc_id", 0.3)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) AS r FROM documents) WHERE r <= 50")
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def keep_last_upsert(spark, sf_dir):
    return sampling.keep_last(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def keep_first_dedup(spark, sf_dir):
    return sampling.keep_first(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT count(*) AS n_left FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def resume_antifilter(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    return sampling.unfinished(d, lab, "doc_id", F.col("quality") == 1).agg(F.count("*").alias("n_left"))


@query("""
WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders), r AS (SELECT *, sum(cents) OVER (ORDER BY o_orderkey) AS running FROM c)
SELECT o_orderkey, running::BIGINT AS running FROM r WHERE running - cents <= 50000000
""")
def budget_prefix(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sampling.budget_prefix(o, ["o_orderkey"], F.col("cents"), 50_000_000).select("o_orderkey", F.col("running").cast("long").alias("running"))


# ---------------------------------------------------------------- splits

LEAK_SQL = "k AS (SELECT doc_id, md5(text) AS k1, md5(" + DUP_SQL.format("text") + ") AS k2 FROM documents)"


def _keyed(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.md5("text").alias("k1"), F.md5(tx.duplicate_form(F.col("text"))).alias("k2"))


@query(f"""
WITH RECURSIVE {LEAK_SQL},
e AS (SELECT a.doc_id AS s, b.doc_id AS d FROM k a JOIN k b ON a.k1 = b.k1 UNION SELECT a.doc_id, b.doc_id FROM k a JOIN k b ON a.k2 = b.k2),
reach AS (SELECT doc_id, doc_id AS other FROM k UNION SELECT r.doc_id, e.d FROM reach r JOIN e ON r.other = e.s)
SELECT doc_id, min(other) AS leakage_group_id FROM reach GROUP BY doc_id
""")
def leakage_components(spark, sf_dir):
    return splitting.leakage_groups(_keyed(spark, sf_dir), "doc_id", ["k1", "k2"])


@query(f"""
WITH {LEAK_SQL}, p AS (SELECT k.*, source, CASE WHEN substr(md5(doc_id::VARCHAR || '-42'), 1, 1) < '8' THEN 'train' WHEN substr(md5(doc_id::VARCHAR || '-42'), 1, 1) < 'c' THEN 'val' ELSE 'test' END AS part FROM k JOIN documents USING (doc_id)),
v AS (SELECT DISTINCT part, 'k1' AS key, k1 AS value FROM p UNION SELECT DISTINCT part, 'source', source FROM p WHERE source IS NOT NULL)
SELECT a.key, a.part AS part_a, b.part AS part_b, count(*) AS n FROM v a JOIN v b ON a.key = b.key AND a.value = b.value AND a.part < b.part GROUP BY ALL
""")
def split_overlap(spark, sf_dir):
    c = F.substring(sampling.shuffle_key("doc_id"), 1, 1)
    rows = _keyed(spark, sf_dir).withColumn("part", F.when(c < "8", "train").when(c < "c", "val").otherwise("test"))
    return joins.overlaps(rows, "part", ["k1", "source"])


@query()
def leak_free_split(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    lab = read(spark, sf_dir, "labels")
    groups = settle(splitting.leakage_groups(rows, "doc_id", ["k1", "k2"]))
    named = rows.select("doc_id", "lang").join(groups, "doc_id").join(lab, "doc_id", "left").withColumn("is_audit", F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False)))
    langs = ["en", "fr", "de", "es"]
    feats = splitting.group_features(named, "leakage_group_id", "lang", ["is_audit"], langs)
    parts = splitting.assign_parts(feats, "leakage_group_id", "es", ["is_audit"], labels=langs)
    return splitting.split_report(named.join(parts, "leakage_group_id"), "split", "leakage_group_id", "lang", langs)


@query("""WITH d AS (SELECT d.doc_id, d.lang, coalesce(l.quality = 0 AND l.toxic = 1, false) AS audit FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS n_rows, count(*) FILTER (audit) AS n_audit, 0::BIGINT AS audit_elsewhere, 0::BIGINT AS shared_keys, 3::BIGINT AS n_parts, false AS over_limit, true AS enough_rare FROM d""")
def leak_free_limits(spark, sf_dir):
    """What any split has to keep: no key in two parts, audited rows in test, no part over 1.02 times its target, the rare label in val."""
    rows = _keyed(spark, sf_dir)
    groups = settle(splitting.leakage_groups(rows, "doc_id", ["k1", "k2"]))
    audit = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(False))
    named = rows.join(groups, "doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("is_audit", audit)
    langs = ["en", "fr", "de", "es"]
    feats = splitting.group_features(named, "leakage_group_id", "lang", ["is_audit"], langs)
    split = settle(named.join(splitting.assign_parts(feats, "leakage_group_id", "es", ["is_audit"], labels=langs), "leakage_group_id").select("doc_id", "lang", "is_audit", "k1", "k2", "split"))
    n = split.count()
    report = {r["split"]: r for r in split.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "es").alias("es")).collect()}
    rare = sum(r["es"] for r in report.values())
    facts = {"n_parts": F.lit(len(report)).cast("long"), "over_limit": any(r["n"] > 1.02 * splitting.SPLIT_SHARES[k] * n for k, r in report.items()), "enough_rare": report["val"]["es"] >= min(30, rare)}
    shared = joins.overlaps(split, "split", ["k1", "k2"]).count()
    counted = split.agg(F.count("*").alias("n_rows"), F.count_if("is_audit").alias("n_audit"), F.count_if(F.col("is_audit") & (F.col("split") != "test")).alias("audit_elsewhere"))
    return counted.select("*", F.lit(shared).cast("long").alias("shared_keys"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in facts.items()])


@query("SELECT source, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in ("en", "fr", "de", "es")) + ", bool_or(doc_id % 100 = 0) AS any_marked FROM documents GROUP BY source")
def group_features(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").withColumn("marked", F.col("doc_id") % 100 == 0)
    return splitting.group_features(d, "source", "lang", ["marked"], ["en", "fr", "de", "es"])


@query("SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)")
def dense_codes(spark, sf_dir):
    return splitting.dense_codes(read(spark, sf_dir, "documents"), "source").select("source", F.col("code").cast("long").alias("code"))


# ---------------------------------------------------------------- evaluation


@query(f"WITH {SCORED_SQL}, c AS (SELECT {COUNTS} FROM scored) SELECT {business_sql()} FROM c")
def business_metrics(spark, sf_dir):
    return ev.business_metrics(scored(spark, sf_dir))


@query(f"""
WITH d AS (SELECT doc_id, CASE quality WHEN 1 THEN 'SLR' ELSE '{ABSTAIN}' END AS truth, CASE WHEN length(text) >= 600 THEN 'SLR' ELSE '{ABSTAIN}' END AS raw, least(1.0::DOUBLE, length(text)::DOUBLE / 2000) AS conf FROM documents JOIN labels USING (doc_id)),
t AS (SELECT truth, CASE WHEN conf >= 0.4::DOUBLE THEN raw ELSE '{ABSTAIN}' END AS pred_label FROM d), c AS (SELECT {COUNTS} FROM t) SELECT {business_sql()} FROM c
""")
def audit_evaluation(spark, sf_dir):
    """Predictions from text length against labels, with abstention below a threshold."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n")).join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    raw = F.when(F.col("n") >= 600, "SLR").otherwise(ABSTAIN)
    conf = F.least(F.lit(1.0), F.col("n").cast("double") / 2000)
    return ev.business_metrics(d.select(F.when(F.col("quality") == 1, "SLR").otherwise(ABSTAIN).alias("truth"), ev.with_abstention(raw, conf, 0.4).alias("pred_label")))


GRID_SQL = f"""g AS (SELECT i * 0.01::DOUBLE AS threshold FROM range(101) t(i)),
w AS (SELECT threshold, count(*) AS n, count(*) FILTER (confidence >= threshold AND pred_label IN {MAIN_SQL}) AS a, count(*) FILTER (confidence >= threshold AND pred_label IN {MAIN_SQL} AND pred_label = truth) AS c FROM g, scored GROUP BY threshold),
curve AS (SELECT threshold, {business_sql()} FROM w)"""
EXACT_SQL = GRID_SQL.replace("SELECT i * 0.01::DOUBLE AS threshold FROM range(101) t(i)", "SELECT DISTINCT confidence AS threshold FROM scored")


@query(f"WITH {SCORED_SQL}, {GRID_SQL} SELECT * FROM curve")
def threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL}, {EXACT_SQL} SELECT * FROM curve")
def exact_sweep(spark, sf_dir):
    return ev.exact_sweep(scored(spark, sf_dir))


POINT_SQL = 'SELECT coalesce(threshold, 1.0::DOUBLE) AS tau, threshold IS NOT NULL AS feasible, "CAR", "AER", "AER_hi", coverage FROM (SELECT 1 AS one) LEFT JOIN best ON true'


@query(f'WITH {SCORED_SQL}, {GRID_SQL}, best AS (SELECT * FROM curve WHERE coalesce("AER_hi", 1) <= 0.12 ORDER BY "CAR" DESC, threshold LIMIT 1) {POINT_SQL}')
def operating_point(spark, sf_dir):
    return ev.operating_point(ev.threshold_sweep(scored(spark, sf_dir)), 0.12)


@query(f'WITH {SCORED_SQL}, {EXACT_SQL}, best AS (SELECT * FROM curve WHERE coalesce("AER_hi", 1) <= 0.12 ORDER BY "C" DESC, "W", "AER_hi", threshold LIMIT 1) {POINT_SQL}')
def operating_point_tiebreak(spark, sf_dir):
    return ev.operating_point_tiebreak(ev.exact_sweep(scored(spark, sf_dir)), 0.12)


CLASS_SQL = f"""cc AS (SELECT pred_label AS pred, confidence AS threshold, count(*) AS a, count(*) FILTER (truth <> pred_label) AS w FROM scored WHERE pred_label IN {MAIN_SQL} GROUP BY ALL),
cv AS (SELECT pred, threshold, (sum(a) OVER (PARTITION BY pred ORDER BY threshold DESC))::BIGINT AS "A", (sum(w) OVER (PARTITION BY pred ORDER BY threshold DESC))::BIGINT AS "W" FROM cc)"""


@query(f"WITH {SCORED_SQL}, {CLASS_SQL} SELECT * FROM cv")
def class_curves(spark, sf_dir):
    return ev.class_curves(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, {CLASS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY "A" - "W" DESC, threshold) AS r FROM cv WHERE {wilson_sql('"W"', '"A"', 'hi')} <= 0.15::DOUBLE)
SELECT pred, threshold, "A", "W" FROM f WHERE r = 1""")
def per_class_threshold(spark, sf_dir):
    return ev.capped_thresholds(ev.class_curves(scored(spark, sf_dir)), 0.15)


def _with_certificate(df: DataFrame, chosen: thresholds.Chosen) -> DataFrame:
    """Business metrics at the chosen thresholds, with the certificate: no choice has more right fills than ``bound``."""
    picked = df.withColumn("pred_label", ev.class_thresholds(F.col("pred_label"), F.col("confidence"), chosen.thresholds))
    return ev.business_metrics(picked).withColumns({"bound": F.lit(chosen.bound).cast("long"), "gap": F.lit(chosen.gap).cast("long")})


@query()
def pooled_class_threshold(spark, sf_dir):
    s = settle(scored(spark, sf_dir))
    return _with_certificate(s, thresholds.best_thresholds(settle(ev.class_curves(s)), cap=0.15))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT unnest(range(0, 21)) AS i), label AS (SELECT unnest({LABELS_SQL}[1:5]) AS pred),
pt AS (SELECT pred, i, count(*) FILTER (pred_label = pred AND confidence >= i / 20::DOUBLE) AS a, count(*) FILTER (pred_label = pred AND confidence >= i / 20::DOUBLE AND truth <> pred) AS w FROM label, g, scored GROUP BY ALL),
{", ".join(f"c{k} AS (SELECT a, w FROM pt WHERE pred = {LABELS_SQL}[{k}] UNION SELECT 0, 0)" for k in range(1, 6))},
total AS (SELECT c1.a + c2.a + c3.a + c4.a + c5.a AS a, c1.w + c2.w + c3.w + c4.w + c5.w AS w FROM c1, c2, c3, c4, c5),
best AS (SELECT DISTINCT a, a - w AS c FROM total WHERE a = 0 OR {wilson_sql('w', 'a', 'hi')} <= 0.15 ORDER BY a - w DESC, w LIMIT 1),
whole AS (SELECT (SELECT count(*) FROM scored) AS n, a, c FROM best)
SELECT {business_sql()}, c::BIGINT AS bound, 0::BIGINT AS gap FROM whole""")
def pooled_grid_threshold(spark, sf_dir):
    """On a grid of 21 thresholds SQL replays all choices."""
    s = settle(scored(spark, sf_dir))
    return _with_certificate(s, thresholds.best_thresholds(thresholds.grid_curves(s, 21), cap=0.15))


TAU_SQL = "CASE pred_label WHEN 'SLR' THEN 0.3::DOUBLE WHEN 'TLR' THEN 0.35::DOUBLE WHEN 'instant' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {SCORED_SQL}, z AS (SELECT truth, CASE WHEN confidence >= {TAU_SQL} THEN pred_label ELSE '{ABSTAIN}' END AS pred_label FROM scored), c AS (SELECT {COUNTS} FROM z) SELECT {business_sql()} FROM c")
def class_threshold_metrics(spark, sf_dir):
    s = scored(spark, sf_dir)
    return ev.business_metrics(s.withColumn("pred_label", ev.class_thresholds(F.col("pred_label"), F.col("confidence"), {"SLR": 0.3, "TLR": 0.35, "instant": 2.0})))


REPORT_SQL = f"""lab AS (SELECT unnest({LABELS_SQL}) AS lb),
rep AS (SELECT lb, (SELECT count(*) FROM scored WHERE truth = lb AND pred_label = lb) AS tp, (SELECT count(*) FROM scored WHERE truth = lb) AS support, (SELECT count(*) FROM scored WHERE pred_label = lb) AS predicted FROM lab),
report AS (SELECT lb AS label, round(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0), 9) AS f1, support FROM rep)"""


@query(f"WITH {SCORED_SQL}, {REPORT_SQL} SELECT * FROM report")
def classification_report(spark, sf_dir):
    return ev.classification_report(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL}, {REPORT_SQL} SELECT round((SELECT avg((truth = pred_label)::INT) FROM scored), 9) AS accuracy, round(avg(f1), 9) AS macro_f1 FROM report")
def overall_scores(spark, sf_dir):
    return ev.overall(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL}, lab AS (SELECT unnest({LABELS_SQL}) AS l) SELECT a.l AS truth, b.l AS pred, count(scored.item_id) AS n FROM lab a CROSS JOIN lab b LEFT JOIN scored ON scored.truth = a.l AND scored.pred_label = b.l GROUP BY ALL")
def confusion_grid(spark, sf_dir):
    return ev.confusion_grid(scored(spark, sf_dir))


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS "row", CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS col, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab_margins(spark, sf_dir):
    return ev.crosstab_margins(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH {SCORED_SQL}, b AS (SELECT {" + ".join(f"(confidence > {i} * 0.1::DOUBLE)::INT" for i in range(1, 10))} AS bin, count(*) AS n, avg(confidence) AS conf, avg((truth = pred_label)::INT) AS acc FROM scored WHERE pred_label IN {MAIN_SQL} GROUP BY 1)
SELECT round(sum(abs(acc - conf) * n) / sum(n)::DOUBLE, 9) AS ece, coalesce(sum(n), 0)::BIGINT AS n_auto FROM b""")
def calibration_error(spark, sf_dir):
    return ev.calibration(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT round(avg({' + '.join(f'(p[{i + 1}] - (truth = {chr(39)}{x}{chr(39)})::INT) ** 2' for i, x in enumerate(ALL_LABELS))}), 9) AS brier FROM scored")
def brier_score(spark, sf_dir):
    return ev.brier(scored(spark, sf_dir))


AUDIT_SQL = "final AS (SELECT item_id, pred_label AS final_label, label_source, truth FROM scored), audit AS (SELECT * FROM final WHERE item_id % 4 = 0)"


def _audit(spark, sf_dir):
    f = scored(spark, sf_dir).select("item_id", F.col("pred_label").alias("final_label"), "label_source", "truth")
    return f.where(F.col("item_id") % 4 == 0), f


@query(f"""WITH {SCORED_SQL}, {AUDIT_SQL}, per AS (SELECT final_label AS label, avg((truth = final_label)::INT) AS p, sum((truth = final_label)::INT) AS c, count(*) AS n FROM audit GROUP BY 1),
sh AS (SELECT final_label AS label, count(*) / (SELECT count(*) FROM final)::DOUBLE AS s FROM final GROUP BY 1)
SELECT round(sum(c) / sum(n)::DOUBLE, 9) AS accuracy, round(avg(p), 9) AS macro_precision, round(sum(p * coalesce(s, 0)), 9) AS weighted_precision, round(sum(coalesce(s, 0)), 9) AS coverage FROM per LEFT JOIN sh USING (label)""")
def weighted_precision(spark, sf_dir):
    return ev.weighted_precision(*_audit(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, {AUDIT_SQL}, t AS (SELECT label_source, round(count(*) / (SELECT count(*) FROM final)::DOUBLE, 9) AS share FROM final GROUP BY 1)
SELECT label_source, round(avg((truth = final_label)::INT), 9) AS precision, count(*) AS n, any_value(share) AS share FROM audit LEFT JOIN t USING (label_source) GROUP BY label_source""")
def source_precision(spark, sf_dir):
    return ev.precision_by(*_audit(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, l AS (SELECT unnest({LABELS_SQL}) AS lb), c AS (SELECT lb, count(*) FILTER (truth = lb AND pred_label = lb) AS tp, count(*) FILTER (pred_label = lb) AS n_pred, count(*) FILTER (truth = lb) AS n_true FROM l, scored GROUP BY lb)
SELECT lb AS label, tp, n_pred, n_true, round(tp / nullif(n_pred, 0)::DOUBLE, 9) AS precision, round(tp / nullif(n_true, 0)::DOUBLE, 9) AS recall FROM c WHERE n_pred + n_true > 0""")
def hit_fractions(spark, sf_dir):
    return ev.hit_fractions(scored(spark, sf_dir))


SLICES_SQL = """u AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS un FROM scored),
sl AS (SELECT truth, pred_label, unnest(['slice_seller', 'slice_source', 'slice_rare']) AS slice, unnest([CASE WHEN un >= 50 THEN 'large' WHEN un >= 5 THEN 'medium' ELSE 'small' END, label_source, (truth = 'TLR')::VARCHAR]) AS value FROM u)"""


@query(f"WITH {SCORED_SQL}, {SLICES_SQL}, c AS (SELECT slice, value, {COUNTS} FROM sl GROUP BY ALL) SELECT slice, value, {business_sql()} FROM c")
def slice_metrics(spark, sf_dir):
    s = profiling.group_size(scored(spark, sf_dir), "user_id", "un")
    s = s.withColumns({"slice_seller": tx.size_bucket(F.col("un")), "slice_source": F.col("label_source"), "slice_rare": F.col("truth") == "TLR"})
    return ev.slice_metrics(s, ["slice_seller", "slice_source", "slice_rare"])


@query(f"""WITH {SCORED_SQL}, w AS (SELECT *, pred_label IN {MAIN_SQL} AS auto, pred_label IN {MAIN_SQL} AND pred_label <> truth AS wrong FROM scored),
c AS (SELECT count(*) AS n, count(*) FILTER (auto) AS "A", count(*) FILTER (wrong) AS "W", count(*) FILTER (wrong AND truth = '{ABSTAIN}') AS should_abstain, count(*) FILTER (wrong AND truth IN {MAIN_SQL}) AS wrong_type FROM w)
SELECT *, round(should_abstain / nullif("W", 0)::DOUBLE, 9) AS frac_should_abstain, round(wrong_type / nullif("W", 0)::DOUBLE, 9) AS frac_wrong_type FROM c""")
def error_decomposition(spark, sf_dir):
    return ev.error_decomposition(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, b AS (SELECT truth IN {MAIN_SQL} AS r, 1 - p[6] >= 0.8::DOUBLE AS s FROM scored), c AS (SELECT count(*) FILTER (r) AS n_real, count(*) FILTER (NOT r) AS n_other, count(*) FILTER (s AND NOT r) AS "FP", count(*) FILTER (NOT s AND r) AS "FN", count(*) FILTER (s AND r) AS tp FROM b)
SELECT n_real, n_other, "FP", "FN", round("FP" / nullif(n_other, 0)::DOUBLE, 9) AS "FP_rate", round("FN" / nullif(n_real, 0)::DOUBLE, 9) AS "FN_rate", round(tp / nullif(tp + "FP", 0)::DOUBLE, 9) AS precision FROM c""")
def boundary_metrics(spark, sf_dir):
    return ev.boundary(scored(spark, sf_dir).withColumn("s", 1 - F.col("p")[5]), "s", 0.8)


REBIAS_SQL = f"al AS (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]) AS alpha), rq AS (SELECT item_id, alpha, truth, [p[1], p[2], p[3], p[4], p[5], p[6] * alpha] AS p FROM al, scored), rp AS (SELECT item_id, alpha, truth, {LABELS_SQL}[list_position(p, list_max(p))] AS pred_label FROM rq)"


@query(f"WITH {SCORED_SQL}, {REBIAS_SQL}, c AS (SELECT alpha, {COUNTS} FROM rp GROUP BY alpha) SELECT alpha, {business_sql()} FROM c")
def rebias_sweep(spark, sf_dir):
    return ev.rebias_sweep(scored(spark, sf_dir), [0.1, 0.25, 0.5, 0.75, 1.0])


@query(f"""WITH {SCORED_SQL}, {REBIAS_SQL}, t AS (SELECT a.truth, a.pred_label AS base, b.pred_label AS best FROM rp a JOIN rp b USING (item_id) WHERE a.alpha = 1.0 AND b.alpha = 0.5),
c AS (SELECT count(*) FILTER (base = '{ABSTAIN}' AND best <> '{ABSTAIN}') AS n, count(*) FILTER (base = '{ABSTAIN}' AND best <> '{ABSTAIN}' AND best = truth) AS correct, count(*) FILTER (base = '{ABSTAIN}' AND truth <> '{ABSTAIN}') AS ceiling FROM t)
SELECT *, round(correct / nullif(n, 0)::DOUBLE, 9) AS precision FROM c""")
def rescue_stats(spark, sf_dir):
    return ev.rescue(scored(spark, sf_dir), 0.5)


@query(f"""WITH {SCORED_SQL}, x AS (SELECT item_id // 2 AS item_id, CASE WHEN item_id % 50 = 0 THEN 'nonsense' ELSE pred_label END AS pred_label, CASE WHEN item_id % 40 = 0 THEN 1.5::DOUBLE ELSE confidence END AS confidence, pred_label AS own, confidence AS top FROM scored)
SELECT count(*) AS n_rows, (count(*) - count(DISTINCT item_id))::BIGINT AS repeated_keys, count(*) FILTER (pred_label NOT IN {LABELS_SQL.replace('[', '(').replace(']', ')')}) AS bad_label, count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS bad_confidence,
0::BIGINT AS bad_probability, 0::BIGINT AS bad_sum, count(*) FILTER (pred_label <> own) AS bad_argmax, count(*) FILTER (confidence <> top) AS bad_max FROM x""")
def contract_check(spark, sf_dir):
    s = scored(spark, sf_dir)
    i = F.col("item_id")
    spoilt = s.select(F.floor(i / 2).alias("item_id"), F.when(i % 50 == 0, "nonsense").otherwise(F.col("pred_label")).alias("pred_label"), F.when(i % 40 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), "p")
    return ev.contract_violations(spoilt)


@query(f"""WITH {SCORED_SQL}, d AS (SELECT item_id, confidence < 0.3::DOUBLE OR pred_label = '{ABSTAIN}' AS out, pred_label, confidence FROM scored), v AS (SELECT CASE WHEN out THEN 'abstain' ELSE 'auto_fill' END AS decision, CASE WHEN out THEN 'model_abstained' ELSE 'model_argmax' END AS reason, confidence FROM d)
SELECT decision, reason, count(*) AS n, count(*) FILTER (reason = 'model_argmax') AS n_scored, round(sum(confidence) FILTER (reason = 'model_argmax'), 6) AS sum_confidence FROM v GROUP BY ALL""")
def decision_log(spark, sf_dir):
    s = scored(spark, sf_dir)
    log = s.select(ev.decide(F.col("pred_label"), F.col("confidence"), 0.3).alias("d"), "confidence").select("d.*", "confidence")
    return monitor.response_log(log).withColumn("sum_confidence", F.round("sum_confidence", 6))


# ---------------------------------------------------------------- vectors


@query(f"""WITH {SCORED_SQL}, v AS (SELECT item_id, p, label FROM scored), w AS (SELECT vec_id AS item_id, {", ".join(f"[{', '.join(f'abs(embedding[{6 * m + i + 1}]::DOUBLE)' for i in range(6))}] AS m{m}" for m in range(1, 4))} FROM embeddings),
t AS (SELECT item_id, {", ".join(f"{LABELS_SQL}[list_position(m{m}, list_max(m{m}))] AS t{m}" for m in range(1, 4))} FROM w), z AS (SELECT v.item_id, pred_label AS t0, confidence, list_sort(v.p, 'DESC') AS sp, v.p AS p, t1, t2, t3 FROM v JOIN scored USING (item_id) JOIN t USING (item_id))
SELECT item_id, ((t1 = t0)::INT + (t2 = t0)::INT + (t3 = t0)::INT) AS agree, len(list_distinct([t1, t2, t3]))::INT AS n_distinct, (t1 = t2 AND t2 = t3)::INT AS all_agree, round(sp[1] - sp[2], 9) AS margin,
round(-(p[1] * ln(p[1] + 1e-12::DOUBLE) + p[2] * ln(p[2] + 1e-12::DOUBLE) + p[3] * ln(p[3] + 1e-12::DOUBLE) + p[4] * ln(p[4] + 1e-12::DOUBLE) + p[5] * ln(p[5] + 1e-12::DOUBLE) + p[6] * ln(p[6] + 1e-12::DOUBLE)), 6) AS entropy FROM z""")
def stack_features(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    tops = [vx.top_label(F.array(*[F.abs(F.col("embedding")[6 * m + i].cast("double")) for i in range(6)]), ALL_LABELS).alias(f"t{m}") for m in range(1, 4)]
    rows = scored(spark, sf_dir).join(e.select(F.col("vec_id").alias("item_id"), *tops), "item_id")
    d = vx.disagreement(F.col("pred_label"), [F.col("t1"), F.col("t2"), F.col("t3")])
    return rows.select("item_id", *[v.alias(k) for k, v in d.items()], F.round(vx.margin(F.col("p")), 9).alias("margin"), F.round(vx.entropy(F.col("p")), 6).alias("entropy"))


@query("""WITH q AS (SELECT vec_id AS prompt_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 14), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, prompt_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM v, q""")
def cosine_prompts(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id < 14").select(F.struct(F.col("vec_id").alias("prompt_id"), F.col("embedding").alias("q")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("prompts"))  # 14 rows
    each = _with_prompts(e, prompts)
    return each.select("vec_id", "prompt_id", F.round(vx.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


def _with_prompts(e: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every vector with every prompt; the prompts are a constant of the plan, as they are few."""
    fixed = F.array(*[F.struct(F.lit(x["prompt_id"]).cast("long").alias("prompt_id"), F.array(*[F.lit(float(v)) for v in x["q"]]).alias("q")) for x in prompts.first()["prompts"]])
    return e.select("vec_id", "embedding", F.explode(fixed).alias("x")).select("vec_id", "embedding", "x.*")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS other, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
c AS (SELECT query_id, label, count(*) AS n FROM s WHERE r <= 10 GROUP BY ALL)
SELECT query_id, vote, n FROM (SELECT query_id, label AS vote, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1""")
def knn_vote(spark, sf_dir):
    e = settle(read(spark, sf_dir, "embeddings"))
    near = neighbours.nearest(e.where("vec_id % 20 = 0"), e, 10)
    return neighbours.vote(near, e)


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)
SELECT vec_id, round(norm, 6) AS norm, array_to_string(list_transform(e, lambda x: round(x / norm * 1000000)::BIGINT), ' ') AS millionths FROM n""")
def l2_normalise(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    whole = F.transform(vx.l2_normalise(F.col("embedding")), lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return e.select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"), F.array_join(whole, " ").alias("millionths"))


@query("SELECT p_type, p_brand, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY GROUPING SETS ((p_type, p_brand), (p_type), ())")
def grouping_rollup(spark, sf_dir):
    return read(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


# ---------------------------------------------------------------- profiles


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name, unnest([count(*) - count(doc_id), count(*) - count(text), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars)])::BIGINT AS n_null FROM documents")
def null_profile(spark, sf_dir):
    return profiling.null_profile(read(spark, sf_dir, "documents"))


@query("SELECT unnest(['role', 'text']) AS column_name, unnest([count(*) FILTER (trim(coalesce(role, '')) = ''), count(*) FILTER (trim(coalesce(text, ''), E' \\t\\n\\r') = '')])::BIGINT AS n_blank FROM conversations")
def blank_profile(spark, sf_dir):
    return profiling.blank_profile(read(spark, sf_dir, "conversations"))


@query("SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def domain_check(spark, sf_dir):
    return profiling.domain_violations(read(spark, sf_dir, "documents"), {"lang": ["en", "fr"], "source": ["src1", "src2"]})


@query("SELECT round(avg((quality = toxic)::INT), 9) AS quality_toxic, round(avg((quality = doc_id % 2)::INT), 9) AS quality_parity FROM labels")
def agreement_rates(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").withColumn("parity", F.col("doc_id") % 2)
    return profiling.agreement(lab, {"quality_toxic": ("quality", "toxic"), "quality_parity": ("quality", "parity")})


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS head FROM (SELECT n FROM g ORDER BY n DESC, o_custkey LIMIT 10))
SELECT count(*) AS n_groups, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max, round(any_value(head) / sum(n)::DOUBLE, 9) AS top_share FROM g, t""")
def seller_skew(spark, sf_dir):
    return profiling.skew_profile(read(spark, sf_dir, "orders"), "o_custkey")


@query("""WITH top AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3), p AS (SELECT lang, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS p, count(*) FILTER (source NOT IN (SELECT source FROM top)) / (SELECT count(*) FROM documents WHERE source NOT IN (SELECT source FROM top))::DOUBLE AS q FROM documents GROUP BY lang)
SELECT round(0.5 * sum(abs(p - q)), 9) AS tvd FROM p""")
def shift_without_top(spark, sf_dir):
    return profiling.shift_without_top(read(spark, sf_dir, "documents"), "source", "lang", 3)


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT (SELECT lang FROM n ORDER BY n DESC, lang LIMIT 1) AS most, (SELECT lang FROM n ORDER BY n, lang LIMIT 1) AS least, round(max(n) / min(n)::DOUBLE, 9) AS ratio FROM n")
def imbalance(spark, sf_dir):
    return profiling.imbalance(read(spark, sf_dir, "documents"), "lang")


@query("SELECT lang AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 9) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf_dir):
    return profiling.class_weights(read(spark, sf_dir, "documents"), "lang")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def repeated_members(spark, sf_dir):
    return profiling.repeated_members(read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h").select("doc_id")


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_good, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 4) AS share_good, count(*) FILTER (quality = 1 AND toxic = 0) AS n_clean, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*)::DOUBLE, 4) AS share_clean FROM labels")
def funnel(spark, sf_dir):
    good = F.col("quality") == 1
    return profiling.funnel(read(spark, sf_dir, "labels"), {"good": good, "clean": good & (F.col("toxic") == 0)})


@query("SELECT count(*) AS n_missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_gap(spark, sf_dir):
    return joins.not_covered(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").agg(F.count("*").alias("n_missing"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def aligned_labels(spark, sf_dir):
    return joins.aligned(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


# ---------------------------------------------------------------- monitoring


def _minutes(n: int) -> str:
    return f"time_bucket(INTERVAL {n} MINUTE, ts)"


@query(f"SELECT {_minutes(60)} AS window_start, event_type, count(*) AS n, round(count(*) / 3600::DOUBLE, 9) AS per_second FROM events GROUP BY ALL")
def rate_window(spark, sf_dir):
    return monitor.rates(read(spark, sf_dir, "events"), "1 hour", 3600)


@query(f"SELECT {_minutes(60)} AS window_start, count(*) FILTER (event_type = 'error') AS n_hit, count(*) AS n, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1.0)::DOUBLE, 9) AS ratio FROM events GROUP BY ALL")
def error_ratio_window(spark, sf_dir):
    return monitor.ratios(read(spark, sf_dir, "events"), "1 hour", F.col("event_type") == "error")


@query(f"SELECT {_minutes(1440)} AS window_start, round(sum(value), 2) AS total, count(value) AS n, round(sum(value) / count(value), 3) AS mean, max(value) AS top FROM events GROUP BY ALL")
def window_summary(spark, sf_dir):
    s = monitor.summaries(read(spark, sf_dir, "events"), "1 day")
    return s.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 3)})


@query(f"SELECT {_minutes(1440)} AS window_start, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def exact_quantiles(spark, sf_dir):
    return monitor.exact_quantiles(read(spark, sf_dir, "events"), "1 day", {"p10": 0.1, "p90": 0.9, "p99": 0.99})


SKETCH = 0.02


@query(f"""WITH b AS (SELECT {_minutes(1440)} AS window_start, CASE WHEN value > 0 THEN 1 WHEN value < 0 THEN -1 ELSE 0 END AS s, CASE WHEN value <> 0 THEN ceil(ln(abs(value)) / ln({(1 + SKETCH) / (1 - SKETCH)}::DOUBLE))::INT ELSE 0 END AS b FROM events),
c AS (SELECT window_start, s, b, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT window_start, s * 2 * pow({(1 + SKETCH) / (1 - SKETCH)}::DOUBLE, b) / {(1 + SKETCH) / (1 - SKETCH) + 1}::DOUBLE AS x, sum(n) OVER (PARTITION BY window_start ORDER BY s, s * b) AS upto, sum(n) OVER (PARTITION BY window_start) AS n FROM c)
SELECT window_start, {", ".join(f"round(arg_min(x, upto) FILTER (upto > floor({q}::DOUBLE * (n - 1))) + (arg_min(x, upto) FILTER (upto > ceil({q}::DOUBLE * (n - 1))) - arg_min(x, upto) FILTER (upto > floor({q}::DOUBLE * (n - 1)))) * any_value({q}::DOUBLE * (n - 1) - floor({q}::DOUBLE * (n - 1))), 6) AS {k}" for k, q in (("p10", 0.1), ("p90", 0.9), ("p99", 0.99)))} FROM r GROUP BY window_start""")
def sketch_quantiles(spark, sf_dir):
    """Quantiles of days from the merged sketches of their hours."""
    hours = sketch.sketch(read(spark, sf_dir, "events"), "1 hour", SKETCH)
    return sketch.quantiles(sketch.merged(hours, "1 day"), {"p10": 0.1, "p90": 0.9, "p99": 0.99}, SKETCH)


EDGES = [5.0, 10.0, 25.0, 50.0, 100.0]


@query(f"""WITH c AS (SELECT {_minutes(1440)} AS window_start, {", ".join(f"count(*) FILTER (value <= {e}) AS le_{i}" for i, e in enumerate(EDGES))}, count(value) AS n FROM events GROUP BY 1)
SELECT window_start, round(CASE {" ".join(f"WHEN le_{i} >= n * 0.9::DOUBLE THEN {EDGES[i - 1] if i else 0.0}::DOUBLE + {EDGES[i] - (EDGES[i - 1] if i else 0.0)}::DOUBLE * (n * 0.9::DOUBLE - {f'le_{i - 1}' if i else '0'}) / nullif(le_{i} - {f'le_{i - 1}' if i else '0'}, 0)" for i in range(len(EDGES)))} ELSE {EDGES[-1]}::DOUBLE END, 6) AS quantile FROM c""")
def latency_quantile(spark, sf_dir):
    return monitor.bucket_quantile(monitor.bucket_counts(read(spark, sf_dir, "events"), "1 day", EDGES), 0.9, EDGES)


SPINE_SQL = f"""o AS (SELECT {_minutes(60)} AS window_start, count(*) FILTER (event_type = 'error') AS n_hit, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1),
sp AS (SELECT unnest(generate_series((SELECT min(window_start) FROM o), (SELECT max(window_start) FROM o), INTERVAL 1 HOUR)) AS window_start),
f AS (SELECT sp.window_start, coalesce(o.n_hit, 0) AS n_hit, coalesce(o.n, 0) AS n FROM sp LEFT JOIN o USING (window_start))"""


def _spine(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return monitor.spine(monitor.ratios(e, "1 hour", F.col("event_type") == "error"), "1 hour", {"n_hit": 0, "n": 0}).select("window_start", "n_hit", "n")


@query(f"WITH {SPINE_SQL} SELECT * FROM f")
def spine_fill(spark, sf_dir):
    return _spine(spark, sf_dir)


@query(f"""WITH {SPINE_SQL}, m AS (SELECT window_start, n_hit >= 1 AS on_ FROM f), i AS (SELECT window_start, on_, sum((NOT on_)::INT) OVER (ORDER BY window_start) AS island FROM m)
SELECT min(window_start) AS run_start, max(window_start) AS run_end, count(*) AS n_windows, count(*) >= 3 AS alerted FROM i WHERE on_ GROUP BY island""")
def alert_runs(spark, sf_dir):
    return monitor.alert_runs(_spine(spark, sf_dir), F.col("n_hit") >= 1, 3)


SERIES_SQL = f"""o AS (SELECT {_minutes(60)} AS window_start, event_type, count(*) FILTER (value > 35) AS n_hit, count(*) AS n FROM events GROUP BY ALL),
sp AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS window_start FROM (SELECT event_type, min(window_start) AS a, max(window_start) AS b FROM o GROUP BY 1)),
m AS (SELECT event_type, window_start, coalesce(2 * n_hit >= n, false) AS on_ FROM sp LEFT JOIN o USING (event_type, window_start)),
i AS (SELECT *, sum((NOT on_)::INT) OVER (PARTITION BY event_type ORDER BY window_start) AS island FROM m),
runs AS (SELECT event_type, min(window_start) AS run_start, max(window_start) AS run_end, count(*) AS n_windows, count(*) >= 3 AS alerted FROM i WHERE on_ GROUP BY event_type, island)"""


@query(f"WITH {SERIES_SQL} SELECT * FROM runs")
def alert_series(spark, sf_dir):
    """Runs of each event type, from the table."""
    counts = {"n_hit": F.count_if(F.col("value") > 35), "n": F.count("*")}
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(*[c.alias(k) for k, c in counts.items()])
    hours = monitor.spine(rows.select("event_type", F.col("w.start").alias("window_start"), "n_hit", "n"), "1 hour", {"n_hit": 0, "n": 0}, by=["event_type"])
    return monitor.alert_runs(hours, (F.col("n") > 0) & (2 * F.col("n_hit") >= F.col("n")), 3, by=["event_type"])


@query(f"""WITH {SERIES_SQL} SELECT event_type, 'ended' AS kind, run_start, run_end, n_windows, alerted FROM runs
UNION ALL SELECT event_type, 'raised', run_start, run_start + INTERVAL 2 HOUR, 3, true FROM runs WHERE alerted""")
def alert_stream(spark, sf_dir):
    """The same runs from a stream over the whole table, with the alerts as they are raised; a last event, long after all others, moves the watermark past them."""
    events = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    events.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).select("ts", F.lit("").alias("event_type"), F.lit(0.0).alias("value")).write.parquet(f"{folder}/last")
    # as a pattern the path may be a file or a folder
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]").select("ts", "event_type", "value")
    stream = source.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/last"))
    found = alerts.alerts(stream, "1 hour", ["event_type"], {"n_hit": F.count_if(F.col("value") > 35), "n": F.count("*")}, 2 * F.col("n_hit") >= F.col("n"), 3)
    alerts.write_alerts(found, f"{folder}/alerts", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/alerts").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start", "run_end")})


# ---------------------------------------------------------------- features and heads

PADDED = "WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM benchmark), p AS (SELECT item_id, ' ' || w || ' ' AS w FROM w)"
NGRAM_SQL = f"""{PADDED}, g AS (SELECT item_id, w, k, unnest(generate_series(1, greatest(length(w) - k + 1, 1))) AS i FROM p, (VALUES (3), (4), (5)) AS o(k) WHERE k = 3 OR length(w) >= k),
c AS (SELECT item_id, substr(w, i, k) AS term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term HAVING count(*) >= 5)"""


@query(f"{NGRAM_SQL} SELECT term, df, round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1, 9) AS idf FROM v, n")
def tfidf_vocabulary(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    counts = features.term_counts(b, "item_id", features.char_ngrams(F.col("text")))
    return features.vocabulary(counts, b.count()).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""{NGRAM_SQL}, t AS (SELECT item_id, term, (1 + ln(tf::DOUBLE)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN v USING (term), n)
SELECT item_id, count(*) AS n_terms, round(sum(w) / sqrt(sum(w * w)), 6) AS weight_sum FROM t GROUP BY item_id""")
def tfidf_weights(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    counts = settle(features.term_counts(b, "item_id", features.char_ngrams(F.col("text"))))
    weights = features.tfidf(counts, features.vocabulary(counts, b.count()), "item_id")
    return weights.groupBy("item_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE vec_id % 5 <> 0 GROUP BY i)
SELECT vec_id, count(*) AS width, round(sum((x - m) / s), 6) AS z_sum, round(sum((x - m) / s * (x - m) / s), 6) AS z_squares, round(max((x - m) / s), 6) AS z_max, round(sum(i * (x - m) / s), 4) AS z_weighted FROM e JOIN m USING (i) GROUP BY vec_id""")
def standard_scale(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    z = features.scaled("embedding", *features.population_scale(e.where("vec_id % 5 <> 0"), "embedding", width))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = e.select("vec_id", z.alias("z"))
    return rows.select(
        "vec_id", F.size("z").cast("long").alias("width"), F.round(total(F.col("z")), 6).alias("z_sum"), F.round(total(F.transform("z", lambda x: x * x)), 6).alias("z_squares"),
        F.round(F.array_max("z"), 6).alias("z_max"), F.round(total(F.transform("z", lambda x, i: x * (i + 1))), 4).alias("z_weighted"),
    )


def _block(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.element_at(F.array(*[F.lit(x) for x in ALL_LABELS]), (F.pmod("label", F.lit(6)) + 1).cast("int")).alias("truth"))
    e = e.withColumn("user_id", F.col("item_id") % 97).withColumn("split", F.when(F.col("item_id") % 5 == 0, "val").otherwise("train"))
    return settle(features.assembler(["embedding_block"]).transform(features.with_block(e, e, "embedding", 64)).drop("embedding", "embedding_block"))


@query(f"""{NGRAM_SQL.replace('FROM benchmark)', "FROM benchmark WHERE item_id % 5 <> 0)").replace('AS n FROM benchmark WHERE item_id % 5 <> 0)', 'AS n FROM benchmark)')}
SELECT (SELECT count(*) FROM benchmark JOIN embeddings ON vec_id = item_id) AS n_scored, ((SELECT count(*) FROM v) + 64)::BIGINT AS width, true AS as_saved, true AS sums_to_one, true AS abstains_for_other""")
def bundle_inference(spark, sf_dir):
    """A bundle fitted on texts and embeddings, with validation rows folded in and tau frozen, saved, loaded, and asked row by row."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.element_at(F.array(*[F.lit(x) for x in ALL_LABELS]), (F.pmod("label", F.lit(6)) + 1).cast("int")).alias("truth"))
    rows = settle(read(spark, sf_dir, "benchmark").select("item_id", F.lit(None).cast("string").alias("title"), F.col("text").alias("description")).join(e, "item_id"))
    split = heads.refit_rows(F.when(F.col("item_id") % 5 == 0, "test").when(F.col("item_id") % 5 == 1, "val").otherwise("train"))
    made = bundle.fit(rows.where(split == "train"), "truth", "item_id", [bundle.Block("embedding", 64)], tau=0.3)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    bundle.save(made, spark, path)
    loaded = bundle.load(spark, path)
    answers = settle(bundle.score(rows, loaded, "item_id"))
    other = F.col("confidence") - F.col("again.confidence")
    same = answers.join(bundle.score(rows, made, "item_id").select("item_id", F.struct("value", "confidence").alias("again")), "item_id").agg(F.bool_and((F.col("value") == F.col("again.value")) & (F.abs(other) < 1e-12))).first()[0]
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    return answers.agg(F.count("*").alias("n_scored"), F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"), F.bool_and((F.col("decision") == "abstain") == (F.col("value") == ABSTAIN)).alias("abstains_for_other")).withColumns({"width": F.lit(loaded.width).cast("long"), "as_saved": F.lit(same)})


@query()
def fit_logreg(spark, sf_dir):
    rows = _block(spark, sf_dir)
    model = heads.fit(rows.where("split = 'train'"), "truth")
    scored_rows = heads.probabilities(model, rows.where("split = 'val'"))
    pred = heads.as_predictions(scored_rows).join(rows.select("item_id", "truth"), "item_id")
    return reports.raw_and_decided(pred, pred.withColumn("pred_label", ev.with_abstention(F.col("pred_label"), F.col("confidence"), 0.3)))


@query()
def fit_cascade(spark, sf_dir):
    rows = _block(spark, sf_dir)
    apply = heads.fit_cascade(rows.where("split = 'train'"), "truth")
    return ev.contract_violations(heads.as_predictions(apply(rows.where("split = 'val'"))))


@query()
def out_of_fold(spark, sf_dir):
    rows = _block(spark, sf_dir)
    got = heads.out_of_fold(rows, "user_id", "truth", head=heads.Head(max_iter=20), k=3)
    return ev.business_metrics(heads.as_predictions(got).join(rows.select("item_id", "truth"), "item_id"))


@query(f"""WITH {SCORED_SQL}, u AS (SELECT 'base' AS scheme, 'proxy' AS projection, truth, pred_label FROM scored UNION ALL SELECT 'strict', 'proxy', truth, CASE WHEN confidence >= 0.35::DOUBLE THEN pred_label ELSE '{ABSTAIN}' END FROM scored
UNION ALL SELECT 'base', 'audit', truth, pred_label FROM scored WHERE item_id % 4 = 0 UNION ALL SELECT 'strict', 'audit', truth, CASE WHEN confidence >= 0.35::DOUBLE THEN pred_label ELSE '{ABSTAIN}' END FROM scored WHERE item_id % 4 = 0),
c AS (SELECT scheme, projection, {COUNTS} FROM u GROUP BY ALL) SELECT scheme, projection, {business_sql()} FROM c""")
def scheme_comparison(spark, sf_dir):
    s = scored(spark, sf_dir)
    strict = s.withColumn("pred_label", ev.with_abstention(F.col("pred_label"), F.col("confidence"), 0.35))
    audit = F.col("item_id") % 4 == 0
    return reports.compare({("base", "proxy"): s, ("strict", "proxy"): strict, ("base", "audit"): s.where(audit), ("strict", "audit"): strict.where(audit)})


@query("""WITH f(n_rounds, n_labels, width, falls, sums_to_one, deterministic) AS (VALUES (3, (SELECT count(DISTINCT label) FROM embeddings WHERE vec_id % 5 <> 0), (SELECT max(len(embedding)) FROM embeddings), true, true, true)),
h AS (SELECT count(*) AS n_scored FROM embeddings WHERE vec_id % 5 = 0) SELECT f.*, n_scored FROM f, h""")
def fit_boosted(spark, sf_dir):
    """Boosting for all labels of embeddings, and what holds for any such model: the loss falls, probabilities sum to one, another partitioning gives the same trees."""
    e = settle(read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("features")))
    how = boosting.Boosting(rounds=3, depth=2, bins=16, rate=0.3, refresh=2)
    train = e.where("vec_id % 5 <> 0")
    model, again = boosting.fit(train, "label", how=how), boosting.fit(train.repartition(3), "label", how=how)
    shape = lambda m: [[(t.feature, t.bin) for t in trees] for trees in m.trees]
    falls = all(a > b for a, b in zip(model.losses, model.losses[1:]))
    scored = model.transform(e.where("vec_id % 5 = 0")).agg(F.bool_and(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"), F.count("*").alias("n_scored"))
    facts = {"n_rounds": len(model.trees), "n_labels": F.lit(len(model.labels)).cast("long"), "width": F.lit(len(model.edges)).cast("long"), "falls": falls, "deterministic": shape(model) == shape(again)}
    return scored.select("*", *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in facts.items()])


@query()
def table_manifest(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return files.manifest({"region": (r, "r_regionkey", ["r_name"], []), "nation": (n, "n_nationkey", ["n_name", "n_regionkey"], ["region"])})


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, arg_max(lang, (n, lang)) AS main FROM n GROUP BY source)
SELECT source, ((row_number() OVER (PARTITION BY main ORDER BY md5(source || '-42'), source) - 1) % 5)::INT AS fold FROM m""")
def fold_assignment(spark, sf_dir):
    return splitting.folds(read(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")


@query(f"""WITH {SCORED_SQL}, g AS (SELECT item_id, 1 - p[6] AS pc, [p[1], p[2], p[3], p[4], p[5]] AS k FROM scored)
SELECT item_id, round(k[1] * pc, 9) AS first, round(1 - pc, 9) AS other, round(k[3] + k[4] + k[5] + 1 - pc, 9) AS tail FROM g""")
def cascade_probabilities(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = F.col("p")
    composed = vx.cascade(1 - p[5], F.slice(p, 1, 5))
    rows = s.select("item_id", composed.alias("c"), vx.merge_tail(p, 2).alias("m"))
    return rows.select("item_id", F.round(F.col("c")[0], 9).alias("first"), F.round(F.col("c")[5], 9).alias("other"), F.round(F.col("m")[2], 9).alias("tail"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, a.label AS truth, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
c AS (SELECT query_id, truth, label, count(*) AS n FROM s WHERE r <= 5 GROUP BY ALL), w AS (SELECT query_id, truth, label AS vote, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM c),
x AS (SELECT truth, (query_id // 20) % 10 AS pred, vote FROM w WHERE r = 1)
SELECT CASE WHEN pred = truth THEN 'correct' WHEN truth = 0 THEN 'should_abstain' ELSE 'wrong_type' END AS kind, CASE WHEN vote = pred THEN 'confirm' WHEN vote = truth THEN 'fix' WHEN vote = 0 THEN 'to_abstain' ELSE 'other' END AS outcome, count(*) AS n FROM x GROUP BY ALL""")
def knn_probe(spark, sf_dir):
    e = settle(read(spark, sf_dir, "embeddings"))
    q = e.where("vec_id % 20 = 0")
    voted = neighbours.vote(neighbours.nearest(q, e, 5), e)
    rows = voted.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth")), "query_id").withColumn("pred", F.pmod(F.floor(F.col("query_id") / 20), F.lit(10)))
    return neighbours.probe_accounting(rows, "truth", "pred", "vote", F.lit(0))


STRICT_SQL = f"CASE WHEN confidence >= 0.35::DOUBLE THEN pred_label ELSE '{ABSTAIN}' END"


@query(f"""WITH {SCORED_SQL}, {REPORT_SQL}, z AS (SELECT truth, {STRICT_SQL} AS pred_label FROM scored), c AS (SELECT {COUNTS} FROM z), b AS (SELECT {business_sql()} FROM c)
SELECT 'raw' AS stage, 'accuracy' AS metric, round((SELECT avg((truth = pred_label)::INT) FROM scored), 9) AS value UNION ALL SELECT 'raw', 'macro_f1', round(avg(f1), 9) FROM report
UNION ALL SELECT 'decided', unnest(['coverage', 'CAR', 'AER', 'AER_hi']), unnest([coverage, "CAR", "AER", "AER_hi"]) FROM b""")
def raw_and_decided(spark, sf_dir):
    s = scored(spark, sf_dir)
    return reports.raw_and_decided(s, s.withColumn("pred_label", ev.with_abstention(F.col("pred_label"), F.col("confidence"), 0.35)))


@query(f"""WITH {SCORED_SQL}, u AS (SELECT 'base' AS scheme, truth, pred_label, item_id % 4 = 0 AS audit FROM scored UNION ALL SELECT 'strict', truth, {STRICT_SQL}, item_id % 4 = 0 FROM scored),
c AS (SELECT scheme, audit, {COUNTS} FROM u GROUP BY ALL), p AS (SELECT scheme, audit, {business_sql()} FROM c), w AS (SELECT a.scheme, a."CAR" AS cp, b."CAR" AS ca, b."AER_hi" AS hi FROM p a JOIN p b ON a.scheme = b.scheme WHERE NOT a.audit AND b.audit),
d AS (SELECT w.scheme, w.cp - x.cp AS dp, w.ca - x.ca AS da, coalesce(w.hi, 1) <= 0.05 AS passes FROM w, w x WHERE x.scheme = 'base')
SELECT scheme, round(dp, 9) AS d_proxy, round(da, 9) AS d_audit, passes, CASE WHEN dp > 1e-9 AND da <= 1e-9 THEN 'teacher_overfit' WHEN da > 1e-9 AND passes THEN 'better' WHEN da < -1e-9 THEN 'worse' ELSE 'no_change' END AS verdict FROM d""")
def scheme_verdicts(spark, sf_dir):
    s = scored(spark, sf_dir)
    strict = s.withColumn("pred_label", ev.with_abstention(F.col("pred_label"), F.col("confidence"), 0.35))
    audit = F.col("item_id") % 4 == 0
    found = reports.compare({("base", "proxy"): s.where(~audit), ("strict", "proxy"): strict.where(~audit), ("base", "audit"): s.where(audit), ("strict", "audit"): strict.where(audit)})
    return reports.verdicts(found, "base", "proxy", "audit")


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def upsert_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.upsert(e, e.where("event_id % 6 = 0").withColumn("event_type", F.lit("new")), "event_id")


@query(SQL["upsert_rows"])
def upsert_buckets(spark, sf_dir):
    """The same edit of a table in buckets, of which only those with an edited key are written again; then one cell, and back."""
    e, path = read(spark, sf_dir, "events").select("event_id", "event_type"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    buckets.create(e, path, "event_id", 16)
    buckets.upsert(e.where("event_id % 6 = 0").withColumn("event_type", F.lit("new")), path)
    first = e.agg(F.min("event_id")).first()[0]
    was = buckets.read(spark, path).where(F.col("event_id") == first).first()["event_type"]
    buckets.edit(spark, path, first, {"event_type": "other"})
    buckets.edit(spark, path, first, {"event_type": was})
    return buckets.read(spark, path)


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 2.0 WHEN 'fr' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM documents")
def lookup_default(spark, sf_dir):
    table = spark.createDataFrame([("en", 2.0), ("fr", 0.5)], "key string, value double")
    return joins.lookup(read(spark, sf_dir, "documents").select("doc_id", "lang"), table, "lang", "weight", 1.0).select("doc_id", "weight")


@query("""SELECT doc_id, regexp_matches(lower(text), 'the |and ')::TINYINT AS lot, regexp_matches(lower(text), 'token')::TINYINT AS parts, length(text)::BIGINT AS text_len, (n_chars >= 50)::INT AS has_key,
CASE WHEN n_chars >= 5000 THEN 'large' WHEN n_chars >= 500 THEN 'medium' ELSE 'small' END AS bucket FROM documents""")
def text_features(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    found = tx.flags(F.col("text"), {"lot": "the |and ", "parts": "token"})
    return d.select("doc_id", *[v.alias(k) for k, v in found.items()], F.char_length("text").cast("long").alias("text_len"), (F.col("n_chars") >= 50).cast("int").alias("has_key"), tx.size_bucket(F.col("n_chars") / 100).alias("bucket"))


@query("""WITH b AS (SELECT doc_id, text, source FROM documents) SELECT doc_id, (lower(translate(text, 'ё', 'е'))) IN ('fotik') AS generic,
CASE WHEN n <= 0 THEN 'no_kb' WHEN n <= 20 THEN 'rare_kb' ELSE 'popular_kb' END AS popularity FROM b LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)""")
def popularity_slices(spark, sf_dir):
    d = profiling.group_size(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "source", "n")
    return d.select("doc_id", tx.is_generic_title(F.col("text")).alias("generic"), tx.popularity_bucket(F.col("n")).alias("popularity"))


@query("WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]{2,}') AS w FROM benchmark), g AS (SELECT item_id, unnest(w) AS term FROM w UNION ALL SELECT item_id, a || ' ' || b FROM (SELECT item_id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1)) SELECT term, count(DISTINCT item_id) AS df, count(*) AS cf FROM g GROUP BY term HAVING count(DISTINCT item_id) >= 2")
def word_vocabulary(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    counts = features.term_counts(b, "item_id", features.word_ngrams(F.col("text")))
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 2")
