"""Personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card numbers and telephone numbers. Each value found is a protected
entity. What a term tells about an entity is estimated from the whole corpus: with p(t) and p(c) the shares of documents
with term and entity and p(t, c) that in which they stand together, the pointwise mutual information
``log(p(t, c) / (p(t) p(c)))`` is how many bits of the entity's information content ``-log p(c)`` the term
discloses. A term that discloses too great a share is a span of its own kind where it stands beside
the entity: it is generalised to what kind of word it is, or removed if it discloses nearly all
(compare Sanchez and Batet, "C-sanitized: a privacy model for document redaction and sanitization").
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.common import per_batch, sha, span_text, texts
from sieveline.storage import BROADCAST_ROWS, fits_broadcast, join_small, settle

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "term"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match begins where its first run of digits does; from within that run it would go the same way.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Disclosure:
    """window: terms on either side of an entity, so that work grows with the number of entities and not with its square. min_support: different
    surroundings in which a term stood beside it; from 1 on entities that occur once are protected as well.

    A term is generalised if it discloses generalise_at of the entity's information, and removed from remove_at on.
    """

    window: int = 20
    min_support: int = 1
    generalise_at: float = 0.75
    remove_at: float = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if k % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses; work grows with the text's length, however it is made up."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            past = m.end()
        else:
            past = max(past, at)  # what comes later can't reach over an @
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost first and without overlap in each kind; failing ones are dropped."""
    found = [("email", *s) for s in emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def beside(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """The terms around each entity: (entity, term, start, end, surroundings). Terms inside of spans don't count.

    The surroundings are a hash of all the terms around, so that copies of a passage are told from new evidence.
    """
    if not spans:
        return []
    taken = sorted((s, e) for _, s, e in spans)
    out = []
    for kind, start, end in spans:
        value = text[start:end].lower()
        if kind != "email":
            value = re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
        entity = xxhash.xxh64_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) >> 1
        around = [*_terms_before(text, start, window), *_terms_after(text, end, window)]
        around = [(s, e) for s, e in around if not any(a < e and s < b for a, b in taken)]
        seen = xxhash.xxh64_intdigest(" ".join(text[s:e].lower() for s, e in around).encode("utf-8", "surrogatepass")) >> 1
        out += [{"entity": entity, "term": text[s:e].lower(), "start": s, "end": e, "seen": seen} for s, e in around]
        if not around:
            out.append({"entity": entity, "term": None, "start": None, "end": None, "seen": seen})
    return out


def _terms_after(text: str, at: int, n: int) -> list[tuple[int, int]]:
    out = []
    for m in _TERM.finditer(text, at):
        if len(out) == n:
            break
        out.append(m.span())
    return out


def _terms_before(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The last terms before a place; looks back further until there are enough or the text begins."""
    reach = 40 * n
    while True:
        low = max(0, at - reach)
        while low > 0 and text[low - 1].isalpha():
            low -= 1
        got = [m.span() for m in _TERM.finditer(text, low, at)]
        if len(got) >= n or low == 0:
            return got[-n:] if n else []
        reach *= 4


NEAR = "array<struct<entity:long,term:string,start:long,end:long,seen:long>>"
FOUND = f"doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near {NEAR}, held string, plain_sha256 string"


def find(docs: DataFrame, rule: Disclosure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base spans of each text, and the terms beside them. ``held`` is the text if it has any, else ``plain_sha256`` is its digest."""

    def run(batch):
        cols: list[list] = [[] for _ in range(10)]
        for text in texts(batch, "text"):
            base = base_spans(text)
            written = span_text(base, KINDS)
            row = [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 if base else 0, *[sum(s[0] == k for s in base) for k in BASE_KINDS], sha(written), written, beside(text, base, rule.window), text if base else None, None if base else sha(text)]
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        return [batch.column(0), *cols]

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(narrow, run, FOUND)


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text", limit: int = BROADCAST_ROWS, flush: int = 300_000) -> DataFrame:
    """``term, n_docs``: in how many rows of ``docs`` each of ``terms`` stands, over whole texts.

    Terms that measure up to ``limit`` rows and a bounded size are sent to the workers; if more, all terms are counted and joined.
    """
    wanted = None
    if fits_broadcast(terms, limit):
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.toLocalIterator()))
    schema = "term string, n long"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=out)
            counts.clear()
            return b

        for b in batches:
            for text in texts(b, "text"):
                here = set(_TERM.findall(text.lower()))
                counts.update(here & wanted.value if wanted else here)
                if len(counts) > flush:
                    yield rows()
        yield rows()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n_docs"))
    return counted if wanted else counted.join(terms, "term")


def disclosing(found: DataFrame, docs: DataFrame, rule: Disclosure, text_col: str = "text") -> DataFrame:
    """``entity, term, degree`` of the terms that disclose too much of an entity; ``found`` is settled."""
    near = found.where(F.size("near") > 0).select("doc_id", "text_hash", F.explode("near").alias("x")).select("doc_id", "text_hash", "x.*")
    together = near.where("term IS NOT NULL").groupBy("entity", "term").agg(F.countDistinct("seen").alias("n_seen"), F.countDistinct(F.struct("doc_id", "text_hash")).alias("n_both"))
    together = settle(together.where(F.col("n_seen") >= rule.min_support))
    entities = near.groupBy("entity").agg(F.countDistinct(F.struct("doc_id", "text_hash")).alias("n_entity"))
    terms = document_counts(docs, settle(together.select("term").distinct()), text_col)
    n = found.count()
    known = together.join(entities, "entity").join(terms, "term")
    # counts of terms are of rows and include all rows counted beside entities
    pmi = F.log(F.col("n_both") * n / (F.greatest("n_docs", "n_both") * F.col("n_entity")))
    information = F.log(n / F.col("n_entity"))
    degree = F.when(information > 0, F.least(F.lit(1.0), pmi / information))
    return settle(known.select("entity", "term", degree.alias("degree")).where(F.col("degree") >= rule.generalise_at))


def term_spans(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """``text_hash, terms``: places of disclosing terms beside their entity, with the greatest degree. Equal texts have equal terms."""
    near = found.where(F.size("near") > 0).select("text_hash", F.explode("near").alias("x")).select("text_hash", "x.*").where("term IS NOT NULL")
    hit = join_small(near, flagged, ["entity", "term"], "inner").groupBy("text_hash", "start", "end").agg(F.max("degree").alias("degree"))
    return hit.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "degree"))).alias("terms"))


TERMS = "array<struct<start:long,end:long,degree:double>>"


def scan(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, sanitised_sha256, terms`` for each row of ``docs``.

    sanitised_sha256 is the digest of the text that ``sanitise`` gives. Texts with base spans are kept until their terms are known, the others are
    read once for spans and once for counts. Defined cases: a null text is empty; texts of any length are searched whole; rows with a null id
    are scanned like any other; repeated rows get equal results, and count as one document beside entities; terms of equal degree are all
    spans; other columns aren't looked at, whatever their names; an empty table gives an empty result.
    """
    found = settle(find(docs, rule, id_col, text_col))
    added = settle(term_spans(found, disclosing(found, docs, rule, text_col)))

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for t, b, more in zip(text, base, terms, strict=True):
            spans = [(k, int(start), int(end), 1.0) for k, start, end in (x.split(":") for x in b.split(","))]
            out.append(sha(rewrite(t, spans + [("term", x["start"], x["end"], x["degree"]) for x in more], rule)))
        return pd.Series(out, dtype=object)

    hot = join_small(found.where("base <> ''").drop("plain_sha256"), added, ["text_hash"]).withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    hot = hot.withColumn("sanitised_sha256", cleaned("held", "base", "terms"))
    rest = found.where("base = ''").withColumn("terms", F.array().cast(TERMS)).withColumnRenamed("plain_sha256", "sanitised_sha256")
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", all_spans().alias("spans"), F.size("terms").cast("long").alias("n_term"), "sanitised_sha256", "terms"]
    return hot.select(*columns).unionByName(rest.select(*columns))


def all_spans() -> Column:
    """Base spans and terms as one text, by start, then kind."""
    part = lambda x, i: F.element_at(F.split(x, ":"), i)
    order = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(part(x, 2).cast("long").alias("s"), F.array_position(order, part(x, 1)).cast("int").alias("k"), part(x, 3).cast("long").alias("e")))
    terms = F.transform("terms", lambda x: F.struct(x.start.alias("s"), F.lit(len(KINDS)).alias("k"), x.end.alias("e")))
    name = lambda x: F.concat_ws(":", F.element_at(order, x.k), x.s.cast("string"), x.e.cast("string"))
    return F.array_join(F.transform(F.array_sort(F.concat(base, terms)), name), ",")


def generalise(word: str) -> str:
    """The kind of word that a term is."""
    if word.isupper() and len(word) > 1:
        return "[ACRONYM]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def rewrite(text: str, spans: list[tuple[str, int, int, float]], rule: Disclosure = Disclosure()) -> str:
    """The text with base spans replaced by their kind and terms generalised or removed. Where spans overlap the first stands."""
    out, past = [], 0
    for kind, start, end, degree in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), -x[2])):
        if start < past:
            if end > past and kind != "term":
                past = end
            continue
        out.append(text[past:start])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif degree < rule.remove_at:
            out.append(generalise(text[start:end]))
        past = end
    return "".join([*out, text[past:]])


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts. Base spans are found again in each text; terms come from the corpus.

    Defined cases are those of ``scan``; a null text stays null, texts without spans stay as they are, and extra columns keep their
    values, whatever their names. Texts are only moved if the table of terms is too large for a broadcast.
    """
    found = settle(find(docs, rule, id_col, text_col))
    added = settle(term_spans(found, disclosing(found, docs, rule, text_col)).withColumnsRenamed({"text_hash": "hash"}))
    # columns go by number, so none of their names can meet those used here
    place, plain = docs.columns.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = to_arrow_schema(plain.schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 if t and base_spans(t) else 0 for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.int64())], names=[*b.schema.names, "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = []
            for t, h, extra in zip(b.column(place).to_pylist(), b.column(len(out)).to_pylist(), b.column(len(out) + 1).to_pylist(), strict=True):
                spans = [(*s, 1.0) for s in base_spans(t)] + [("term", x["start"], x["end"], x["degree"]) for x in extra or []] if h else []
                col.append(rewrite(t, spans, rule) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.string()) if k == place else b.column(k) for k in range(len(out))], schema=out)

    keyed = plain.mapInArrow(hashes, StructType([*plain.schema.fields, *StructType.fromDDL("hash long").fields]))
    return join_small(keyed, added, ["hash"]).select(*plain.columns, "hash", "terms").mapInArrow(run, plain.schema).toDF(*docs.columns)
