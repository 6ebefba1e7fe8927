"""Language identification by rank-order profiles (Cavnar and Trenkle, "N-Gram-Based Text Categorization").

A profile is a list of the most frequent n-grams, one to three letters of a word with its borders. A document's
profile is compared to each language's by the out-of-place distance: how far each of its n-grams stands from its rank
in the other profile, or the profile's length if it isn't there. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.common import per_batch, texts

PROFILE = 300
#: Languages whose profiles are compared. With them the profiles that are sent to workers have under 300,000 entries.
MAX_LANGUAGES = 1000
SPACE, BITS = 32, 21
#: While counting, a task sorts so many characters at a time, and hands on its counts when there are so many n-grams.
CHARS, GRAMS = 1 << 20, 1 << 19

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it's no letter."""
    if not _fold:
        table = np.full(0x110000, SPACE, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _fold.append(table)
    return _fold[0]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text's words as numbers; empty if it has no letter."""
    letters = fold_table()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    gap = letters == SPACE
    c = letters[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]  # one space at a time
    if len(c) < 3:
        return np.empty(0, dtype=np.uint64)
    c = c.astype(np.uint64)
    one = c[c != SPACE]
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    return np.concatenate((one, two, three[c[1:-1] != SPACE]))


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams; equally frequent ones by number."""
    found, counts = np.unique(grams(text), return_counts=True)
    if len(found) > size:
        # all that are as frequent as the last that counts, then those in order
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.argsort(-counts, kind="stable")][:size]


def is_held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(3)) == 1


def learn(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank``: each language's profile from all rows of ``labelled(lang, text)``.

    Tasks count n-grams by language and hand on sums; equally frequent n-grams rank by number.
    """
    schema = "lang string, gram long, n long"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def count(lang: str) -> None:
            found, n = np.unique(grams(" ".join(waiting.pop(lang))), return_counts=True)
            sizes.pop(lang)
            if lang in counts:
                both, where = np.unique(np.concatenate((counts[lang][0], found)), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate((counts[lang][1], n))).astype(np.int64)
                found = both
            counts[lang] = found, n

        def rows() -> pa.RecordBatch:
            langs = np.repeat(np.array(list(counts), dtype=object), [len(g) for g, _ in counts.values()])
            g, n = (np.concatenate([x[i] for x in counts.values()] or [np.empty(0)]).astype(np.int64) for i in (0, 1))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(g), pa.array(n)], schema=out)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts(b, "text"), strict=True):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] > CHARS:
                    count(lang)
            if sum(len(g) for g, _ in counts.values()) > GRAMS:
                yield rows()
        for lang in list(waiting):
            count(lang)
        yield rows()

    narrow = labelled.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    summed = narrow.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a limit on the row number itself, so that each task keeps its first ones only before a language meets in one
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``; profiles come from ``learn``.

    score is 1 less the distance as a share of the greatest possible one. Defined cases: ``und`` and 0 for
    a null text, one without letters, or if no language was learned; the first of equally near languages
    in order; rows with a null id and repeated rows are predicted as they stand; other columns aren't looked
    at; an empty table gives an empty result. Over MAX_LANGUAGES languages are an error.
    """
    if profiles.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"profiles of over {MAX_LANGUAGES} languages")
    known = profiles.toPandas()
    langs = sorted(known.lang.unique())
    all_grams = np.unique(known.gram.to_numpy(dtype=np.uint64)) if len(known) else np.empty(0, dtype=np.uint64)
    ranks = np.full((len(all_grams), len(langs)), -1, dtype=np.int32)
    if len(known):
        ranks[np.searchsorted(all_grams, known.gram.to_numpy(dtype=np.uint64)), known.lang.map({x: i for i, x in enumerate(langs)})] = known["rank"]
    shared = docs.sparkSession.sparkContext.broadcast((langs, all_grams, ranks))

    def one(text: str, langs: list[str], all_grams: np.ndarray, ranks: np.ndarray) -> tuple[str, float]:
        own = profile(text, size)
        if not len(own) or not langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(all_grams, own), len(all_grams) - 1)
        there = np.where((all_grams[at] == own)[:, None], ranks[at], -1)
        away = np.where(there < 0, size, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return langs[best], float(1 - away[best] / (size * len(own)))

    def run(batch):
        got = [one(t, *shared.value) for t in texts(batch, "text")]
        return [batch.column(0), [g[0] for g in got], [g[1] for g in got]]

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(narrow, run, "doc_id long, lang_pred string, score double")
