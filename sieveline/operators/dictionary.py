"""Names of a dictionary in texts, whatever the size of either: a trie of the names' words, walked once along a text.

From each word that begins a name the trie is followed as far as the text goes along with it. A dictionary that was measured to be small is sent to
the tasks that read the texts, and no text or word is shuffled. Of a larger one the first words are sent, as a bitmap of fixed size; the words of texts that
may begin a name go, with as many words after them as names have, to the names with that first word, and only hits come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.storage import fits_broadcast, settle

#: A name at a word of a text, counted from 0; ``neg`` is less the number of its words, so hits sort as (leftmost, longest).
HITS = "array<struct<pos:int,neg:int,name:string>>"
#: Bits of the bitmap of first words (2 MB); parts that the words of texts are dealt to: a first word that has more than a part's share of them is salted.
BITS = 24
PARTS = 256
#: Bytes of texts whose hits a task holds at a time.
PART_BYTES = 1 << 20

Trie = dict[str, "Trie"]
#: The key at which a node has the whole name, if one ends there; no word is empty.
END = ""


def build(names: Sequence[str]) -> Trie:
    """Nodes by word; names are words with one space between them."""
    root: Trie = {}
    for name in names:
        node = root
        for word in name.split(" "):
            node = node.setdefault(word, {})
        node[END] = name
    return root


def walk(words: Sequence[str], trie: Trie) -> list[tuple[int, int, str]]:
    """(pos, -n, name) of every name in a text, leftmost first, the longest first of those that begin together."""
    out, end = [], len(words)
    for pos in [i for i, w in enumerate(words) if w in trie and w]:
        node, at, here = trie[words[pos]], pos + 1, []
        while True:
            if END in node:
                here.append((pos, pos - at, node[END]))
            if at == end or not words[at] or (node := node.get(words[at])) is None:
                break
            at += 1
        out += reversed(here)
    return out


@lru_cache(maxsize=2)
def _sent(raw: str) -> Trie:
    """A worker's trie of the names that were sent to it, built once."""
    return build(raw.split("\n"))


def _array(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    """HITS of a batch."""
    flat = [h for hits in found for h in hits]
    offsets = np.concatenate(([0], np.cumsum([len(h) for h in found], dtype=np.int64))).astype(np.int32)
    parts = [pa.array([h[i] for h in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["pos", "neg", "name"]))


def in_parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts, in column ``at``, have ``PART_BYTES`` in all or are one: hits of a text take many times its bytes."""
    begin, size = 0, 0
    for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if size and size + n > PART_BYTES:
            yield batch.slice(begin, row - begin)
            begin, size = row, 0
        size += n
    if batch.num_rows:
        yield batch.slice(begin)


def with_hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, name: str = "hits") -> DataFrame:
    """``texts`` with an array of HITS, in order, of ``dictionary``'s column name; ``dictionary`` is settled.

    ``text`` and names are words with one space between them. Defined cases: a null or empty text has no hits; names that are null or empty are left out, and
    repeated ones count once; texts of any length are walked whole; the key has to be unique only for a dictionary that isn't sent
    (rows that share one then share their hits); an empty dictionary gives empty arrays. Names with the same first word are one task's trie.
    """
    names = dictionary.select("name").where("name IS NOT NULL AND name <> ''")
    if not fits_broadcast(names):
        found = hits_by_first_word(texts.select(key, text), key, text, names)
        return texts.join(found.withColumnRenamed("__hits", name), key, "left").withColumn(name, F.coalesce(name, F.array().cast(HITS)))
    shared = texts.sparkSession.sparkContext.broadcast("\n".join(sorted({r[0] for r in names.collect()})))

    schema = StructType([*texts.schema.fields, *StructType.fromDDL(f"`{name}` {HITS}").fields])
    columns, at = texts.columns, texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _sent(shared.value) if shared.value else {}
        for b in batches:
            for part in in_parts(b, at):
                hits = _array([walk(t.split(" "), trie) if t else [] for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, hits], names=[*columns, name])

    return texts.mapInArrow(run, schema)


def bitmap(words: DataFrame) -> np.ndarray:
    """Bits of the CRC-32 of a column of words: a fixed size, whatever the number of words, gathered in rows of 4 KB."""
    bit = (F.crc32(words.columns[0]) % (1 << BITS)).cast("int")
    rows = words.select(bit.alias("b")).groupBy(F.expr("b div 32768").cast("int").alias("at")).agg(F.collect_set(F.col("b") % 32768).alias("set"))
    out = np.zeros(1 << BITS, np.bool_)
    for r in rows.toLocalIterator():  # 512 rows at most
        out[r["at"] * 32768 + np.array(r["set"])] = True
    return np.packbits(out)


def hits_by_first_word(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, __hits`` of the texts with hits, for dictionaries of any size.

    The words that begin a name meet its first word's names in one partition, names first: they are read into a trie, along which the texts' words are then
    walked one after the other. First words that are frequent in texts are salted, and their names go to every salt.
    """
    spark = texts.sparkSession
    named = settle(names.distinct().select("name", F.element_at(F.split("name", " "), 1).alias("first")))
    longest = named.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    shared = spark.sparkContext.broadcast(bitmap(named.select("first").distinct()))
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, first string, pos int, tail string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.unpackbits(shared.value), {}
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for row, t in enumerate(b.column(1)):
                words = (t.as_py() or "").split(" ")
                for w in set(words) - known.keys():
                    if len(known) > 1_000_000:
                        known.clear()
                    known[w] = bool(w) and bool(bits[zlib.crc32(w.encode()) % (1 << BITS)])
                for pos in [i for i, w in enumerate(words) if known.get(w)]:
                    for column, x in zip(rows, (row, words[pos], pos, " ".join(words[pos : pos + longest]))):
                        column.append(x)
                if len(rows[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), *[pa.array(x, f.type) for x, f in zip(rows[1:], list(out)[1:])]], schema=out)
                    rows = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), *[pa.array(x, f.type) for x, f in zip(rows[1:], list(out)[1:])]], schema=out)

    starts = settle(texts.select(key, text).mapInArrow(begin, schema))
    counts = starts.groupBy("first").agg(F.count("*").alias("n"))
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // PARTS)
    hot = F.broadcast(counts.where(F.col("n") > share).select("first", F.ceil(F.col("n") / share).cast("int").alias("salts")))  # PARTS rows at most
    one = F.coalesce("salts", F.lit(1))
    asked = starts.join(hot, "first", "left").select("first", F.pmod(F.xxhash64(key, "pos"), one).cast("int").alias("salt"), F.lit(1).alias("asks"), key, "pos", "tail")
    told = named.join(hot, "first", "left").select("first", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"), F.lit(0).alias("asks"), F.lit(None).cast(kind).alias(key), F.lit(None).cast("int").alias("pos"), F.col("name").alias("tail"))
    found_schema = f"`{key}` {kind}, pos int, neg int, name string"
    found = to_arrow_schema(StructType.fromDDL(found_schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, {}
        for b in batches:
            rows, hits = [], []
            for row, (first, salt, asks, pos, tail) in enumerate(zip(*[b.column(c).to_pylist() for c in ("first", "salt", "asks", "pos", "tail")])):
                if (first, salt) != at:
                    at, trie = (first, salt), {}
                if not asks:
                    node = trie
                    for word in tail.split(" "):
                        node = node.setdefault(word, {})
                    node[END] = tail
                elif trie:
                    words = tail.split(" ")
                    for begin_at, neg, name in walk(words, trie):
                        if begin_at:
                            break
                        rows.append(row)
                        hits.append((pos, neg, name))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int32())), *[pa.array([h[i] for h in hits], f.type) for i, f in enumerate(list(found)[1:])]], schema=found)

    rows = told.unionByName(asked).repartition("first", "salt").sortWithinPartitions("first", "salt", "asks").mapInArrow(meet, found_schema)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "neg", "name"))).cast(HITS).alias("__hits"))
