"""SimHash near-duplicates found through pivot distance tables.

A fingerprint is the majority vote of the XXH64 values of a text's three-word shingles. Fingerprints
link at two differing bits or fewer, and a component is what links reach.

Pivot distance tables. For reference fingerprints p the triangle inequality gives
``|d(x, p) - d(y, p)| <= d(x, y)``, so a pair of which one coordinate differs by more than the radius
can't link. Two sets of pivots are used:

* The zero fingerprint and the 64 fingerprints of one bit, in four families of sixteen neighbouring
  bits. A changed bit moves the coordinates of its own family only (beside what the zero pivot says),
  so two fingerprints that differ in two bits or fewer agree in at least two whole families. The 6
  choices of two families are hash-joined on equality: every pair with such a difference meets, and no other pairs
  are looked at. The offsets ``d(x, e_i) - d(x, 0) = 1 - 2 * x_i`` of a family are stored as its 16 bits.
* ``PIVOTS`` well-spread fingerprints. Their distances stand in a table beside each fingerprint; pairs that
  met are discarded by maximum coordinate difference, and the rest are verified by their differing bits.

A meeting point of over ``PAIR_LIMIT`` fingerprints, for which pairs would be more work, isn't compared in pairs. Its members go to an
exact way without pairs: each is sent to its 65 fingerprints of one changed bit or none. Two that share such a
fingerprint differ in two bits or fewer, and all that do share one; so linking those in a group to its
least member finds the same components. Such a group never has over 65 members.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm import resemblance
from sieveline.llm.common import per_batch, texts
from sieveline.operators.graph import connected_components
from sieveline.storage import join_small, settle

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: With n members there are n (n - 1) / 2 pairs, but 65 n fingerprints of one changed bit or none: pairs are fewer up to here.
PAIR_LIMIT = 131
#: Shingles whose bits are unpacked at a time.
UNPACK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned integer; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and only ASCII spaces part words
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        return digest(join(words), SEED)
    hashes = np.array([digest(join(s), SEED) for s in zip(words, words[1:], words[2:])], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), UNPACK):
        part = hashes[k : k + UNPACK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``; fp holds the 64 bits as a signed long."""

    def run(batch):
        signed = np.array([fingerprint(t) for t in texts(batch, "text")], dtype=np.uint64).astype(np.int64)
        return batch.column(0), signed

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """n reference fingerprints, spread by a hash, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", SEED)).astype(np.int64)) for i in range(n)]


def pivot_table(fps: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Adds ``d``, the distances of ``fp`` to the reference fingerprints."""
    return fps.withColumn("d", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots(n)]))


def family_keys(fp: Column) -> Column:
    """For each choice of two of the four pivot families, the coordinates that must agree, as (choice, value)."""
    band = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*[F.struct(F.lit(k).cast("byte").alias("choice"), (F.shiftleft(band[i], 16) + band[j]).alias("value")) for k, (i, j) in enumerate(pairs)])


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints whose components are those of all links.

    ``fps`` has one row for each distinct ``fp``. Edges are verified links, but not all of them where
    many fingerprints meet (see the module).
    """
    met = fps.select("fp", F.explode(family_keys(F.col("fp"))).alias("k")).select("fp", "k.choice", "k.value")
    counts = met.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = settle(met.join(counts, ["choice", "value"]))

    few = pivot_table(met.where(F.col("n") <= pair_limit).select("choice", "value", "fp"))
    few = few.groupBy("choice", "value").agg(F.collect_list(F.struct("fp", "d")).alias("m"))

    def apart(a: Column, b: Column) -> Column:
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))))

    def partners(a: Column) -> Column:
        close = F.filter("m", lambda b: (b.fp > a.fp) & (apart(a.d, b.d) <= RADIUS) & (F.bit_count(a.fp.bitwiseXOR(b.fp)) <= RADIUS))
        return F.transform(close, lambda b: F.struct(a.fp.alias("src"), b.fp.alias("dst")))

    pairs = few.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.src", "e.dst")

    many = met.where(F.col("n") > pair_limit).select("fp").distinct()
    ball = F.transform(F.array(F.lit(0).cast("long"), *[F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64)]), lambda bit: F.col("fp").bitwiseXOR(bit))
    hubs = many.select("fp", F.explode(ball).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    stars = hubs.select(F.array_min("m").alias("src"), F.explode("m").alias("dst")).where("src <> dst")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    component_id is the smallest doc_id reachable through links, itself included. Defined cases: null and
    blank texts have fingerprint zero and link like any other; rows with a null id get the component
    of their fingerprint (null if no row of it has an id); repeated rows are returned as often as they
    stand; other columns of ``docs`` aren't looked at; an empty table gives an empty result.
    """
    marked = settle(fingerprints(docs, id_col, text_col))
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(fps.select("fp"), pair_limit))
    grouped = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(grouped.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does, with their columns.

    Components are those of ``resemblance.groups``: two differing bits of a fingerprint would let most edited copies pass.
    The row with the least id stays, of rows with that id the one with the least hash of its text, and of repeated rows one.
    Rows with a null id come after all others. Defined cases: null and blank texts are alike, so one row of all these stays;
    texts of any length are compared whole; extra columns keep their values, whatever their names; an empty table
    stays empty. Texts are only moved if the list of rows that go is too large for a broadcast.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    found = resemblance.groups(keyed.drop("row"))
    stays = (F.col("key") == F.col("first_key")) & (F.col("tie") == F.col("first_tie"))
    rows = settle(found.groupBy("key", "tie").agg(F.bool_and(stays).alias("stays"), F.count("*").alias("n")))
    keyed = keyed.drop("text")
    left = join_small(keyed, settle(rows.where(~F.col("stays")).select("key", "tie")), ["key", "tie"], "left_anti")
    again = settle(rows.where("stays AND n > 1").select("key", "tie"))
    if again.isEmpty():
        return left.select("row.*")
    once = join_small(left, again, ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.first("row").alias("row"))
    return join_small(left, again, ["key", "tie"], "left_anti").select("row.*").unionByName(once.select("row.*"))
