"""A trie of conversations, built as mergeable partial tables of its nodes.

A node is a sequence of turns, and its key a sum of hashes of turns with their places. Sums can be taken piece by piece, so a conversation of any length is
cut into segments: their sums are added up first, then the turns of each segment. Partitions combine the rows of a node locally; tables of nodes are then merged by
key, in rounds, with members summed and lists of ends joined. A node that all conversations share is one row of each partition, then
one of each salt, then one. The roll-up from the leaves doubles its reach in each round: a node first takes what its children
have, then what those two levels below have gathered, then four. So rounds are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sieveline.llm.common import words_of
from sieveline.storage import settle

#: Turns whose places are counted, or whose hashes are summed, in one task; salts of the first merge; ids of a block of ends (a power of two).
SEGMENT = 512
SALTS = 64
BLOCK_BITS = 8
KEY = ["depth", "k1", "k2"]
MODULUS = Decimal((1 << 61) - 1)


@dataclass(frozen=True)
class Trie:
    """``nodes``: KEY, the parent's p1, p2, the least member conv_id, n_convs and n_words of the last turn. ``ends``: KEY, block, ids."""

    nodes: DataFrame
    ends: DataFrame


def steps(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, place, digest, n_words``: the turns of each conversation, numbered from 0 by turn. Texts leave their rows as digests.

    ``turns`` has conv_id, turn, role and text. Defined cases: null roles and texts are empty, null turns come first, and rows without a conv_id are left out; of turns that tie the
    lesser digest comes first, so repeated rows are repeated turns; texts of any length are hashed whole; other columns
    aren't looked at; an empty table gives an empty result. Places are counted over slices of turn numbers and then within them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(words_of(text)).cast("long").alias("n_words"),
    )
    rows = rows.withColumn("__s", F.coalesce(F.expr(f"turn div {segment} - int(turn < 0)"), F.lit(-(1 << 62))))
    sizes = rows.groupBy("conv_id", "__s").agg(F.count("*").alias("__n"))
    before = sizes.select("conv_id", "__s", (F.sum("__n").over(W.partitionBy("conv_id").orderBy("__s")) - F.col("__n")).alias("__before"))
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy("conv_id", "__s").orderBy(F.asc_nulls_first("turn"), "digest")))
    return ranked.join(before, ["conv_id", "__s"]).select("conv_id", (F.col("__before") + F.col("__r") - 1).cast("long").alias("place"), "digest", "n_words")


def _key(total: Column) -> Column:
    return F.pmod(total, F.lit(MODULUS)).cast("long")


def paths(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For each of ``steps``' rows the node that it leads to: KEY, p1, p2, conv_id, n_words, and whether it is the conversation's last."""
    place = F.col("place").cast("long")
    tagged = rows.select(
        "conv_id",
        place.alias("place"),
        F.expr(f"place div {segment}").alias("__s"),
        "n_words",
        F.xxhash64(place, "digest").cast("decimal(20,0)").alias("x1"),
        F.xxhash64(F.lit(1), "digest", place).cast("decimal(20,0)").alias("x2"),
    )
    sums = tagged.groupBy("conv_id", "__s").agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"), F.count("*").alias("n"))
    conv = W.partitionBy("conv_id")
    upto = conv.orderBy("__s")
    before = sums.select("conv_id", "__s", *[(F.sum(f"s{i}").over(upto) - F.col(f"s{i}")).alias(f"b{i}") for i in (1, 2)], F.sum("n").over(conv.orderBy("__s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("turns"))
    here = W.partitionBy("conv_id", "__s").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    run = tagged.withColumns({f"r{i}": F.sum(f"x{i}").over(here) for i in (1, 2)}).join(before, ["conv_id", "__s"])
    after, at = [F.col(f"b{i}") + F.col(f"r{i}") for i in (1, 2)], [F.col(f"b{i}") + F.col(f"r{i}") - F.col(f"x{i}") for i in (1, 2)]
    return run.select(
        (F.col("place") + 1).alias("depth"),
        *[_key(x).alias(f"k{i}") for i, x in enumerate(after, 1)],
        *[_key(x).alias(f"p{i}") for i, x in enumerate(at, 1)],
        "conv_id",
        "n_words",
        (F.col("place") + 1 == F.col("turns")).alias("is_last"),
    )


def _joined(ends: DataFrame) -> DataFrame:
    """Blocks of ends with the same node and number as one, in order. A block has 2**BLOCK_BITS ids at most."""
    return ends.groupBy(*KEY, "block").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def partial(rows: DataFrame, members: DataFrame, segment: int = SEGMENT) -> Trie:
    """The trie of some conversations: ``rows`` as by ``steps``, with places from 0 without gaps; ``members(conv_id)`` are all conversations, also those without rows.

    Nodes are combined within partitions and then by key and salt; a node is a row for each salt at most.
    """
    along = paths(rows, segment)
    zero = F.lit(0).cast("long")
    silent = members.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(True).alias("__silent"))
    root = members.join(silent, "conv_id", "left").select(
        *[zero.alias(c) for c in KEY], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], "conv_id", zero.alias("n_words"), F.coalesce("__silent", F.lit(False)).alias("is_last")
    )
    every = settle(along.unionByName(root))
    counted = every.groupBy(*KEY, F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("__salt")).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_words").alias("n_words")
    )
    ends = every.where("is_last").select(*KEY, F.shiftright("conv_id", BLOCK_BITS).alias("block"), F.array("conv_id").alias("ids"))
    return Trie(counted.drop("__salt"), _joined(ends))


def merge(*tries: Trie) -> Trie:
    """One trie of several whose conversations are different ones: by key, members are summed and lists of ends joined."""
    nodes, ends = (reduce(DataFrame.unionByName, parts) for parts in ([t.nodes for t in tries], [t.ends for t in tries]))
    whole = nodes.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("n_words").alias("n_words"))
    return Trie(whole, _joined(ends) if len(tries) > 1 else ends)


def end_hashes(ends: DataFrame) -> DataFrame:
    """KEY and ``ends_sha256``, of a node's ends in ascending order, joined by commas. A node's blocks come in order; only a running hash is held."""
    schema = "depth long, k1 long, k2 long, ends_sha256 string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for b in batches:
            done = []
            for *new, ids in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if new != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = new, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(out)], schema=out)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, digest.hexdigest()), out)], schema=out)

    in_order = ends.repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return in_order.select(*KEY, F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).mapInArrow(run, schema)


def roll_up(trie: Trie) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each node of a merged trie.

    A node is named by its least member and its depth. ``n_leaves`` and ``saved_tokens`` are over its subtree, itself included. In round k nodes send what
    they have to the node 2**k levels above them, which they know, and ask it for the one as far above itself.
    """
    nodes = settle(trie.nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256().hexdigest()
    named = nodes.join(children, KEY, "left").join(end_hashes(trie.ends), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    named = settle(named.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_words", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
    sums = named.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"))
    deepest = named.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        sent = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("__l"), F.sum("saved_tokens").alias("__t"))
        above = sums.select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("__up"))
        gathered = sums.join(sent, ["conv_id", "depth"], "left").join(above, ["up", "depth"], "left")
        sums = settle(gathered.select("conv_id", "depth", F.col("__up").alias("up"), *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_leaves", "__l"), ("saved_tokens", "__t"))]))
        reach *= 2
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return named.join(sums.drop("up"), ["conv_id", "depth"]).select(columns)


def build(turns: DataFrame) -> DataFrame:
    """``roll_up``'s rows for all conversations of ``turns(conv_id, turn, role, text)``; for the defined cases see ``steps``."""
    rows = settle(steps(turns))
    return roll_up(merge(partial(rows, rows.select("conv_id").distinct())))


def with_shared_heads(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on others' beginnings, as (rows like ``steps``', members).

    A conversation c begins with the first h turns of conversation c - c % ``every`` (all if it has fewer, none if it isn't there) and goes on with its own turns after
    its first h; h is crc32(c) % ``most``. ``rows`` is settled.
    """
    c = F.col("conv_id")
    firsts = rows.where((c % every == 0) & (F.col("place") < most - 1)).groupBy(c.alias("__base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n_words"))).alias("__first"))
    members = rows.select("conv_id").distinct().select("conv_id", (c - c % every).alias("__base"), (F.crc32(c.cast("string")) % most).cast("int").alias("__h"))
    members = members.join(firsts, "__base", "left").select("conv_id", "__h", F.slice(F.coalesce("__first", F.array().cast(rows.select(F.array(F.struct("place", "digest", "n_words")).alias("x")).schema["x"].dataType)), F.lit(1), F.col("__h")).alias("__first"))
    members = settle(members)
    front = members.select("conv_id", F.explode("__first").alias("x")).select("conv_id", "x.*")
    own = rows.join(members.select("conv_id", "__h", F.size("__first").alias("__n")), "conv_id").where(F.col("place") >= F.col("__h"))
    own = own.select("conv_id", (F.col("place") - F.col("__h") + F.col("__n")).alias("place"), "digest", "n_words")
    return own.unionByName(front), members.select("conv_id")


def conversation_nodes(turns: DataFrame, every: int = 20, most: int = 4, segment: int = SEGMENT) -> DataFrame:
    """``build`` after ``with_shared_heads``."""
    rows, members = with_shared_heads(settle(steps(turns, segment)), every, most)
    return roll_up(merge(partial(rows, members, segment)))


def union_of(tries: Sequence[Trie]) -> DataFrame:
    """``roll_up`` of partial tries that were built apart, of different conversations."""
    return roll_up(merge(*tries))
