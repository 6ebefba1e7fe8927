"""Sharding by extendible hashing, in DataFrame functions only.

A document's place is 60 bits of a hash of its id. A shard is a prefix of these bits. Only a prefix whose documents
have too many bytes is split on the next bit, so shards have prefixes of different lengths, and the
directory is indexed by as many bits as the longest of them: each shard fills all entries that begin with its
prefix.

The bytes are summed by prefixes some bits longer than shards need to be on average. From these cells the
sums of all shorter prefixes follow, and the shards are the shortest ones that fit. Cells that don't fit are
split by further bits in rounds that read their documents only. Documents with equal hashes (one id that
stands many times) are never parted by bits; past the last bit they fill pages of the shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.storage import fits_broadcast, join_small, settle

BITS = 60
#: Cells have so many bits more than shards on average, and each further round adds so many.
SPARE_BITS = 6
#: Depths whose prefixes are summed from the same cells.
FOLD = 6
SHARD_BYTES = 2 << 20
#: The largest directory that is broadcast.
DIRECTORY_ROWS, DIRECTORY_BYTES = 1 << 20, 64 << 20


def place(id_col: Column) -> Column:
    """60 bits of the id's md5 as a long; a null id counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def prefixes(cells: DataFrame, low: int, bits: int) -> DataFrame:
    """``__depth, p, b, n`` of all prefixes of ``low`` to ``bits`` bits, from the sums ``b`` and ``n`` of those of ``bits`` bits (``__key``).

    FOLD depths at a time: a cell is made into FOLD rows, not into one for each depth, and cells of the next depths above are 2**FOLD times fewer.
    """
    out = None
    while True:
        least = max(low, bits - FOLD + 1)
        up = F.call_function("shiftright", F.col("__key"), (F.lit(bits) - F.col("__depth")).cast("int"))
        nodes = cells.select("b", "n", "__key", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("__depth")).groupBy("__depth", up.alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        out = nodes if out is None else out.unionByName(nodes)
        if least == low:
            return out
        cells = settle(cells.groupBy(F.shiftright("__key", bits - least + 1).alias("__key")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")))
        bits = least - 1


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``__start, __depth, __open`` of each shard: the least hash with its prefix, the prefix's bits, and whether its documents are
    too many after the last bit. ``rows`` has __h and __bytes.
    """
    total, n = rows.agg(F.coalesce(F.sum("__bytes"), F.lit(0)), F.count("*")).first()
    low, bits = 0, min(BITS, SPARE_BITS + math.ceil(math.log2(max(1, total / limit))))
    todo, found = rows, None
    while True:
        cells = settle(todo.groupBy(prefix(F.col("__h"), bits).alias("__key")).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")))
        nodes = settle(prefixes(cells, low, bits).withColumn("fits", (F.col("b") <= limit) | (F.col("n") == 1)))
        # a shard is a prefix that fits, while the one before it doesn't: of a prefix's children all are looked at
        above = nodes.where("NOT fits").select((F.col("__depth") + 1).alias("__depth"), F.col("p").alias("__above"))
        child = nodes.withColumn("__above", F.shiftright("p", 1))
        first = child.join(above, ["__depth", "__above"], "left_semi") if low else child.join(above, ["__depth", "__above"], "left_semi").unionByName(child.where("__depth = 0"))
        start = F.call_function("shiftleft", F.col("p"), (F.lit(BITS) - F.col("__depth")).cast("int"))
        leaves = first.where("fits").select(start.alias("__start"), "__depth", F.lit(False).alias("__open"))
        found = leaves if found is None else found.unionByName(leaves)
        left = settle(nodes.where(~F.col("fits") & (F.col("__depth") == bits)).select(F.col("p").alias("__key")))
        if left.isEmpty():
            return settle(found)
        if bits == BITS:
            return settle(found.unionByName(left.select(F.col("__key").alias("__start"), F.lit(BITS).alias("__depth"), F.lit(True).alias("__open"))))
        todo = settle(join_small(todo.withColumn("__key", prefix(F.col("__h"), bits)), left, ["__key"], "left_semi").drop("__key"))
        low, bits = bits, min(BITS, bits + SPARE_BITS)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Adds ``shard`` and ``bytes`` to each row; no shard has over ``limit`` bytes unless one text alone does.

    shard is the prefix in bits (``root`` for the empty one), with ``+page`` after it where equal hashes
    overflow. Rows look their shard up in the directory, of which all shards under one of the shortest prefix are one entry: it is
    broadcast if it was measured to have DIRECTORY_ROWS entries and DIRECTORY_BYTES at most (some million shards); beyond that rows move to their entry, once.
    Defined cases: a null text has 0 bytes; a text of any length counts whole; a null id hashes as an empty one; repeated rows share a
    hash and fill pages where they are too many for one shard, the order of equal ones being indifferent; columns named shard or bytes are
    replaced, others keep their values; an empty table gives an empty result.
    """
    # the row travels as one column, so none of its names can meet those used here
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("row"), place(F.col(id_col)).alias("__h"), size.alias("bytes"))
    shards = directory(settle(rows.select("__h", F.col("bytes").alias("__bytes"))), limit)
    base, overflow = shards.agg(F.coalesce(F.min("__depth"), F.lit(0)), F.coalesce(F.bool_or("__open"), F.lit(False))).first()
    entries = shards.groupBy(prefix(F.col("__start"), base).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("__start", "__depth", "__open"))).alias("__in"))
    entries = settle(entries)
    entries = F.broadcast(entries) if fits_broadcast(entries, DIRECTORY_ROWS, DIRECTORY_BYTES) else entries.hint("merge")
    out = rows.withColumn("__key", prefix(F.col("__h"), base)).join(entries, "__key", "left")
    out = out.withColumn("__at", F.element_at(F.filter("__in", lambda x: x["__start"] <= F.col("__h")), -1)).drop("__in", "__key")
    name = F.substring(F.lpad(F.bin("__h"), BITS, "0"), F.lit(1), F.col("__at.__depth"))
    out = out.withColumn("shard", F.when(F.col("__at.__depth") == 0, F.lit("root")).otherwise(name))
    if overflow:
        full = out.where("__at.__open").withColumn("__big", F.col("bytes") > limit // 2)
        order = W.partitionBy("__h", "__big").orderBy("bytes", F.xxhash64(F.col("row")[text_col])).rowsBetween(W.unboundedPreceding, 0)
        page = F.when(F.col("__big"), F.concat(F.lit("b"), F.count(F.lit(1)).over(order).cast("string")))
        half = max(1, limit // 2)
        page = page.otherwise(F.floor((F.sum("bytes").over(order) - F.col("bytes")) / half).cast("string"))
        full = full.withColumn("shard", F.concat(F.col("shard"), F.lit("+"), page)).drop("__big")
        out = out.where(~F.col("__at.__open")).unionByName(full)
    keep = [c for c in docs.columns if c not in ("shard", "bytes")]
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "shard", "bytes")


def manifest(assigned: DataFrame) -> DataFrame:
    """Documents and bytes of each shard."""
    return assigned.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("bytes").alias("bytes"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder for each shard, each written by one task as far as shards allow."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)
