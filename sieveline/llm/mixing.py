"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target of words. Its documents, shuffled by a hash, make one stream that is cut into blocks of
equal words, so its target is a number of blocks, pass after pass. The mix is a row of as many slots as all sources need.
Slot i takes the point ``frac(i * phi)`` of the golden ratio's sequence, and its source is the one in whose share of the
cumulative blocks the point falls, so each source comes up evenly all along the mix. A source's slots are ranked, and the
slot of rank r takes block r (after the last block, the first again). The few slots whose source already has all its
blocks go, in order, to the few ranks for which there was no point. What a document gives to the mix, and where, is
joined from the slots of the blocks that it stands in.

Nothing is ranked in one task: streams are summed by buckets of the shuffle's hash, ranks by chunks of slots, and a block
has at most as many documents as words. Texts take no part in this.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import words_of
from sieveline.storage import join_small, settle

#: Points are multiples of 1 / POINTS, and GOLDEN is the golden ratio's fraction of that, so a point is made from a slot without overflow.
POINTS, GOLDEN = 1 << 31, 1327217885


@dataclass(frozen=True)
class Plan:
    """Weights repeat over the sources in order; a target is at most max_repeats times its source's words. A block has ``block`` words."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_repeats: int = 3
    block: int = 256
    seed: str = "mix"


def with_place(df: DataFrame, id_col: Column, source: Column, text: Column, plan: Plan) -> DataFrame:
    """Adds ``__src`` (the source, never null), ``__size`` (words) and ``__at`` (the place in the shuffle)."""
    return df.withColumns(
        {
            "__src": F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~")),
            "__size": F.size(words_of(text.cast("string"))).cast("long"),
            "__at": F.md5(F.concat(F.lit(plan.seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))),
        }
    )


def targets(placed: DataFrame, plan: Plan) -> DataFrame:
    """One row for each source: ``__src, __no, __words, __weight, __target``.

    Sources count by code point ("~", null, stands last). Targets share all words by weight, and what
    passes max_repeats times a source's words is shared by the others: a level L with
    ``sum(min(L * weight, cap)) = all words``. With sources by cap / weight, L is the greatest of
    ``(all words - caps before) / (weights from here on)``.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in plan.weights]), (F.pmod(F.col("__no") - 1, F.lit(len(plan.weights))) + 1).cast("int"))
    table = placed.groupBy("__src").agg(F.sum("__size").alias("__words"))
    table = table.withColumn("__no", F.row_number().over(W.orderBy("__src"))).withColumn("__weight", w)
    table = table.withColumn("__cap", F.col("__words") * plan.max_repeats)
    by_cap = W.orderBy(F.col("__cap") / F.col("__weight"), "__no")
    everywhere = W.partitionBy(F.lit(0))
    caps_before = F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weights_on = F.sum("__weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    table = table.withColumn("__level", (F.sum("__words").over(everywhere) - caps_before) / weights_on)
    table = table.withColumn("__level", F.max("__level").over(everywhere))
    table = table.withColumn("__target", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__weight")))
    return table.select("__src", "__no", "__words", "__weight", "__target")


def quotas(sources: DataFrame, plan: Plan) -> DataFrame:
    """``sources`` with ``__want`` (words to take), ``__blocks`` of a pass and ``__need`` (blocks of all passes)."""
    want = F.least(F.col("__words") * plan.max_repeats, F.floor(F.col("__target") + 0.5)).cast("long")
    s = sources.withColumns({"__want": want, "__blocks": F.ceil(F.col("__words") / plan.block).cast("long")})
    full, rest = F.floor(F.col("__want") / F.col("__words")), F.pmod("__want", "__words")
    need = F.when(F.col("__words") > 0, full * F.col("__blocks") + F.ceil(rest / plan.block)).otherwise(0)
    return s.withColumn("__need", need.cast("long"))


def schedule(quota: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The mix: ``slot, __src, pass, block, words``, a row for each slot from 0 on.

    ``quota`` is what ``quotas`` returns, settled. The slot takes the first ``words`` words of the block, which are all of them
    unless the stream or the target ends in it.
    """
    spark = quota.sparkSession
    n, n_sources = quota.agg(F.coalesce(F.sum("__need"), F.lit(0)), F.count("*")).first()
    s = quota.where("__need > 0")
    upto = F.sum("__need").over(W.orderBy("__no").rowsBetween(W.unboundedPreceding, 0))
    edge = lambda x: F.floor(x.cast("double") / F.lit(float(max(1, n))) * POINTS).cast("long")
    s = s.withColumns({"__hi": edge(upto), "__lo": edge(upto - F.col("__need"))})

    # points meet the shares by cells, of which there are some for each source
    cell = POINTS >> max(12, (4 * n_sources).bit_length())
    shares = s.where("__hi > __lo").select("__src", "__need", "__lo", "__hi", F.explode(F.sequence(F.floor(F.col("__lo") / cell), F.floor((F.col("__hi") - 1) / cell))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(POINTS)) * GOLDEN, F.lit(POINTS)).alias("p"))
    chunk = 1 << ((n.bit_length() + 1) // 2)
    drawn = join_small(slots.withColumn("cell", F.floor(F.col("p") / cell)), settle(shares), ["cell"], "inner").where("p >= __lo AND p < __hi")
    drawn = drawn.select("slot", "__src", "__need", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = settle(drawn.groupBy("__src", "chunk").agg(F.count("*").alias("n")))
    before = counts.select("__src", "chunk", (F.sum("n").over(W.partitionBy("__src").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = join_small(drawn, settle(before), ["__src", "chunk"], "inner")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("__src", "chunk").orderBy("slot")) - 1)
    ranked = settle(ranked.select("slot", "__src", "__need", "rank"))

    # as many slots are free as ranks have none; by the sequence's low discrepancy they are a few for each source
    free = ranked.where("rank >= __need").select("slot", F.row_number().over(W.orderBy("slot")).alias("k"))
    got = s.join(counts.groupBy("__src").agg(F.sum("n").alias("got")), "__src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = got.where("got < __need").select("__no", "__src", F.explode(F.sequence(F.col("got"), F.col("__need") - 1)).alias("rank"))
    short = short.select("__src", "rank", F.row_number().over(W.orderBy("rank", "__no")).alias("k"))
    every = ranked.where("rank < __need").select("slot", "__src", "rank").unionByName(free.join(short, "k").select("slot", "__src", "rank"))

    which = join_small(every, settle(s.select("__src", "__words", "__want", "__blocks")), ["__src"], "inner")
    which = which.withColumns({"pass": F.floor(F.col("rank") / F.col("__blocks")), "block": F.pmod("rank", "__blocks")})
    offset = F.col("block") * plan.block
    words = F.least(F.lit(plan.block), F.col("__words") - offset, F.col("__want") - F.col("pass") * F.col("__words") - offset)
    return which.select("slot", "__src", "pass", "block", words.alias("words"))


def in_stream(placed: DataFrame, ties: list[str]) -> DataFrame:
    """Adds ``__start`` to each row of ``placed``: the words before it in its source's stream."""
    bucketed = placed.withColumn("__bucket", F.substring("__at", 1, 3))
    sums = bucketed.groupBy("__src", "__bucket").agg(F.sum("__size").alias("__n"))
    before = sums.select("__src", "__bucket", (F.sum("__n").over(W.partitionBy("__src").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    here = F.sum("__size").over(W.partitionBy("__src", "__bucket").orderBy("__at", "__size", *ties).rowsBetween(W.unboundedPreceding, 0))
    rows = bucketed.withColumn("__here", here - F.col("__size"))
    rows = rows.join(before.hint("merge"), ["__src", "__bucket"])  # dealt as the windows are
    return rows.withColumn("__start", F.col("__before") + F.col("__here")).drop("__bucket", "__here", "__before")


def drawn_parts(rows: DataFrame, slots: DataFrame, plan: Plan, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with ``pass, slot, part``, a row for each slot that takes words of a document; part is how many."""
    b = F.lit(plan.block)
    last = F.floor((F.col("__start") + F.col("__size") - 1) / b)
    parts = rows.where("__size > 0").select("__src", "__start", "__size", *columns, F.explode(F.sequence(F.floor(F.col("__start") / b), last)).alias("block"))
    parts = parts.join(slots, ["__src", "block"])
    low = F.greatest("__start", F.col("block") * b)
    part = F.least(F.col("__start") + F.col("__size"), F.col("block") * b + F.col("words")) - low
    return parts.withColumn("part", part).where("part > 0")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, slot, n_slots`` for each row of ``docs``.

    taken: words that all slots take of the document, repeats counted. slot: the first of them, its place in the mix, null
    if there is none. n_slots: how many there are. Defined cases: a null or blank text has size 0 and nothing is taken of it;
    a text of any length is cut into blocks like any other; null is a source, the last; rows with a null id and repeated rows are
    mixed as rows of their own; other columns aren't looked at, whatever their names; an empty table gives an empty
    result. The shuffle and the schedule depend on the rows only, so reruns agree; which of several equal rows comes first doesn't matter.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("__of"), F.col(text_col).alias("__text"))
    placed = settle(with_place(narrow, F.col("doc_id"), F.col("__of"), F.col("__text"), plan).drop("__text", "__of"))
    quota = settle(quotas(targets(placed, plan), plan))
    rows = settle(in_stream(placed, []).drop("__at"))
    given = drawn_parts(rows, schedule(quota, plan), plan, []).groupBy("__src", "__start").agg(F.sum("part").alias("taken"), F.min("slot").alias("slot"), F.count("*").alias("n_slots"))
    # of rows with the same start only one has any words
    given = given.withColumn("__words_in", F.lit(True))
    rows = rows.withColumn("__words_in", F.col("__size") > 0).join(given, ["__src", "__start", "__words_in"], "left")
    rows = join_small(rows, settle(quota.select("__src", "__words", "__target")), ["__src"])
    none = F.lit(0).cast("long")
    return rows.select(
        "doc_id", F.col("__size").alias("size"), F.col("__words").alias("source_size"), F.col("__target").alias("target"),
        F.coalesce("taken", none).alias("taken"), "slot", F.coalesce("n_slots", none).alias("n_slots"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """The mix: rows of ``docs`` with its columns, in the order of the schedule's slots.

    A document has a row for each pass that takes words of it, where the first of its slots stands. Partitions are equal ranges of
    slots, sorted, so what is written is in the mix's order. The one document of a source in which its last pass ends is cut to the
    words taken, joined by spaces; rows of which nothing is taken (null and blank texts among them) are left out. A column
    n_chars, if any, is brought up to date for cut texts. Defined cases are those of ``mix``; extra columns keep their values,
    whatever their names. Texts are moved twice: to their slots by row, and into the order of slots.
    """
    spark = docs.sparkSession
    whole = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    # the row travels as one column, so none of its names can meet those used here; rows of one key are equal
    rows = docs.select(F.struct("*").alias("__row"), F.xxhash64(F.col(id_col).cast("string")).alias("__key"), F.xxhash64(*whole).alias("__tie"), F.col(id_col).alias("__id"), F.col(source_col).alias("__of"), F.col(text_col).alias("__text"))
    placed = with_place(rows.drop("__row"), F.col("__id"), F.col("__of"), F.col("__text"), plan).drop("__id", "__of", "__text")
    placed = settle(placed)
    quota = settle(quotas(targets(placed, plan), plan))
    n = quota.agg(F.coalesce(F.sum("__need"), F.lit(0))).first()[0]
    parts = drawn_parts(in_stream(placed, ["__tie"]), schedule(quota, plan), plan, ["__key", "__tie"])
    keys = ["__key", "__tie"]
    picks = parts.groupBy("__src", "__start", "pass", *keys, "__size").agg(F.sum("part").alias("__take"), F.min("slot").alias("__slot"))
    once = rows.groupBy(*keys).agg(F.first("__row").alias("__row"))
    found = once.join(picks.select(*keys, "__start", "__size", "__take", "__slot").hint("merge"), keys)
    cut, text = F.col("__take") < F.col("__size"), F.col("__row")[text_col]
    short = F.array_join(F.slice(words_of(text), F.lit(1), F.col("__take").cast("int")), " ")
    new = {text_col: F.when(cut, short).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length(short)).otherwise(F.col("__row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartitionById(ranges, F.floor(F.col("__slot") * ranges / F.lit(max(1, n))).cast("int")).sortWithinPartitions("__slot", "__start")
    return found.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])
