"""Near-duplicates by Jaccard similarity of five-word shingles, found without missing a pair.

Texts link if their shingle sets have a Jaccard coefficient of at least four fifths; a component is what links reach.

Candidates. Under any one order of all shingles, two sets of a and b members with that coefficient share one
among the first ``a // 5 + 1`` of the one and the first ``b // 5 + 1`` of the other. Only these are indexed, rare ones
first (by counts in ``1 << BITS`` hash buckets), so what many texts have in common seldom is. The order changes the work
only, never the result.

Pivots. Every set has a wide SimHash fingerprint. Of the sets that share an indexed shingle the least is the reference,
the hub. The others' Hamming distances to their hub are the table: the hub itself is compared with those within ``REACH``,
and two others only if their distances to it differ by no more than that, their own distance passes, and the hub left
them in different components. Where more than ``FEW`` sets share a shingle, only those are paired that differ from a reference
for their hub in the same places (``links_by_delta``): near copies of one text that don't link with each other have little else in
common than that text. These come first, and of what differs in one place each set is compared with one of them before pairs are
made of what is still apart. At a coefficient of 0.8 a bit differs with odds of 0.19 at most, so ``REACH`` bits of
``LANES * 64`` are seven standard deviations away. Of a large group of near copies all but the strays are compared once.

Parities. A set has a second sketch: of each of ``PARITIES * 64`` cells of shingles, whether it has an odd number of members. Every place in which
two sets differ changes one bit, so sets differ in as many places as their parities at least, and pairs of which these say that they can't link are
dropped where they meet, before any row is made for them. No link is lost by it; it tells little of texts of some thousand words and more.

Every link is verified on the whole sets. Shingles and sets are known by 64-bit hashes. Texts of fewer than five words are a
shingle of their own; texts without words are alike.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import per_batch, texts
from sieveline.operators.graph import connected_components
from sieveline.storage import join_small, settle, settle_measured, sweep, write_out

SHINGLE = 5
SEED = 42
#: Log2 of the buckets by which shingles are counted for their order.
BITS = 18
#: Words of 64 bits in a fingerprint, and the most bits in which fingerprints of linked sets differ.
LANES, REACH = 4, 96
#: Words of 64 parities in a set's second sketch.
PARITIES = 16
#: Sets that share an indexed shingle and are compared pair by pair; beyond it pairs come through their differences from a reference.
#: A set costs some hundred of these, so up to here there are fewer pairs.
FEW = 128
#: Members of a hub's group, about, that vote on its reference.
VOTERS = 64
#: Shingles whose bits are unpacked at a time.
UNPACK = 1 << 14
#: Odd multipliers that tell the places of a shingle's words apart, those of a fingerprint's words, and one that mixes the sum.
_PLACES = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_LANES = [0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95]
_MIX = np.uint64(0xE7037ED1A0B428DB)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted signed longs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(words) < SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        one = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
        n = len(words) - SHINGLE + 1
        h = np.zeros(n, dtype=np.uint64)
        for j, p in enumerate(_PLACES):
            h += one[j : j + n] * np.uint64(p)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def node(s: np.ndarray) -> int:
    """A set's own hash as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64))


def fingerprint(s: np.ndarray) -> list[int]:
    """Majority votes of a set's members on ``LANES * 64`` bits, as signed longs."""
    ones = np.zeros(LANES * 64, dtype=np.int64)
    for k in range(0, len(s), UNPACK):
        h = s[k : k + UNPACK].view(np.uint64)
        x = np.stack([h * np.uint64(p) for p in _LANES], axis=1)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s)).view(np.int64).tolist()


def parities(s: np.ndarray) -> list[int]:
    """For each cell of shingles whether a set has an odd number of them, as signed longs."""
    cells = (s & (PARITIES * 64 - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=PARITIES * 64).astype(np.uint8) & 1).view(np.int64).tolist()


def apart(a: Column, b: Column, words: int = LANES) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))


def near_parities(a: Column, b: Column, m: Column, n: Column) -> Column:
    """Whether sets of m and n members may have a coefficient of four fifths by their parities: these differ in (m + n) / 9 places at most."""
    return 9 * apart(a, b, PARITIES) <= m + n


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often shingles of each bucket stand in the texts of ``docs``."""

    def run(batch):
        return np.unique(np.concatenate([_bucket(shingles(t)) for t in texts(batch, "text")]), return_counts=True)

    # bounded by construction: a row for each bucket
    rows = per_batch(docs.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BITS, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


FOUND = "key long, tie long, node long, n int, fp array<long>, odd array<long>, tokens array<long>"


def marked(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``key, tie, node, n, fp, odd, tokens``: the set of each text, its size, its fingerprint and parities, and the shingles it is indexed by."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    def run(batch):
        nodes, sizes, fps, odds, firsts = [], [], [], [], []
        for t in texts(batch, "text"):
            s = shingles(t)
            order = np.lexsort((s, shared.value[_bucket(s)]))
            nodes.append(node(s))
            sizes.append(len(s))
            fps.append(fingerprint(s))
            odds.append(parities(s))
            firsts.append(s[order[: len(s) // 5 + 1]])
        return batch.column(0), batch.column(1), nodes, sizes, fps, odds, firsts

    return per_batch(docs.select("key", "tie", "text"), run, FOUND)


def sets_of(docs: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, s``: the sets of ``nodes``, made again from one text of each."""
    keys = found.select("key", "tie", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "tie")).alias("k"))
    picked = join_small(docs, settle(keys.select("k.*").distinct()), ["key", "tie"], "left_semi").select("text")

    def run(batch):
        sets = [shingles(t) for t in texts(batch, "text")]
        return [node(s) for s in sets], sets

    return per_batch(picked, run, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))


def linked(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets have a coefficient of four fifths, in whole numbers; ``pairs`` is settled."""
    sets = sets_of(docs, found, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return settle(both.where(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select(*pairs.columns))


def _fits(m: Column, n: Column) -> Column:
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def index_of(found: DataFrame) -> DataFrame:
    """``hub, node, token``: the sets that share an indexed shingle with a lesser one, and the least that has it."""
    index = found.select("node", F.explode("tokens").alias("token"))
    hubs = index.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("token", "hub")
    return settle(join_small(index, settle(hubs), ["token"], "inner").where("node <> hub").distinct())


def distances(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hub, node, n, fp, d, fits``: the table of distances to the hubs, and whether sizes and parities let them link."""
    hub = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("fp").alias("hub_fp"), F.col("odd").alias("hub_odd"))
    table = index.select("hub", "node").distinct().join(nodes, "node").join(hub, "hub")
    fits = _fits(F.col("n"), F.col("hub_n")) & near_parities(F.col("odd"), F.col("hub_odd"), F.col("n"), F.col("hub_n"))
    return settle(table.select("hub", "node", "n", "fp", apart(F.col("fp"), F.col("hub_fp")).alias("d"), fits.alias("fits")))


def _roots_of(index: DataFrame, table: DataFrame, roots: DataFrame) -> DataFrame:
    left = index.join(table.drop("fits"), ["hub", "node"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return settle(left.select("token", "hub", "node", "n", "fp", "d", "root"))


def split_tokens(left: DataFrame) -> DataFrame:
    """``token, main, sets``: the shingles whose sets, but for the hub, are in several components, and the one with most of them."""
    per_root = left.groupBy("token", "root").agg(F.count("*").alias("c"))
    split = per_root.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("sets"), F.count("*").alias("c"))
    return settle(split.where("c > 1").select("token", "main", "sets"))


def members_of_many(index: DataFrame, table: DataFrame, roots: DataFrame) -> DataFrame:
    """``hub, node, n, root``: what shares with more than ``FEW`` sets a shingle that the hubs left in several components."""
    left = _roots_of(index, table, roots)
    many = left.join(split_tokens(left).where(F.col("sets") > FEW), "token", "left_semi")
    return settle(many.select("hub", "node", "n", "root").distinct())


def other_pairs(index: DataFrame, table: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b, ra, rb``: pairs without a hub, in shingles of ``FEW`` sets at most, that may link and are in different components so far."""
    left = _roots_of(index, table, roots)
    pairs = settle(pairs_of_few(left.join(split_tokens(left).where(F.col("sets") <= FEW), "token")).distinct())
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}")) for x in "ab")
    near = near_parities(F.col("odda"), F.col("oddb"), F.col("na"), F.col("nb"))
    return settle(pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "ra", "rb"))


def pairs_of_few(left: DataFrame) -> DataFrame:
    """Pairs whose fingerprints are close, of those outside a shingle's main component against all of its ``FEW`` sets at most."""
    x, y = left.where("root <> main").alias("x"), left.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    close = (F.abs(F.col("x.d") - F.col("y.d")) <= REACH) & (apart(F.col("x.fp"), F.col("y.fp")) <= REACH)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & _fits(F.col("x.n"), F.col("y.n")) & close)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))


def references(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, r``: what over half of some ``VOTERS`` members of a hub's group have. Any other set would do, at more work."""
    some = members.groupBy("hub").agg(F.count("*").alias("c"))
    voters = members.join(some, "hub").where(F.pmod(F.xxhash64("hub", "node"), F.ceil(F.col("c") / VOTERS)) == 0).select("hub", "node")
    votes = voters.join(sets, "node").select("hub", F.explode("s").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("v"))
    held = votes.join(voters.groupBy("hub").agg(F.count("*").alias("k")), "hub").where("2 * v > k")
    return held.groupBy("hub").agg(F.collect_list("e").alias("r"))  # no longer than two sets of an average size


def linked_places(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs(hub, a, b, ra, rb)`` that link: the places in which two sets differ from each other are those in which only one differs from the reference."""

    def side(x: str) -> DataFrame:
        return rows.select("hub", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}"), F.col("places").alias(f"p{x}"))

    both = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    differ = F.col("ma") + F.col("mb") - 2 * F.size(F.array_intersect("pa", "pb"))
    return both.where(9 * differ <= F.col("na") + F.col("nb")).select("a", "b", "ra", "rb")


def links_by_delta(docs: DataFrame, found: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``a, b, ra, rb`` of ``members(hub, node, n, root)`` of one hub, found through their differences from the hub's reference; with the roots
    they make the components that all links of these members make.

    Sets of a and b members link if they differ in (a + b) / 9 places at most. With m the places in which a set differs from
    the reference, two with 9 (m + m') <= a + b link for certain, and both with the set of the least 9 m - a, which is compared with all.
    All others that link have at least (9 (m + m') - (a + b)) / 18 of these places in common. So under one order of the places, rare ones
    first, the first common one is among the first b // 8 + 1 of the one with fewer and the first a // 4 + 1 of the other, and what stands
    before it in either is a difference. Places of one set alone come first and are never joined.

    Sets that share such a place are compared with one of them first, the one nearest to the reference; pairs are made only of what that
    leaves in different components. The larger a group is the more of it hangs together after that.
    """
    spark = docs.sparkSession
    sets = settle(sets_of(docs, found, members.select("node").distinct()))
    sweep(spark)
    known = settle(references(members, sets))
    sweep(spark)
    none = F.array().cast("array<long>")
    rows = join_small(members.join(sets, "node"), known, ["hub"], "left").withColumn("r", F.coalesce("r", none))
    rows = rows.withColumn("places", F.concat(F.array_except("s", "r"), F.array_except("r", "s")))
    rows = settle(rows.select("hub", "node", "n", "root", F.size("places").alias("m"), "places").withColumn("f", 9 * F.col("m") - F.col("n")))
    sweep(spark)
    best = settle(rows.groupBy("hub").agg(F.min(F.struct("f", "node", "root")).alias("best")))
    near = join_small(rows.drop("places"), best, ["hub"], "inner").where((F.col("root") != F.col("best.root")) & (F.col("f") + F.col("best.f") <= 0))
    near = near.select(F.col("best.node").alias("a"), F.col("node").alias("b"), F.col("best.root").alias("ra"), F.col("root").alias("rb"))

    places = rows.select("hub", "node", F.explode("places").alias("e"))
    often = settle(places.groupBy("hub", "e").agg(F.count("*").alias("c")).where("c > 1"))
    sweep(spark)
    order = join_small(places, often, ["hub", "e"], "inner").groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("order"))
    ranked = rows.drop("places").join(order, ["hub", "node"]).join(nodes.select("node", "odd"), "node")
    ranked = ranked.select("hub", "node", "n", "root", "m", "f", "odd", (F.col("m") - F.size("order")).alias("alone"), F.posexplode("order").alias("pos", "o"))
    ranked = ranked.select("hub", "node", "n", "root", "m", "f", "odd", (F.col("alone") + F.col("pos")).alias("at"), F.col("o.e").alias("e"))
    ranked = settle(ranked.where(F.col("at") <= F.floor(F.col("n") / 4)))
    sweep(spark)

    def may_link(x: str, y: str) -> Column:
        c = lambda side, name: F.col(f"{side}.{name}")
        rest = F.least(c(x, "m") - c(x, "at"), c(y, "m") - c(y, "at"))
        enough = 18 * rest >= 9 * (c(x, "m") + c(y, "m")) - (c(x, "n") + c(y, "n"))
        return _fits(c(x, "n"), c(y, "n")) & enough & near_parities(c(x, "odd"), c(y, "odd"), c(x, "n"), c(y, "n"))

    def named(x: str, y: str) -> list[Column]:
        return [F.col("hub"), F.col(f"{x}.node").alias("a"), F.col(f"{y}.node").alias("b"), F.col(f"{x}.root").alias("ra"), F.col(f"{y}.root").alias("rb")]

    pivots = ranked.groupBy("hub", "e").agg(F.min(F.struct("f", "node", "n", "root", "m", "odd", "at")).alias("x"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = ranked.alias("y").join(pivots, ["hub", "e"]).where((F.col("x.root") != F.col("y.root")) & may_link("x", "y"))
    stars = settle(stars.select(*named("x", "y")).distinct())
    links = settle_measured(near.unionByName(linked_places(rows, stars)))
    sweep(spark)
    tops = connected_components(links.select(F.col("ra").alias("src"), F.col("rb").alias("dst"))).select(F.col("root").alias("top"), F.col("node").alias("root"))
    left = settle(join_small(ranked, tops, ["root"], "left").withColumn("top", F.coalesce("top", "root")))
    per_top = left.groupBy("hub", "e", "top").agg(F.count("*").alias("c")).groupBy("hub", "e").agg(F.count("*").alias("c"))
    left = settle(left.join(per_top.where("c > 1").drop("c"), ["hub", "e"]))
    sweep(spark)
    y = left.where(F.col("at") <= F.floor(F.col("n") / 8)).alias("y")
    fewer = F.struct("y.m", "y.node") < F.struct("x.m", "x.node")
    pairs = left.alias("x").join(y, ["hub", "e"]).where((F.col("x.top") != F.col("y.top")) & fewer & may_link("x", "y"))
    pairs = settle(pairs.select(*named("x", "y")).distinct())
    return settle_measured(links.unionByName(linked_places(rows, pairs)).distinct())


def merged(roots: DataFrame, late: DataFrame) -> DataFrame:
    """``node, root`` after the links ``late(a, b, ra, rb)`` between components of ``roots``."""
    joined = connected_components(late.select(F.col("ra").alias("src"), F.col("rb").alias("dst")))
    ends = late.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("e")).select("e.*")
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return settle_measured(roots.unionByName(ends).distinct().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def components(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``node, root`` of the sets that link with another; ``found`` is what ``marked`` gives, written out."""
    spark = docs.sparkSession
    nodes = settle(found.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd")))
    index = index_of(found)
    sweep(spark)
    table = distances(index, nodes)
    star = linked(docs, found, settle(table.where((F.col("d") <= REACH) & F.col("fits")).select(F.col("hub").alias("a"), F.col("node").alias("b"))))
    sweep(spark)
    roots = connected_components(star.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = members_of_many(index, table, roots)
    sweep(spark)
    if not members.isEmpty():
        roots = merged(roots, links_by_delta(docs, found, members, nodes))
        sweep(spark)
    pairs = other_pairs(index, table, nodes, roots)
    sweep(spark)
    if pairs.isEmpty():
        return roots
    late = linked(docs, found, pairs)
    sweep(spark)
    return merged(roots, late)


def groups(docs: DataFrame) -> DataFrame:
    """``key, tie, first_key, first_tie`` for each row of ``docs(key, tie, text)``: the least row that links reach, itself included."""
    found = write_out(marked(docs, bucket_counts(docs)))
    roots = components(docs, found)
    sets = found.groupBy("node").agg(F.min(F.struct("key", "tie")).alias("k")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sets = settle(sets)
    least = sets.groupBy("root").agg(F.min("k").alias("first"))
    named = settle(sets.join(least, "root").select("node", F.col("first.key").alias("first_key"), F.col("first.tie").alias("first_tie")))
    return found.select("key", "tie", "node").join(named, "node").drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``: the smallest doc_id that links reach, itself included.

    Defined cases: null and blank texts are alike; a row with a null id gets the component of its text, null if no row of
    it has an id; rows with the same id and repeated rows are returned as often as they stand; texts of any length are compared
    whole; other columns aren't looked at, whatever their names; an empty table gives an empty result.
    """
    last = F.lit((1 << 63) - 1)
    text = F.col(text_col).cast("string")
    found = groups(docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text")))
    return found.select(F.nullif("key", last).alias("doc_id"), F.nullif("first_key", last).alias("component_id"))
