import hashlib
import math
from collections import Counter, defaultdict

import pytest
from oracle import compare
from pyspark.sql import functions as F

from sieveline.llm import mixing, oracles, queries, sharding

DOCS = "doc_id long, text string, source string, shard string, size int, __src string"


def rows(n=60):
    out = [(i, "w " * (i * 7 % 23), f"src{i % 5}", "x", 1, "y") for i in range(n)]
    return [*out, (None, "a b c", "src0", "x", 1, "y"), (7, None, None, None, None, None), (8, "one two", None, "x", 1, "y"), (3, "w w w", "src1", "x", 1, "y"), (3, "w w w", "src1", "x", 1, "y"), (99, "big " * 5000, "é", "x", 1, "y")]


@pytest.mark.parametrize("name", ["op8_extendible_sharding", "op10_mixing"])
def test_against_sql(spark, name):
    compare(spark, queries.queries()[name], oracles.SQL[name], "/root/testdata/sf0.01")


def test_mix_meets_targets_and_limits(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    by = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r.size
        by[r.source_size, r.target].append(r)
    for (size, target), part in by.items():
        assert target <= 3 * size
        assert abs(sum(r.taken for r in part) - target) <= 0.5
    assert abs(sum(t for _, t in by) - sum(r.size for r in got)) < 1e-6


def test_schedule_is_even_and_whole(spark):
    plan = mixing.Plan(block=4)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(600)] + [(1000, "tiny source", "t")], "doc_id long, text string, source string")
    placed = mixing.with_place(docs, F.col("doc_id"), F.col("source"), F.col("text"), plan)
    quota = mixing.settle(mixing.quotas(mixing.targets(placed, plan), plan))
    want = {r["__src"]: r for r in quota.collect()}
    slots = mixing.schedule(quota, plan).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(sum(r["__need"] for r in want.values())))
    total = Counter()
    for r in slots:
        total[r["__src"]] += r["words"]
    assert {k: abs(total[k] - r["__target"]) <= 0.5 for k, r in want.items()} == dict.fromkeys(want, True)
    for k in want:  # every block of every pass, once
        mine = sorted((r["pass"], r["block"]) for r in slots if r["__src"] == k)
        blocks = -(-want[k]["__words"] // 4)
        assert mine == [(i // blocks, i % blocks) for i in range(want[k]["__need"])]
    # at any point of the mix each source is close to its share
    seen = Counter()
    for n, r in enumerate(slots, 1):
        seen[r["__src"]] += 1
        assert all(abs(seen[k] - n * want[k]["__need"] / len(slots)) <= 4 for k in want)


def plain_mix(data, block, golden):
    """(row, slots that take words of it) by laying out streams and slots word by word. data: (doc_id, words, source)."""
    sources = sorted({s for *_, s in data})
    size = {s: sum(n for _, n, x in data if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    level, open_ = 0, set(sources)
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in sources if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            break
        open_ -= full
    want = {s: math.floor(level * weight[s] + 0.5) if s in open_ else 3 * size[s] for s in sources}
    ranks = {}
    for s in sources:
        stream = [d for d in sorted((d for d in data if d[2] == s), key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()) for _ in range(d[1])]
        cut = [stream[i : i + block] for i in range(0, len(stream), block)]
        ranks[s], left = [], want[s]
        while left > 0:
            ranks[s].append(cut[len(ranks[s]) % len(cut)][:left])
            left -= len(ranks[s][-1])
    n, upto, ends = sum(map(len, ranks.values())), 0, []
    for s in sources:
        upto += len(ranks[s])
        ends.append((math.floor(upto / n * 2**31), s))
    slots, free, used = {}, [], Counter()
    for i in range(n):
        s = next(s for end, s in ends if i * golden % 2**31 < end)
        if used[s] < len(ranks[s]):
            slots[i] = ranks[s][used[s]]
            used[s] += 1
        else:
            free.append(i)
    rest = sorted((r, k, s) for k, s in enumerate(sources) for r in range(used[s], len(ranks[s])))
    slots |= {i: ranks[s][r] for i, (r, _, s) in zip(free, rest, strict=True)}
    by = defaultdict(list)
    for i in sorted(slots):
        for d, words in Counter(slots[i]).items():
            by[d].append((i, words))
    return by


@pytest.mark.parametrize("golden", [mixing.GOLDEN, 1])
def test_mix_against_brute_force(spark, monkeypatch, golden):
    """Slots are those of the sequence; another multiplier, which spoils it, gives other ones."""
    monkeypatch.setattr(mixing, "GOLDEN", golden)
    data = [(i, 1 + i * 37 % 90, f"s{i * i % 7 % 4}") for i in range(300)]
    docs = spark.createDataFrame([(d, "w " * n, s) for d, n, s in data], "doc_id long, text string, source string")
    got = {r.doc_id: (r.taken, r.slot, r.n_slots) for r in mixing.mix(docs, plan=mixing.Plan(block=16)).collect()}
    want, other = plain_mix(data, 16, golden), plain_mix(data, 16, 442405961)
    row = lambda by, d: (sum(w for _, w in by[d]), by[d][0][0] if by[d] else None, len(by[d]))
    assert got == {d[0]: row(want, d) for d in data} != {d[0]: row(other, d) for d in data}


def test_mixed_documents_are_in_the_order_of_slots(spark):
    docs = spark.createDataFrame([(i, f"d{i} " * (1 + i * 37 % 90), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    first = {r.doc_id: r.slot for r in mixing.mix(docs, plan=mixing.Plan(block=16)).collect()}
    out = [r.doc_id for r in mixing.mixed_documents(docs, plan=mixing.Plan(block=16)).collect()]
    seen = list(dict.fromkeys(out))
    assert [first[d] for d in seen] == sorted(first[d] for d in seen) and len({d % 3 for d in out[:20]}) == 3


def test_mixed_documents_carry_the_words_taken(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r.doc_id] += len((r.text or "").split())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_clashing_names_keep_their_values(spark):
    schema = "doc_id long, text string, source string, n_chars int, __src string, __at string, __size int, __row string, row string, key int, rank string, tie string, fp int, __h int, __q string, __kept string, bytes string"
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60)), "s", 7, "a", "b", 3, "c", "d", 4, "e", "f", 5, 6, "g", "h", "i") for i in range(5)], schema)
    want = sorted(map(tuple, docs.collect()))
    from sieveline.llm import quality, simhash

    for kept in (quality.keep_good(docs), simhash.keep_first(docs), mixing.mixed_documents(docs)):
        assert kept.schema.names == docs.columns and sorted(map(tuple, kept.collect())) == want
    out = sharding.assign(docs).collect()
    assert sorted(tuple(r)[:16] for r in out) == [w[:16] for w in want] and all(isinstance(r.bytes, int) for r in out)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.mix(docs).count() == mixing.mixed_documents(docs).count() == sharding.assign(docs).count() == 0
    nulls = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix(nulls).collect()] == [(1, 0, 0, 0.0, 0, None, 0)]


def place(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def plain_shards(data, limit):
    """Splits buckets one bit at a time, as they overflow."""
    out, todo = {}, [("", [(place(d), k, len((t or "").encode())) for k, (d, t) in enumerate(data)])]
    while todo:
        name, bucket = todo.pop()
        if sum(b for *_, b in bucket) <= limit or len(bucket) <= 1:
            out |= {k: name or "root" for _, k, _ in bucket}
        else:
            for bit in "01":
                todo.append((name + bit, [x for x in bucket if format(x[0], "060b")[len(name)] == bit]))
    return [out[k] for k in range(len(data))]


@pytest.mark.parametrize(("limit", "sent"), [(50, True), (400, True), (400, False), (10**9, True)])
def test_shards_against_splitting_by_bits(spark, monkeypatch, limit, sent):
    if not sent:  # as with a directory that is too large for a broadcast
        monkeypatch.setattr(sharding, "fits_broadcast", lambda *a: False)
    data = [(i, "x" * (i * 37 % 90)) for i in range(300)] + [(1000, "y" * 5000), (1001, None)]
    docs = spark.createDataFrame([(*r, "old") for r in data], "doc_id long, text string, shard string")
    got = sharding.assign(docs, limit=limit)
    assert Counter((r.doc_id, r.shard) for r in got.collect()) == Counter((d, s) for (d, _), s in zip(data, plain_shards(data, limit)))
    for r in sharding.manifest(got).collect():
        assert r.bytes <= limit or r.n_docs == 1
    assert got.columns == ["doc_id", "text", "shard", "bytes"]


def test_equal_hashes_fill_pages(spark):
    data = [(5, "z" * 30)] * 50 + [(None, "q" * 80)] * 3 + [(6, "é")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sharding.assign(docs, limit=100)
    assert got.count() == len(data)
    assert all(r.bytes <= 100 for r in sharding.manifest(got).collect())
