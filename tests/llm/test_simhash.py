import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from sieveline.llm import simhash
from sieveline.storage import read

SCHEMA = "doc_id long, text string, fp string, d int"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(pairs):
    """Brute force over all pairs; pairs: (doc_id, unsigned fingerprint)."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(pairs)), 2):
        if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(pairs))]


@pytest.mark.parametrize("limit", [simhash.PAIR_LIMIT, 1])
def test_documents_against_brute_force(spark, sf, limit):
    docs = read(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = sorted((d, f, c) for (d, f), c in zip(fps, plain_components(fps)))
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, pair_limit=limit).collect())
    assert got == want


@pytest.mark.parametrize("limit", [12, 3, 1])
def test_links_of_dense_and_chained_fingerprints(spark, limit):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base[:6]:
        x = b
        for _ in range(40):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << bit
            fps.add(x)
    fps |= {base[7] ^ (1 << i) for i in range(64)} | {0, 2**64 - 1, 1 << 63}
    fps = sorted(fps)
    want = plain_components(list(enumerate(fps)))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    from sieveline.operators.graph import connected_components

    edges = simhash.links(df, limit)
    assert all(bin((r.src ^ r.dst) % 2**64).count("1") <= 2 for r in edges.collect())
    roots = {r.node % 2**64: r.root for r in connected_components(edges).collect()}
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(roots.get(f, ("alone", f)), []).append(i)
    assert [next(min(g) for g in got.values() if i in g) for i in range(len(fps))] == want


def test_edge_cases(spark):
    long_text = "word " * 30000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n\t ", "x", 1), (4, "one two", "x", 1), (4, "one two", "x", 1), (None, "ONE\vtwo", "x", 1), (6, long_text, "x", 1), (None, "some other words here", "x", 1)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (6, 6), (None, None)])
    assert len(out) == len(rows)
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "d"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (True, 0)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0
