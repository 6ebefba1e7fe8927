import random
import sys
from itertools import combinations

import corpus_pipeline
import numpy as np

from sieveline.llm import resemblance
from sieveline.storage import read


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(rows):
    """Brute force over all pairs of (doc_id, text)."""
    sets, root = plain_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def planted():
    """Edited copies, chains of them, a large group, and a line that unlike texts have in common."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, rows = text(30), []
    for _ in range(25):
        base = text(rng.choice([5, 60, 200]))
        rows.append(base)
        for _ in range(4):  # each edits the one before, so that ends of a chain needn't link
            base = [w if rng.random() > 0.025 else f"e{rng.randrange(10**6)}" for w in base]
            rows.append(base)
    big = text(150)
    rows += [[*big[:k], f"n{k}", *big[k + 1 :]] for k in range(0, 150, 2)]
    rows += [[*line, *text(rng.choice([3, 6, 100]))] for _ in range(60)]
    rows += [[], ["one"], ["one"], ["One", "two"]]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def family():
    """Edited copies of one text that mostly don't link with each other, the text itself among them or not."""
    rng = random.Random(5)
    base, other = ([f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(2))
    rows = []
    for k in range(140):
        copy = list(base if k < 100 else other)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [f"e{rng.randrange(40)}"]
        rows.append(copy)
    rows += [base, base[:100] + other[:20], base + other]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_by_differences_from_a_reference(spark, sf, monkeypatch):
    for few, voters in ((1, 64), (1, 1), (16, 64)):
        monkeypatch.setattr(resemblance, "FEW", few)
        monkeypatch.setattr(resemblance, "VOTERS", voters)
        for rows in (planted(), family()):
            want = plain_components(rows)
            got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got == want and len(set(want.values())) < len(rows)


def test_against_brute_force(spark, sf):
    for rows in (planted(), [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]):
        want = plain_components(rows)
        got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want and len(set(want.values())) < len(rows)


def test_stage_drops_edited_copies(spark, sf):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for k, edits in enumerate((2, 4, 6, 7), 1):  # each edit changes five shingles
        w = list(base)
        for i in rng.sample(range(5, 395, 6), edits):
            w[i] = f"edit{k}x{i}"
        rows.append((k, " ".join(w)))
    rows.append((9, " ".join(f"v{i}" for i in range(400))))
    a = plain_sets([t for _, t in rows])
    assert all(0.8 <= len(a[0] & s) / len(a[0] | s) < 1 for s in a[1:5])
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9]


def test_pairs_of_near_copies_grow_with_their_number(spark, monkeypatch):
    """Copies of one text with two or three edited words each: with four times as many there are sixteen times the links, and still at most eight pairs a copy are verified."""
    verified = []

    def counted(verify):
        def run(*given):
            verified.append(given[-1].count())
            return verify(*given)

        return run

    for name in ("linked", "linked_places"):
        if hasattr(resemblance, name):
            monkeypatch.setattr(resemblance, name, counted(getattr(resemblance, name)))

    def copies(n):
        rng = random.Random(6)
        base = [f"w{rng.randrange(10**6)}" for _ in range(146)]
        for k in range(n):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.choice([2, 3])):
                copy[at] = f"e{rng.randrange(10**6)}"
            yield k, " ".join(copy)

    for n in (500, 2000):
        rows = list(copies(n))
        verified.clear()
        got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if n == 500:
            assert got == plain_components(rows)
        assert sum(verified) <= 8 * n, verified


def test_size_estimates_stay_small(spark, monkeypatch):
    """A checkpoint keeps the planner's estimate of what it was made of; along the joins these came to megabytes a number, in the driver."""
    sys.set_int_max_str_digits(0)
    bits = []

    def seen(settle):
        def run(df):
            kept = settle(df)
            bits.append(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
            return kept

        return run

    monkeypatch.setattr(resemblance, "FEW", 16)
    for name in ("settle", "settle_measured"):
        if hasattr(resemblance, name):
            monkeypatch.setattr(resemblance, name, seen(getattr(resemblance, name)))
    rows = [*planted(), *((10_000 + d, t) for d, t in family())]
    got = {r.doc_id: r.component_id for r in resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows) and len(bits) > 30
    assert max(bits) < 4_000, bits


def test_parities_never_say_more_than_sets_differ():
    rng = np.random.default_rng(1)
    for n in (0, 1, 30, 3000):
        s = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        t = np.unique(np.concatenate([s[n // 3 :], rng.integers(-(2**63), 2**63 - 1, n // 4)]))
        bits = sum((a ^ b).bit_count() for a, b in zip(*[np.array(resemblance.parities(x), np.int64).view(np.uint64).tolist() for x in (s, t)], strict=True))
        assert bits <= len(np.setxor1d(s, t)) and resemblance.parities(s) == resemblance.parities(s.copy())
        assert n != 30 or bits == len(np.setxor1d(s, t))
