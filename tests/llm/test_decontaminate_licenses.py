import random
from collections import Counter

from sieveline.llm import decontaminate as dc
from sieveline.llm import licenses, queries
from sieveline.llm.license_texts import TEMPLATES
from sieveline.storage import read

DOCS = "doc_id long, text string, item_id long, words string"


def plain_tiles(item, doc, least):
    """Greedy string tiling as it is defined: the longest unmarked common runs, over and over."""
    used_i, used_d, total = set(), set(), 0
    while True:
        best, where = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                if n > best:
                    best, where = n, [(i, j)]
                elif n == best and n >= least:
                    where.append((i, j))
        if best < least or not where:
            return total
        for i, j in where:
            if used_i.isdisjoint(range(i, i + best)) and used_d.isdisjoint(range(j, j + best)):
                used_i |= set(range(i, i + best))
                used_d |= set(range(j, j + best))
                total += best


def test_tiles_against_definition():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(5, 30))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            i, n, j = rng.randrange(len(item)), rng.randrange(3, 12), rng.randrange(len(doc) + 1)
            doc[j:j] = item[i : i + n]
        got = dc.tiles(item, doc, 3)
        spots_i = [k for i, _, n in got for k in range(i, i + n)]
        spots_d = [k for _, j, n in got for k in range(j, j + n)]
        assert len(set(spots_i)) == len(spots_i) and len(set(spots_d)) == len(spots_d)
        assert all(item[i : i + n] == doc[j : j + n] and n >= 3 for i, j, n in got)
        assert len(spots_i) == plain_tiles(item, doc, 3)


def passage(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_passages(spark):
    a, b = passage(40, 1), passage(30, 2)
    half = a.split()
    moved = " ".join(half[20:] + ["between"] + half[:20])
    rows = [
        (1, f"before {a} after"),
        (2, f"{moved.upper()}!"),
        (3, " ".join(half[:15])),
        (4, f"{a}\n{b}"),
        (5, passage(300, 3)),
        (6, None),
        (7, ""),
        (None, a),
        (1, f"before {a} after"),
        (8, " ".join(w for i, w in enumerate(half) for w in ([w] if i % 8 else [w, "x"]))),
        (9, passage(30000, 4) + " " + b),
        (10, " ".join(half[i] for i in range(0, 40, 2))),
    ]
    docs = spark.createDataFrame([(*r, 0, "w") for r in rows], DOCS)
    bench = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    for rule in (dc.Rule(), dc.Rule(block_words=1)):  # in one block, and an item at a time
        got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench, rule).collect())
        assert got == Counter([(1, 1), (1, 1), (2, 1), (4, 1), (4, 2), (None, 1), (8, 1), (9, 2)])
        kept = dc.clean(docs, bench, rule)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 5, 6, 7, 10])
    covers = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in dc.contaminated(docs, bench).collect()}
    assert covers[2, 1] == (40, 2) and covers[1, 1] == (40, 1)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f", 0, "w")], DOCS)
    assert dc.contaminated(docs, bench).count() == dc.contaminated(some, bench).count() == dc.clean(docs, bench).count() == licenses.scan(docs).count() == 0
    assert dc.clean(some, bench).count() == 1


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, dc.words(r.text)) for r in read(spark, sf, "documents").collect()]
    bench = [(r.item_id, dc.words(r.text)) for r in read(spark, sf, "benchmark").collect()]
    want = set()
    for d, w in docs:
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, iw in bench:
            if not grams.isdisjoint(tuple(iw[i : i + 5]) for i in range(len(iw) - 4)) and plain_tiles(iw, w, 5) >= 0.5 * len(iw):
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in queries.op3_decontaminate(spark, sf).collect()} == want


def plain_licenses(text):
    """(coefficient, first word, words, template) of every run of words that reaches the threshold, without any pruning."""
    words, found = licenses.normalise(text or ""), []
    for name, t in TEMPLATES.items():
        b = Counter(licenses.bigrams(licenses.normalise(t)))
        size = sum(b.values())
        for i in range(len(words) - 1):
            seen, common = Counter(), 0
            for j in range(i, min(len(words) - 1, i + 2 * size)):
                p = words[j], words[j + 1]
                seen[p] += 1
                common += seen[p] <= b[p]
                if (score := 2 * common / (j - i + 1 + size)) >= 0.8:
                    found.append((round(score, 9), i, j - i + 2, name))
    return found


def test_licenses_against_brute_force(spark):
    rng = random.Random(5)
    mit = TEMPLATES["MIT"]
    broken = mit.split()
    reworded = TEMPLATES["GPL-3.0-notice"].replace("This work", "This text")
    texts = [
        "Released under the MIT License.",
        "x y z\nLicensed under CC BY-NC 4.0.\nq",
        "\n".join([passage(20, 1), *[" ".join(broken[i : i + 12]) for i in range(0, len(broken), 12)], passage(9, 2)]),
        "\n".join(" ".join(w for w in broken[i : i + 15] if rng.random() > 0.03) for i in range(0, len(broken), 15)),
        passage(200, 3),
        None,
        "",
        "license",
        "Copyright 2024 Foo Inc. All rights reserved.",
        "ALL RIGHTS\nRESERVED",
        TEMPLATES["GPL-3.0-header"] + "\n" + TEMPLATES["ISC"],
        f"{passage(30, 4)} {mit} {passage(30, 6)}",
        f"{TEMPLATES['GPL-2.0-notice']} {passage(5, 7)} {reworded}",
        "\n\nall rights reserved " * 3,
        TEMPLATES["BSD-3-Clause"],
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame([(i, t, 0, "w") for i, t in enumerate(texts)], DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.dice, 9), r.first_line, r.n_lines, r.n_words))
    matcher = licenses.Matcher()
    for i, t in enumerate(texts):
        # by definition: the best run, then the best of those that share no word with it, and so on
        want, used = [], set()
        for score, s, n, name in sorted(plain_licenses(t), key=lambda x: (-x[0], x[1], -x[2], x[3])):
            if used.isdisjoint(range(s, s + n)):
                used |= set(range(s, s + n))
                want.append((name, score))
        assert Counter((x[0], x[1]) for x in got.get(i, [])) == Counter(want), i
        assert sorted(x[0] for x in matcher.find(t or "")) == sorted(x[0] for x in got.get(i, []))
    names = {i: [x[0] for x in v] for i, v in got.items()}
    assert names[2] == ["MIT"] and names[11] == ["MIT"] and names[10] == ["GPL-3.0-header", "ISC"] and names[14] == ["BSD-3-Clause"]
    assert names[8] == ["all-rights-reserved"] and names[12] == ["GPL-2.0-notice", "GPL-3.0-notice"] and names[13] == ["all-rights-reserved"] * 3
    assert got[9][0][2:] == (0, 2, 3) and [x[2] for x in got[13]] == [2, 4, 6]


def test_license_query(spark, sf):
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = {}
    for r in queries.op2_license_scan(spark, sf).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    notices = {k: v for k, v in TEMPLATES.items() if k.endswith("notice") or k == "all-rights-reserved"}
    for d, t in texts.items():
        assert got.get(d, set()) >= {k for k, v in notices.items() if v in t}
