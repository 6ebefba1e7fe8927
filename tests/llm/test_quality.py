import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from sieveline.llm import oracles, quality, queries

DOCS = "doc_id long, text string, source string, kept string, n_words int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    spots = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots)


def test_against_sql(spark):
    compare(spark, queries.queries()["op5_host_quality"], oracles.OP5, "/root/testdata/sf0.01")


def test_measures_of_texts(spark):
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z\x0bq\x0cr", "é#ü $$ <b>\n\n  \nl\nl\n l", "p q r s p q r s p q", "w " * 70000, "one two three " * 3000, "퟿   line"]
    got = quality.judge(spark.createDataFrame([(i, t, "h", "x", 1) for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: plain(t) for i, t in enumerate(texts)}
    assert {r.doc_id for r in got if not r.base_failed} == {i for i, t in enumerate(texts) if plain(t)[0] >= 50 and plain(t)[4] * 100 <= 50 * plain(t)[0]}


def test_random_texts(spark):
    found = []

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="ab \n#", max_size=60))
    def collect(t):
        found.append(t)

    collect()
    got = quality.judge(spark.createDataFrame([(i, t, "h", "x", 1) for i, t in enumerate(found)], DOCS)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: plain(t) for i, t in enumerate(found)}


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", f"host{i % 7}") for i in range(700)]
    rows += [(1000 + i, "short" if i % 10 else good, "bad") for i in range(100)]
    rows += [(2000, good, "few"), (2001, "short", "few"), (2002, "short", "few"), (2003, good, None), (None, good, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    kept = [(r.doc_id, r.kept) for r in quality.judge(docs).collect()]
    assert len(kept) == len(rows)
    # one host fails as a whole; hosts of few documents don't
    assert Counter(kept) == Counter((d, t == good and h != "bad") for d, t, h in rows)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter((*r, "x", 1) for r in rows if r[1] == good and r[2] != "bad")


def test_shrinkage(spark):
    """The shrunk rate stands between a host's own rate and that of all hosts."""
    rows = [(i, "short" if i < 60 * h / 5 + i % 60 else "w " * 0 + " ".join(f"w{j}" for j in range(60)), f"h{h}") for h in range(5) for i in range(60)]
    limits = quality.Limits(host_rate=0.5)
    measured = quality.settle(quality.measure(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)))
    got = {r["__host"]: r["__host_failed"] for r in quality.host_verdicts(measured, "source", limits).collect()}
    n = {h: sum(1 for r in rows if r[2] == h) for h in got}
    f = {h: sum(1 for r in rows if r[2] == h and r[1] == "short") for h in got}
    m = sum(f[h] / n[h] for h in got) / len(got)
    v = sum((f[h] / n[h] - m) ** 2 for h in got) / len(got)
    w = max(1, m * (1 - m) / max(v, 1e-9) - 1)
    assert math.isfinite(w)
    assert got == {h: (f[h] + m * w) / (n[h] + w) > 0.5 for h in got}


def test_small_hosts_of_junk(spark):
    """Junk that only the host rules know goes with its host, however few documents that has."""
    good = " ".join(f"w{i}" for i in range(60))
    junk = {"symbols": " ".join(f"w{i} # $" for i in range(60)), "lines": "\n".join(["a b c d e", *(f"x{i} y{i}" for i in range(30)), *["same"] * 60])}
    rows = [(i, good, f"host{i % 40}") for i in range(400)] + [(1000, good, "one")]
    rows += [(2000 + 100 * n + i, t, f"{k}{n}") for n in (5, 19, 20) for k, t in junk.items() for i in range(n)]
    rows = [(k, *r[1:], "x", 1) for k, r in enumerate(rows)]
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert not any(r.base_failed for r in got if rows[r.doc_id][1] in (good, junk["symbols"]))
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in rows if r[1] == good}
    assert quality.keep_good(spark.createDataFrame(rows, DOCS)).count() == 401


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert quality.judge(docs).count() == quality.keep_good(docs).count() == 0
