import hashlib
import random
import struct
import sys
import zlib

import pytest

from sieveline.llm import bpe, periodic, queries

DOCS = "doc_id long, text string, runs string, ids int, n_words string"
SF = "/root/testdata/sf0.001"


def brute_runs(w, power, least):
    """Every period, every maximal stretch of words that equal the word a period further on."""
    found = {}
    for p in range(1, len(w) // power + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in found.items())


def some_word(rnd):
    k, n = rnd.randint(1, 4), rnd.randint(0, 90)
    kind = rnd.random()
    if kind < 0.3:
        return [rnd.randrange(k) for _ in range(n)]
    if kind < 0.7:
        w = []
        while len(w) < n:
            unit = [rnd.randrange(k) for _ in range(rnd.randint(1, 9))]
            w += (unit * 30)[: rnd.randint(1, 35)]
            if rnd.random() < 0.4:
                i = rnd.randrange(len(w))
                w += w[i : i + rnd.randint(1, 40)]
        return w
    x, y = [0], [0, 1]  # Fibonacci words have many runs
    while len(y) < n + 2:
        x, y = y, y + x
    y = y[:n]
    for _ in range(rnd.randint(0, 3)):
        if y:
            y[rnd.randrange(len(y))] = rnd.randrange(3)
    return y


def test_runs_against_definition():
    rnd, total = random.Random(12), 0
    for _ in range(3000):
        w, power, least = some_word(rnd), rnd.choice([2, 2, 3, 4]), rnd.choice([1, 2, 5, 24])
        want = brute_runs(w, power, least)
        assert periodic.runs(w, power, least) == want, (w, power, least)
        words = [b"%d" % x for x in w]
        assert not want or periodic.may_have_runs(words, power, least)
        repeated = {i for a, n, p in want for i in range(a + p, a + n)}
        assert periodic.collapse(words, want) == [x for i, x in enumerate(words) if i not in repeated]
        total += len(want)
    assert total > 10_000


def test_factors_are_longest_earlier_strings():
    rnd = random.Random(2)
    for _ in range(300):
        w = some_word(rnd)
        at = 0
        for start, length, source in periodic.factors(w):
            assert start == at
            if source < 0:
                assert length == 1 and w[start] not in w[:start]
            else:
                assert source < start and w[source : source + length] == w[start : start + length]
                longer = w[start : start + length + 1]
                assert len(longer) == length or all(w[i : i + length + 1] != longer for i in range(start))
            at += length
        assert at == len(w)


def rewritten(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text):
    w = rewritten(doc_id, text)
    found = brute_runs(w, 3, 24)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    repeated = {i for a, n, p in found for i in range(a + p, a + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in repeated)))


def odd_docs():
    rnd = random.Random(4)
    words = ["", "one", "a\tb", " ".join("ab" * 20), "x y z " * 9, "\n".join(["the same line"] * 12), "é \x0b\x0c ü " * 20, "a\xa0b " * 30, "  ", "x " * 23, "x " * 24]
    rows = [(i, rnd.choice(words) + " " + rnd.choice(words)) for i in range(120)]
    rows += [(i, " ".join(rnd.choice(["p", "q", "r", "s"]) for _ in range(rnd.randint(0, 300)))) for i in range(200, 320)]
    rows += [(None, None), (None, "u v " * 30), (7, None), (7, "x y z " * 9), (7, "x y z " * 9), (500, "w " * 100_000), (501, " ".join(f"w{i % 30_000}" for i in range(100_000)))]
    return [(*r, "x", 1, "y") for r in rows]


def test_runs_query_against_definition(spark, tmp_path):
    spark.createDataFrame(odd_docs(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    short = [r for r in odd_docs() if r[0] not in (500, 501)]
    rest = [r for r in got if r[0] in (500, 501)]
    assert [r for r in got if r[0] not in (500, 501)] == sorted((plain_row(*r[:2]) for r in short), key=repr)
    assert {r[0]: r[1:6] for r in rest} == {500: (1, 0, 100_000, 1, 100_000_000), 501: (1, 0, 100_000, 30_000, 3333)}
    assert sum(r[1] for r in got) > 40


def test_runs_over_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert [got[d] for d, _ in docs] == [plain_row(*r) for r in docs]
    assert any(r[1] for r in got.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert periodic.scan(none).collect() == [] and bpe.decode(bpe.encode(none)).collect() == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def model():
    with open(bpe.TOKENIZER, "rb") as f:
        return bpe.model(f.read())


def encoded(model, text):
    return bpe.as_array(model.encode([(0, list(model.words(text)))])[0][1])


PIECES = ["a", "b", "aa", " ", "  ", "\n", "\t", "é", "ж", "中", "😀", "　", "\u0085", "\x1c", "'s", "'re", "1", "٣", "-", "---", "=", "<|endoftext|>", "<|", "the", "ing", "́", "�", "z", "​", "\xa0", "\x00", "ɐ", "Ա"]


def test_encodes_and_decodes_as_the_library(model, library):
    rnd = random.Random(13)
    for _ in range(1500):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoded(model, text) == ids, text
        assert bpe.spell_out(struct.pack(f"<{len(ids)}I", *ids), model.bytes_of) == text
    for k in (1, 2, 3, 4):
        for _ in range(100):  # long words of few letters, where merges tie and overlap
            text = "".join(rnd.choice("ab-= "[:k]) for _ in range(rnd.randint(1, 300)))
            assert encoded(model, text) == library.encode(text, add_special_tokens=False).ids, text
    for _ in range(300):  # ids that are no text
        ids = [rnd.randrange(50_400) for _ in range(20)]
        assert bpe.spell_out(struct.pack("<20I", *ids), model.bytes_of) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_parts_words_as_in_the_library(model, library):
    for low in range(0, sys.maxunicode, 97):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in range(low, min(low + 97, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000)
        assert list(model.words(text)) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], low


def test_tokens_of_the_query(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_texts_in_blocks(spark, library, block):
    texts = [None, "", " ", "one", "one two  three\n\n<|endoftext|>four", "the end <|endoftext|><|endoftext|>", "w" * 5000 + " " * 3000, "é" * 200, "中文 текст", "same", "same"]
    rows = [(i if i % 4 else None, t, "x", 1, "y") for i, t in enumerate(texts)]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS).coalesce(1), block=block)).collect()
    assert [(r.doc_id, r.text) for r in got] == [(r[0], r[1] or "") for r in rows]
    assert [bpe.as_array(r.ids) for r in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_refused():
    with open("/opt/tokenizers/word_bpe_49k.json", "rb") as f, pytest.raises(ValueError, match="byte-level"):
        bpe.Model(f.read())
