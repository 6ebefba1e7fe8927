import hashlib
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import chat, language, queries
from sieveline.storage import read

DOCS = "doc_id long, text string, lang string, score string"


def plain_profile(text, size=300):
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    n = Counter()
    for w in folded.split():
        p = f" {w} "
        n.update(w)
        n.update(p[i : i + 2] for i in range(len(p) - 1))
        n.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for _, _, g in sorted((-k, code(g), g) for g, k in n.items())][:size], n


def test_profiles():
    for text in ["", "a", "Ab ab!", "le chat  est\nnoir", "ÀÉ ñ ß", "x" * 1000, "123 --", "один два two", "a b c d"]:
        want, _ = plain_profile(text)
        code = [sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in want]
        assert [int(x) for x in language.profile(text)] == code, text


def test_against_brute_force(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text", "lang").collect()
    learned = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None:
            learned.setdefault(r.lang, Counter()).update(plain_profile(r.text)[1])
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    ranks = {}
    for lang, n in learned.items():
        ranks[lang] = {g: i for i, (_, _, g) in enumerate(sorted((-k, code(g), g) for g, k in n.items())[:300])}
    got = {r.doc_id: r for r in queries.op6_language(spark, sf).collect()}
    assert len(got) == len(rows)
    right = 0
    for r in rows:
        p, _ = plain_profile(r.text)
        away = {x: sum(abs(i - q[g]) if g in q else 300 for i, g in enumerate(p)) for x, q in ranks.items()}
        best = min(sorted(away), key=away.get)
        g = got[r.doc_id]
        assert g.lang_pred == best and abs(g.score - (1 - away[best] / (300 * len(p)))) < 1e-9
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        right += g.held_out and g.lang_pred == r.lang
    assert right >= 0.95 * sum(g.held_out for g in got.values())


def test_counts_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, f"wort{i} über den fluß", "de", "x") for i in range(50)] + [(i, f"word{i} over the river", "en", "x") for i in range(50, 90)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, language.learn(docs).collect()))
    counts = {}
    for _, t, x, _ in rows:
        counts.setdefault(x, Counter()).update(plain_profile(t)[1])
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = sorted((x, code(g), i) for x, n in counts.items() for i, (_, _, g) in enumerate(sorted((-k, code(g), g) for g, k in n.items())[:300]))
    assert whole == want
    assert np.uint64(max(w[1] for w in want)) < np.uint64(1 << 63)


def test_language_edges(spark):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "123 !", "en", "x"), (4, "the river and the sea", "en", "x"), (None, "der fluß und das meer", "de", "x"), (4, "the river and the sea", "en", "x"), (5, "la mer " * 50000, "fr", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.lang_pred) for r in language.predict(docs, language.learn(docs)).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "fr")])
    none = language.predict(docs, language.learn(docs.where(F.lit(False))))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert language.predict(spark.createDataFrame([], DOCS), language.learn(docs)).count() == 0


# ---------------------------------------------------------------- chat

TURNS = "conv_id long, turn long, role string, text string, segment string"
PIECES = ["<", "|", ">", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "[INST[/INST]", "<<SYS>>", "<</SYS>>", chat.MARK, "a", "é", "\n", "<|end|>", "<|image:1|>", "<<s>s>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.lists(st.sampled_from(PIECES), max_size=6).map("".join))
def test_round_trip(text, role):
    safe = chat.escape(text)
    assert not any(c in safe for c in chat.CONTROL)
    assert chat.unescape(safe) == text
    out = chat.format_turn(role, [{"type": "text", "text": text}, {"type": "image", "ref": "r", "width": 56, "height": 28}])
    assert chat.parse(out["segment"] * 2) == [(role, text)] * 2
    assert out["attachments"] == [{"number": 1, "type": "image", "ref": "r", "tokens": 2}]


def test_parts_in_order(spark):
    parts = [
        {"type": "text", "text": "see "},
        {"type": "image", "ref": "a.png", "width": 280, "height": 29},
        {"type": "text", "text": " and <|image:9|> "},
        {"type": "audio", "ref": "b.wav", "seconds": 2.01},
        {"type": "document", "ref": "c.pdf", "pages": 3},
        {"type": "hologram", "ref": "d"},
        {"type": "text", "text": None},
        {"type": "image", "ref": None, "width": 10**6, "height": 10**6},
    ]
    out = chat.format_turn("assistant", parts)
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in out["attachments"]] == [(1, "image", "a.png", 20), (2, "audio", "b.wav", 51), (3, "document", "c.pdf", 1536), (4, "part", "d", 0), (5, "image", None, 1024)]
    body = out["segment"][out["loss_start"] : out["loss_end"]]
    assert chat.read_text(body) == "see  and <|image:9|> "
    assert body.index("<|image:1|>") < body.index("<|audio:2|>") < body.index("<|document:3|>") < body.index("<|part:4|>") < body.index("<|image:5|>")
    keys = ("type", "text", "ref", "width", "height", "seconds", "pages")
    rows = [(1, 0, "assistant", [tuple(p.get(k) for k in keys) for p in parts])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = chat.assemble(chat.format_conversations(df, F.col("content"))).collect()[0]
    assert got.formatted == out["segment"] and [tuple(s) for s in got.loss_spans] == [(out["loss_start"], out["loss_end"])] and len(got.attachments) == 5


def plain_digest(turns):
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    said = "".join(t or "" for r, t in turns if r == "assistant")
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), h(every), len(said), h(said)


def test_conversations_read_back(spark, sf):
    turns = {}
    for r in read(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat_format(spark, sf).collect()}
    assert got == {k: plain_digest(v) for k, v in turns.items()}


def test_chat_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "assistant", "", "x"), (None, 0, "user", "q", "x"), (None, 1, "assistant", "a" * 500000, "x"), (2, 0, "assistant", "é<s>", "x"), (2, 0, "assistant", "é<s>", "x")]
    df = spark.createDataFrame(rows, TURNS)
    seg = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(seg).collect()}
    assert got == {k: plain_digest([(r, t) for c, _, r, t, _ in rows if c == k]) for k in (1, None, 2)}
    whole = {r.conv_id: r for r in chat.assemble(seg).collect()}
    for r in chat.read_back(seg).collect():
        w = whole[r.conv_id]
        assert len(w.formatted) == r.formatted_chars
        assert hashlib.sha256("".join(chat.read_text(w.formatted[s.start : s.end]) for s in w.loss_spans).encode()).hexdigest() == r.loss_sha256
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0
