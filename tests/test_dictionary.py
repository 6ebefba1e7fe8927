import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline import storage
from sieveline.operators import dictionary, labelling


def brute(text, names, longest=5):
    """Every run of words that is a name, leftmost first, the longest first of those that begin together."""
    words = text.split(" ") if text else []
    return [(i, -k, " ".join(words[i : i + k])) for i in range(len(words)) for k in range(longest, 0, -1) if i + k <= len(words) and " ".join(words[i : i + k]) in names]


def some_texts(rnd, n=300):
    words = ["a", "b", "c", "dd", "é", "ж", "e1", "f"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(n)]
    return [(i, t, "x", 1) for i, t in enumerate([*texts, None, "", "a", "a  b", " a"])]


def some_names(rnd, n=60):
    words = ["a", "b", "c", "dd", "é", "ж", "e1", "zz"]
    return {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(n)}


@pytest.mark.parametrize("sent,parts", [(storage.BROADCAST_ROWS, 256), (2, 256), (2, 3)])
def test_hits_against_definition(spark, monkeypatch, sent, parts):
    monkeypatch.setattr(storage.fits_broadcast, "__defaults__", (sent, storage.BROADCAST_BYTES))
    monkeypatch.setattr(dictionary, "PARTS", parts)  # with three, first words are salted
    rnd = random.Random(sent + parts)
    names, rows = some_names(rnd), some_texts(rnd)
    texts = spark.createDataFrame(rows, "i long, t string, name string, hits_ int").repartition(3)
    kb = spark.createDataFrame([(n,) for n in [*names, *list(names)[:9]]] + [(None,), ("",)], "name string")
    got = {r.i: [tuple(h) for h in r.hits] for r in dictionary.with_hits(texts, "i", "t", kb).collect()}
    assert got == {r[0]: brute(r[1], names) for r in rows} and sum(map(len, got.values())) > 1000


def test_no_names(spark):
    texts = spark.createDataFrame([(1, "a b")], "i long, t string")
    assert dictionary.with_hits(texts, "i", "t", spark.createDataFrame([], "name string")).first().hits == []


def test_large_dictionary_is_dealt_by_first_word(spark):
    """300,000 names are too many to be sent: their texts' words go to them, and labels are those of the definition."""
    word = lambda kind, i: kind + str(i).translate(str.maketrans("0123456789", "abcdefghjk"))
    spelt = lambda kind, c: F.concat(F.lit(kind), F.translate(c.cast("string"), "0123456789", "abcdefghjk"))
    names = spark.range(300_000).select(F.concat_ws(" ", spelt("w", F.col("id") % 70_000), spelt("v", F.col("id"))).alias("name"), F.lit("SLR").alias("label"))
    w, v = (lambda i: word("w", i)), (lambda i: word("v", i))
    short = spark.createDataFrame([(w(7), "TLR"), (f"{w(8)} {v(8)} x", "TLR")], "name string, label string")
    kb = storage.settle(names.unionByName(short))
    assert not storage.fits_broadcast(kb.select("name"))
    rows = [(1, f"a {w(7)} {v(7)} b", ""), (2, w(7), ""), (3, f"{w(8)} {v(8)} x {w(9)} {v(9)}", ""), (4, f"{w(8)} {v(8)} y", ""), (5, f"{w(123)} {v(9)}", f"and {w(5)} {v(5)}"), (6, "", None), (7, f"{w(9)} {w(10)}", v(10)), (8, f"{w(69999)} {v(279999)}", "")]
    rows += [(100 + i, "plain words", " ".join(f"{w((i * 31 + j) % 80_000)} {v(j)}" for j in range(40))) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id long, title string, description string")
    got = {r.item_id: (r.kb_model, r.kb_label) for r in labelling.apply_dictionary(items, kb).collect()}
    known = {f"{w(i % 70_000)} {v(i)}" for i in range(300_000)} | {w(7), f"{w(8)} {v(8)} x"}

    def plain(title, description):
        inside = brute(title, known)
        if inside and any(pos >= inside[0][0] - inside[0][1] for pos, *_ in inside):
            return None
        return next((n for *_, n in brute(f"{title} {description or ''}".strip(), known)), None)

    want = {r[0]: plain(r[1], r[2]) for r in rows}
    assert {k: v[0] for k, v in got.items()} == want and want[1] == f"{w(7)} {v(7)}" and want[3] is None and want[5] == f"{w(5)} {v(5)}"
    assert all((label is None) == (model is None) for model, label in got.values())


def test_a_dictionary_that_is_sent_shuffles_nothing(spark):
    texts = spark.createDataFrame(some_texts(random.Random(1)), "i long, t string, name string, k int")
    plan = dictionary.with_hits(texts, "i", "t", spark.createDataFrame([("a b",)], "name string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hits_are_held_for_a_part_of_a_batch(monkeypatch):
    monkeypatch.setattr(dictionary, "PART_BYTES", 10)
    texts = ["abc", None, "defgh", "ij", "k" * 25, "", "lm", None]
    parts = [p.column(1).to_pylist() for p in dictionary.in_parts(pa.record_batch({"i": list(range(8)), "t": texts}), 1)]
    assert parts == [["abc", None, "defgh", "ij"], ["k" * 25], ["", "lm", None]]
    assert list(dictionary.in_parts(pa.record_batch({"t": pa.array([], pa.string())}), 0)) == []
