import base64
import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import privacy, queries, secrets
from sieveline.storage import read

DOCS = "doc_id long, text string, n_email int, term string"
LUHN_OK = "4539578763621486"


def plain_luhn(d):
    s = [int(x) for x in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def plain_privacy(t):
    """The contract's patterns as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and plain_luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def digest(spans, kinds):
    text = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))
    return text, hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0129()%é\n", max_size=60))
def test_privacy_patterns(t):
    assert sorted(privacy.base_spans(t)) == sorted(plain_privacy(t))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "256.1.1.1", "a@b.c", "@", "x@y", LUHN_OK, "4539 5787 6362 1486", "+1 (017) 555-7713", "+", "é", " ", ".", "1", "00001.2.3.4", "9" * 25])).map("".join))
def test_privacy_patterns_put_together(t):
    assert sorted(privacy.base_spans(t)) == sorted(plain_privacy(t))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeef", "0123456789abcdef", "ſecret=abcdefgh", "é", ".", "x"])).map("".join))
def test_secret_patterns(t):
    assert sorted(secrets.base_spans(t)) == sorted(plain_secrets(t))


def test_queries_against_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    for r in queries.op1_privacy(spark, sf).collect():
        base = plain_privacy(texts[r.doc_id])
        assert r.base_sha256 == digest(base, privacy.KINDS)[1]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in privacy.BASE_KINDS]
        shown = [tuple([k, int(s), int(e)]) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert sorted(x for x in shown if x[0] != "term") == sorted(base) and len(shown) == len(base) + r.n_term
    for r in queries.op7_secret_scan(spark, sf).collect():
        base = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == digest(base, secrets.KINDS)[1]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, *_ in base) for k in secrets.KINDS[:3])


def corpus():
    rng = random.Random(1)
    common = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(30)), 0, "x") for i in range(400)]
    for k in range(3):  # the same person in different surroundings
        rows.append((1000 + k, f"{' '.join(rng.choice(common) for _ in range(8))} Zebulon wrote from zeb@mail.example.com {' '.join(rng.choice(common) for _ in range(8))}", 0, "x"))
    rows += [(2000 + k, "seen once Quixote at q@mail.example.com here", 0, "x") for k in range(5)]  # copies are no new evidence
    return rows


def test_disclosing_terms(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    rule = privacy.Disclosure(window=5, min_support=2)
    got = {r.doc_id: r for r in privacy.scan(docs, rule).collect()}
    for k in range(3):
        words = [rows[400 + k][1][t["start"] : t["end"]] for t in got[1000 + k].terms]
        assert "Zebulon" in words and not set(words) & {"alpha", "beta", "gamma", "delta", "omega", "kappa"}
    assert all(not got[2000 + k].terms and got[2000 + k].n_email == 1 for k in range(5))
    # by brute force: log ratios of document counts
    n, n_t, n_c, both = len(rows), 3, 3, 3
    degree = math.log(both * n / (n_t * n_c)) / math.log(n / n_c)
    t = next(t for t in got[1000].terms if rows[400][1][t["start"] : t["end"]] == "Zebulon")
    assert abs(t["degree"] - min(1, degree)) < 1e-9
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs, rule).collect()}
    assert "Zebulon" not in clean[1000] and "zeb@" not in clean[1000] and "[EMAIL]" in clean[1000]
    assert clean[5] == rows[5][1]
    assert privacy.sanitise(docs).columns == docs.columns


def plain_disclosure(rows, rule):
    """By text: (spans of terms, sanitised text), from document counts of all terms and entities."""
    n, stands, near, has = len(rows), Counter(), {}, {}
    for d, t in rows:
        stands.update({m[0] for m in re.finditer(r"[^\W\d_]+", t.lower())})
        base = plain_privacy(t)
        every = [m.span() for m in re.finditer(r"[^\W\d_]+", t)]
        for kind, s, e in base:
            value = t[s:e].lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", t[s:e])
            # a word that the entity's edge parts counts on either side of it
            before = [m.span() for m in re.finditer(r"[^\W\d_]+", t[:s])][-rule.window :]
            after = [(a + e, b + e) for a, b in (m.span() for m in re.finditer(r"[^\W\d_]+", t[e:]))][: rule.window]
            around = [x for x in before + after if not any(x[0] < q and p < x[1] for _, p, q in base)]
            has.setdefault((kind, value), set()).add((d, t))
            for a, b in around:
                near.setdefault((kind, value, t[a:b].lower()), {}).setdefault((d, t), []).append((a, b))
    out = {t: {} for _, t in rows}
    for (kind, value, term), docs in near.items():
        c = len(has[kind, value])
        information = math.log(n / c)
        degree = min(1.0, math.log(len(docs) * n / (max(stands[term], len(docs)) * c)) / information) if information > 0 else 0
        if degree >= rule.generalise_at:
            for (_, t), spots in docs.items():
                for x in spots:
                    out[t][x] = max(degree, out[t].get(x, 0))
    return {t: (sorted(found), privacy.rewrite(t, [(*b, 1.0) for b in plain_privacy(t)] + [("term", *x, g) for x, g in found.items()])) for t, found in out.items()}


def test_terms_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    want, texts = plain_disclosure(rows, privacy.Disclosure()), dict(rows)
    added = 0
    for r in queries.op1_privacy(spark, sf).collect():
        spans, text = want[texts[r.doc_id]]
        assert [(int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"] == spans
        assert r.sanitised_sha256 == hashlib.sha256(text.encode()).hexdigest()
        added += len(spans)
    assert added
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, hash int, terms string, __hash int")
    got = privacy.sanitise(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted((d, want[t][1], 1, "x", 2) for d, t in rows)


def test_an_entity_that_occurs_once(spark):
    rng = random.Random(5)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "of", "wrote", "from", "to", "the", "yesterday"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(30)), 0, "x") for i in range(300)]
    text = "yesterday Quixote Ramirez of Toboso wrote from quix@mail.example.com to the alpha"
    got = next(r for r in privacy.scan(spark.createDataFrame([*rows, (999, text, 0, "x")], DOCS)).collect() if r.doc_id == 999)
    assert {text[t["start"] : t["end"]] for t in got.terms} == {"Quixote", "Ramirez", "Toboso"}


def test_digests_behind_a_secrets_name():
    encode, test = secrets.encoder(*map(secrets.read_vocabulary, secrets.VOCABULARIES)), secrets.Test()
    digest = hashlib.sha1(b"key").hexdigest()
    assert secrets.random_spans(f"commit {digest}", encode, test) == []
    assert secrets.random_spans(f"api_key = {digest}", encode, test) == [("random", 10, 50)]
    assert secrets.random_spans("password = correct_horse_battery_staple", encode, test) == []


def test_term_counts_beyond_the_limit(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    terms = spark.createDataFrame([("alpha",), ("zebulon",), ("nowhere",)], "term string")
    few = {r.term: r.n_docs for r in privacy.document_counts(docs, terms).collect()}
    many = {r.term: r.n_docs for r in privacy.document_counts(docs, terms, limit=1, flush=2).collect()}
    assert few == many == {"alpha": sum("alpha" in r[1] for r in corpus()), "zebulon": 3}


def test_edges(spark):
    long_text = "a" * 300_000 + "@b.cd " + "1" * 200_000 + " +" * 1000 + "f" * 100_000
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (None, "me@x.org", 0, "x"), (3, "me@x.org", 0, "x"), (3, "me@x.org", 0, "x"), (4, long_text, 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = privacy.scan(docs).collect()
    assert Counter((r.doc_id, r.n_email) for r in got) == Counter([(1, 0), (2, 0), (None, 1), (3, 1), (3, 1), (4, 1)])
    found = secrets.scan(docs).collect()
    assert Counter((r.doc_id, r.n_hex) for r in found) == Counter([(1, 0), (2, 0), (None, 0), (3, 0), (3, 0), (4, 3)])
    empty = spark.createDataFrame([], DOCS)
    assert privacy.scan(empty).count() == secrets.scan(empty).count() == privacy.sanitise(empty).count() == 0


def test_token_efficiency(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(40)]
    keys += [base64.b64encode(rng.randbytes(600)).decode()]
    harmless = [hashlib.sha256(b"x").hexdigest(), hashlib.md5(b"y").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "internationalization_of_software_2024", "12345678901234567890", "ThisIsAVeryLongClassNameForTesting", "menteciónadococimenteci"]
    docs = spark.createDataFrame([(i, f"here {t} there", 0, "x") for i, t in enumerate(keys + harmless)], DOCS)
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [got[i].n_random for i in range(len(keys))] == [1] * len(keys)
    assert [got[len(keys) + i].n_random for i in range(len(harmless))] == [0] * len(harmless)
    assert f"random:5:{5 + 40}" in got[0].spans


def test_keys_without_digits_and_in_paths():
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    encode, test = secrets.encoder(*map(secrets.read_vocabulary, secrets.VOCABULARIES)), secrets.Test()
    found = lambda keys: sum(len(secrets.random_spans(f"here {k} there", encode, test)) == 1 for k in keys)
    make = lambda alphabet, n: ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
    for n in (16, 20, 24, 40):
        assert found(make(letters, n)) >= 295 and found(make(letters + "0123456789", n)) >= 295
    assert found(f"services/production/config/database/password/{k}" for k in make(letters + "0123456789", 32)) >= 298
    assert found("word" * 100 + k + "word" * 100 for k in make(letters, 300)) >= 295
    harmless = ["services/production/config/database/password", "getElementsByTagNameNS", "Donaudampfschifffahrtsgesellschaft", "2024-01-02T03-04-05Z", "user_2024_report_final", "----------------------", hashlib.sha1(b"x").hexdigest(), f"files/{hashlib.md5(b'y').hexdigest()}/index"]
    assert found(harmless) == 0


def test_values_with_a_full_stop_and_other_names():
    encode, test = secrets.encoder(*map(secrets.read_vocabulary, secrets.VOCABULARIES)), secrets.Test()
    digest = hashlib.sha1(b"x").hexdigest()
    for text in (f"token = {digest}.", f"SECRET_KEY={digest}, and", f"client_secret := '{digest}'", f"auth: {digest}.", f'"access_key" => "{digest}"'):
        assert [text[a:b] for _, a, b in secrets.random_spans(text, encode, test)] in ([digest], [f"SECRET_KEY={digest}"]), text
    for text in (f"commit {digest}.", f"author {digest}", f"sha1: {digest}", f"authority: {digest}"):
        assert secrets.random_spans(text, encode, test) == [], text
    assert secrets.random_spans("Tłumaczenie-Rozporządzenia żółćżółćżółćżółć Ελληνικάγράμματα", encode, test) == []


def test_false_spans_over_a_table_and_recall():
    """Of the words of all test texts at most ten spans are taken for random; of planted keys of each alphabet at least 95 %."""
    import random
    import string

    import pyarrow.parquet as pq

    encode, test = secrets.encoder(*map(secrets.read_vocabulary, secrets.VOCABULARIES)), secrets.Test()
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    found = [x[a:b] for x in texts if x for _, a, b in secrets.random_spans(x, encode, test)]
    planted = [f for f in found if len(f) == 40 and set(f.lower()) <= set("0123456789abcdef")]
    assert len(planted) > 100 and len(found) - len(planted) <= 10, sorted(set(found) - set(planted))
    rnd = random.Random(6)
    for letters in (string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters):
        for n in (16, 24, 40):
            keys = ["".join(rnd.choice(letters) for _ in range(n)) for _ in range(300)]
            assert sum(len(secrets.random_spans(f"so {k}, it", encode, test)) == 1 for k in keys) >= 0.95 * len(keys), (letters, n)
