import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from oracle import compare

from sieveline.llm import oracles, prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string, k1 long, depth string"


def of(rows):
    """conv_id -> (role, text) in order."""
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: v[:2])] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # a remainder has its number's sign, as in SQL
    return out


def words(text):
    return len(text.encode().split())


def brute(convs):
    """Nodes of the definition."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(node))
        out.append(
            (
                min(inside),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(inside),
                sum(len(x) == len(node) + 1 for x in below),
                sum(not any(y[:-1] == x for y in below if y) for x in below),
                sum((len(members[x]) - 1) * words(x[-1][1]) for x in below if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(rnd, n=60):
    texts = ["hi there", "ok", "", None, "a b\tc\x0bd", "naïve — text"]
    rows = []
    for c in rnd.sample(range(-30, 200), n):
        for t in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t or rnd.choice([0, None]), rnd.choice(["user", "user", None]), rnd.choice(texts), 5, "x"))
    rnd.shuffle(rows)
    return rows


def test_against_sql(spark):
    compare(spark, queries.queries()["op11_prefix_trie"], oracles.SQL["op11_prefix_trie"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("segment", [2, 512])
def test_against_definition(spark, segment):
    rows = made(random.Random(segment))
    # a chain of nested conversations, a long one, repeated turns, and rows without a conversation
    rows += [(1000 + i, t, "user", f"t{t}", 0, "") for i in range(5) for t in range(i + 2)]
    rows += [(2001, t, "user", "same" if t < 40 else f"w{t}", 0, "") for t in range(70)] + [(2002, t, "user", "same", 0, "") for t in range(45)]
    rows += [(3001, 0, "user", "twice", 0, "")] * 2 + [(None, 0, "user", "nobody's", 0, ""), (3021, 1, "user", "long " * 20000, 0, "")]
    rows += [(4000 + 20 * i, t, "user", "all the same", 0, "") for i in range(700) for t in range(2)]
    got = result(prefix_trie.conversation_nodes(spark.createDataFrame(rows, TURNS), segment=segment))
    assert got == brute(rebuilt(of(rows)))


def test_conversations_as_they_are(spark):
    rows = made(random.Random(7))
    assert result(prefix_trie.build(spark.createDataFrame(rows, TURNS))) == brute(of(rows))


def test_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.build(none).collect() == [] and prefix_trie.conversation_nodes(none).collect() == []


def test_partial_tries_merge(spark):
    rows = made(random.Random(9), 90)
    parts = []
    for k in range(3):
        steps = prefix_trie.settle(prefix_trie.steps(spark.createDataFrame([r for r in rows if r[0] % 3 == k], TURNS)))
        parts.append(prefix_trie.partial(steps, steps.select("conv_id").distinct()))
    halfway = prefix_trie.merge(parts[0], parts[1])
    assert result(prefix_trie.union_of([halfway, parts[2]])) == brute(of(rows))


def test_query_on_odd_rows(spark, tmp_path):
    rows = made(random.Random(3))
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(queries.op11_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(of(rows)))
