import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate_licenses import plain_tiles
from test_mixing_sharding import plain_shards
from test_quality import plain
from test_resemblance import plain_components

from sieveline.llm import decontaminate as dc
from sieveline.llm.sharding import SHARD_BYTES
from sieveline.storage import read


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixture", "shards"]


def test_run_against_brute_force(spark, sf):
    docs = [r.asDict() for r in read(spark, sf, "documents").collect()]
    good = []
    for d in docs:
        n, _, _, _, repeated = plain(d["text"])
        if n >= 50 and 100 * repeated <= 50 * n:
            good.append(d)
    components = plain_components([(d["doc_id"], d["text"]) for d in good])
    first = [d for d in good if components[d["doc_id"]] == d["doc_id"]]
    bench = [dc.words(r.text) for r in read(spark, sf, "benchmark").collect()]
    clean = []
    for d in first:
        w = dc.words(d["text"])
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if not any(not grams.isdisjoint(tuple(b[i : i + 5]) for i in range(len(b) - 4)) and plain_tiles(b, w, 5) >= 0.5 * len(b) for b in bench):
            clean.append(d)
    # the mix: whole passes over each source's shuffled documents, and a cut one
    size = {d["doc_id"]: plain(d["text"])[0] for d in clean}
    sources = sorted({d["source"] for d in clean})
    words = {s: sum(size[d["doc_id"]] for d in clean if d["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    open_, target, left = set(sources), {}, sum(words.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * words[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * words[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    want = Counter()
    for s in sources:
        mine = sorted((d for d in clean if d["source"] == s), key=lambda d: hashlib.md5(f"mix:{d['doc_id']}".encode()).hexdigest())
        todo = int(target[s] + 0.5)
        while todo > 0:
            for d in mine:
                take = min(todo, size[d["doc_id"]])
                if take:
                    want[d["doc_id"], take] += 1
                todo -= take
    got = corpus_pipeline.run(spark, sf).withColumn("n", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).collect()
    assert Counter((r.doc_id, r.n) for r in got) == want
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, s) for r, s in zip(got, plain_shards([(r.doc_id, r.text) for r in got], SHARD_BYTES)))


def test_every_stage_keeps_the_columns(spark, sf):
    docs = read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.where(F.lit(False)), sf).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, blank and long texts, repeated rows, extra and clashing columns, through all stages."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [
        (None, None, None, None, None, None, None),
        (1, None, "en", "a", 0, "x", 1),
        (2, "", "en", "a", 0, None, None),
        (3, " \n\t", None, None, 3, "x", 1),
        (4, words(4, 60), None, None, 1, "x", 1),
        (4, words(4, 60), None, None, 1, "x", 1),
        (None, words(5, 80), "fr", "b", 2, "x", None),
        (None, words(5, 80), "fr", "b", 2, "x", None),
        (6, words(6, 40000), "fr", "b", 2, "x", None),
        (7, words(7, 49), "fr", "b", 2, "x", None),
        (8, "same " * 100, "fr", "c", 2, "x", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, kept int")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_out(stage(spark, docs, sf))
        seen.append((name, docs.columns, docs.collect()))
    names = ["doc_id", "text", "lang", "source", "n_chars", "shard", "kept"]
    assert all(cols == names for _, cols, _ in seen[:-1])
    assert sorted(str(r.doc_id) for r in seen[0][2]) == ["4", "4", "6", "None", "None"]
    assert sorted(str(r.doc_id) for r in seen[1][2]) == sorted(str(r.doc_id) for r in seen[2][2]) == ["4", "6", "None"]
    taken = Counter()
    for r in seen[3][2]:
        taken[r.doc_id] += len(r.text.split())
    assert taken[4] == 180 and taken[None] + taken[6] == 60 + 80 + 40000 - 180  # the small source is full, the other takes the rest
    assert {r.kept for r in seen[3][2] if r.doc_id == 4} == {1}
    assert all(r.shard == "root" and r.bytes == len(r.text) for r in seen[4][2])
