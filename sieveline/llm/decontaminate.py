"""Benchmark decontamination by greedy string tiling.

Documents meet a benchmark item where they share a run of ``min_match`` words (a seed). Greedy string tiling then
marks the longest common runs that don't overlap, again and again, down to that length. The tiles may stand
in any order in the document, so a passage whose sentences were moved around is covered as well as a straight copy.
The document is contaminated if tiles cover enough of the item.

The search for runs is a running Karp-Rabin: rolling hashes of all unmarked windows of one length are matched, matches
are extended, and the length is lowered as they are used up (Wise, "String Similarity via Greedy String Tiling
and Running Karp-Rabin Matching").
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import per_batch, texts

_WORD = re.compile(r"\w+")
BASE, PRIME = 1_000_003, (1 << 61) - 1


@dataclass(frozen=True)
class Rule:
    """min_match: words of the shortest tile, and of seeds. min_cover: share of an item's words that tiles cover.

    block_words: words of benchmark items that are sent to workers at a time. A larger benchmark takes more passes.
    """

    min_match: int = 5
    min_cover: float = 0.5
    block_words: int = 500_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hashes(seq: list[int], marked: list[bool], length: int) -> list[tuple[int, int]]:
    """(hash, start) of the windows of unmarked tokens, with a rolling hash."""
    top, out, h, run = pow(BASE, length - 1, PRIME), [], 0, 0
    for i, x in enumerate(seq):
        if marked[i]:
            h = run = 0
            continue
        if run == length:
            h = (h - seq[i - length] * top) % PRIME
        else:
            run += 1
        h = (h * BASE + x) % PRIME
        if run == length:
            out.append((h, i - length + 1))
    return out


def tiles(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles."""
    used_item, used_doc, out = [False] * len(item), [False] * len(doc), []
    length = min(len(item), len(doc))
    while length >= min_match:
        where = defaultdict(list)
        for h, j in _hashes(doc, used_doc, length):
            where[h].append(j)
        found = []
        for h, i in _hashes(item, used_item, length):
            for j in where.get(h, ()):
                if item[i : i + length] == doc[j : j + length]:
                    n = length
                    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_item[i + n] and not used_doc[j + n]:
                        n += 1
                    found.append((n, i, j))
        overlapped = False
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if any(used_item[i : i + n]) or any(used_doc[j : j + n]):
                overlapped = True
                continue
            used_item[i : i + n] = [True] * n
            used_doc[j : j + n] = [True] * n
            out.append((i, j, n))
        if overlapped:  # what is left of a run may still be long enough; as one was marked, this ends
            continue
        length = max(min_match, length // 2) if length > min_match else 0
    return out


class Benchmark:
    """Items with the seeds that they share with documents. A seed takes some 200 bytes, as words are shared."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule, self.items, self.least = rule, {}, {}
        self.seeds: dict[tuple[str, ...], int | list[int]] = {}
        one: dict[str, str] = {}
        for k, (item_id, text) in enumerate(items):
            w = [one.setdefault(x, x) for x in words(text or "")]
            if len(w) < rule.min_match:
                continue
            self.items[k] = item_id, w
            own = set(self.shingles(w))
            for g in own:
                at = self.seeds.setdefault(g, k)
                if isinstance(at, list):
                    at.append(k)
                elif at != k:
                    self.seeds[g] = [at, k]
            # a tile of n words has n - min_match + 1 seeds, so words that are covered have a min_match-th as many; repeated seeds count once
            windows = len(w) - rule.min_match + 1
            self.least[k] = math.ceil(rule.min_cover * len(w) / rule.min_match) if len(own) == windows else 1

    def shingles(self, w: list[str]):
        return zip(*[w[k:] for k in range(self.rule.min_match)])

    def find(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(item_id, words of the item, words covered, tiles, cover) of the items that a text contains."""
        w = words(text)
        if not self.seeds or self.seeds.keys().isdisjoint(self.shingles(w)):
            return []
        at, shared = [], set()
        for j, g in enumerate(self.shingles(w)):
            if g in self.seeds:
                at.append(j)
                shared.add(g)
        hits: Counter = Counter()
        for g in shared:
            k = self.seeds[g]
            hits.update(k if isinstance(k, list) else (k,))
        # outside seeds no tile is long enough: what stands between them is one token that matches nothing
        kept: list[str | None] = []
        last = -1
        for j in at:
            if j > last:
                kept.append(None)
            kept += w[max(j, last) : j + self.rule.min_match]
            last = max(last, j + self.rule.min_match)
        out = []
        for k in sorted(k for k, n in hits.items() if n >= self.least[k]):
            item_id, iw = self.items[k]
            number = {x: n + 2 for n, x in enumerate(dict.fromkeys(iw))}
            got = tiles([number[x] for x in iw], [number.get(x, 1) for x in kept], self.rule.min_match)
            covered = sum(n for *_, n in got)
            if covered >= self.rule.min_cover * len(iw):
                out.append((item_id, len(iw), covered, len(got), covered / len(iw)))
        return out


def blocks(benchmark: DataFrame, rule: Rule, item_col: str = "item_id", text_col: str = "text"):
    """The benchmark in blocks of a bounded size, read one at a time."""
    items, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        items.append((r[0], r[1]))
        size += len(words(r[1] or ""))
        if size >= rule.block_words:
            yield Benchmark(items, rule)
            items, size = [], 0
    if items:
        yield Benchmark(items, rule)


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, item_words, covered, n_tiles, cover`` for each document and benchmark item that it contains.

    Defined cases: null and empty texts contain nothing; items of under min_match words, null ones included, can't be
    told from chance and match nothing; rows with a null id and repeated rows are searched as they stand;
    other columns aren't looked at; empty tables give an empty result.
    """
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, item_words long, covered long, n_tiles long, cover double"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(blocks(benchmark, rule)):
        shared = sc.broadcast(block)

        def run(batch, shared=shared):
            found = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True) for x in shared.value.find(t)]
            return list(zip(*found)) if found else None

        part = per_batch(narrow, run, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their columns; nothing is shuffled."""
    sc, place = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for block in blocks(benchmark, rule):
        shared = sc.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                keep = [t is None or not shared.value.find(t) for t in b.column(place).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
