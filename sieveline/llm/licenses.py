"""Licence scans: Dice coefficient over word bigrams against licence templates.

A passage is a run of words, wherever lines break. It is compared with a template if its size allows for the threshold: with a and
b bigrams the coefficient is ``2 * common / (a + b)``, and as common is min(a, b) at most, a passage reaches t only if
``t / (2 - t) * b <= a <= (2 - t) / t * b``. Passages of fitting size have ``t * b / (2 - t)`` bigrams of the template in common
at least, so one of any set of ``b`` less this, and one more, is among them. The set of the template's rarest bigrams
(by how many templates have their words) shows where passages can begin at all.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import per_batch, texts
from sieveline.llm.license_texts import TEMPLATES

_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> list[str]:
    """Lower-case words without punctuation."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


@dataclass(frozen=True)
class Template:
    name: str
    grams: dict
    size: int
    least: int
    most: int
    seeds: frozenset


class Matcher:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8):
        self.threshold = threshold
        grams = {k: Counter(bigrams(normalise(v))) for k, v in templates.items()}
        grams = {k: g for k, g in grams.items() if g}
        common = Counter(w for g in grams.values() for w in {w for pair in g for w in pair})
        self.templates = []
        for k, g in grams.items():
            b = sum(g.values())
            least, most = math.ceil(threshold / (2 - threshold) * b - 1e-9), math.floor((2 - threshold) / threshold * b + 1e-9)
            spare, seeds = b - math.ceil(threshold * (least + b) / 2 - 1e-9), set()
            for pair in sorted(g, key=lambda p: (min(common[p[0]], common[p[1]]), -len(p[0] + p[1]), p)):
                seeds.add(pair)
                spare -= g[pair]
                if spare < 0:
                    break
            self.templates.append(Template(k, dict(g), b, least, most, frozenset(seeds)))
        self.seeds = frozenset().union(*[t.seeds for t in self.templates])

    def _best_from(self, grams: list, start: int, t: Template) -> tuple[float, int]:
        """(coefficient, bigrams) of the best passage that begins at a bigram, the shortest of equal ones."""
        best, seen, common = (0.0, 0), {}, 0
        for j in range(start, min(len(grams), start + t.most)):
            p = grams[j]
            if p is None:
                break
            most = t.grams.get(p)
            if most is None:  # a passage that ends in another bigram is better without it
                continue
            n = seen[p] = seen.get(p, 0) + 1
            common += n <= most
            size = j - start + 1
            if size >= t.least and (score := 2 * common / (size + t.size)) > best[0]:
                best = (score, size)
        return best

    def _passages(self, grams: list) -> list[tuple[float, int, int, str]]:
        """(coefficient, first bigram, bigrams, template): for each template and place the best passage that reaches the threshold."""
        at = defaultdict(list)
        for i, p in enumerate(grams):
            if p in self.seeds:
                at[p].append(i)
        out = []
        for t in self.templates:
            starts: set[int] = set()
            for p in t.seeds:
                for i in at.get(p, ()):
                    starts.update(range(max(0, i - t.most + 1), i + 1))
            for s in starts:
                if grams[s] in t.grams:
                    score, size = self._best_from(grams, s, t)
                    if score >= self.threshold:
                        out.append((score, s, size, t.name))
        return out

    def find(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coefficient, first line, lines, words) of the passages that match, none of which overlap.

        The best passage is taken first, then the best of what stands outside of it, until there are no more.
        """
        words = normalise(text)
        if self.seeds.isdisjoint(zip(words, words[1:])):
            return []
        grams: list = bigrams(words)
        kept: list[tuple[str, float, int, int]] = []
        while found := self._passages(grams):
            used = bytearray(len(words) + 1)
            for score, s, size, name in sorted(found, key=lambda x: (-x[0], x[1], -x[2], x[3])):
                if used.find(1, s, s + size + 1) < 0:
                    used[s : s + size + 1] = b"\x01" * (size + 1)
                    kept.append((name, score, s, size + 1))
                    for k in range(max(0, s - 1), min(len(grams), s + size + 1)):
                        grams[k] = None  # its words are in no other passage
        begins, n = [], 0
        for line in text.split("\n"):
            begins.append(n)
            n += len(normalise(line))
        line_of = lambda word: bisect_right(begins, word) - 1
        return [(name, score, line_of(s), line_of(s + n - 1) - line_of(s) + 1, n) for name, score, s, n in sorted(kept, key=lambda x: x[2])]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, dice, first_line, n_lines, n_words`` for each passage of a document that matches a template.

    Of passages that overlap the best counts, of equally good ones the first, then the longest, then the first template by name.
    Defined cases: null texts, and texts without words, match nothing; texts of any length are searched whole, in time that grows with
    the licence text in them; rows with a null id and repeated rows are scanned as they stand; other columns aren't looked at, whatever their
    names; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, threshold))

    def run(batch):
        found = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True) for x in shared.value.find(t)]
        return list(zip(*found)) if found else None

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(narrow, run, "doc_id long, license string, dice double, first_line long, n_lines long, n_words long")
