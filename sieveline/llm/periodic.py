"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with a period, the smallest one, that no neighbouring word extends. A text is parted into
Lempel-Ziv factors, each the longest string that has occurred before (or a new word), with a suffix automaton. Runs that touch the beginning of a factor and
end before its end are found with Main's algorithm, from longest common extensions on either side of that place. All others lie strictly inside of a
factor, so they are copies of runs in the factor's earlier occurrence. Every run is found once, in time linear in the text but for
dictionary look-ups.

Two exact shortcuts use that only runs of some length and exponent are wanted: a text in which no window of words repeats that such
a run must repeat has none, and a factor whose neighbours are too short for such a run to touch its beginning isn't searched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of texts that go out in one batch.
BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors of w as (start, length, start of an earlier occurrence), (start, 1, -1) for a new letter.

    ``first`` of a state is where its strings end first, so a string that ends at j has occurred before if that is less than j.
    """
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i = [], 0
    while i < len(w):
        state, j = 0, i
        while j < len(w) and first[to := step[state][w[j]]] < j:
            state, j = to, j + 1
        out.append((i, j - i, first[state] - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def extensions(x: Sequence[int]) -> list[int]:
    """For each place of x, the length of the longest common prefix of x and what begins there."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: Sequence[int], start: int, begin: int, end: int, most: int, power: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, p) of the runs with a period p up to ``most`` that touch ``begin`` and end before ``end``, by Main's algorithm.

    They begin after ``start`` or at the text's beginning. A run's places that equal the place a period further on are an interval that touches ``begin`` or
    the place a period before it; common prefixes and suffixes from there give its ends.
    """
    t, v = w[start:begin], w[begin : end + 1]
    ahead = extensions([*v, -2, *t, *v])[len(v) + 1 :]
    behind = extensions([*t[::-1], -3, *v[::-1], *t[::-1]])[len(t) + 1 :]
    seen = set()
    for p in range(1, most + 1):
        both = []
        if p < len(v):
            both.append((begin - behind[len(v) - p], begin + p + ahead[len(t) + p] - 1))
        if p <= len(t):
            both.append((begin - p - (behind[len(v) + p] if p < len(t) else 0), begin + ahead[len(t) - p] - 1))
        for a, b in both:
            # with the same ends and a larger period it is the same run
            if b < end and b - a + 1 >= max(least, power * p) and (a, b) not in seen:
                seen.add((a, b))
                yield a, b, p


def runs(words: Sequence[int], power: int = 3, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` letters and ``power`` periods (2 or more), by start, then period."""
    w = [*words, -1]  # a letter of its own, so that runs end before the end
    parts = factors(w)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in range(1, len(parts)):
        begin, length, source = parts[k]
        end = begin + length - 1
        before, before2 = parts[k - 1][1], parts[k - 2][1] if k > 1 else 0
        # a period of the run takes in the beginning of the factor before, or of the one before that if the run ends with the factor before
        span = max(length + before, before + before2)
        most = span // (power - 1)
        if span + most >= least:
            for a, b, p in crossing(w, max(0, begin - before - before2 - most), begin, end, most, power, least):
                found[a].append((b, p))
        if source >= 0 and found:
            for a in range(source + 1, source + length):
                # those that are copied here may lie in the earlier occurrence themselves
                for b, p in found.get(a, ()):
                    if b + 1 < source + length:
                        found[a + begin - source].append((b + begin - source, p))
    return sorted((a, b - a + 1, p) for a, ends in found.items() for b, p in ends)


def may_have_runs(words: Sequence[bytes], power: int, least: int) -> bool:
    """False only if there is no run: one of ``least`` words and ``power`` periods repeats a window of the width below, a period further on."""
    width = max(1, -(-least * (power - 1) // power))
    n = len(words)
    if n <= width:
        return False
    with np.errstate(over="ignore"):
        base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        powers, backs = np.full(n, base), np.full(n - width + 1, back)
        powers[0] = backs[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.fromiter(map(hash, words), np.int64, n).view(np.uint64) * np.cumprod(powers))))
        windows = (sums[width:] - sums[:-width]) * np.cumprod(backs)
    windows.sort()
    return bool((windows[1:] == windows[:-1]).any())


def collapse(words: Sequence[bytes], found: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run repeats after its first period."""
    kept, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in found):
        kept += words[at : max(at, start)]
        at = max(at, end)
    return [*kept, *words[at:]]


def strongest(found: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; of equal ones the first, of these the one with the smallest period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def runs_of(text: str, power: int = 3, least: int = 24) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words of a text, and its runs. ``bytes.split`` parts at the ASCII white space that parts words here, and at no other."""
    words = text.encode().split()
    if not may_have_runs(words, power, least):
        return words, []
    numbers: dict[bytes, int] = {}
    return words, runs([numbers.setdefault(x, len(numbers)) for x in words], power, least)


def scan(docs: DataFrame, power: int = 3, least: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` for each row of ``docs``.

    ``runs`` are of at least ``least`` words and ``power`` periods, with places counted in words from 0; ``strongest`` has the greatest exponent (null: no
    run); ``collapsed`` are the words that no run repeats, joined by one space. Defined cases: a null text is empty and has no words; texts of any
    length are searched whole; of equal exponents the first run, then the smallest period counts; rows with a null id and repeated rows are
    searched as they stand; other columns aren't looked at, whatever their names; an empty table gives an empty result.
    """
    if power < 2:
        raise ValueError("a run has two periods at least")
    out = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "period")
        for b in batches:
            rows, size = [], 0
            for key, text in zip(b.column(0), b.column(1)):
                words, found = runs_of(text.as_py() or "", power, least)
                best = strongest(found)
                rows.append(
                    {
                        "doc_id": key.as_py(),
                        "n_words": len(words),
                        "runs": [dict(zip(names, r)) for r in found],
                        "strongest": None if best is None else dict(zip(names, best)),
                        "collapsed": b" ".join(collapse(words, found)).decode(),
                    }
                )
                size += len(rows[-1]["collapsed"])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
