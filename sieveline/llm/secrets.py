"""Secret scans with a token-efficiency test.

BPE vocabularies spell ordinary words with few tokens and random strings with many. A run of characters that a key
could consist of is reported as ``random`` if it, or a part of it, has few characters for each token, unless it is a digest of known
length, a UUID or a number that isn't the value of a secret's name. Patterns find what keys look like whatever their tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import per_batch, sha, span_text, texts

KINDS = ["assign", "access", "hex", "random"]
#: A run has to be spelt badly by all of them: words of one language are spelt with many tokens by a vocabulary of another.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how GPT-2's vocabulary parts text before merging, without its look-ahead.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a secret is given to: the names of assign and some more, with what follows them.
_NAMED = re.compile(r"""(?:passw(?:or)?d|secret|token|api_?key|private_?key|access_?key|credential|auth(?![a-z]))[\w-]{0,32}["']?\s{0,4}(?::=|=>|[:=])\s{0,4}["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs of what keys are made of. Letters of other alphabets that have two cases belong to a run, so that words aren't cut at them.
LEAST = 16
_RUN = re.compile("[A-Za-z0-9+/_=\u00aa-\u024f\u0370-\u052f\u1e00-\u1fff-]{%d,}" % LEAST)
_SEPARATOR = re.compile("[/_=+-]+")
_DIGIT = re.compile("[0-9]")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}


@dataclass(frozen=True)
class Test:
    """A run is random if it has at most max_ratio characters a token, without a digit max_ratio_letters, in any of its windows or as a whole."""

    max_ratio: float = 2.2
    max_ratio_letters: float = 2.0
    window: int = 256


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost first and without overlap in each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # runs are matched whole, so those of under 24 characters are the ones that fail
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def known(run: str) -> bool:
    """Digests of known lengths, UUIDs, and numbers with few letters or none, such as dates."""
    if _HEX_ONLY.fullmatch(run) and len(run) in DIGESTS or _UUID.fullmatch(run):
        return True
    letters, digits = sum(c.isalpha() for c in run), sum(c.isdigit() for c in run)
    return 5 * letters <= letters + digits


def ratio(run: str, encode, window: int) -> float:
    """Characters a token."""
    return len(run) / max(1, sum(len(encode(run[i : i + window])) for i in range(0, len(run), window)))


def is_random(run: str, encode, test: Test, named: bool = False) -> bool:
    """Whether the run, one of its parts between separators, or all parts put together pass the test in any window.

    ``named``: the run is the value of a secret's name, so what looks like a digest or an identifier isn't taken for one.

    Parts put together say what short ones are made of: names in a path stay words, groups of a random key don't. What has a letter of another
    alphabet is a word.
    """
    if known(run) and not named:
        return False
    run = run if named else _UUID.sub("/", run)
    every = _SEPARATOR.split(run)
    parts = [p for p in every if named or not (_HEX_ONLY.fullmatch(p) and len(p) in DIGESTS)]
    together = "".join(parts)
    # separators are tokens of their own, so a run counts with them only if letters and digits are mixed in it
    mixed = len(parts) == len(every) and sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:])) >= 3
    for s in {*parts, together, *([run] if mixed else [])}:
        if len(s) >= LEAST and s.isascii() and not (s.isdigit() if named else known(s)):
            limit = test.max_ratio if _DIGIT.search(s) else test.max_ratio_letters
            # a last window that is too short to tell goes with the one before
            starts = range(0, max(1, len(s) - LEAST + 1), test.window)
            if any(ratio(s[i : i + test.window] if i != starts[-1] else s[i:], encode, test.window + LEAST) <= limit for i in starts):
                return True
            if ratio(s, encode, test.window) <= limit:
                return True
    return False


def random_spans(text: str, encode, test: Test) -> list[tuple[str, int, int]]:
    runs = list(_RUN.finditer(text))
    values = [m.span(1) for m in _NAMED.finditer(text)] if runs and (":" in text or "=" in text) else []
    # a value may end in a full stop that isn't part of the run, and the run may begin with the name
    named = lambda m: any(a < m.end() and m.start() < b for a, b in values)
    return [("random", *m.span()) for m in runs if is_random(m[0], encode, test, bool(values) and named(m))]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(*vocabularies: bytes):
    """A function that spells a string with the vocabulary that needs the fewest tokens for it."""
    import tiktoken

    def one(vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    each = [one(v) for v in vocabularies]
    return each[0] if len(each) == 1 else lambda s: min((e(s) for e in each), key=len)


def scan(docs: DataFrame, vocabularies: Sequence[str] = VOCABULARIES, test: Test = Test(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for each row of ``docs``.

    Defined cases: a null text is empty; texts of any length are searched whole, long runs window by window; rows with a null id and repeated
    rows are scanned as they stand; a ratio equal to its limit passes; other columns aren't looked at, whatever their names; an empty table gives an
    empty result. The vocabularies are read once,
    on the driver, and sent to the workers: files of under 2 MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast([read_vocabulary(v) for v in vocabularies])
    made: list = []

    def run(batch):
        if not made:
            made.append(encoder(*shared.value))
        out: list[list] = [[] for _ in range(6)]
        for text in texts(batch, "text"):
            base = base_spans(text)
            more = random_spans(text, made[0], test)
            for k, kind in enumerate(KINDS):
                out[k].append(sum(s[0] == kind for s in base + more))
            out[4].append(sha(span_text(base, KINDS)))
            out[5].append(span_text(base + more, KINDS))
        return [batch.column(0), *out]

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(narrow, run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
