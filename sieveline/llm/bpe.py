"""Byte-level BPE encoding and decoding by a depth-first walk of a trie of distinct words.

The BPE encoding of a string ends in one token, and what stands before that token is encoded as if it stood alone. So the last token of a
prefix follows from the last tokens of shorter ones: it is the only token that the prefix ends in and that is compatible with the last token before it, that is,
the two of them encode to themselves. Distinct words in the order of their bytes are a depth-first walk of their trie: the last tokens of
the prefix that a word shares with the one before stay on the stack, so a shared prefix is encoded once. A word's tokens are read from the stack backwards.

Words are distinct within blocks of texts, in the tasks that read the texts. Nothing is shuffled: what all texts have in common is found again in each
task, which costs less than to send texts to their words and back.
"""

from __future__ import annotations

import codecs
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the byte-level pre-tokenizer parts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these letters Unicode versions of the pattern's classes differ, so the tokenizer's own pre-tokenizer parts such texts.
OTHER_LETTERS = "[^\x00-ԯ]"
#: Words of a block, for which one trie is walked; words that are kept from block to block, none of them longer than KEPT_CHARS.
BLOCK_WORDS = 200_000
KEPT_WORDS = 400_000
KEPT_CHARS = 40
KEPT_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> dict[int, bytes]:
    """What each id of a tokenizer file stands for, added tokens included; all that decoding needs."""
    spec, letters = json.loads(raw), byte_letters()
    spelt = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return spelt | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class Model:
    """The vocabulary and merges of a tokenizer file, and the walk."""

    def __init__(self, raw: bytes):
        import regex

        spec = json.loads(raw)
        parted, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = parted.get("type") == "ByteLevel" and not parted.get("add_prefix_space") and parted.get("use_regex", True)
        if not plain or spec["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take in what is around them aren't supported")
        letters = byte_letters()
        spell = {s: bytes(letters[c] for c in s) for s in model["vocab"]}
        self.bytes_of = vocabulary(raw)
        self.ids = {spell[s]: i for s, i in model["vocab"].items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.ids[spell[a]], self.ids[spell[b]]): (rank, self.ids[spell[a] + spell[b]]) for rank, (a, b) in enumerate(pairs)}
        self.beginnings = {t[:i] for t in self.ids for i in range(len(t) + 1)}
        # a state is the longest end of what was walked that a token begins with; states and moves are made as they are met
        self.states, self.state_of, self.moves = [b""], {b"": 0}, {}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"]}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.word, self.other = regex.compile(PATTERN), regex.compile(OTHER_LETTERS)
        self.raw, self.library = raw, None
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def words(self, text: str) -> Iterator[str]:
        """The words of a text in order; an added token is a word, which no other word can be."""
        for part in self.at_added.split(text) if self.at_added and any(a in text for a in self.added) else [text]:
            if part in self.added:
                yield part
            elif self.other.search(part):
                if self.library is None:
                    from tokenizers import Tokenizer

                    self.library = Tokenizer.from_str(self.raw.decode())
                yield from (part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part))
            else:
                yield from (m.group() for m in self.word.finditer(part)) if len(part) > 1 << 20 else self.word.findall(part)

    def merged(self, text: bytes) -> list[int]:
        """The encoding by definition: the first of the merges of least rank, again and again. For short strings."""
        ids, get = [self.single[b] for b in text], self.merges.get
        while found := [(m, i) for i, pair in enumerate(zip(ids, ids[1:])) if (m := get(pair))]:
            (_, made), at = min(found)
            ids[at : at + 2] = [made]
        return ids

    def together(self, before: int, token: int) -> bool:
        """Whether a token stays as it is after ``before``, or at the beginning of a word (-1)."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        pair = [before, token] if before >= 0 else [token]
        known = tuple(pair) not in self.merges and self.merged(b"".join([self.bytes_of[t] for t in pair])) == pair
        self.pairs[before << 32 | token] = known
        return known

    def move(self, state: int, byte: int) -> int:
        """The state after one byte more; with it the tokens that end there, as (length, token), longest first."""
        end = self.states[state] + bytes([byte])
        while end not in self.beginnings:
            end = end[1:]
        if (to := self.state_of.get(end)) is None:
            to = self.state_of[end] = len(self.states)
            self.states.append(end)
            self.ends.append(tuple((len(end) - i, self.ids[end[i:]]) for i in range(len(end)) if end[i:] in self.ids))
        if len(self.moves) >= KEPT_PAIRS:
            self.moves.clear()
        self.moves[state << 8 | byte] = to
        return to

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each distinct word with its token ids as little-endian 32-bit integers, in the order of the trie.

        The stack has, for each prefix of the word being walked, its state, its last token and that token's length.
        """
        moves, ends, pairs = self.moves, self.ends, self.pairs
        stack, path = [(0, -1, 0)], b""
        for word in sorted(words):
            shared = _shared(path, word)
            del stack[shared + 1 :]
            state = stack[-1][0]
            for byte in word[shared:]:
                if (to := moves.get(state << 8 | byte)) is None:
                    to = self.move(state, byte)
                state = to
                for length, token in ends[state]:
                    before = stack[-length][1]
                    if (known := pairs.get(before << 32 | token)) is None:
                        known = self.together(before, token)
                    if known:
                        break
                else:
                    raise ValueError("the vocabulary has tokens that its merges don't make")
                stack.append((state, token, length))
            out, end = [], len(word)
            while end:
                _, token, length = stack[end]
                out.append(token)
                end -= length
            yield word, struct.pack(f"<{len(out)}I", *reversed(out))
            path = word

    def encode(self, blocks: list[tuple[int, list[str]]]) -> list[tuple[int, bytes]]:
        """(row, ids) for (row, words): one walk for all words that aren't known yet."""
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        if not kept:
            kept.update(self.added)
        new = [w.encode() for w in set(chain.from_iterable(words for _, words in blocks)) - kept.keys()]
        here = {}
        for word, ids in self.walk(new):
            w = word.decode()
            (kept if len(w) <= KEPT_CHARS else here)[w] = ids
        if here:
            return [(row, b"".join([kept.get(w) or here[w] for w in words])) for row, words in blocks]
        return [(row, b"".join([kept[w] for w in words])) for row, words in blocks]


def spell_out(ids: bytes, table: dict[int, bytes], at_once: int = 1 << 20) -> str:
    """The text of packed ids; bytes that aren't UTF-8 are replaced, unknown ids left out."""
    made = codecs.getincrementaldecoder("utf-8")("replace")
    parts = (struct.unpack_from(f"<{min(at_once, len(ids) // 4 - i)}I", ids, 4 * i) for i in range(0, len(ids) // 4, at_once))
    texts = [made.decode(b"".join([table.get(t, b"") for t in part])) for part in parts]
    return "".join([*texts, made.decode(b"", True)])


def _shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@lru_cache(maxsize=2)
def model(raw: bytes) -> Model:
    """A worker's model of a tokenizer file, made once."""
    return Model(raw)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``: its text's tokens as little-endian unsigned 32-bit integers (``as_array`` unpacks them).

    Added tokens that stand in a text are tokens, as the tokenizers library takes them; none are put around it. Defined cases: a null or empty text has no
    tokens; texts of any length are encoded whole, ``block`` words at a time; rows with a null id and repeated rows are encoded as they
    stand; other columns aren't looked at, whatever their names; an empty table gives an empty result. The tokenizer file is read once, on the driver, and
    sent to the workers: a few MB, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        for b in batches:
            keys, ids, blocks, size, done = b.column(0), {}, [], 0, 0

            def flush(upto: int) -> Iterator[pa.RecordBatch]:
                nonlocal blocks, size, done
                for row, part in bpe.encode(blocks):
                    ids.setdefault(row, []).append(part)
                blocks, size = [], 0
                if upto > done:  # these rows are whole
                    yield pa.RecordBatch.from_arrays([keys.slice(done, upto - done), pa.array([b"".join(ids.pop(i, ())) for i in range(done, upto)], pa.binary())], names=["doc_id", "ids"])
                    done = upto

            for row in range(b.num_rows):
                words = bpe.words(b.column(1)[row].as_py() or "")
                while part := list(islice(words, block)):
                    blocks.append((row, part))
                    size += len(part)
                    if size >= block:
                        yield from flush(row)
            yield from flush(b.num_rows)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, text`` of ``encode``'s rows: the text that the ids stand for, added tokens included.

    Defined cases: null ids are none and give an empty text; ids that aren't in the vocabulary are left out; bytes that aren't UTF-8 become U+FFFD; a text of
    any length is decoded whole; repeated rows and null doc_ids stay as they stand; an empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_read(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = pa.array([spell_out(x or b"", table) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def as_array(ids: bytes | None) -> list[int]:
    """Packed ids as numbers."""
    return list(chain.from_iterable(struct.iter_unpack("<I", ids or b"")))
