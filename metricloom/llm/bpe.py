"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A vocabulary file is read once per worker process from the path given; it is never shipped or copied. Words
(pre-tokens) already merged are kept in two generations of bounded size, so memory does not grow with the corpus.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level vocabularies split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How many characters past its end a match of PATTERN can depend on.
LOOKAHEAD = 2
GENERATION = 300_000
LONG_WORD = 256
IDS_PER_BATCH = 1 << 20
#: Words of at most so many bytes are counted side by side: so many at once, if there are so many at least.
SHORT_WORD = 32
SIDE_BY_SIDE = 4096
FEW_WORDS = 8
NO_PAIR, NO_SYMBOL = 1 << 60, (1 << 20) - 1


def _latin_pattern() -> re.Pattern:
    """PATTERN for texts below U+0250, with its classes spelled out for the faster standard engine."""
    low = [chr(c) for c in range(0x250)]
    letters = "".join(c for c in low if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in low if unicodedata.category(c)[0] == "N")
    space = "".join(c for c in low if regex.match(r"\s", c))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


_WIDE = re.compile(r"[^\u0000-ɏ]")
_LATIN, _ANY = _latin_pattern(), regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    return (_ANY if _WIDE.search(text) else _LATIN).findall(text)


def each_pretoken(text: str) -> Iterator[str]:
    """pretokens(), found one by one."""
    return (m[0] for m in (_ANY if _WIDE.search(text) else _LATIN).finditer(text))


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, mapped to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe(dict):
    """pre-token -> its ids, as a mapping that computes what it lacks."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = _byte_chars()
        self.of_byte = [0] * 256
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in chain(vocab.items(), self.added.items()):
            self.bytes_of[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.old: dict[str, tuple[int, ...]] = {}
        self.packed = Packed(self)
        self.counts = Counts(self)

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.merge(word.encode())
            if len(word) > LONG_WORD:
                return ids
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merges the pair of least rank, leftmost first, until no pair is in the table. An entry of the queue is
        a rank and the place of its left symbol; it is stale if that place now starts another pair, or none. Each
        place knows the pair it starts, and a merge's new pair takes its entry's place in the queue."""
        get = self.merges.get
        ids = list(map(self.of_byte.__getitem__, word))
        n = len(ids)
        pairs = [get(a << 20 | b) for a, b in zip(ids, ids[1:])]
        queue = [m >> 20 << 32 | i for i, m in enumerate(pairs) if m is not None]
        if not queue:
            return tuple(ids)
        heapify(queue)
        pairs.append(None)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = queue[0]
            left = entry & 0xFFFFFFFF
            m = pairs[left]
            if m is None or m >> 20 != entry >> 32:
                heappop(queue)
                continue
            right = following[left]
            merged = ids[left] = m & 0xFFFFF
            ids[right], pairs[right] = -1, None
            after = following[left] = following[right]
            m = None
            if after < n:
                before[after] = left
                m = get(merged << 20 | ids[after])
            pairs[left] = m
            if m is None:
                heappop(queue)
            else:
                heapreplace(queue, m >> 20 << 32 | left)
            if (b := before[left]) >= 0:
                m = pairs[b] = get(ids[b] << 20 | merged)
                if m is not None:
                    heappush(queue, m >> 20 << 32 | b)
        return tuple([i for i in ids if i >= 0])

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between added tokens, and the added tokens with their ids."""
        if self.special is None or not self.special.search(text):
            yield text, None
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, self.added[part] if k % 2 else None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, added in self.parts(text):
            if added is not None:
                out.append(added)
            else:
                out.extend(chain.from_iterable(map(self.__getitem__, pretokens(part))))
        return out

    def encode_bytes(self, text: str) -> bytes:
        """What encode() gives, as 32-bit integers in native order: words already merged are only put together."""
        packed, out = self.packed, []
        for part, added in self.parts(text):
            if added is not None:
                out.append(array("i", (added,)).tobytes())
            else:
                out.extend(map(packed.__getitem__, pretokens(part)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Packed(dict):
    """pre-token -> its ids as 32-bit integers, computed where lacking and kept as Bpe keeps its own."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("i", self.bpe.merge(word.encode())).tobytes()
            if len(word) > LONG_WORD:
                return ids
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Counts:
    """pre-token -> the number of its tokens, kept as Bpe keeps its own; words that lack are merged side by side."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        pairs = np.array([*bpe.merges, 1 << 62], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array([*bpe.merges.values(), NO_PAIR], np.int64)[order]
        self.of_byte = np.array(bpe.of_byte, np.int64)
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def __getitem__(self, word: str) -> int:
        n = self.known.get(word)
        return self.learn({word})[word] if n is None else n

    def learn(self, words: set[str]) -> dict[str, int]:
        """The numbers of tokens of words that are not in `known`, which then has them."""
        found = {w: self.old[w] for w in words if w in self.old}
        fresh = [w for w in words if w not in found]
        found.update(zip(fresh, self.merged([w.encode() for w in fresh]), strict=True))
        if len(self.known) + len(found) > GENERATION:
            self.known, self.old = {}, self.known
        self.known.update(islice(((w, n) for w, n in found.items() if len(w) <= LONG_WORD), GENERATION))
        return found

    def merged(self, words: list[bytes]) -> list[int]:
        """How many tokens Bpe.merge() makes of each word. Many short words are merged together, those of like length
        at a time; few words and long ones by the queue."""
        if len(words) < FEW_WORDS:
            return [len(self.bpe.merge(w)) for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        counts = np.empty(len(words), np.int64)
        short = int(np.searchsorted(sizes[order], SHORT_WORD, "right"))
        for lo in range(0, short, SIDE_BY_SIDE):
            own = order[lo : min(lo + SIDE_BY_SIDE, short)]
            counts[own] = self._merged([words[k] for k in own.tolist()], sizes[own])
        for k in order[short:].tolist():
            counts[k] = len(self.bpe.merge(words[k]))
        return counts.tolist()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], NO_PAIR)

    def _merged(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """One round merges in each word the pair of least rank, leftmost first; a word without one is done. Symbols
        are doubly linked places of one array, a row a word, with a place that pairs with nothing at both ends."""
        width = int(sizes.max()) + 2
        ids = np.full((len(words), width), NO_SYMBOL, np.int64)
        ids[:, 1:-1][np.arange(width - 2) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ids = ids.ravel()
        ranks = np.append(self._rank(ids[:-1], ids[1:]), NO_PAIR)
        by_word, counts = ranks.reshape(-1, width), sizes.copy()
        following, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        rows = np.arange(len(words))
        while True:
            left = rows * width + by_word[rows].argmin(axis=1)
            m = ranks[left]
            some = m != NO_PAIR
            rows, left, m = rows[some], left[some], m[some]
            if not len(rows):
                return counts
            counts[rows] -= 1
            right, first = following[left], before[left]
            after = following[right]
            ids[left] = merged = m & 0xFFFFF
            following[left], before[after], ranks[right] = after, left, NO_PAIR
            ranks[left], ranks[first] = self._rank(merged, ids[after]), self._rank(ids[first], merged)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int). Null and empty texts have no ids; strings of added
    tokens in a text become those tokens. Null ids, repeated rows and other columns are harmless; an empty table
    gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)

        def flush() -> pa.RecordBatch:
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

        for b in batches:
            keys, ids, held = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys.append(key)
                ids.append(bpe.encode_bytes(text.as_py() or ""))
                held += len(ids[-1]) // 4
                if held >= IDS_PER_BATCH:
                    yield flush()
                    keys, ids, held = [], [], 0
            if keys:
                yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and text, the concatenated vocabulary strings of ids (null and empty: empty text).
    Bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [bpe.decode(ids.values.to_pylist() if ids.is_valid else []) for ids in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    types = dict(encoded.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string"
    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, by way of encoding and decoding."""
    encoded = encode_documents(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = decode_documents(encoded, path, ("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
