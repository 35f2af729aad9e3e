"""Sets of word shingles as sorted unsigned 64-bit hashes, computed over whole Arrow buffers.

Words are runs of bytes other than x20 and x09-x0D, with A-Z lower-cased. Each word gets a polynomial
hash from one prefix sum over the bytes; five consecutive word hashes are folded into a shingle hash.
Equality of shingles is equality of their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
SEGMENT = 1 << 18
U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240521)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


_BASE = 0xD6E8FEB86659FD93
_POW = _powers(_BASE, SEGMENT)
_INV = _powers(pow(_BASE, -1, 1 << 64), SEGMENT)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def _words(buf: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of at most SEGMENT bytes; firsts: offsets at which a document starts."""
    word = ~_SPACE[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin[firsts] |= word[firsts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = firsts[firsts > 0] - 1
    last[cut] |= word[cut]
    a, b = np.flatnonzero(begin), np.flatnonzero(last) + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _POW[: len(buf)], out=total[1:])
    return a, mix((total[b] - total[a]) * _INV[a] + (b - a).astype(np.uint64))


def _fold(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> U(29))) * _MUL + h[k : len(h) - n + 1 + k]
    return mix(out + U(n))


def _unique(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h


def _of_words(h: np.ndarray) -> np.ndarray:
    return _unique(_fold(h, min(WIDTH, len(h)))) if len(h) else h


def _long(buf: np.ndarray) -> np.ndarray:
    """Word hashes of one text longer than a segment, cut at white space; a word longer than that has a hash of its own."""
    parts, at = [], 0
    while at < len(buf):
        end = min(at + SEGMENT, len(buf))
        spaces = np.flatnonzero(_SPACE[buf[at:end]])
        if end == len(buf) or len(spaces):
            stop = end if end == len(buf) else at + int(spaces[-1]) + 1
            parts.append(_words(buf[at:stop], np.zeros(1, np.int64))[1])
        else:
            stop = end
            while stop < len(buf) and not len(spaces := np.flatnonzero(_SPACE[buf[stop : stop + SEGMENT]])):
                stop += SEGMENT
            stop = stop + int(spaces[0]) if stop < len(buf) else len(buf)
            parts.append(np.array([xxhash.xxh3_64_intdigest(buf[at:stop].tobytes().lower())], np.uint64))
        at = stop
    return np.concatenate(parts)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text (null: empty): distinct shingles of five words, of fewer words the
    whole sequence as one, without words the empty set."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + SEGMENT, side="right")) - 1
        if j <= i:
            yield _of_words(_long(data[offsets[i] : offsets[i + 1]]))
            i += 1
            continue
        low = offsets[i]
        buf = data[low : offsets[j]]
        edges = offsets[i : j + 1] - low
        if not len(buf):
            for _ in range(i, j):
                yield np.zeros(0, np.uint64)
            i = j
            continue
        starts, h = _words(buf, np.unique(edges[:-1][edges[:-1] < len(buf)]))
        at = np.searchsorted(starts, edges)
        folded = _fold(h, WIDTH) if len(h) >= WIDTH else h[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield _unique(folded[a : b - WIDTH + 1]) if b - a >= WIDTH else _of_words(h[a:b])
        i = j
