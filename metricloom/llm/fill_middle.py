"""Fill-in-the-middle documents, by bit-parallel work on big integers.

A text's UTF-8 bytes become masks with a bit a byte: bytes.translate maps a class of bytes to "1" and the rest to "0",
and int(..., 2) reads that as one integer (the first byte is bit 0). Units end where shifted Boolean operations on
the masks say so: lines at line feeds, words at the last byte before white space, characters at the byte before the
next leading byte; whatever ends a text ends its last unit. The number of units is the bit_count of the ends, the
k-th end is found by recursive halving, and code points are counted on the mask of leading bytes. All of this is
linear in the text, whatever its length.

Cuts come from the first four 8-digit groups of sha256("7:" + decimal doc_id), so a row's cuts depend on nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, utf8_list

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 100, 50, 7
ROWS = 64
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _table(members: bytes) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


LINE_FEED = _table(b"\n")
WHITE = _table(b" \t\n\x0b\x0c\r")
LEADING = _table(bytes([*range(0x80), *range(0xC0, 0x100)]))


def mask(reversed_data: bytes, table: bytes) -> int:
    """A bit for every byte of the class, of data that is given back to front."""
    return int(reversed_data.translate(table), 2) if reversed_data else 0


def unit_ends(data: bytes, unit: str = "lines") -> tuple[int, int]:
    """The mask of bytes that end a unit ("lines", "words" with the white space after them and, for the first, before
    it, or "characters") and the mask of the code points' leading bytes."""
    back = data[::-1]
    leading, last = mask(back, LEADING), 1 << len(data) >> 1
    if unit == "lines":
        ends = mask(back, LINE_FEED)
    elif unit == "words":
        white = mask(back, WHITE)
        lead = (white ^ (white + 1)) >> 1  # the run of white space that the text begins with belongs to its first word
        ends = white & ~(white >> 1) & ~((lead + 1) >> 1)
    elif unit == "characters":
        ends = leading >> 1
    else:
        raise ValueError(f"no such unit: {unit}")
    return ends | last, leading


def select(bits: int, width: int, k: int) -> int:
    """The place of the k-th (from 0) set bit among the lowest `width` bits: the half that has it is halved again."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - below, at + half
    return at


def cut(data: bytes, units: tuple[int, int], draws: tuple[int, int]) -> tuple[int, int, int]:
    """The number of units, and the bytes before the smaller and the larger of the drawn numbers of units."""
    n = units[0].bit_count()
    places = [select(units[0], len(data), k - 1) + 1 if k else 0 for k in sorted(h % (n + 1) for h in draws)]
    return n, places[0], places[1]


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(doc_id: int | None, data: bytes, unit: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, the code points of prefix and middle, and the output of one text."""
    h = draws(doc_id, seed)
    ends, leading = unit_ends(data, unit)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not data or p in data or s in data or m in data or h[2] % 100 >= rate:
        return ends.bit_count(), "plain", None, None, data
    n, lo, hi = cut(data, (ends, leading), (h[0], h[1]))
    count = lambda end: (leading & ((1 << end) - 1)).bit_count()
    prefix, middle, suffix = data[:lo], data[lo:hi], data[hi:]
    spm = h[3] % 100 < spm_rate
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm else "psm", count(lo), count(hi) - count(lo), out


def fill_middle(docs: DataFrame, unit: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> a row a row: doc_id, n (units of the text), form ("psm", "spm" or "plain"),
    prefix_chars and middle_chars (code points; null if plain) and output, the rearranged text.

    A null text is an empty one; empty texts, texts that contain a mark and all but `rate` of a hundred others are
    plain, which means unchanged. A null doc_id draws as the empty string does. Rows of one id have the same draws.
    Other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                ids = part.column(0).to_pylist()
                found = [rearranged(i, t, unit, rate, spm_rate, seed) for i, t in zip(ids, utf8_list(part.column(1)), strict=True)]
                n, form, prefix, middle, out = zip(*found, strict=True)
                yield batch(doc_id=pa.array(ids, pa.int64()), n=pa.array(n, pa.int64()), form=pa.array(form, pa.string()), prefix_chars=pa.array(prefix, pa.int64()), middle_chars=pa.array(middle, pa.int64()), output=pa.array(out, pa.binary()).cast(pa.string()))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, FORMS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    of = lambda *order: F.concat(*(F.get(parts, F.lit(k)) for k in order))
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_middle() with SHA-256 of the output and of the text restored from it."""
    found = fill_middle(docs)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
