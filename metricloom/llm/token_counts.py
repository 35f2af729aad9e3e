"""Token counts that follow edits: a segment tree of pre-token counts per document, kept in a table.

The leaves are short runs of pre-tokens with their token counts; inner nodes hold sums of characters and tokens. A
stored tree is a row: the text, each pre-token's width and token count, and the sums. An edit is located by
descending the sums; only the leaves it touches are cut out of the text, and only the pre-tokens it can change are
encoded again, from the last boundary that cannot depend on the edited characters to the first boundary behind the
edit where old and new pre-tokens meet again. Then the sums above the changed leaves are updated. Strings of added
tokens are one token, as in encoding.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LOOKAHEAD, Bpe, each_pretoken, load, pretokens
from .common import arrow_map, short_batches, written

LEAF = 64
CONTEXT = 8
STORED = "text string, widths array<int>, counts array<int>, chars array<int>, tokens array<int>"
Piece = tuple[str, int]
Row = tuple[str, np.ndarray, np.ndarray, list[int], list[int]]
Leaf = tuple[str, list[int], list[int]]


def pieces_of(text: str, bpe: Bpe) -> list[Piece]:
    """The pre-tokens and added tokens of a text, with their token counts."""
    out: list[Piece] = []
    for part, added in bpe.parts(text):
        out += [(part, 1)] if added is not None else [(p, len(bpe[p])) for p in pretokens(part)]
    return out


def _sums(leaves: np.ndarray) -> list[int]:
    """Leaf values under the sums of all inner nodes: node 1 is the root, 2k and 2k + 1 are below k."""
    size = 1 << max(len(leaves) - 1, 0).bit_length()
    level, levels = np.concatenate([leaves, np.zeros(size - len(leaves), np.int64)]), []
    while len(level) > 1:
        levels.append(level)
        level = level.reshape(-1, 2).sum(axis=1)
    return [0, *np.concatenate([level, *reversed(levels)]).tolist()]


def _row(text: str, widths: np.ndarray, counts: np.ndarray) -> Row:
    edges = np.arange(0, max(len(widths), 1), LEAF)
    by_leaf = lambda v: _sums(np.add.reduceat(v, edges, dtype=np.int64) if len(v) else np.zeros(1, np.int64))
    return text, widths, counts, by_leaf(widths), by_leaf(counts)


def rows_of(texts: list[str], bpe: Bpe) -> list[Row]:
    """The stored trees of texts, each of which is encoded once as a whole. Pre-tokens that no earlier text had are
    merged together for all of them."""
    cut, known = [], bpe.counts.known
    for text in texts:
        words, added_at = [], []
        for part, added in bpe.parts(text):
            if added is None:
                words += pretokens(part)
            else:
                added_at.append(len(words))
                words.append(part)
        counts = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
        counts[added_at] = 1
        lacking = np.flatnonzero(counts < 0)
        cut.append((np.fromiter(map(len, words), np.int32, len(words)), counts, lacking, [words[k] for k in lacking.tolist()]))
    learned = bpe.counts.learn(set().union(*(words for *_, words in cut)))
    for _, counts, lacking, words in cut:
        counts[lacking] = [learned[w] for w in words]
    return [_row(text, widths, counts) for text, (widths, counts, *_) in zip(texts, cut, strict=True)]


def row_of(text: str, bpe: Bpe) -> Row:
    """The stored tree of one text."""
    return rows_of([text], bpe)[0]


class TokenTree:
    """The pre-tokens of one text and their token counts. Leaves are cut out of the text when they are needed."""

    def __init__(self, text: str, widths: np.ndarray, counts: np.ndarray, chars: list[int], tokens: list[int], bpe: Bpe):
        self.text, self.widths, self.counts, self.chars, self.tokens, self.bpe = text, widths, counts, chars, tokens, bpe
        self.n_leaves = max(-(-len(widths) // LEAF), 1)
        self.size = len(chars) // 2
        self.first = [0, *accumulate(chars[self.size :])]
        self.held: dict[int, Leaf] = {}
        self.encoded_chars = 0
        self.context = LOOKAHEAD + max(map(len, bpe.added), default=0)

    @classmethod
    def of(cls, text: str, bpe: Bpe) -> TokenTree:
        """The tree of a text, which is encoded once as a whole."""
        return cls(*row_of(text, bpe), bpe)

    def stored(self) -> Row:
        """The row of a tree: of the edited text, in leaves of full length again if an edit has changed any."""
        if not self.held:
            return self.text, self.widths, self.counts, self.chars, self.tokens
        text, widths, counts = zip(*map(self._leaf, range(self.n_leaves)), strict=True)
        return _row("".join(text), *(np.array(list(chain.from_iterable(x)), np.int32) for x in (widths, counts)))

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def leaf(self, k: int) -> list[Piece]:
        text, widths, counts = self._leaf(k)
        return [(text[end - w : end], n) for end, w, n in zip(accumulate(widths), widths, counts, strict=True)]

    def _leaf(self, k: int) -> Leaf:
        """The text of a leaf, and the widths and token counts of its pieces."""
        if k in self.held:
            return self.held[k]
        own = slice(k * LEAF, (k + 1) * LEAF)
        return self.text[self.first[k] : self.first[k + 1]], self.widths[own].tolist(), self.counts[own].tolist()

    def _locate(self, at: int) -> tuple[int, int]:
        """The leaf that has character `at` (the last leaf at the end), and where the leaf starts."""
        k, start = 1, 0
        last = self.size + self.n_leaves - 1
        while k < self.size:
            k *= 2
            first_right = k + 1
            while first_right < self.size:
                first_right *= 2
            if at - start >= self.chars[k] and first_right <= last:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def _set(self, k: int, leaf: Leaf) -> None:
        self.held[k] = leaf
        k += self.size
        self.chars[k], self.tokens[k] = sum(leaf[1]), sum(leaf[2])
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters [start, end), cut to the text."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, base = self._locate(max(0, start - self.context - 1))
        while first and base + self.context > start:
            first -= 1
            base -= self.chars[self.size + first]
        before, widths, counts = self._leaf(first)
        starts = list(accumulate(widths, initial=base))
        kept = max(bisect_right(starts, start - self.context) - 1, 0)
        at = starts[kept]
        stale, stale_widths, stale_counts, leaf = before[at - base :], widths[kept:], counts[kept:], first

        def further() -> None:
            nonlocal stale, leaf
            leaf += 1
            more, more_widths, more_counts = self._leaf(leaf)
            stale += more
            stale_widths.extend(more_widths)
            stale_counts.extend(more_counts)

        while at + len(stale) < end and leaf + 1 < self.n_leaves:
            further()
        behind, shift = CONTEXT, len(replacement) - (end - start)
        while True:
            changed = stale[: start - at] + replacement + stale[end - at :]
            whole = leaf + 1 == self.n_leaves
            bounds = dict(zip(accumulate(stale_widths), count(1)))
            fresh, p, met = [], 0, None
            for piece, added in self._cut(changed):
                p += len(piece)
                if not whole and p + self.context > len(changed):
                    break
                fresh.append((piece, added))
                if p >= start - at + len(replacement) and p - shift in bounds:
                    met = bounds[p - shift]
                    break
            if met is not None or whole:
                break
            for _ in range(behind):
                if leaf + 1 < self.n_leaves:
                    further()
            behind *= 2
        self.encoded_chars += sum(len(p) for p, _ in fresh)
        unchanged = slice(len(stale_widths) if met is None else met, None)
        new_widths = widths[:kept] + [len(p) for p, _ in fresh] + stale_widths[unchanged]
        new_counts = counts[:kept] + [1 if added else self.bpe.counts[p] for p, added in fresh] + stale_counts[unchanged]
        for k in range(first + 1, leaf + 1):
            self._set(k, ("", [], []))
        self._set(first, (before[: at - base] + changed, new_widths, new_counts))
        if len(new_widths) > 16 * LEAF:
            chars = self.encoded_chars
            self.__init__(*self.stored(), self.bpe)
            self.encoded_chars = chars

    def _cut(self, text: str) -> Iterator[tuple[str, bool]]:
        for part, added in self.bpe.parts(text):
            if added is not None:
                yield part, True
            else:
                yield from ((p, False) for p in each_pretoken(part))


EDITS = "array<struct<start: bigint, end: bigint, replacement: string>>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    text, *lists = zip(*rows, strict=True) if rows else ((),) * 5
    ends = lambda x: pa.array(np.concatenate(([0], np.cumsum([len(v) for v in x]))).astype(np.int32))
    flat = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32))
    return [pa.array(text, pa.string()), *(pa.ListArray.from_arrays(ends(x), flat(x)) for x in lists)]


def build_trees(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text and the columns `keep`) -> doc_id, these columns and the stored tree of each row: text,
    widths, counts, chars, tokens. Null texts are empty. Each text is encoded once; write the result to keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = rows_of([t or "" for t in part.column(part.num_columns - 1).to_pylist()], bpe)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_columns(rows)], [*part.schema.names[:-1], "text", "widths", "counts", "chars", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), *keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", " + STORED
    return arrow_map(rows, run, schema)


def apply_edits(trees: DataFrame, path: str, new_trees: bool = False) -> DataFrame:
    """trees (doc_id, edits: array of (start, end, replacement) in code points, applied in order, and a stored tree)
    -> doc_id, n_tokens before, edited_tokens after all edits, and encoded_chars, how many characters were encoded;
    with new_trees also the stored tree of the edited text. Nothing else is encoded: counts come from the trees.

    Null replacements and edits are empty; null positions are 0; edits are cut to the text. Repeated rows and null
    ids are counted like others; an empty table gives no rows."""
    names = ["doc_id", "n_tokens", "edited_tokens", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                counts, rows = [], []
                for edits, text, *lists in zip(*part.columns[1:], strict=True):
                    widths, sizes, chars, tokens = (x.values.to_numpy() for x in lists)
                    tree = TokenTree(text.as_py(), widths, sizes, chars.tolist(), tokens.tolist(), bpe)
                    before = tree.count
                    for e in edits.as_py() or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    counts.append((before, tree.count, tree.encoded_chars))
                    if new_trees:
                        rows.append(tree.stored())
                numbers = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, *(_columns(rows) if new_trees else [])], names + (["text", "widths", "counts", "chars", "tokens"] if new_trees else []))

    rows = trees.select(F.col("doc_id").cast("long"), F.col("edits").cast(EDITS), "text", "widths", "counts", "chars", "tokens")
    return arrow_map(rows, run, "doc_id long, n_tokens long, edited_tokens long, encoded_chars long" + (", " + STORED if new_trees else ""))


def edited_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, edits) by way of stored trees: each text is encoded once, its tree is written, and edits
    are applied to the trees. Columns and odd inputs as in apply_edits."""
    short_batches(docs.sparkSession)
    return apply_edits(written(build_trees(docs, path, ("edits",)), "trees", compression="zstd"), path)


def with_sample_edits(docs: DataFrame) -> DataFrame:
    """documents with three edits each: a sentence put in at the middle, seven characters taken out at a quarter,
    and ten characters at three quarters replaced by the text's first twenty."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("bigint")
    edit = lambda at, width, text: F.struct(at.alias("start"), (at + width).alias("end"), text.alias("replacement"))
    edits = F.array(
        edit(F.floor(n / 2), 0, F.lit(" It's 42 new words,\n\nput in here. ")),
        edit(F.floor(n / 4), 7, F.lit("")),
        edit(F.floor(n * 3 / 4), 10, F.substring(F.coalesce("text", F.lit("")), 1, 20)),
    )
    return docs.select("doc_id", "text", edits.alias("edits"))
