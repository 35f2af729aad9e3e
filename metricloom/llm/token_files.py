"""Token files: independent zstandard frames with a document index, a trailing seek table and a checksum per frame.

Layout of a file: frames of about FRAME_BYTES bytes of little-endian token ids (2 bytes each if the vocabulary
allows it, else 4); a skippable frame with the index (doc_id and token count of each document in order); the
seek table of the public zstandard seekable format, with the low 32 bits of XXH64 of each frame's content. A
reader takes the table from the end of the file and decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, open_fs, partitions, scratch, short_batches, written

FRAME_BYTES = 1 << 20
LEVEL = 3
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CACHE_WORDS, COUNTED_WORDS = 600_000, 200_000
GROUP = 64
BATCH_BYTES = 4 << 20
FILE_TOKENS, FILE_DOCS = 64 << 20, 1 << 20
MANIFEST = "part int, piece int, file string, docs long, tokens long, least long, most long"
#: What a tokenizer file must say of normalisation and pre-tokens for WordEncoder's own splitting.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class TokenFileWriter:
    def __init__(self, out, width: int):
        self.out, self.kind, self.width = out, np.dtype(f"<u{width}"), width
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.parts: list[bytes] = []
        self.held = self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.tokens += len(ids)
        if len(ids) and int(ids.max()) >= 1 << 8 * self.width:
            raise ValueError(f"token id {int(ids.max())} does not fit into {self.width} bytes")
        data = ids.astype(self.kind).tobytes()
        for lo in range(0, len(data), FRAME_BYTES):
            part = data[lo : lo + FRAME_BYTES]
            if self.held + len(part) > FRAME_BYTES:
                self._frame()
            self.parts.append(part)
            self.held += len(part)

    def _frame(self) -> None:
        if self.held:
            data = b"".join(self.parts)
            packed = self.zstd.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self._frame()
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        index = struct.pack("<BQ", self.width, len(ids)) + known.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes()
        index = struct.pack("<Q", xxhash.xxh64_intdigest(index)) + self.zstd.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()


class TokenFile:
    """Random access to an open token file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_END or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        f.seek(size - 17 - 12 * count)
        head = f.read(8 + 12 * count)
        if struct.unpack_from("<II", head) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(head, "<u4", offset=8).reshape(count, 3)
        self.packed = np.concatenate(([0], np.cumsum(self.table[:, 0].astype(np.int64))))
        self.plain = np.concatenate(([0], np.cumsum(self.table[:, 1].astype(np.int64))))
        self.zstd = zstandard.ZstdDecompressor()
        at = int(self.packed[-1])
        f.seek(at)
        raw = f.read(size - 17 - 12 * count - at)
        seal = struct.unpack_from("<Q", raw, 8)[0]
        index = self.zstd.decompress(raw[16:])
        if xxhash.xxh64_intdigest(index) != seal:
            raise ValueError("the index is damaged")
        width, n = struct.unpack_from("<BQ", index)
        self.kind = np.dtype(f"<u{width}")
        self.known = np.frombuffer(index, np.uint8, n, 9)
        self.doc_ids = np.frombuffer(index, "<i8", n, 9 + n)
        self.counts = np.frombuffer(index, "<i8", n, 9 + 9 * n)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.f.seek(int(self.packed[k]))
            data = self.zstd.decompress(self.f.read(int(self.table[k, 0])), int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, data)
        return self.last[1]

    def ids(self, k: int) -> np.ndarray:
        """The token ids of the k-th document."""
        lo, hi = int(self.starts[k]) * self.kind.itemsize, int(self.starts[k + 1]) * self.kind.itemsize
        parts = []
        for n in range(int(np.searchsorted(self.plain, lo, "right")) - 1, len(self.table)):
            if self.plain[n] >= hi:
                break
            base = int(self.plain[n])
            parts.append(self.frame(n)[max(0, lo - base) : hi - base])
        return np.frombuffer(b"".join(parts), self.kind)


# ---- encoding --------------------------------------------------------------------------------------------------


class WordEncoder:
    """Whole texts to little-endian uint32 ids, as the tokenizers library encodes them.

    The library encodes each pre-token on its own, so for texts whose normalisation is plain (below U+0250 before
    and after lower-casing, where it is lower-casing and white space) words are looked up, and the library encodes
    unknown ones only, many together with spaces between. All other texts go to the library whole, and so does
    every text if the tokenizer file normalises or splits in another way (NORMALIZER, PRE_TOKENIZER) or has added
    tokens that don't begin with "<|".
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = lambda part: part and json.loads(part.__getstate__())
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.own = rules(self.tokenizer.normalizer) == NORMALIZER and rules(self.tokenizer.pre_tokenizer) == PRE_TOKENIZER and all(t.content.startswith("<|") and not t.normalized for t in added)
        low = [chr(c) for c in range(0x250)]
        letters = "".join(c for c in low if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in low if unicodedata.category(c)[0] == "N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t\n\x0b\x0c\r \x85\xa0{letters}{numbers}]+").findall
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+").findall
        plain = "".join(c for c in low if max(map(ord, c.lower())) < 0x250)
        self.wide = re.compile(f"[^{re.escape(plain)}]").search
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        self.old_sizes: dict[str, int] = {}

    def _unknown(self, words: set[str], known: dict, old: dict) -> list[str]:
        """The words that neither generation has; those of the older one move up."""
        missing = []
        for w in words:
            if (found := old.get(w)) is not None:
                known[w] = found
            else:
                missing.append(w)
        return missing

    def _encoded(self, missing: list[str]) -> tuple[bytes, list[int]]:
        """The ids of words and where each word's begin and end, in bytes."""
        e = self.tokenizer.encode(" ".join(missing), add_special_tokens=False)
        of = np.array(e.word_ids, np.int64)
        cut = np.flatnonzero(of[1:] != of[:-1]) + 1
        if len(cut) + 1 != len(missing):
            raise ValueError("words and pre-tokens differ")
        ids = np.array(e.ids, "<u4").tobytes()
        return ids, [0, *(4 * cut).tolist(), len(ids)]

    def _parts(self, texts: list[str]) -> tuple[list[bytes | list[str]], set[str]]:
        """Of each text its words or, if it isn't plain, its ids; and all words."""
        out: list[bytes | list[str]] = []
        seen: set[str] = set()
        for text in texts:
            plain = text.isascii()
            if not self.own or "<|" in text or not plain and self.wide(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append((self.ascii_words if plain else self.words)(text.lower()))
                seen.update(out[-1])
        return out, seen

    def forget(self) -> None:
        """Gives up the counts of words."""
        self.sizes, self.old_sizes = {}, {}

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text has. Only counts of words are kept."""
        out, seen = self._parts(texts)
        if len(self.sizes) >= COUNTED_WORDS:
            self.sizes, self.old_sizes = {}, self.sizes
        if missing := self._unknown(seen.difference(self.sizes), self.sizes, self.old_sizes):
            _, edges = self._encoded(missing)
            self.sizes.update((w, (hi - lo) // 4) for w, lo, hi in zip(missing, edges, edges[1:]))
        get = self.sizes.__getitem__
        return [len(x) // 4 if isinstance(x, bytes) else sum(map(get, x)) for x in out]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, seen = self._parts(texts)
        if len(self.cache) >= CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        if missing := self._unknown(seen.difference(self.cache), self.cache, self.old):
            ids, edges = self._encoded(missing)
            self.cache.update((w, ids[lo:hi]) for w, lo, hi in zip(missing, edges, edges[1:]))
        get = self.cache.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(get, x)) for x in out]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- Spark -----------------------------------------------------------------------------------------------------


def id_width(tokenizer: str, end_id: int | None) -> int:
    """Bytes that each id of a vocabulary, or the id that ends documents, needs."""
    most = max(load(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values())
    return 2 if max(most, end_id or 0) < 1 << 16 else 4


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2) -> DataFrame:
    """Writes the ids of all documents under path in ascending doc_id order (nulls first, ties by a hash of the text,
    by which rows of one id are dealt as well), a file for at most FILE_TOKENS ids and FILE_DOCS documents of a range
    (a longer document has a file of its own), and returns the manifest: part, piece, file, docs, tokens, least and
    most doc_id. Null texts are empty; each document ends with end_id. Only files in the manifest count, whatever
    failed tasks leave behind."""
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    short_batches(docs.sparkSession)
    width = id_width(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        encoder, out, name, piece = load(tokenizer), None, "", 0
        end = b"" if end_id is None else struct.pack("<I", end_id)

        def closed() -> pa.RecordBatch:
            out.close()
            known = [i for i in out.ids if i is not None]
            ends = (pa.array([f(known, default=None)], pa.int64()) for f in (min, max))
            return batch(part=pa.array([TaskContext.get().partitionId()], pa.int32()), piece=pa.array([piece], pa.int32()), file=[name], docs=[len(out.counts)], tokens=[out.tokens], least=next(ends), most=next(ends))

        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                keys, texts = (c.to_pylist() for c in b.slice(lo, GROUP).columns)
                for key, ids in zip(keys, encoder.encode_all([t or "" for t in texts]), strict=True):
                    ids = np.frombuffer(ids + end, "<u4")
                    if out is not None and (out.tokens + len(ids) > FILE_TOKENS or len(out.ids) >= FILE_DOCS):
                        yield closed()
                        out, piece = None, piece + 1
                    if out is None:
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids.zst"
                        out = TokenFileWriter(fs.open_output_stream(f"{root}/{name}", compression=None), width)
                    out.add(key, ids)
        if out is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    manifest = written(rows.mapInArrow(run, MANIFEST), "manifest")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian uint32) of the documents under
    path; with doc_ids only of those: files without any are not opened, and frames without any not decompressed."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = F.sum("tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"), "least", "most")
    if doc_ids is not None:
        ids = F.array(*(F.lit(int(i)) for i in sorted(doc_ids))).cast("array<bigint>")
        files = files.where(F.exists(ids, lambda i: i.between(F.col("least"), F.col("most"))))
    files = files.select("file", "base")
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    t = TokenFile(f, f.size())
                    chosen = np.arange(len(t.counts)) if wanted is None else np.flatnonzero(np.isin(t.doc_ids, wanted) & (t.known == 1))
                    rows, held = [], 0
                    for n, k in enumerate(chosen.tolist()):
                        ids = t.ids(k).astype("<u4").tobytes()
                        rows.append((int(t.doc_ids[k]) if t.known[k] else None, base + int(t.starts[k]), int(t.counts[k]), ids))
                        held += len(ids)
                        if held >= BATCH_BYTES or n == len(chosen) - 1:
                            keys, starts, counts, values = zip(*rows, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                            rows, held = [], 0

    return files.repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read back from files."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path)
    return read_token_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
