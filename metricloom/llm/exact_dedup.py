"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition reduces its rows to one sorted run of distinct digests. The digest space has one owner
per slot (a power of two of them). In round r the slots that differ in bit r exchange the halves of their runs,
so that after log2(slots) binomial rounds every digest has reached its owner; at each level the arriving sorted
runs are merged and equal digests leave one entry, with the identifier that stays and the number of copies. A
hot group is one entry per run from the first level on, and no task ever holds more than its share of digests.

Entries merge only if SHA-256, length and an independent 64-bit check of the normalised text all agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, utf8_list, without_rows, written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RUN = "slot int, sha binary, size long, seal long, keep long, copies long"
_SCHEMA = pa.schema([("slot", pa.int32()), ("sha", pa.binary()), ("size", pa.int64()), ("seal", pa.int64()), ("keep", pa.int64()), ("copies", pa.int64())])


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, size, seal) of every row; texts with A-Z lower-cased, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.translate(LOWER) for t in utf8_list(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                ],
                ["id", "sha", "size", "seal"],
            )

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), run, "id long, sha binary, size long, seal long")


def _merged(rows: pa.Table) -> pa.Table:
    """Rows of equal (sha, size, seal) as one, in digest order."""
    return rows.group_by(["sha", "size", "seal"]).aggregate([("keep", "max"), ("copies", "sum")]).sort_by([("sha", "ascending"), ("size", "ascending"), ("seal", "ascending")])


def _entries(merged: pa.Table) -> pa.Table:
    return merged.rename_columns({"keep_max": "keep", "copies_sum": "copies"}).select(["sha", "size", "seal", "keep", "copies"])


def _owner(sha: pa.Array, slots: int) -> np.ndarray:
    head = pc.binary_slice(sha, 0, 4).cast(pa.binary(4))
    return (np.frombuffer(head.combine_chunks().buffers()[1] if isinstance(head, pa.ChunkedArray) else head.buffers()[1], ">u4")[-len(sha) :] % slots).astype(np.int64) if len(sha) else np.zeros(0, np.int64)


def _emit(table: pa.Table, slot: int, bits: tuple[int, int], slots: int) -> Iterator[pa.RecordBatch]:
    """A merged run with the slot of the next level: bits [lo, hi) of the present slot give way to the owner's."""
    table = table.combine_chunks()
    sha = table["sha"].combine_chunks() if table.num_rows else pa.array([], pa.binary())
    mask = (1 << bits[1]) - (1 << bits[0])
    to = (np.full(len(sha), slot) & ~mask) | (_owner(sha, slots) & mask)
    cols = [pa.array(to.astype(np.int32)), sha, *(table[c].combine_chunks() if table.num_rows else pa.array([], pa.int64()) for c in ("size", "seal", "keep_max", "copies_sum"))]
    yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def _local_run(slots: int, bits: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[pa.Table] = []  # each at least twice as long as the next, so that a row is merged log(n) times
        for b in batches:
            t = pa.table({"sha": b.column("sha"), "size": b.column("size"), "seal": b.column("seal"), "keep": b.column("id"), "copies": pa.array(np.ones(b.num_rows, np.int64))})
            while runs and runs[-1].num_rows < 2 * t.num_rows:
                t = _entries(_merged(pa.concat_tables([runs.pop(), t])))
            runs.append(t)
        if runs:
            yield from _emit(_merged(pa.concat_tables(runs)), TaskContext.get().partitionId() % slots, bits, slots)

    return run


def _merge_level(slots: int, bits: tuple[int, int]):
    """Merges the sorted stream of a slot batch by batch; the last digest is held back until the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            slot = b.column("slot")[0].as_py()
            t = pa.Table.from_batches([b]).select(["sha", "size", "seal", "keep", "copies"])
            t = _merged(t if held is None else pa.concat_tables([held, t]))
            held = _entries(t.slice(t.num_rows - 1))
            yield from _emit(t.slice(0, t.num_rows - 1), slot, bits, slots)
        if held is not None:
            yield from _emit(_merged(held), slot, bits, slots)

    return run


def merged_runs(digests: DataFrame, bits_per_round: int = 1) -> DataFrame:
    """One row per distinct text: (sha, size, seal, keep = largest id, copies). bits_per_round > 1 merges more
    runs per level in fewer rounds."""
    depth = max(0, round(np.log2(max(1, partitions(digests.sparkSession)))))
    slots = 1 << depth
    cuts = [(a, min(a + bits_per_round, depth)) for a in range(0, depth, bits_per_round)] + [(depth, depth)]
    runs = arrow_map(digests, _local_run(slots, cuts[0]), RUN)
    for bits in cuts[1:]:
        level = runs.repartitionById(slots, F.col("slot")).sortWithinPartitions("sha", "size", "seal")
        runs = arrow_map(level, _merge_level(slots, bits), RUN)
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, and the empty text is a text like
    any other. Of equal texts the row with the largest id stays. Repeated rows that share that id all stay; ids
    that are null never win, and a group of null ids only keeps them all (keep_id null). An empty table gives
    no rows; other columns are ignored.
    """
    digests = written(text_digests(docs, id_col, text_col), "digests")
    return digests.join(merged_runs(digests), ["sha", "size", "seal"]).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; columns unchanged, repeated rows of the id that stays remain."""
    gone = exact_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256)
    return without_rows(docs, gone, {"id": F.col("doc_id").cast("long"), "sha": sha})
