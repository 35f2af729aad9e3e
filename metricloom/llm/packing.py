"""Packing into batches of a token budget within optimal length buckets.

Bucket boundaries come from a dynamic programme over the histogram of all lengths: of all ways to cut the lengths
into at most `buckets` ranges, the one with the least padding when every document is padded to its range's longest.
The cost of a range obeys the quadrangle inequality, so each layer is solved by divide and conquer. Inside a bucket
documents are numbered by length and id, and each run of floor(budget / boundary) of them is a batch.

Numbers are dealt without any bucket in one task: rows are dealt by ranges of (bucket, length, id), numbered within
each range, and shifted by the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, short_batches, written
from .token_files import GROUP, load

BUCKETS = 16
BUDGET = 65_536


def word_count(text):
    """Words between white space; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most `buckets` ranges of lengths (ascending, distinct) with the least padding."""
    m = len(lengths)
    if m <= buckets:
        return lengths.tolist()
    docs = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    tokens = np.concatenate(([0], np.cumsum(counts * lengths))).astype(np.float64)
    best = lengths * docs[1:] - tokens[1:]  # padding of the first j + 1 lengths in one range
    cuts = []
    for _ in range(buckets - 1):
        new, cut = np.empty(m), np.zeros(m, np.int64)
        new[0], todo = 0.0, [(1, m - 1, 0, m - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)  # the last length of the ranges before
            cost = best[i] + lengths[j] * (docs[j + 1] - docs[i + 1]) - (tokens[j + 1] - tokens[i + 1])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        best = new
        cuts.append(cut)
    ends, j = [m - 1], m - 1
    for cut in reversed(cuts):
        if j == 0:
            break
        j = int(cut[j])
        ends.append(j)
    return lengths[sorted(set(ends))].tolist()


def boundaries(lengths: DataFrame, column: str, buckets: int = BUCKETS) -> list[int]:
    """Optimal boundaries over the histogram of all rows (null counts as 0): one row for each length there is, which
    is what the driver gets, whatever the number of documents."""
    rows = lengths.select(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("n")).groupBy("n").count().orderBy("n").toPandas()
    return optimal_boundaries(rows["n"].to_numpy(np.int64), rows["count"].to_numpy(np.int64), buckets) if len(rows) else []


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range and each row's number among its range's rows of the bucket; rows come sorted by bucket."""
    bucket, count, part = None, 0, TaskContext.get().partitionId()
    for b in batches:
        own = b.column(2).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, int)
        number = np.arange(len(own), dtype=np.int64)
        for at, end in zip(edges.tolist(), [*edges[1:].tolist(), len(own)], strict=True):
            if own[at] != bucket:
                bucket, count = own[at], 0
            number[at:end] += count - at
            count += end - at
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(number)], ["doc_id", "n_tokens", "bucket", "part", "number"])


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """lengths (doc_id, n_tokens) -> one row per row: doc_id, n_tokens, bucket (0 is the shortest), bucket_tokens
    (the length padded to), batch (number within the bucket) and slot (place within the batch).

    Null lengths count as 0; a document longer than the budget is a batch of its own. Repeated rows and null ids
    are packed like others; an empty table gives no rows; other columns are ignored."""
    spark = lengths.sparkSession
    rows = written(lengths.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    ends = boundaries(rows, "n_tokens", buckets)
    rows = rows.withColumn("bucket", F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e < F.col("n_tokens"))) if ends else F.lit(0))
    dealt = rows.repartitionByRange(partitions(spark), "bucket", "n_tokens", "doc_id").sortWithinPartitions("bucket", "n_tokens", "doc_id")
    numbered = written(arrow_map(dealt, _numbered, "doc_id long, n_tokens long, bucket int, part int, number long"), "numbered")
    counts = numbered.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("bucket", "part", before.alias("before"))  # at most a row for each bucket and task
    padded = F.get(F.array(*(F.lit(e).cast("long") for e in ends)), F.col("bucket")) if ends else F.lit(0).cast("long")
    out = numbered.join(F.broadcast(shifts), ["bucket", "part"]).withColumn("bucket_tokens", padded)
    place, size = F.col("before") + F.col("number"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    return out.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(place / size).cast("long").alias("batch"), (place % size).cast("long").alias("slot"))


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """pack() of documents by their number of words (null text: 0); any column of token counts packs the same way."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), buckets, budget)


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of every row: how many ids the tokenizer at that path gives the whole text, without marks
    of its own around it. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)  # once a worker: reading the file takes three times the memory of what is read
        encoder.forget()
        for b in batches:
            counts: list[int] = []
            for lo in range(0, b.num_rows, GROUP):
                texts = [t or "" for t in b.column(1).slice(lo, GROUP).to_pylist()]
                counts += encoder.counts(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])
        encoder.forget()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long")


def pack_tokens(docs: DataFrame, tokenizer: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """pack() of documents by their number of tokens."""
    short_batches(docs.sparkSession)
    return pack(token_counts(docs, tokenizer), buckets, budget)
