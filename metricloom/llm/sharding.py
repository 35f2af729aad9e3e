"""Resharding by minimum-cost flow: shards of new capacities are made of old ones by moving the fewest bytes.

A sharded table is a manifest of Parquet files (the blocks), each in one shard, with rows and bytes. From the old
shards' sizes and the new shards' capacities a minimum-cost flow decides how many bytes each old shard sends to each
new one; keeping bytes in place is free. Every old shard's blocks are laid out in a row, and the flows are intervals
of it: a block inside one interval stays, untouched, or moves whole, as a copy of its file; only blocks that a border
crosses, at most as many as there are flows, are rewritten. Rows of these are dealt largest first to the shard
that still lacks most of its share, so shards come within a small row's size of their capacities.

The flow problem has a node a shard, whatever the size of the data; sums over blocks are windows within old shards
over the manifest alone, and texts are read and written only where they move.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, open_fs, partitions, scratch, written

OLD_SHARDS, NEW_SHARDS = 7, 8
COPY_BYTES = 4 << 20
ROUNDS, LEVEL = 3, 1e-3
ROW = "doc_id long, text string, size long"
MANIFEST = "shard int, file string, rows long, bytes long"


# ---- flow ------------------------------------------------------------------------------------------------------


def min_cost_flow(supplies: Mapping[int, int], capacities: Mapping[int, int], cost: Callable[[int, int], float] = lambda old, new: float(old != new)) -> dict[tuple[int, int], int]:
    """How much each old shard sends to each new one, {(old, new): amount > 0}, at the least total cost, when all
    supplies are dealt and no capacity is exceeded. cost(old, new) is that of one byte, 0 or more.

    Successive shortest paths: from the source, by way of old shards that still hold something, Dijkstra's shortest
    path (with potentials, so that no arc's reduced cost is negative) leads over new shards with room to the sink,
    also along flows that it takes back; each path carries as much as it can. There is a node a shard."""
    olds, news = sorted(supplies), sorted(capacities)
    if sum(supplies.values()) > sum(capacities.values()):
        raise ValueError("the capacities are less than what there is")
    m, n = len(olds), len(olds) + len(news)
    source, sink = n, n + 1
    room, price = np.zeros((n + 2, n + 2), np.int64), np.zeros((n + 2, n + 2))
    for i, old in enumerate(olds):
        room[source, i] = supplies[old]
        for j, new in enumerate(news, m):
            room[i, j], price[i, j] = supplies[old], cost(old, new)
            price[j, i] = -price[i, j]
    for j, new in enumerate(news, m):
        room[j, sink] = capacities[new]
    height = np.zeros(n + 2)
    while room[source].any():
        far, before, done = np.full(n + 2, np.inf), np.full(n + 2, -1), np.zeros(n + 2, bool)
        far[source] = 0
        while np.isfinite(reach := np.where(done, np.inf, far)).any():
            at = int(reach.argmin())
            done[at] = True
            through = far[at] + np.maximum(price[at] + height[at] - height, 0)
            better = (room[at] > 0) & ~done & (through < far)
            far[better], before[better] = through[better], at
        height += np.where(done, far, far[done].max())
        path = [sink]
        while path[-1] != source:
            path.append(int(before[path[-1]]))
        arcs = list(zip(path[1:], path, strict=False))
        amount = min(int(room[a]) for a in arcs)
        for a, b in arcs:
            room[a, b] -= amount
            room[b, a] += amount
    return {(old, new): int(room[j, i]) for i, old in enumerate(olds) for j, new in enumerate(news, m) if room[j, i]}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    """The total in shards 0 to shards - 1, a byte apart at most."""
    return {k: total // shards + (k < total % shards) for k in range(shards)}


# ---- files -----------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The rows of the files in folders under path, with the file (from path on) and their place in it."""
    found = spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(*(f"{path}/{x}" for x in folders))
    name = F.regexp_extract("_metadata.file_path", r"([^/]+/shard=[0-9]+/[^/]+)$", 1)
    return found.select(*(F.col(c) for c in found.columns), name.alias("file"), F.col("_metadata.row_index").alias("row_index"))


def _listed(rows: DataFrame) -> DataFrame:
    """A manifest of files; reads their sizes only."""
    shard = F.regexp_extract("file", "/shard=([0-9]+)/", 1).cast("int")
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).select(shard.alias("shard"), "file", "rows", "bytes")


def write_shards(docs: DataFrame, path: str, shards: int = OLD_SHARDS) -> DataFrame:
    """Writes doc_id and text of every row into shards 0 to shards - 1 under path, by a hash of doc_id, and returns the
    manifest (shard, file, rows, bytes). A row's size is its text's UTF-8 bytes (null: none) plus 1. Each task writes
    a file a shard, so nothing is shuffled, whatever ids repeat. Other columns aren't kept."""
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), size)
    rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(f"{path}/first")
    return written(_listed(_rows(docs.sparkSession, path, ["first"])), "manifest")


def _intervals(flows: Mapping[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, begin, end) on each old shard's bytes: what stays comes first."""
    out, at = [], {}
    for old, new in sorted(flows, key=lambda a: (a[0], a[0] != a[1], a[1])):
        begin = at.get(old, 0)
        at[old] = begin + flows[old, new]
        out.append((old, new, begin, at[old]))
    return out


def _copied(files: DataFrame, path: str) -> DataFrame:
    """Files (file, new, rows, bytes) copied into a folder of their new shards, byte by byte, in parallel."""
    folder = f"moved-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        for b in batches:
            for file, new, rows, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs.create_dir(f"{root}/{folder}/shard={new}", recursive=True)
                name = f"{folder}/shard={new}/{uuid.uuid4().hex}.parquet"
                with fs.open_input_stream(f"{root}/{file}", compression=None) as f, fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    while part := f.read(COPY_BYTES):
                        out.write(part)
                yield pa.RecordBatch.from_pylist([{"shard": new, "file": name, "rows": rows, "bytes": size}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())]))

    return arrow_map(files.select("file", "new", "rows", "bytes").repartition(partitions(files.sparkSession), "file"), run, MANIFEST)


def _split(spark: SparkSession, path: str, needs: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """The manifest of rewritten files: rows of each file in needs are dealt, largest first, to the shard that lacks
    most of the bytes it is to get from this file. needs has as many files as there are flows at most."""
    folder = f"split-{uuid.uuid4().hex}"

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = [(-need, new) for new, need in needs[pdf["file"].iloc[0]]]
        heapq.heapify(heap)
        pdf = pdf.sort_values(["size", "row_index"], ascending=[False, True])
        dealt = []
        for size in pdf["size"].tolist():
            lacks, new = heap[0]
            dealt.append(new)
            heapq.heapreplace(heap, (lacks + size, new))
        return pdf[["file", "row_index"]].assign(shard=dealt)

    rows = _rows(spark, path, sorted(needs))
    where = rows.select("file", "row_index", "size").groupBy("file").applyInPandas(deal, "file string, row_index long, shard int")
    rows.join(where, ["file", "row_index"]).select("file", "doc_id", "text", "size", "shard").repartition(partitions(spark), "file", "shard").drop("file").write.partitionBy("shard").parquet(f"{path}/{folder}")
    return _listed(_rows(spark, path, [folder]))


def reshard(spark: SparkSession, path: str, manifest: DataFrame, shards: int = NEW_SHARDS, capacities: Mapping[int, int] | None = None, cost: Callable[[int, int], float] | None = None) -> DataFrame:
    """The manifest of shards with the given capacities (by default equal ones, 0 to shards - 1) that is reached from
    the given manifest of files under path at the least cost of moved bytes. Files that stay aren't touched, files
    that move whole are copied, and those that a border crosses rewritten; the given manifest stays readable."""
    for again in range(ROUNDS):
        old = {r["shard"]: r["bytes"] for r in manifest.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
        new = dict(capacities) if capacities is not None else equal_capacities(sum(old.values()), shards)
        flows = min_cost_flow(old, new, cost) if cost else min_cost_flow(old, new)
        if again and sum(n for (i, j), n in flows.items() if i != j) <= LEVEL * sum(old.values()) / max(len(new), 1):
            break
        manifest = _moved(spark, path, manifest, flows)
    return manifest


def _moved(spark: SparkSession, path: str, manifest: DataFrame, flows: Mapping[tuple[int, int], int]) -> DataFrame:
    """The manifest after flows of bytes between shards."""
    arcs = spark.createDataFrame(_intervals(flows), "shard int, new int, begin long, end long")
    # over the manifest alone; blocks of long rows come first, where they stay, and those of short ones at the borders
    end = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc(F.col("bytes") / F.col("rows")), "file"))
    blocks = manifest.withColumn("hi", end).withColumn("lo", F.col("hi") - F.col("bytes"))
    met = blocks.join(F.broadcast(arcs), "shard").where("lo < end AND hi > begin")  # arcs: a row a flow
    need = (F.least("hi", "end") - F.greatest("lo", "begin")).alias("need")
    fates = written(met.groupBy("shard", "file", "rows", "bytes").agg(F.collect_list(F.struct("new", need)).alias("parts")), "fates")
    whole = fates.where("size(parts) = 1").withColumn("new", F.col("parts")[0]["new"])
    out = whole.where("new = shard").select("shard", "file", "rows", "bytes").unionByName(_copied(whole.where("new <> shard"), path))
    needs = {r["file"]: [(p["new"], p["need"]) for p in r["parts"]] for r in fates.where("size(parts) > 1").collect()}  # a file a border
    if needs:
        out = out.unionByName(_split(spark, path, needs))
    return written(out, "manifest")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, size, shard, slot (gapless from 0 in each shard) and the given columns of text (by default the text) of
    every row in the manifest's files. Only these columns meet the manifest, which Spark broadcasts if it is small."""
    folders = [r[0] for r in manifest.select(F.substring_index("file", "/", 1)).distinct().collect()]  # three a resharding at most
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("file")) - F.col("rows")
    at = manifest.select("file", "shard", before.alias("before"))
    if not folders:
        return at.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"), "shard", "before", *(F.lit(None).cast("string").alias(c) for c in columns or ["text"])).withColumnRenamed("before", "slot")
    rows = _rows(spark, path, folders).select("file", "row_index", "doc_id", "size", *(c.alias(n) for n, c in (columns or {"text": F.col("text")}).items()))
    return rows.join(at, "file").select("doc_id", "size", "shard", (F.col("before") + F.col("row_index")).alias("slot"), *(columns or ["text"]))


def resharded(docs: DataFrame, old: int = OLD_SHARDS, new: int = NEW_SHARDS) -> DataFrame:
    """docs (doc_id, text) in `old` shards by a hash of doc_id, then in `new` shards of near equal bytes, as read back
    from their files: doc_id, size, text_crc32 (of the text's UTF-8 bytes, null: none), law, shard, slot and grown_shard,
    which this law leaves null. Every row has a place, whatever ids or texts repeat or are null; equal rows may lie in
    different shards. An empty table gives no rows."""
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    manifest = reshard(spark, path, write_shards(docs, path, old), new)
    rows = read_shards(spark, path, manifest, {"text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    return rows.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
