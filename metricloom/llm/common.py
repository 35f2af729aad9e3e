"""Helpers shared by the operators: the shared scratch folder, written tables and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
FILTER_BUCKETS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Only where driver and executors are one
    process and it is unset, as in tests, it is a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="metricloom-"))
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: all that was made of them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without_rows(docs: DataFrame, dropped: DataFrame, on: dict[str, Column]) -> DataFrame:
    """docs without the rows whose values `on` are a row of dropped (nulls equal nulls); columns unchanged. A table of
    at most FILTER_BUCKETS hash buckets, which tasks get, keeps most rows out of the join, so their texts aren't
    shuffled."""
    dropped = written(dropped.select(*on).distinct(), "dropped")
    bucket = F.pmod(F.xxhash64(*on), F.lit(FILTER_BUCKETS)).alias("bucket")
    buckets = F.broadcast(dropped.select(bucket).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in on.items())).select("row", *on, bucket)
    some, other = rows.join(buckets, "bucket", "left_semi"), rows.join(buckets, "bucket", "left_anti")
    gone = dropped.select(*(F.col(n).alias(f"gone_{n}") for n in on))
    same = functools.reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"gone_{n}")) for n in on))
    return other.select("row.*").unionByName(some.join(gone, same, "left_anti").select("row.*"))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _trim() -> None:
    """Gives memory that is free back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(fn, schema), after which the worker trims its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # the one that _trim() can give back
        try:
            yield from fn(batches)
        finally:
            _trim()

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of named arrays (numpy arrays, lists or Arrow arrays)."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def utf8_list(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession, rows: int = 400, size: int = 4 << 20) -> None:
    """Lets Arrow batches have at most so many rows and about so many bytes in this session, unless it has settings of
    its own: texts and packed lists are long, and a batch is held by the JVM (outside its heap) and by Python at once."""
    for name, usual, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
