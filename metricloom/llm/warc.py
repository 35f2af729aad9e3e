"""Web archives (WARC 1.1) as a PySpark data source: spark.read.format("warc") and df.write.format("warc").

Writing: each task writes archives of bounded size, one gzip member a record, whose extra field "SL" holds the
member's compressed and full length. Files become visible through a manifest that the driver writes on commit,
so what failed or repeated tasks leave behind is never read.

Reading: each archive is a partition. Filters on record type and other header columns are pushed into the scan.
A record's header is parsed first; if a pushed filter rejects it, or payloads aren't wanted, its payload isn't
decoded: the scan jumps to the next member ("SL", or Content-Length in a plain file) or, in foreign gzip files
without lengths, inflates past it without keeping it.

Load the source anew (spark.read.format("warc").load(path)) for each set of filters: Spark 4.1 keeps what was pushed
into a loaded Python source, so one that was filtered once gives later queries, and other branches of the same
query, the filtered records only.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .common import open_fs, scratch

RECORD = (
    "file string, offset long, record_id string, record_type string, date string, target_uri string, "
    "refers_to string, payload_digest string, content_type string, content_length long, http_length long, payload binary"
)
#: The header fields of the format that become columns.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "date": "warc-date",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096
READ_BYTES = 1 << 20
HEAD_LIMIT = 1 << 20
DATE = "1970-01-01T00:00:00Z"


# ---- writing ---------------------------------------------------------------------------------------------------


def record_bytes(record_id: str, record_type: str, target_uri: str | None, date: str | None, refers_to: str | None, payload_digest: str | None, content_type: str, block: bytes) -> bytes:
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date or DATE),
        ("WARC-Target-URI", target_uri),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        ("WARC-Profile", IDENTICAL if record_type == "revisit" else None),
        ("WARC-Payload-Digest", payload_digest),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 1) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    extra = struct.pack("<2sHII", b"SL", 8, 12 + 12 + len(body) + 8, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def http_block(payload: bytes, length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows need record_id, record_type and payload; target_uri, date, refers_to, payload_digest and http_length
    (the full payload's length, for revisits) may be missing or null. A null payload is empty."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                rows = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                of = lambda name, k, rows=rows: rows[name][k].as_py() if name in rows else None
                for k in range(batch.num_rows):
                    payload = bytes(of("payload", k) or b"")
                    kind = of("record_type", k) or "resource"
                    http = kind in ("response", "revisit")
                    given = of("http_length", k)
                    block = http_block(payload, len(payload) if given is None else given) if http else payload
                    content = f"application/http; msgtype={'response' if http else 'request'}" if http else "application/octet-stream"
                    member = gzip_member(record_bytes(of("record_id", k) or f"urn:uuid:{uuid.uuid4()}", kind, of("target_uri", k), of("date", k), of("refers_to", k), of("payload_digest", k), content, block))
                    if out is None or size + len(member) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    out.write(member)
                    size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for name in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{root}/{name}")


# ---- reading ---------------------------------------------------------------------------------------------------


class _Window:
    """Random access to a file by way of one read-ahead buffer."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.buf = f, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        """n bytes from pos on, fewer at the end of the file."""
        n = max(0, min(n, self.size - pos))
        if pos < self.base or pos + n > self.base + len(self.buf):
            self.f.seek(pos)
            self.base, self.buf = pos, self.f.read(max(n, READ_BYTES))
        return self.buf[pos - self.base : pos - self.base + n]


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields and the length of the header, if it is whole."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
            continue
        last, _, value = line.partition(":")
        last = last.strip().lower()
        fields[last] = value.strip()
    return fields, end + 4


def _columns(fields: dict[str, str]) -> dict:
    row = {c: fields.get(h) for c, h in FIELDS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c] and row[c].strip("<>")
    row["content_length"] = int(fields.get("content-length", "0"))
    return row


def _payload(row: dict, block: bytes) -> tuple[int | None, bytes]:
    """The HTTP Content-Length, and the block without HTTP headers."""
    if not (row["content_type"] or "").startswith("application/http"):
        return None, block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, block
    length = next((x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    return int(length) if length else None, body


def records(f, size: int, gz: bool, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    """The wanted records of an archive in order."""
    w, pos = _Window(f, size), 0
    while pos < size:
        if gz:
            start = w.get(pos, 24)
            if start[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at byte {pos}")
            known = struct.unpack_from("<I", start, 16)[0] if len(start) == 24 and start[3] & 4 and start[12:14] == b"SL" else None
            z, at, data, found = zlib.decompressobj(31), pos, b"", None
            while found is None and not z.eof and (z.unconsumed_tail or at < size) and len(data) < HEAD_LIMIT:
                chunk = z.unconsumed_tail or w.get(at, 4096 if known is None else min(known, 4096))
                at += 0 if z.unconsumed_tail else len(chunk)
                data += z.decompress(chunk, 2048)
                found = _head(data)
            if found is None:
                raise ValueError(f"no record header at byte {pos}")
            fields, head = found
            row = _columns(fields)
            keep = wanted(row)
            if keep and payload or known is None:
                parts = [data]
                while not z.eof:
                    chunk = z.unconsumed_tail or w.get(at, 1 << 16)
                    if not chunk:
                        raise ValueError(f"the member at byte {pos} is cut short")
                    at += 0 if z.unconsumed_tail else len(chunk)
                    part = z.decompress(chunk, 1 << 20)
                    if keep and payload:
                        parts.append(part)
                data = b"".join(parts)
                after = at - len(z.unused_data)
            else:
                after = pos + known
            block = data[head : head + row["content_length"]]
        else:
            n = 4096
            while (found := _head(data := w.get(pos, n))) is None:
                if n >= HEAD_LIMIT or pos + n >= size:
                    raise ValueError(f"no record header at byte {pos}")
                n *= 4
            fields, head = found
            row = _columns(fields)
            keep = wanted(row)
            block = w.get(pos + head, row["content_length"]) if keep and payload else data[head:]
            after = pos + head + row["content_length"] + 4
        if keep:
            http, body = _payload(row, block)
            yield row | {"offset": pos, "http_length": http, "payload": body if payload else None}
        pos = after


def _test(f: ds.Filter) -> Callable[[dict], bool] | None:
    """The filter as a test of a record's header columns, if it can be decided from the header."""
    if isinstance(f, ds.Not):
        inner = f.child
        test = _test(inner)
        if test is None or isinstance(inner, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)):
            return test and (lambda r: not test(r))
        name = inner.attribute[0]
        return lambda r: r[name] is not None and not test(r)  # SQL: neither it nor its opposite holds for null
    if len(f.attribute) != 1 or f.attribute[0] not in (*FIELDS, "content_length"):
        return None
    name, value = f.attribute[0], getattr(f, "value", None)
    present = lambda test: lambda r: r[name] is not None and test(r[name])
    match f:
        case ds.EqualTo():
            return present(lambda x: x == value)
        case ds.EqualNullSafe():
            return lambda r: r[name] == value
        case ds.In():
            return present(lambda x: x in f.value)
        case ds.IsNull():
            return lambda r: r[name] is None
        case ds.IsNotNull():
            return lambda r: r[name] is not None
        case ds.StringStartsWith():
            return present(lambda x: x.startswith(value))
        case ds.StringEndsWith():
            return present(lambda x: x.endswith(value))
        case ds.StringContains():
            return present(lambda x: value in x)
        case ds.GreaterThan() if name == "content_length":
            return present(lambda x: x > value)
        case ds.GreaterThanOrEqual() if name == "content_length":
            return present(lambda x: x >= value)
        case ds.LessThan() if name == "content_length":
            return present(lambda x: x < value)
        case ds.LessThanOrEqual() if name == "content_length":
            return present(lambda x: x <= value)
    return None


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[ds.InputPartition]:
        fs, root = open_fs(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [ds.InputPartition(root)]
        found = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file}
        manifests = [n for n in found if n.startswith("_manifest-")]
        if manifests:
            names = [x for m in manifests for x in json.loads(fs.open_input_file(f"{root}/{m}").read())]
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        return [ds.InputPartition(f"{root}/{n}") for n in sorted(names, key=lambda n: -found[n].size)] or [ds.InputPartition("")]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        fs, _ = open_fs(self.path)
        tests = [_test(f) for f in self.filters]
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])
        rows, held = [], 0
        with fs.open_input_file(partition.value) as f:
            for row in records(f, f.size(), partition.value.endswith(".gz"), lambda r: all(t(r) for t in tests), self.payload):
                rows.append(row | {"file": partition.value})
                held += len(row["payload"] or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(ds.DataSource):
    """Options: path (a file or folder, local or any URI that pyarrow opens); payload ("false": headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


# ---- pages -----------------------------------------------------------------------------------------------------

REVISIT_BYTES = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """A record per page (page_id, url, html). Null html is an empty payload. Of pages with equal payloads of at
    least REVISIT_BYTES bytes, those with the largest page_id are responses and the others revisits of it; null
    ids never win, and where all ids are null, all are responses."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", payload.alias("payload"))
    pages = pages.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload"), "seal": F.xxhash64("payload")})
    # pages that can't be revisits have keys of their own, so that equal small ones don't meet in one task
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    pages = pages.withColumn("match", F.when(F.col("bytes") >= REVISIT_BYTES, F.col("sha")).otherwise(alone))
    key = ["match", "bytes", "seal"]
    winners = pages.where(F.col("bytes") >= REVISIT_BYTES).groupBy(key).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(winners, key, "left").select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("sha")).alias("payload_digest"),
        F.col("bytes").alias("http_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str) -> None:
    """Writes a record per page to archives under path."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each page record under path, a row
    a record whatever ids repeat, and whether it is intact: a response's digest is computed from its payload and held
    against the one it names (null for revisits and for digests that aren't in hexadecimal). A revisit has its payload's length and digest in its own header, and stays whether or
    not its response is in these archives; unresolved() finds those whose isn't."""
    register(spark)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    found = spark.read.format("warc").load(path).where("record_type IN ('response', 'revisit')")
    revisit = F.col("record_type") == "revisit"
    own = F.sha1(F.coalesce("payload", F.lit(b"")))
    said = F.regexp_replace("payload_digest", "^sha1:", "")
    return found.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")).alias("payload_bytes"),
        F.when(revisit, said).otherwise(own).alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
        F.when(~revisit & said.rlike("^[0-9a-f]{40}$"), said == own).alias("intact"),
    )


def unresolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, refers_to and payload_digest of the revisits under path whose response, of that page_id and digest,
    isn't there. Reads headers only. (A loaded source keeps the filters pushed into it: each side loads its own.)"""
    register(spark)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    headers = lambda kind: spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == kind)
    held = headers("response").select(page("record_id").alias("refers_to"), "payload_digest").distinct()
    return headers("revisit").select(page("record_id").alias("page_id"), page("refers_to").alias("refers_to"), "payload_digest").join(held, ["refers_to", "payload_digest"], "left_anti").select("page_id", "refers_to", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"))


def pages_by_way_of_archives(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    archive_pages(pages, path)
    return read_pages(pages.sparkSession, path)
