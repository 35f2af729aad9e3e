"""The trie of conversation prefixes, by an LCP-aware external mergesort.

A conversation is a path of turns, each a 16-byte digest of (role, text) and the text's length, so texts aren't
shuffled. Equal paths become one row first: their conversations are dealt by ranges of (path, conv_id), so that a
path that a third of all conversations share is spread over many tasks, each of which joins a stretch of ids.

Distinct paths are dealt by ranges of paths. A task sorts stretches of bounded size into runs, each path with the
number of leading turns that it shares with the one before (its LCP); all runs but the last go to the shared folder.
A loser tree merges them: of two heads the one that shares more with the last path out comes first, and only where
they share equally many are turns compared, from the first that may differ on. The merged stream with its LCPs feeds a
stack of open nodes; a node is finished, and leaves, as soon as a path comes that doesn't pass through it.

Nodes on a task's first and last path may go on in the neighbouring ranges. These seams, two paths a task, are put
together by one more stack over the tasks in order. A parent is finished after its children, so that its smallest
member meets them in a join on (task, node), which has no more rows to a key than a task has nodes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, open_fs, partitions, scratch, written

TURN = 16
RUN_BYTES, BLOCK_ROWS, CHUNK_CHARS = 64 << 20, 5000, 1 << 20
SHARED_TURNS, GROUP = 9, 5
PATHS = "conv_id long, path binary, sizes array<long>"
STRETCH = "path binary, sizes array<long>, first long, n long, ids string"
DISTINCT = "path binary, sizes array<long>, n long, least long, ends string"
NODE = "part int, seq long, parent_part int, parent_seq long, depth long, turn binary, size long, is_open boolean, is_left boolean, is_right boolean, n long, least long, children long, leaves long, saved long, ends string"
ROWS_OUT = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- paths -----------------------------------------------------------------------------------------------------


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (struct of key and length in turn order) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.sha2(role, 256), text), 256), 1, 2 * TURN)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    )
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    dealt = rows.withColumn("group", group).repartition(partitions(conversations.sparkSession), "group")  # and not again by conv_id
    return dealt.groupBy("group", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _path(turns) -> list:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["key"]), "")).alias("path"), F.transform(turns, lambda t: t["size"]).alias("sizes")]


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path and sizes of each conversation as it is. Turns come in order of turn (null first; equal turns by a
    digest of role and text), null role and text are empty, and rows without a conv_id belong to no conversation.
    A conversation's path, 16 bytes a turn, is one row."""
    return _turns(conversations).select("conv_id", *_path(F.col("turns")))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """As conversation_paths(), but each conversation c begins with the first h turns of conversation c - c % 5 (all it
    has, none if it is absent), and its own turns follow from the h-th on; h = crc32(decimal c) % 9. The five
    conversations that may meet are dealt together, once."""
    met = _turns(conversations).groupBy("group").agg(F.collect_list(F.struct("conv_id", "turns")).alias("all"))
    base = F.get(F.filter("all", lambda c: c["conv_id"] == F.col("group")), F.lit(0))["turns"]
    each = met.withColumn("base", F.coalesce(base, F.expr("filter(all[0].turns, t -> false)"))).select("base", F.inline("all"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")
    return each.withColumn("h", h).select("conv_id", *_path(F.concat(F.slice("base", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))))


def distinct_paths(paths: DataFrame, chunk: int = CHUNK_CHARS) -> DataFrame:
    """Each distinct path with its number of conversations, the smallest of them, and the SHA-256 of their decimal ids,
    ascending and joined by commas. No task holds more than `chunk` characters of one path's ids."""
    spark = paths.sparkSession
    deal = partitions(spark)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes, ids, chars, out = None, [], [], 0, []

        def closed():
            out.append((key, sizes, ids[0], len(ids), ",".join(map(str, ids))))

        def flushed():
            path, size, first, n, text = zip(*out, strict=True)
            out.clear()
            return batch(path=pa.array(path, pa.binary()), sizes=pa.array(size, pa.list_(pa.int64())), first=pa.array(first, pa.int64()), n=pa.array(n, pa.int64()), ids=pa.array(text, pa.string()))

        held = 0
        for b in batches:
            for conv, path, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (path != key or chars >= chunk):
                    closed()
                    held += len(key) + chars
                    ids, chars = [], 0
                    if len(out) >= ROWS_OUT or held >= RUN_BYTES // 8:
                        yield flushed()
                        held = 0
                key, sizes = path, size
                ids.append(conv)
                chars += len(str(conv)) + 1
        if ids:
            closed()
            yield flushed()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes, n, least, sha = None, [], 0, None, None
        for b in batches:
            out = []
            for path, size, first, count, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path == key:
                    n += count
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    out.append((key, sizes, n, least, sha.hexdigest()))
                key, sizes, n, least, sha = path, size, count, first, hashlib.sha256(ids.encode())
            if out:
                yield _distinct(out)
        if sha is not None:
            yield _distinct([(key, sizes, n, least, sha.hexdigest())])

    dealt = paths.repartitionByRange(deal, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    met = written(arrow_map(dealt.select("conv_id", "path", "sizes"), stretches, STRETCH), "stretches")
    return arrow_map(met.repartition(deal, "path").sortWithinPartitions("path", "first"), joined, DISTINCT)


def _distinct(rows: list[tuple]) -> pa.RecordBatch:
    path, sizes, n, least, ends = zip(*rows, strict=True)
    return batch(path=pa.array(path, pa.binary()), sizes=pa.array(sizes, pa.list_(pa.int64())), n=pa.array(n, pa.int64()), least=pa.array(least, pa.int64()), ends=pa.array(ends, pa.string()))


# ---- runs ------------------------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """The number of leading turns that two paths share, if they share `at` at least."""
    most = min(len(a), len(b))
    if a[at * TURN : most] == b[at * TURN : most]:
        return most // TURN
    at *= TURN
    while a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(rows: list[tuple]) -> list[tuple[int, tuple]]:
    """(LCP with the row before, row) in order of the rows' paths."""
    rows.sort(key=lambda r: r[0])
    return [(shared(a[0], b[0]), b) for a, b in zip([(b"",), *rows], rows, strict=False)]


def spilled(fs, path: str, run: list[tuple[int, tuple]]) -> None:
    with fs.open_output_stream(path, compression=None) as f:
        writer = None
        for lo in range(0, len(run), BLOCK_ROWS):
            part = run[lo : lo + BLOCK_ROWS]
            block = pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), *_distinct([x[1] for x in part]).columns], ["lcp", "path", "sizes", "n", "least", "ends"])
            writer = writer or pa.ipc.new_stream(f, block.schema)
            writer.write_batch(block)
        writer.close()


def read_run(fs, path: str) -> Iterator[tuple[int, tuple]]:
    """A spilled run, a block at a time."""
    with fs.open_input_stream(path, compression=None) as f:
        for block in pa.ipc.open_stream(f):
            for lcp, *row in zip(*(c.to_pylist() for c in block.columns), strict=True):
                yield lcp, tuple(row)


def merged(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """The runs' rows in order with their LCPs, through a tree of losers. Paths of all runs are distinct.

    Every head knows its LCP with the last row out. The head of a larger LCP is the smaller path, and the LCP of the
    two is the smaller one, so nothing is compared; with equal LCPs turns are, from there on, and the loser keeps the
    LCP that is found, which is the one it has with whatever wins over it."""
    width = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[tuple | None] = [None] * width
    lcps = [0] * width

    def pull(k: int) -> None:
        if k < len(runs):
            lcps[k], heads[k] = next(runs[k], (0, None))

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; the loser's LCP becomes that with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        h = shared(x, y, lcps[a])
        win, lose = (a, b) if x[h * TURN :] < y[h * TURN :] else (b, a)
        lcps[lose] = h
        return win, lose

    for k in range(width):
        pull(k)
        lcps[k] = 0
    losers, winners = [0] * width, [0] * width + list(range(width))
    for at in range(width - 1, 0, -1):
        winners[at], losers[at] = duel(winners[2 * at], winners[2 * at + 1])
    best = winners[1] if width > 1 else 0
    while heads[best] is not None:
        yield lcps[best], heads[best]
        pull(best)
        at = (best + width) // 2
        while at:
            best, losers[at] = duel(best, losers[at])
            at //= 2


# ---- nodes -----------------------------------------------------------------------------------------------------


class _Node:
    __slots__ = ("seq", "depth", "turn", "size", "n", "least", "children", "leaves", "saved", "ends", "aliases")

    def __init__(self, seq, depth: int, turn: bytes, size: int):
        self.seq, self.depth, self.turn, self.size = seq, depth, turn, size
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.ends = None
        self.aliases: list[tuple[int, int]] = []

    def add(self, n: int, least: int | None, ends: str | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.ends = ends or self.ends

    def finish(self) -> None:
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * self.size

    def take(self, child: _Node) -> None:
        """Counts a finished child."""
        self.add(child.n, child.least, None)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def _record(part: int, x: _Node, parent: tuple[int, int] | None, state: tuple[bool, bool, bool]) -> tuple:
    up = parent or (None, None)
    return part, x.seq, *up, x.depth, x.turn, x.size, *state, x.n, x.least, x.children, x.leaves, x.saved, x.ends


_SCHEMA = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in NODE.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def nodes_of(part: int, stream: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Records of the trie of one range's paths: finished nodes as they leave the stack; at the end, open and without
    what open children count, those of the first and the last path."""
    stack, left, seq = [_Node(0, 0, b"", 0)], 0, 1
    opened: list[tuple[_Node, int | None]] = []
    some = False
    for lcp, (path, sizes, n, least, ends) in stream:
        while len(stack) > lcp + 1:
            x = stack.pop()
            if x.seq <= left:  # nodes of the first path are numbered first
                opened.append((x, stack[-1].seq))
                continue
            x.finish()
            stack[-1].take(x)
            yield _record(part, x, (part, stack[-1].seq), (False, False, False))
        for depth in range(lcp, len(path) // TURN):
            stack.append(_Node(seq, depth + 1, path[depth * TURN : depth * TURN + TURN], sizes[depth]))
            seq += 1
        stack[-1].add(n, least, ends)
        if not some:
            left, some = seq - 1, True
    if some:
        for x, up in opened:
            yield _record(part, x, (part, up), (True, True, False))
        for k, x in enumerate(stack):
            yield _record(part, x, (part, stack[k - 1].seq) if k else None, (True, x.seq <= left, True))


def _seams(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Finished nodes of the open ones (records of all tasks in order of part and seq): one for each node, and a record
    without depth for every further (part, seq) that it has, with its smallest member."""
    stack: list[_Node] = []

    def closed(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            x = stack.pop()
            x.finish()
            if stack:
                stack[-1].take(x)
            part, x.seq = x.seq
            yield _record(part, x, stack[-1].seq if stack else None, (False, False, False))
            for a, b in x.aliases:
                yield a, b, None, None, None, None, None, False, False, False, None, x.least, None, None, None, None

    def passed(chain: list[tuple]) -> Iterator[tuple]:
        """Goes down a task's first or last path."""
        at = 0
        while at < min(len(chain), len(stack)) and (at == 0 or stack[at].turn == chain[at][5]):
            at += 1
        yield from closed(at)
        for k, r in enumerate(chain):
            own = (r[0], r[1])
            if k < at and (stack[k].seq == own or own in stack[k].aliases[-1:]):
                continue
            if k < at:
                stack[k].aliases.append(own)
            else:
                stack.append(_Node(own, r[4], r[5], r[6]))
            x = stack[k]
            x.add(r[10], r[11], r[15])
            x.children += r[12]
            x.leaves += r[13]
            x.saved += r[14]

    def part_of(group: list[tuple]) -> Iterator[tuple]:
        for side in (8, 9):
            yield from passed(sorted((r for r in group if r[side]), key=lambda r: r[4]))

    group: list[tuple] = []
    for r in rows:
        if group and group[0][0] != r[0]:
            yield from part_of(group)
            group = []
        group.append(r)
    if group:
        yield from part_of(group)
    yield from closed(0)


def trie(paths: DataFrame, run_bytes: int = RUN_BYTES, chunk: int = CHUNK_CHARS) -> DataFrame:
    """conversation_paths() or rebuilt_paths() -> a row a node, one for each distinct sequence of first turns, the empty
    one (the root) with them: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Conversations with equal paths, also such without turns, are
    members of the same nodes; no conversations give no rows."""
    spark = paths.sparkSession
    deal, folder = partitions(spark), scratch(spark, "runs")
    rows = written(distinct_paths(written(paths, "paths"), chunk), "distinct")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs, root, runs, rows, held = TaskContext.get().partitionId(), None, "", [], [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(row)
                held += 3 * len(row[0]) + 500
                if held >= run_bytes:
                    if fs is None:
                        fs, root = open_fs(folder)
                        fs.create_dir(root, recursive=True)
                    runs.append(f"{root}/{part}-{uuid.uuid4().hex}.arrows")
                    spilled(fs, runs[-1], sorted_run(rows))
                    rows, held = [], 0
        out = []
        for record in nodes_of(part, merged([*(read_run(fs, p) for p in runs), iter(sorted_run(rows))])):
            out.append(record)
            if len(out) >= ROWS_OUT:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)
        for p in runs:
            fs.delete_file(p)

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for record in _seams(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            out.append(record)
            if len(out) >= ROWS_OUT:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    found = written(arrow_map(rows.repartitionByRange(deal, "path"), run, NODE), "nodes")
    closed = written(arrow_map(found.where("is_open").repartition(1).sortWithinPartitions("part", "seq"), seams, NODE), "seams")  # two paths a task
    every = found.where("NOT is_open").unionByName(closed)
    up = every.select(F.col("part").alias("parent_part"), F.col("seq").alias("parent_seq"), F.col("least").alias("parent_conv_id"))
    out = every.where("depth IS NOT NULL").join(up, ["parent_part", "parent_seq"], "left")
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text) with the role and text of each node's last turn (null for the
    root), which come from its smallest member."""
    nodes = trie(conversation_paths(conversations))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    key = F.substring(F.sha2(F.concat(F.sha2("role", 256), F.col("text")), 256), 1, 2 * TURN)
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), key)).cast("long")
    return nodes.join(rows.select("conv_id", at.alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
