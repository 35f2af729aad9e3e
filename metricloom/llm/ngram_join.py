"""Self-join of documents on the Jaccard similarity of their word shingles (0.8 or more), by set relations.

Equal sets are one node. Nodes that share a least hash with another node are compared with it first; those that
are similar enough become members of its star, with their exact distance (size of the symmetric difference) to
its centre. The complete join then runs over inverted lists of prefix tokens, rarest first. A list holds one
entry a star, in blocks of similar set size, each sorted by the tokens left behind the list's position, so that
a probe skips whole blocks, and the rest of a block, where too few tokens are left for the overlap needed.
What lists bring together is a pair of stars. The answers of members are derived from those of their centres:
distance is a metric, so a pair of stars is skipped whole where the centres are further apart than the limit
plus both radii. The members of the few pairs of stars that this leaves open go through lists of their own, where
each has its own size and position, so that members meet only if they share tokens that their star's centre does
not explain; of these only pairs are compared whose distances to their centres can make up the difference. The
product of two stars is never formed.

Nothing is capped: heavy tokens only come last in the order of prefixes, and any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BUCKETS, arrow_map, partitions, release, short_batches, without_rows, written
from .components import connected_components
from .shingles import U, mix, shingle_sets

HASHES = 8
PICKS = 5
HOT_TOKENS = 1 << 20  # most entries of the table of frequent tokens that tasks get: 16 MB
HOT_DF = 16
CHUNK = 1 << 17
SUBSLOTS = 8
SHORT_LIST = 48
_ODD = np.random.default_rng(7).integers(1, 2**62, HASHES, dtype=np.uint64) * U(2) + U(1)


# ---- sets ------------------------------------------------------------------------------------------------------


def needed(total):
    """Least overlap of two similar sets whose sizes sum to total: 100 o >= 80 (total - o)."""
    return -(-4 * total // 9)


def furthest(total):
    """Largest distance of two similar sets whose sizes sum to total."""
    return total - 2 * needed(total)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes over a power of two of cells, at least two cells an element. The number of
    cells in which two sketches differ is at most the distance of the sets."""
    bits = max(8, int(2 * len(s) - 1).bit_length())
    cells = ((s * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=1 << bits) & 1).tobytes()


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the distance of the sets that the sketches are of."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(y) > len(x):  # cells of the finer sketch that fall into one of the coarser are neighbours
        fold = len(y) // len(x)
        y = np.packbits(np.bitwise_xor.reduce(np.unpackbits(y).reshape(-1, fold), axis=1))
    return int(_POPCOUNT[x ^ y].sum())


def _overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _seal(text: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _profiles(docs: DataFrame, hot: Broadcast) -> DataFrame:
    """A row a document; `own` is the share of its tokens that few other documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                n, digests, sketches, least, own = [], [], [], [], []
                for s in shingle_sets(part.column(1)):
                    n.append(len(s))
                    digests.append(_digest(s) if len(s) else None)
                    sketches.append(_sketch(s) if len(s) else None)
                    least.append([(s * odd).min() for odd in _ODD] if len(s) else [])
                    own.append(1 - _places(s, *hot.value)[0].mean() if len(s) else 1.0)
                mins = pa.array([np.array(x, np.uint64).view(np.int64) for x in least], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), mins, pa.array(own, pa.float64())], ["id", "seal", "n", "digest", "sketch", "least", "own"])

    return arrow_map(docs.withColumn("seal", _seal("text")), run, "id long, seal long, n long, digest binary, sketch binary, least array<long>, own double")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of docs whose id may be that of a node's first document. Others are kept out by a table of at most
    FILTER_BUCKETS hash buckets of the id."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS))
    buckets = nodes.select(bucket("first").alias("bucket")).distinct()
    return docs.join(F.broadcast(buckets), bucket("id") == F.col("bucket"), "left_semi")


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes given: their first documents' texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = list(shingle_sets(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "digest", "tokens"])

    found = arrow_map(_texts_of(docs, nodes), run, "id long, digest binary, tokens binary")
    of = nodes.select("node", "first", "digest")
    joined = found.join(of, (found.digest == of.digest) & found.id.eqNullSafe(of["first"]))
    return joined.select("node", "tokens").dropDuplicates(["node"])


def _overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of nodes with `overlap`."""
    pairs = written(pairs, "pairs")  # used three times
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets_of(docs, nodes.join(ends, "node", "left_semi")), "sets")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("_x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("_y")), "b").select(*pairs.columns, "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_overlap(x.as_py(), y.as_py()) for x, y in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.int64())], [*b.schema.names[:-2], "overlap"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", overlap long"
    out = written(arrow_map(both, run, schema), "overlaps")
    release(pairs, sets)
    return out


def _sketch_bounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, limit long, ...) whose sketches allow a distance of `limit`, with that bound as `bound`."""
    with_a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("_x")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("_y")), "b").select(*pairs.columns, "_x", "_y")
    limit_at = pairs.columns.index("limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True)], np.int64)
            out = pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found)], [*b.schema.names[:-2], "bound"])
            yield out.filter(pa.array(found <= np.array(b.column(limit_at))))

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", bound long"
    return arrow_map(both, run, schema)


# ---- stars -----------------------------------------------------------------------------------------------------


def _similar(n, m, overlap):
    return F.expr(f"180 * {overlap} >= 80 * ({n} + {m})")


def _near(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, tries: int) -> DataFrame:
    """Verified links (a, b, na, nb, overlap) among pairs (a, na, b), of each a to the `tries` candidates that its
    sketch puts nearest."""
    pairs = pairs.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").withColumn("limit", F.expr("na + nb - 2 * ((4 * (na + nb) + 8) div 9)"))
    near = _sketch_bounds(nodes, pairs).groupBy("a", "na").agg(F.slice(F.array_sort(F.collect_set(F.struct("bound", "b", "nb"))), 1, tries).alias("p"))
    near = near.select("a", "na", F.explode("p").alias("p")).select("a", "na", F.col("p.b").alias("b"), F.col("p.nb").alias("nb"))
    return _overlaps(docs, nodes, near).where(_similar("na", "nb", "overlap"))


def _stars(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links of nodes to pivots, and (node, star, far) with far the distance to the centre.

    Each of a node's least hashes names two of the nodes that share it: the one with the least share of tokens of its
    own, which in a group of near copies is the nearest to what they were made from, and the largest. Its first pivots
    are the two that most of its hashes name. Nodes that this links with nothing are compared with the PICKS nodes
    that most of their hashes name, where each hash names up to six: the first and last in three orders and among
    linked nodes. What this misses, the inverted lists find."""
    keyed = nodes.select("node", "n", "own", F.posexplode("least").alias("k", "h"))
    central = F.struct("own", "node")
    ends = keyed.groupBy("k", "h").agg(F.min_by("node", central).alias("lo"), F.max("node").alias("hi"))
    other = lambda c: F.mode(F.when(F.col(c) != F.col("node"), F.col(c)), True)
    own = keyed.join(ends, ["k", "h"]).groupBy("node", "n").agg(F.array(other("lo"), other("hi")).alias("pivots"))
    pairs = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.array_compact(F.array_distinct("pivots"))).alias("b"))
    links = _near(docs, nodes, pairs, 1)

    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("linked", F.lit(True))
    marked = keyed.join(linked, "node", "left")
    mixed = F.xxhash64("node", F.lit(1))
    linked = F.when(F.col("linked"), central)
    picks = marked.groupBy("k", "h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("node", mixed).alias("first"), F.max_by("node", mixed).alias("last"), F.min_by("node", central).alias("known"), F.min_by("node", linked).alias("also"))
    picks = picks.where("lo < hi").select("k", "h", F.array_compact(F.array("lo", "hi", "first", "last", "known", "also")).alias("picks"))
    rest = marked.where("linked IS NULL").join(picks, ["k", "h"]).groupBy("node", "n").agg(F.flatten(F.collect_list("picks")).alias("all"))
    rest = rest.withColumn("all", F.array_remove("all", F.col("node")))
    named = F.transform(F.array_distinct("all"), lambda p: F.struct((-F.size(F.filter("all", lambda x: x == p))).alias("times"), p.alias("b")))
    pairs = rest.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.slice(F.array_sort(named), 1, PICKS)["b"]).alias("b"))
    links = written(links.unionByName(_near(docs, nodes, pairs, 3)), "links")

    centres = links.select(F.col("b").alias("node")).distinct()
    stars = links.join(centres, links.a == centres.node, "left_anti").withColumn("far", F.expr("na + nb - 2 * overlap"))
    members = stars.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.struct("far", "b")).alias("star"), F.min("far").alias("far"))
    return links.select("a", "b"), members


# ---- the order of tokens ---------------------------------------------------------------------------------------


def _hot_tokens(docs: DataFrame, slots: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The most frequent tokens, as their leading bits: (number of bits, sorted keys, document frequencies).
    Tasks send each other sorted runs of distinct keys, a slot for each range of keys."""
    bits = 32 + int(slots).bit_length() - 1
    starts = np.array([-(-(k << bits) // slots) for k in range(slots + 1)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(sets) >> U(64 - bits), return_counts=True)
            cut = np.searchsorted(keys, starts)
            rows = []
            for k in range(slots):
                part, m = (keys[cut[k] : cut[k + 1]] - starts[k]).astype(np.uint32), n[cut[k] : cut[k + 1]]
                rows.append((part[m == 1].tobytes(), part[m > 1].tobytes(), m[m > 1].astype(np.uint32).tobytes()))
            once, more, times = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary()), pa.array(times, pa.binary())], ["slot", "once", "more", "times"])

        sets, held = [], 0
        for b in batches:
            for s in shingle_sets(b.column(1)):
                if len(s):
                    sets.append(s)
                    held += len(s)
                if held >= CHUNK * 2:
                    yield flush(sets)
                    sets, held = [], 0
        if sets:
            yield flush(sets)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slot: dict[int, list] = {}
        for b in batches:
            for slot, once, more, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_slot.setdefault(slot, []).append((once, more, times))
        for slot in list(by_slot):
            rows = by_slot.pop(slot)
            every = np.frombuffer(b"".join([r[0] for r in rows] + [r[1] for r in rows]), np.uint32)
            times = np.frombuffer(b"".join(r[2] for r in rows), np.uint32)
            del rows
            once = len(every) - len(times)
            for k in range(SUBSLOTS):  # a part of the slot's range of keys at a time
                mine = every & np.uint32(SUBSLOTS - 1) == k
                keys, more = every[mine], times[mine[once:]]
                order = np.argsort(keys, kind="stable")
                weights = np.concatenate([np.ones(len(keys) - len(more), np.int64), more])[order]
                keys = keys[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                df = np.add.reduceat(weights, first) if len(first) else weights
                hot = df >= HOT_DF
                yield pa.RecordBatch.from_arrays([pa.array((keys[first][hot].astype(np.uint64) + starts[slot]).view(np.int64)), pa.array(df[hot])], ["key", "df"])

    runs = arrow_map(docs, count, "slot int, once binary, more binary, times binary").repartitionById(slots, F.col("slot"))
    hot = arrow_map(runs, total, "key long, df long").orderBy(F.desc("df"), "key").limit(HOT_TOKENS).toPandas().sort_values("key")
    return bits, hot["key"].to_numpy(np.int64).view(np.uint64), hot["df"].to_numpy(np.int64)


def _places(s: np.ndarray, bits: int, keys: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a set are frequent, and where the table has them."""
    if not len(keys):
        return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
    own = s >> U(64 - bits)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return keys[at] == own, at


def _prefix(s: np.ndarray, bits: int, keys: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the global order (tokens that aren't frequent by hash, then the frequent by
    frequency and hash): one more than a similar set can lack."""
    length = len(s) - needed_alone(len(s)) + 1
    hot, at = _places(s, bits, keys, df)
    rare = s[~hot]
    if len(rare) >= length:
        return rare[:length]
    rest, times = s[hot], df[at[hot]]
    return np.concatenate([rare, rest[np.lexsort((rest, times))][: length - len(rare)]])


def needed_alone(n):
    """Least overlap of a set of n elements with any similar set."""
    return -(-4 * n // 5)


# ---- lists -----------------------------------------------------------------------------------------------------

_ENTRY = np.dtype([("token", "<u8"), ("star", "<i8"), ("comp", "<i8"), ("low", "<i4"), ("high", "<i4"), ("left", "<i4")])


def _collapsed(e: np.ndarray) -> np.ndarray:
    """One entry for each token and star: the least and largest set size, and the most tokens left, itself included."""
    e = e[np.lexsort((e["star"], e["token"]))]
    if len(e) < 2:
        return e
    first = np.flatnonzero(np.concatenate(([True], (e["token"][1:] != e["token"][:-1]) | (e["star"][1:] != e["star"][:-1]))))
    out = e[first].copy()
    out["low"] = np.minimum.reduceat(e["low"], first)
    out["high"] = np.maximum.reduceat(e["high"], first)
    out["left"] = np.maximum.reduceat(e["left"], first)
    return out


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of the stars of entries x and y can be similar, judged by size and position."""
    least = needed(x["low"].astype(np.int64) + y["low"])
    sizes = (5 * x["high"].astype(np.int64) >= 4 * y["low"].astype(np.int64)) & (5 * y["high"].astype(np.int64) >= 4 * x["low"].astype(np.int64))
    return sizes & (x["left"] >= least) & (y["left"] >= least) & (x["comp"] != y["comp"])


def _long_list(e: np.ndarray) -> list[np.ndarray]:
    """Pairs of a long list, block by block. A block has sets of similar size, those with most tokens left first;
    a probe takes from it only the run of entries that have enough left."""
    block = np.floor(np.log(np.maximum(e["low"], 1)) / np.log(1.1)).astype(np.int64)
    e = e[np.lexsort((-e["left"], block))]
    block = np.sort(block)
    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    blocks = [(e[a:b], int(e["low"][a:b].min()), int(e["high"][a:b].max())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for i, (mine, low, _) in enumerate(blocks):
        for k, (other, other_low, other_high) in enumerate(blocks[: i + 1]):
            if 5 * other_high < 4 * low:
                continue
            least = needed(low + other_low)
            x = mine[: np.searchsorted(-mine["left"], -least, "right")]
            y = other[: np.searchsorted(-other["left"], -least, "right")]
            for p in range(len(x)):
                rest = y[p + 1 :] if k == i else y
                hit = rest["star"][_possible(np.broadcast_to(x[p], len(rest)), rest)]
                if len(hit):
                    out.append(np.stack([np.full(len(hit), x["star"][p]), hit], axis=1))
    return out


def _pairs_of_lists(e: np.ndarray) -> np.ndarray:
    """Pairs of stars of different components that some list brings together and size and position allow."""
    e = _collapsed(e)
    first = np.flatnonzero(np.concatenate(([True], e["token"][1:] != e["token"][:-1])))
    length = np.diff(np.append(first, len(e)))
    mixed = np.minimum.reduceat(e["comp"], first) != np.maximum.reduceat(e["comp"], first)
    out = []
    for at, n in zip(first[mixed & (length > SHORT_LIST)].tolist(), length[mixed & (length > SHORT_LIST)].tolist(), strict=True):
        out += _long_list(e[at : at + n])
    e = e[np.repeat(mixed & (length <= SHORT_LIST), length)]
    for step in range(1, SHORT_LIST):
        x, y = e[:-step], e[step:]
        same = x["token"] == y["token"]
        if not same.any():
            break
        x, y = x[same], y[same]
        ok = _possible(x, y)
        out.append(np.stack([x["star"][ok], y["star"][ok]], axis=1))
    if not out:
        return np.zeros((0, 2), np.int64)
    pairs = np.sort(np.concatenate(out), axis=1)
    return np.unique(pairs, axis=0)


def _candidates(docs: DataFrame, nodes: DataFrame, slots: int, hot: Broadcast) -> DataFrame:
    """Distinct pairs (a, b), a < b, of stars of different components from the inverted lists; nodes: first,
    digest, n, star, comp; hot: what _hot_tokens returns."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sets = list(shingle_sets(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([_prefix(s, *hot.value).tobytes() if len(s) else b"" for s in sets], pa.binary())], ["id", "digest", "prefix"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            e = _collapsed(np.concatenate(parts))
            slot = ((mix(e["token"]) >> U(32)) * U(slots)) >> U(32)
            order = np.argsort(slot, kind="stable")
            e, cut = e[order], np.searchsorted(slot[order], np.arange(slots + 1).astype(np.uint64))
            blobs = [b"".join(e[name][cut[k] : cut[k + 1]].tobytes() for name in _ENTRY.names) for k in range(slots)]
            return pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array(blobs, pa.binary())], ["slot", "entries"])

        parts, held = [], 0
        for b in batches:
            for star, comp, n, prefix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = np.frombuffer(prefix, np.uint64)
                e = np.empty(len(tokens), _ENTRY)
                e["token"], e["star"], e["comp"], e["low"], e["high"] = tokens, star, comp, n, n
                e["left"] = n - np.arange(len(tokens))
                parts.append(e)
                held += len(e)
                if held >= CHUNK:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for blob in b.column(1):
                raw = memoryview(blob.as_buffer())
                n, at = len(raw) // _ENTRY.itemsize, 0
                e = np.empty(n, _ENTRY)
                for name in _ENTRY.names:
                    kind = _ENTRY[name]
                    e[name] = np.frombuffer(raw[at : at + n * kind.itemsize], kind)
                    at += n * kind.itemsize
                if n:
                    parts.append(e)
        found = [np.zeros((0, 2), np.int64)]
        for k in range(SUBSLOTS):  # lists are whole in a part of the slot, and parts are sorted one after the other
            own = [e[(mix(e["token"]) & U(SUBSLOTS - 1)) == U(k)] for e in parts]
            if any(map(len, own)):
                found.append(_pairs_of_lists(np.concatenate(own)))
        pairs = np.unique(np.concatenate(found), axis=0)
        for lo in range(0, len(pairs), 1 << 18):
            part = pairs[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["a", "b"])

    own = arrow_map(docs, prefixes, "id long, digest binary, prefix binary")
    # a shuffle between the two Arrow maps, whatever the sizes: in one task they would need two Python workers
    joined = own.join(nodes.hint("merge"), (own.digest == nodes.digest) & own.id.eqNullSafe(nodes["first"])).select("star", "comp", "n", "prefix")
    dealt = arrow_map(joined, postings, "slot int, entries binary").repartitionById(slots, F.col("slot"))
    return arrow_map(dealt, lists, "a long, b long").distinct()


# ---- the join --------------------------------------------------------------------------------------------------


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links).select("node", "root")
    return nodes.join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _star_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, slots: int, hot: Broadcast) -> DataFrame:
    """Links between stars of different components; nodes: node, first, digest, n, sketch, star, far, comp."""
    stars = nodes.groupBy("star").agg(F.max("far").alias("radius"), F.max("n").alias("high"))
    stars = stars.join(nodes.select(F.col("node").alias("star"), F.col("n").alias("size")), "star")
    side = lambda c: stars.select(F.col("star").alias(c), F.col("size").alias(f"n{c}"), F.col("radius").alias(f"r{c}"), F.col("high").alias(f"h{c}"))
    pairs = _candidates(docs, nodes.select("first", "digest", "n", "star", "comp"), slots, hot)
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("limit", F.expr("(ha + hb) div 9 + ra + rb"))
    near = _overlaps(docs, nodes, _sketch_bounds(nodes, pairs).drop("bound"))
    direct = near.where(_similar("na", "nb", "overlap")).select("a", "b")
    open_ = near.where("ra + rb > 0 AND NOT (180 * overlap >= 80 * (na + nb)) AND na + nb - 2 * overlap <= limit")
    open_ = open_.select(F.col("a").alias("low"), F.col("b").alias("high"), F.expr("na + nb - 2 * overlap").alias("gap"))
    if not open_.limit(1).count():
        return direct
    now = written(_roots(nodes.drop("comp"), links.union(direct)), "roots")
    stars = open_.select(F.col("low").alias("star")).union(open_.select("high")).distinct()
    inside = written(now.join(stars, "star", "left_semi"), "inside")
    inner = _candidates(_texts_of(docs, inside), inside.select("first", "digest", "n", F.col("node").alias("star"), "comp"), slots, hot)
    member = lambda c: inside.select(F.col("node").alias(c), F.col("star").alias(f"s{c}"), F.col("far").alias(f"f{c}"), F.col("n").alias(f"n{c}"))
    inner = inner.join(member("a"), "a").join(member("b"), "b").withColumns({"low": F.least("sa", "sb"), "high": F.greatest("sa", "sb")})
    inner = inner.join(open_, ["low", "high"]).where("fa + fb + (na + nb) div 9 >= gap AND 5 * least(na, nb) >= 4 * greatest(na, nb)")
    inner = inner.select("a", "b", "na", "nb", F.expr("na + nb - 2 * ((4 * (na + nb) + 8) div 9)").alias("limit"))
    exact = _overlaps(docs, nodes, _sketch_bounds(nodes, inner).drop("bound"))
    return direct.union(exact.where(_similar("na", "nb", "overlap")).select("a", "b"))


def _joined(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> id, seal, n, digest, and for sets that are not empty component_id, the smallest id of the
    component, and chosen, the least digest that has it."""
    slots = partitions(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_tokens(docs, slots))
    profiles = written(_profiles(docs, hot), "profiles")
    grouped = profiles.where("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("least").alias("least"), F.first("own").alias("own"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links, members = _stars(docs, nodes)
    linked = _roots(nodes.drop("least", "own").join(members, "node", "left").withColumns({"star": F.coalesce("star", "node"), "far": F.coalesce("far", F.lit(0))}), links)
    linked = written(linked, "linked")
    more = _star_links(docs, linked, links, slots, hot)
    final = _roots(nodes.select("node", "digest", "first"), links.union(more))
    best = F.min(F.struct(F.col("first").isNull(), "first", "digest")).alias("best")
    smallest = written(final.groupBy("comp").agg(best).select("comp", F.col("best.first").alias("component_id"), F.col("best.digest").alias("chosen")), "smallest")
    hot.unpersist()  # all that needs it is written
    of_digest = final.join(smallest, "comp").select("digest", "component_id", "chosen")
    return profiles.select("id", "seal", "n", "digest").join(of_digest, "digest", "left")


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links lead to, the row's own included; documents without words
    link with nothing and are their own component. Ids that are null are never the smallest; a component of
    null ids only has a null component_id. Rows that repeat an id are each compared; an empty table gives no rows.
    """
    out = _joined(_texts(docs, id_col, text_col))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that are similar, by way of links, to a row of smaller doc_id, or of the same doc_id and
    a shingle set of smaller digest; columns unchanged. Rows whose id is null stay, and so do rows without words and
    rows that repeat both doc_id and text of one that stays."""
    rest = (F.col("id") != F.col("component_id")) | (F.col("digest") != F.col("chosen"))
    gone = _joined(_texts(docs)).where((F.col("n") > 0) & F.col("id").isNotNull() & rest).select("id", "seal")
    return without_rows(docs, gone, {"id": F.col("doc_id").cast("long"), "seal": _seal("text")})
