"""Toxicity of documents: a support vector machine on a gapped-subsequence string kernel with Nystroem landmarks.

Two strings are alike in the subsequences of four symbols they share, each weighted by DECAY to the power of the
span it covers (at most SPAN symbols), so an insult keeps most of its likeness when characters are inserted into
it or left out. Strings are words with marks at both ends; letters lose case and accents; runs of single
characters between spaces ("i d i o t") are also read as one word.

Training is on a bounded sample of labelled documents outside the held-out fold. Sentences have no labels of
their own: all fragments of a clean document are clean, and of a toxic document the most telling one is toxic.
First fragments are picked by how much more often they occur in toxic documents; then the machine itself picks
each document's best fragment and is trained again. Strings are single words: white space always ends one, so
an insult of several harmless words is not seen. (Windows of several words were tried: they confuse words of a
language with the run of two shorter ones, and lost more than they found.) It is linear in kernel values with landmarks, and since the
kernel has an explicit feature map, a trained machine is one table of weights over subsequences. A document
scores as its best fragment, calibrated by a logistic curve on documents that taught nothing else.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, short_batches, written

#: The most labelled documents that are learnt from, chosen by a hash of doc_id.
MAX_TRAINING_DOCS = 8000
#: One in so many of these calibrates and teaches nothing else.
CALIBRATION_SHARE = 5
#: Most toxic and most clean fragments that a machine is trained on: the most telling, and of clean ones the most
#: frequent and others by a hash.
MAX_TELLING, MAX_PLAIN = 600, 6000
#: A fragment tells if so many toxic documents have it (and more than chance gives any), and so few clean ones for
#: each of these. Where none does, the TOP fragments by the same order are taken.
LEAST_TOXIC, MOST_CLEAN, TOP = 3, 0.02, 20
#: Letters of beginnings of words that count as fragments beside the words.
BEGINNINGS = (4, 5, 6)
LANDMARKS = 256
ROUNDS = 2
DECAY, SPAN = 0.8, 8
WINDOW, STRIDE = 24, 16
CACHE_WORDS = 200_000
SYMBOLS = 5  # bits
MARK, OTHER = 27, 28

_PATTERNS = [(a, b, c, DECAY ** (c + 1)) for c in range(3, SPAN) for a, b in itertools.combinations(range(1, c), 2)]
_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")


class _Symbols(dict):
    """Character -> symbol, for str.translate: letters without case and accent, letters of other scripts dealt over
    the same 26, all else OTHER."""

    def __missing__(self, c: int) -> str:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()[0]
        symbol = ord(base) - 96 if "a" <= base <= "z" else ord(base[0]) % 26 + 1 if base.isalpha() else OTHER
        self[c] = out = chr(symbol)
        return out


_SYMBOLS = _Symbols()
_ENDS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


@functools.lru_cache(maxsize=4096)
def _norm(length: int) -> float:
    """The scale of a string of that many symbols, ends included."""
    return sum(w * w * max(0, length - c) for *_, c, w in _PATTERNS) ** 0.5 or 1.0


def _symbols(fragment: str) -> list[bytes]:
    """The fragment's symbols with marks at its ends, long ones in overlapping windows. A fragment that ends in
    NUL is a beginning: it has no mark at its end."""
    open_end = fragment.endswith("\0")
    s = fragment.rstrip("\0").strip(_ENDS).translate(_SYMBOLS).encode("latin-1")
    s = bytes([MARK]) + s + (b"" if open_end else bytes([MARK]))
    return [s] if len(s) <= WINDOW else [s[i : i + WINDOW] for i in range(0, len(s) - WINDOW + STRIDE, STRIDE)]


def _codes(m: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For strings of equal length (rows of m): the codes of all subsequences of a pattern, and its weight."""
    m = m.astype(np.int32)
    length = m.shape[1]
    for a, b, c, w in _PATTERNS:
        if length > c:
            n = length - c
            yield (m[:, :n] << 3 * SYMBOLS) | (m[:, a : a + n] << 2 * SYMBOLS) | (m[:, b : b + n] << SYMBOLS) | m[:, c:], w


def _features(fragment: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in _symbols(fragment):
        scale = _norm(len(s))
        for codes, w in _codes(np.frombuffer(s, np.uint8).reshape(1, -1)):
            for c in codes[0].tolist():
                out[c] = out.get(c, 0.0) + w / scale
    return out


@dataclass
class Machine:
    table: np.ndarray  # weight of each subsequence
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def values(self, fragments: list[str]) -> np.ndarray:
        """The machine's value of each fragment; of several windows the largest counts."""
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, f in enumerate(fragments):
            for s in _symbols(f):
                at, rows = by_length.setdefault(len(s), ([], []))
                at.append(i)
                rows.append(s)
        out = np.full(len(fragments), -np.inf)
        for length, (at, rows) in by_length.items():
            for lo in range(0, len(rows), 4096):
                part = rows[lo : lo + 4096]
                total = np.zeros(len(part))
                for codes, w in _codes(np.frombuffer(b"".join(part), np.uint8).reshape(-1, length)):
                    total += w * self.table[codes].sum(axis=1)
                np.maximum.at(out, at[lo : lo + 4096], total / _norm(length))
        return out + self.bias

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -35, 35)))


class _Cache(dict):
    """fragment -> value, in two generations."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.machine, self.old = machine, {}

    def learn(self, words: set[str]) -> None:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
            missing = words
        else:
            missing = words.difference(self)
        unknown = []
        for w in missing:
            if (v := self.old.get(w)) is not None:
                self[w] = v
            else:
                unknown.append(w)
        self.update(zip(unknown, self.machine.values(unknown).tolist(), strict=True))


def fragments(text: str) -> set[str]:
    low = text.lower()
    words = set(low.split())
    for m in _SPACED.finditer(low):
        words.add(m[0].replace(" ", ""))
    return words


def _best(texts: pa.Array, cache: _Cache, group: int = 128) -> Iterator[tuple[float, str]]:
    """Each text's largest value and the fragment that has it; the bias and nothing for texts without words."""
    for lo in range(0, len(texts), group):
        sets = [fragments(t or "") for t in texts.slice(lo, group).to_pylist()]
        cache.learn(set().union(*sets))
        for words in sets:
            top = max(words, key=lambda w: (cache[w], w), default="") if words else ""
            yield (cache[top] if top else cache.machine.bias), top


# ---- training --------------------------------------------------------------------------------------------------


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps on its support vectors; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    loss = lambda w: w @ w / 2 + cost * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        part, own = x[inside], 2 * cost * weight[inside]
        aim = np.linalg.solve(ridge + (part * own[:, None]).T @ part, part.T @ (own * y[inside]))
        step = 1.0
        while (new := loss(w + step * (aim - w))) > now and step > 1e-3:
            step /= 2
        w = w + step * (aim - w)
        if now - new < 1e-9 * now:
            break
        now = new
    return w[:-1], float(w[-1])


def _machine(found: dict[str, float], plain: list[str]) -> Machine:
    """A machine from toxic fragments with their counts of documents and clean fragments, the most telling and
    the most frequent first."""
    telling = list(found)
    half = min(len(telling), LANDMARKS * 5 // 8)
    landmarks = telling[:half] + plain[: LANDMARKS - half]
    rows = [_features(f) for f in landmarks]
    codes = np.unique([c for r in rows for c in r])
    table = np.zeros((len(rows), len(codes)), np.float32)
    for k, r in enumerate(rows):
        table[k, np.searchsorted(codes, list(r.keys()))] = list(r.values())

    def kernel(strings: Iterable[str]) -> np.ndarray:
        out = []
        for f in strings:
            r = _features(f)
            own, times = np.array(list(r.keys()), np.int64), np.array(list(r.values()))
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            known = codes[at] == own
            out.append(table[:, at[known]] @ times[known])
        return np.array(out)

    values, vectors = np.linalg.eigh(kernel(landmarks))
    keep = values > 5e-3 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.vstack([kernel(telling), kernel(plain)]) @ root
    y = np.concatenate([np.ones(len(telling)), -np.ones(len(plain))])
    weight = np.concatenate([np.clip(np.array(list(found.values())), 1, 25), np.ones(len(plain))])
    w, bias = _svm(x, y, weight)
    weights = np.zeros(1 << 4 * SYMBOLS, np.float32)
    weights[codes] = table.T @ (root @ w)
    return Machine(weights, bias)


def _calibrated(machine: Machine, values: np.ndarray, labels: np.ndarray) -> Machine:
    """With a logistic curve through the sample's values, its targets drawn in by one count either way."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    slope, shift = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * values + shift, -35, 35)))
        g = np.array([((p - target) * values).sum() + 1e-3 * slope, (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * values * values).sum() + 1e-3, (v * values).sum()], [(v * values).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    machine.slope, machine.shift = float(max(slope, 1e-3)), float(shift)
    return machine


def held_out(doc_id):
    """Whether a document is in the fold that is never learnt from; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Machine | float:
    """A machine from docs (doc_id, text) and labels (doc_id, toxic): of the labels outside the held-out fold, at
    most max_docs, and of rows that have them as many at most (rows of one id and text count once). Repeated labels of a document count as toxic if one does; null labels don't count. Without
    both kinds of labels the result is the share of toxic ones."""
    short_batches(docs.sparkSession)
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    apart = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(CALIBRATION_SHARE)) == 0
    whole = written(texts.withColumn("apart", apart).select("doc_id", "toxic", "text", "apart"), "labelled")
    if whole.count() > max_docs:  # ids repeat: the bound is on rows, equal ones once
        sealed = whole.withColumn("seal", F.xxhash64("text")).dropDuplicates(["doc_id", "seal"])
        few = sealed.select("doc_id", "seal").orderBy(F.xxhash64("doc_id", "seal"), "doc_id", "seal").limit(max_docs)
        whole = written(sealed.join(F.broadcast(few), ["doc_id", "seal"], "left_semi").drop("seal"), "labelled")
    count = {(r["toxic"], r["apart"]): r["count"] for r in whole.groupBy("toxic", "apart").count().collect()}
    if len({t for t, _ in count}) < 2:
        return float(any(t for t, _ in count))
    split = len(count) == 4  # few labels teach and calibrate alike
    sample, rest = (whole.where("NOT apart"), whole.where("apart")) if split else (whole, whole)
    toxic, clean = (sum(n for (t, a), n in count.items() if t == label and not (split and a)) for label in (1, 0))

    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w"))
    words = words.select("toxic", F.btrim("w", F.lit(_ENDS)).alias("w")).where("length(w) >= 3")
    begun = [F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("\0"))) for n in BEGINNINGS]
    pieces = words.select("toxic", F.explode(F.array("w", *begun)).alias("w")).where("w IS NOT NULL")
    counts = pieces.groupBy("w").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    counts = written(counts.withColumn("z", z), "pieces")
    # telling: more toxic documents than chance gives any fragment if labels fell at random
    surely = (math.log(counts.count() + 1) + 2) / -math.log(toxic / (toxic + clean))
    found = {r["w"]: r["t"] for r in counts.where(f"t >= {LEAST_TOXIC} AND t >= {surely} AND c <= {MOST_CLEAN} * t").orderBy(F.desc("z"), "w").limit(MAX_TELLING).collect()}
    if not found:
        found = {r["w"]: r["t"] for r in counts.where("t > 0").orderBy(F.desc("z"), "w").limit(TOP).collect()}
    ordinary = counts.where("c > 0 AND z < 1 AND w NOT LIKE '%\\0'")
    frequent = [r["w"] for r in ordinary.orderBy(F.desc("c"), "w").limit(MAX_PLAIN // 4).collect()]
    spread = [r["w"] for r in ordinary.orderBy(F.xxhash64("w"), "w").limit(MAX_PLAIN * 3 // 4).collect()]
    plain = list(dict.fromkeys(frequent + spread))
    machine = _machine(found, plain)
    for _ in range(ROUNDS):
        best = _scored(sample.select("toxic", "text"), machine, ["toxic"]).toPandas()
        hit = best[(best["fragment"] != "") & (best["value"] > -1)]
        near = hit[hit["toxic"] == 0].groupby("fragment")["value"].max().sort_values(ascending=False)
        floor = max(0.0, float(best[best["toxic"] == 0]["value"].quantile(0.995)))
        chosen = hit[(hit["toxic"] == 1) & (hit["value"] > floor) & ~hit["fragment"].isin(near.index)].groupby("fragment").size()
        chosen = chosen.sort_values(ascending=False, kind="stable")[:MAX_TELLING]
        found |= {w: float(n) for w, n in chosen.items() if w not in found}
        plain = list(dict.fromkeys([w for w in near.index[:MAX_PLAIN] if w not in found] + plain))
        machine = _machine(found, plain)
    best = _scored(rest.select("toxic", "text"), machine, ["toxic"]).toPandas()
    return _calibrated(machine, best["value"].to_numpy(float), best["toxic"].to_numpy(float))


# ---- scoring ---------------------------------------------------------------------------------------------------


def _scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns `keep` with value and fragment of column text (the last column of docs)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    caches: dict[int, _Cache] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = caches.setdefault(0, _Cache(shared.value))
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                values, best = zip(*_best(part.column(part.num_columns - 1), cache), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values, pa.float64()), pa.array(best, pa.string())], [*keep, "value", "fragment"])

    types = dict(docs.dtypes)
    return arrow_map(docs.select(*keep, "text"), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", value double, fragment string")


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) and the most telling fragment of every row.

    Null and empty texts have no fragment and score as the machine's bias does. Repeated rows and null ids are
    scored like others; other columns are ignored; an empty table gives no rows."""
    machine = train(docs, labels, max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if isinstance(machine, float):
        scored = rows.select("doc_id", F.lit(machine).alias("score"), F.lit("").alias("fragment"))
    else:
        exponent = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("value") * machine.slope + machine.shift))
        scored = _scored(rows, machine, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-exponent))).alias("score"), "fragment")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "fragment")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; columns unchanged. Rows of one doc_id are judged by their own texts."""
    machine = train(docs, labels)
    if isinstance(machine, float):
        return docs.where(F.lit(machine < 0.5))
    columns = docs.columns
    rest = docs.select(*columns)
    value_at = _keeping(rest, machine)
    return value_at.select(*columns)


def _keeping(docs: DataFrame, machine: Machine) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                values = np.array([v for v, _ in _best(part.column(at), cache)])
                yield part.filter(pa.array(cache.machine.probability(values) < 0.5))

    return arrow_map(docs, run, docs.schema)
