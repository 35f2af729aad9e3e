"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of five words is hashed once; the top bits of its hash name one of BINS bins, and the least hash of
a bin stands for it. An empty bin takes the value of a bin found by hashing its own number and an attempt
counter until a filled bin is met (optimal densification); after ATTEMPTS misses the filled bin of least hash
under the empty bin's number is taken, which is as uniform and needs no further attempts. The low BITS bits of
each bin are packed into 64-bit words. Likeness is the share of equal bins, corrected for the 1 in 2**BITS of
unequal bins that agree by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
PER_WORD = 64 // BITS
WIDTH = 5
ATTEMPTS = 8
SPACE = " \t\n\x0b\x0c\r"
LOWEST = -(1 << 63)


def _bin(h: Column) -> Column:
    """The bin of a hash, so numbered that sorted hashes are in bin order."""
    return F.shiftright(h, 64 - BIN_BITS) + BINS // 2


def _probe(j: Column, attempt: int) -> Column:
    return F.pmod(F.xxhash64(j, F.lit(attempt)), F.lit(BINS)).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: the packed words (array of long) of the fingerprint of column `text`, an empty
    array for texts without words or null. Words are what white space separates, lower-cased; fewer than five
    words are one shingle."""
    words, hashes, least, filled = (f"_{out}_{k}" for k in ("words", "hashes", "least", "filled"))
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE))
    df = df.withColumn(words, F.when(F.length(trimmed) > 0, F.split(trimmed, r"[ \t\n\x0B\f\r]+")))
    shingle = lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WIDTH)))
    last = F.greatest(F.size(words) - WIDTH, F.lit(0))
    df = df.withColumn(hashes, F.when(F.col(words).isNotNull(), F.sort_array(F.transform(F.sequence(F.lit(0), last), shingle))))
    df = df.withColumn(least, F.filter(F.col(hashes), lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col(hashes), i - 1)))))
    # every filled bin's hash followed by a null for each empty bin up to the next filled one
    null = F.lit(None).cast("bigint")
    gap = lambda h, i: (F.coalesce(_bin(F.get(F.col(least), i + 1)), F.lit(BINS)) - _bin(h) - 1).cast("int")
    spread = F.flatten(F.transform(F.col(least), lambda h, i: F.concat(F.array(h), F.array_repeat(null, gap(h, i)))))
    df = df.withColumn(filled, F.concat(F.array_repeat(null, _bin(F.get(F.col(least), F.lit(0))).cast("int")), spread))
    low = F.lit((1 << BITS) - 1).cast("bigint")

    def value(j: Column) -> Column:
        nearest = F.array_min(F.transform(F.col(least), lambda h: F.xxhash64(j, _bin(h)).bitwiseAND(F.lit(~((1 << BITS) - 1)).cast("bigint")).bitwiseOR(h.bitwiseAND(low))))
        return F.coalesce(F.get(F.col(filled), j), *(F.get(F.col(filled), _probe(j, k)) for k in range(ATTEMPTS)), nearest).bitwiseAND(low)

    one = lambda g: F.aggregate(F.sequence(F.lit(0), F.lit(PER_WORD - 1)), F.lit(0).cast("bigint"), lambda acc, i: F.shiftleft(acc, BITS).bitwiseOR(value(g * PER_WORD + i)))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), one)
    df = df.withColumn(out, F.when(F.col(least).isNotNull(), packed).otherwise(F.array().cast("array<bigint>")))
    return df.drop(words, hashes, least, filled)


def as_text(words: Column) -> Column:
    """The packed words in hexadecimal; empty for documents without words."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two documents; of two without words 1, of one without words 0."""
    ones = int("0001" * PER_WORD, 2)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):  # each bin's lowest bit tells whether any of its BITS bits differ
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(ones).cast("bigint"))).cast("bigint")

    chance = 1 / (1 << BITS)
    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    share = F.lit(1.0) - unequal / F.lit(float(BINS))
    corrected = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with `bucket`: ranges of `key` of about equal counts, found by two short searches a row."""
    cuts = rows.select(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 20 * buckets) if buckets > 1 else F.lit(None)).first()[0]
    cuts = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    if not groups:
        return rows.withColumn("bucket", F.lit(0))
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("key")))
    longs = lambda values: F.array(*(F.lit(v).cast("bigint") for v in values))
    coarse = F.greatest(below(longs([g[0] for g in groups])) - 1, F.lit(0))
    rows = rows.withColumn("_coarse", coarse)
    return rows.withColumn("bucket", F.col("_coarse") * step + below(F.get(F.array(*map(longs, groups)), F.col("_coarse")))).drop("_coarse")


def with_next(rows: DataFrame, carried: list[str], buckets: int) -> DataFrame:
    """rows (key: long not null, tie, and the columns carried) with next_<c> of the row that follows by key
    descending, then tie; the first row follows the last. Rows are dealt by ranges of key; the first row of each
    range also visits the range that ends before it, so no window spans more than one range."""
    rows = _bucketed(rows, buckets)
    tops = rows.groupBy("bucket").agg(F.max("key").alias("top"))
    order = Window.orderBy("bucket")  # one row a bucket
    tops = tops.select(F.col("top").alias("key"), F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_visits"))
    rows = rows.join(F.broadcast(tops), "key", "left")
    seats = F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("_visits").alias("at"), F.lit(1).alias("guest")))
    rows = rows.withColumn("_seat", F.explode(F.filter(seats, lambda s: s["at"].isNotNull())))
    rows = rows.select("key", "tie", *carried, F.col("_seat.at").alias("bucket"), F.col("_seat.guest").alias("guest"))
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "tie")
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("guest = 0").drop("bucket", "guest")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Null texts are empty. The next document is the one with the next smaller doc_id (ties by a hash of the text, null
    ids last); after the last comes the first, so a single row is its own next. The edited text has the last
    floor(n_chars / 3) code points replaced by the first as many, or all, of the next text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    rows = rows.select("doc_id", "body", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.xxhash64("body").alias("tie"))
    rows = with_fingerprint(rows, "body", "print")
    rows = with_next(rows, ["doc_id", "body", "print"], 8 * partitions(docs.sparkSession)).drop("tie", "next_doc_id")
    rows = rows.withColumn("n_chars", F.char_length("body").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("body", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_body", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_fingerprint(rows, "edited", "edited_print")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
