"""Pairs of intervals that overlap by more than a share of their union, without comparing all with all.

Two such intervals are nearly as long as each other and have their middles close together: with a share of s, the
shorter is longer than s times the longer, and the middles are at most (1 - s) / 2s of the shorter apart. So lengths
fall into classes, each 1 / s times as long as the one before, and middles into cells as wide as that distance for the
longest of the class. An interval lies in one cell of its own class, and looks for others in three cells of its class
and of the next longer one: an equi-join on (group, class, cell) in which every pair meets once. Cells that many
intervals share are split: those that lie in them are spread over parts by a hash, and those that look visit each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, CROWDED = 0.60, 2000


def overlapping(intervals: DataFrame, share: float = SHARE, by: Sequence[str] = (), crowded: int = CROWDED) -> DataFrame:
    """by, first, second (ids, first < second) and overlap of all pairs of intervals (id, low, high) of a group that
    overlap by more than `share` of their union. ids are distinct in a group; intervals with a null end or id, or without
    length, overlap with none; null groups are a group. Cells of more than `crowded` intervals are split."""
    if not 0 < share < 1:
        raise ValueError("share lies between 0 and 1")
    step = (1 / share) * (1 + 1e-9)  # a little more, so that rounding takes no pair more than one class apart
    rows = intervals.select(*by, "id", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).where("id IS NOT NULL AND high > low")
    rows = rows.withColumn("class", F.floor(F.log(F.col("high") - F.col("low")) / math.log(step)).cast("int"))
    width = lambda c: F.pow(F.lit(step), c + 1) * ((1 - share) / (2 * share) * (1 + 1e-9))
    cell = lambda c: F.floor((F.col("low") + F.col("high")) / 2 / width(c))
    held = rows.withColumn("cell", cell(F.col("class")))
    key = [*(F.coalesce(F.xxhash64(*by), F.lit(0)).alias("_g") for _ in by[:1]), "class", "cell"]
    names = [*(["_g"] if by else []), "class", "cell"]
    full = held.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded)
    full = full.select(*names, F.ceil(F.col("_n") / crowded).cast("int").alias("_parts"))
    lying = held.select(*key, *(F.col(c).alias(f"_b_{c}") for c in by), F.col("id").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    lying = lying.join(full, names, "left").withColumn("_part", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    looking = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_up")).withColumn("class", F.col("class") + F.col("_up"))
    looking = looking.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_at")).withColumn("cell", cell(F.col("class")) + F.col("_at"))
    looking = looking.select(*key, *(F.col(c).alias(f"_a_{c}") for c in by), F.col("id").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), "_up")
    looking = looking.join(full, names, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1))).drop("_parts")
    met = looking.join(lying, [*names, "_part"]).where("_up = 1 AND a <> b OR _up = 0 AND a < b")
    for c in by:
        met = met.where(F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")))
    shared = F.least("ah", "bh") - F.greatest("al", "bl")
    overlap = shared / (F.greatest("ah", "bh") - F.least("al", "bl"))
    found = met.withColumn("overlap", overlap).where(F.col("overlap") > share)
    return found.select(*(F.col(f"_a_{c}").alias(c) for c in by), F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "overlap")
