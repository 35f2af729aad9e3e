"""Overlapping intervals against all pairs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from metricloom.operators import intervals, policy
from metricloom.queries import QUERIES


def plain(rows, share):
    out = set()
    for (g, a, al, ah), (h, b, bl, bh) in itertools.combinations([r for r in rows if None not in r[1:] and r[3] > r[2]], 2):
        if g == h and a != b:
            overlap = (min(ah, bh) - max(al, bl)) / (max(ah, bh) - min(al, bl))
            if overlap > share:
                out.add((g, min(a, b), max(a, b), round(overlap, 9)))
    return out


def some(kind, n=160):
    rng = random.Random(kind)
    rows = []
    for k in range(n):
        if kind == "one place":
            low, length = rng.choice([0.0, 1.0]), rng.choice([50.0, 51.0, 55.0])
        elif kind == "scales":
            length = 10 ** rng.uniform(-6, 6)
            low = rng.uniform(-2, 2) * length
        else:
            low = float(rng.randint(-30, 30))
            length = float(rng.randint(-1, 12))
        rows.append((rng.choice([None, "x", "y"]), k, low, low + length))
    return [*rows, ("x", None, 0.0, 1.0), ("x", 1000, None, 1.0), ("x", 1001, 0.0, None), ("y", 1002, 5.0, 5.0)]


@pytest.mark.parametrize("kind", ["one place", "scales", "whole numbers"])
@pytest.mark.parametrize("share", [0.6, 0.25, 0.9])
def test_pairs_equal_all_pairs(spark, kind, share):
    rows = some(kind)
    df = spark.createDataFrame(rows, "g string, id long, low double, high double")
    for crowded in (intervals.CROWDED, 3):
        got = [(r["g"], r["first"], r["second"], round(r["overlap"], 9)) for r in intervals.overlapping(df, share, ["g"], crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, share)
    alone = [(r["first"], r["second"]) for r in intervals.overlapping(df, share).collect()]
    assert len(alone) == len(set(alone)) and set(alone) == {p[1:3] for p in plain([(0, *r[1:]) for r in rows], share)}


def test_plans_have_no_cross_join(spark):
    effects = spark.createDataFrame([("a", 0.0, 10.0), ("b", 1.0, 9.0), ("c", 40.0, 50.0)], "id string, low double, high double")
    df = policy.overlaps(effects)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert [tuple(r) for r in df.collect()] == [("a", "b", 0.8)] and policy.overlaps(effects.limit(0)).count() == 0
    with pytest.raises(ValueError):
        intervals.overlapping(effects, 1.0)


def test_crowded_cells_are_split(spark, sf_dir):
    rows = spark.range(3000).select(F.col("id"), F.lit(0.0).alias("low"), (F.lit(10.0) + F.col("id") % 2 * 1000).alias("high"))
    found = intervals.overlapping(rows.where("id < 60"), crowded=7)
    assert found.count() == 2 * (30 * 29 // 2)
    assert QUERIES["shipping_overlaps"](spark, sf_dir).count() > 0
