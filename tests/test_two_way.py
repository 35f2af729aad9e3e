"""Two-way effects against least squares with dummies, balanced and not, connected and not."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import causal, two_way


def by_dummies(rows):
    units, weeks = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[r[3], *(float(r[0] == u) for u in units), *(float(r[1] == w) for w in weeks)] for r in rows])
    y = np.array([r[2] for r in rows])
    dummies = x[:, 1:]
    rank = np.linalg.matrix_rank(dummies)
    d = x[:, 0] - dummies @ np.linalg.lstsq(dummies, x[:, 0], rcond=None)[0]
    e = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
    beta = d @ e / (d @ d)
    free = len(rows) - rank - 1
    return beta, np.sqrt((e - beta * d) @ (e - beta * d) / free / (d @ d)), len(rows), free


def panel(units, weeks, share, seed, halves=False):
    rng = np.random.default_rng(seed)
    first = dt.date(2020, 1, 5)
    rows, effect = [], rng.normal(0, 2, weeks)
    for u in range(units):
        own = rng.normal(0, 3)
        for w in range(weeks):
            if halves and (u % 2) != (w >= weeks // 2):  # two components: no unit has weeks of both halves
                continue
            if rng.random() < share or w == u % weeks:
                late = w % (weeks // 2) >= weeks // 4 if halves else w >= weeks // 2
                d = float(u % 3 == 0 and late)
                rows.append((f"u{u}", first + dt.timedelta(weeks=w), float(own + effect[w] + 0.5 * d + rng.normal(0, 0.3)), d))
    return rows


SHAPES = [(2, 20, 1.0), (3, 50, 1.0), (5, 100, 1.0), (5, 114, 1.0), (5, 114, 0.8), (30, 160, 1.0), (30, 160, 0.5), (12, 70, 0.3)]


@pytest.mark.parametrize("units, weeks, share", SHAPES)
@pytest.mark.parametrize("direct", [True, False])
def test_effects_equal_least_squares_with_dummies(spark, units, weeks, share, direct):
    rows = panel(units, weeks, share, units * weeks)
    df = spark.createDataFrame(rows, "unit string, week date, y double, d double")
    got = two_way.two_way(df, two_way.DIRECT_SETS if direct else 0).first()
    beta, se, n, free = by_dummies(rows)
    assert (got["n"], got["free"]) == (n, free)
    assert got["estimate"] == pytest.approx(beta, abs=1e-9, rel=1e-9) and got["se"] == pytest.approx(se, abs=1e-9, rel=1e-9)


@pytest.mark.parametrize("direct", [True, False])
def test_components_count_in_the_rank(spark, direct):
    rows = panel(20, 40, 0.6, 3, halves=True)
    got = two_way.two_way(spark.createDataFrame(rows, "unit string, week date, y double, d double"), two_way.DIRECT_SETS if direct else 0).first()
    beta, se, n, free = by_dummies(rows)
    assert (got["n"], got["free"]) == (n, free) and got["estimate"] == pytest.approx(beta, abs=1e-9) and got["se"] == pytest.approx(se, abs=1e-9)


def test_odd_panels(spark):
    schema = "unit string, week date, y double, d double"
    day = dt.date(2024, 1, 7)
    assert tuple(two_way.two_way(spark.createDataFrame([], schema)).first()) == (None, None, 0, 0)
    same = [(u, day + dt.timedelta(weeks=w), 1.0 * w, float(u == "a")) for u in "ab" for w in range(5)]
    got = two_way.two_way(spark.createDataFrame(same, schema)).first()
    assert got["estimate"] is None and got["n"] == 10  # d is a unit's effect
    gaps = [(u, w, None if k == 3 else y, d) for k, (u, w, y, d) in enumerate(panel(6, 30, 1.0, 1))] + [(None, day, 1.0, 0.0)]
    assert two_way.two_way(spark.createDataFrame(gaps, schema)).first()["n"] == 6 * 30 - 1
    with pytest.raises(ValueError, match="several rows"):
        two_way.two_way(spark.createDataFrame([*same, same[0]], schema))


def test_did_of_many_units_takes_a_condition(spark):
    rows = [(f"{u[1:]}|x", w, y, d) for u, w, y, d in panel(60, 80, 0.4, 9)]
    start = sorted({r[1] for r in rows})[40]
    series = spark.createDataFrame([r[:3] for r in rows], "unit string, week date, rate double")
    on = F.split_part("unit", F.lit("|"), F.lit(1)).cast("int") % 3 == 0
    got = causal.did(series, on, F.lit(start)).first()
    kept = [(u, w, y, float(int(u.split("|")[0]) % 3 == 0 and w >= start)) for u, w, y, _ in rows if w >= start - dt.timedelta(weeks=52)]
    beta, se, n, free = by_dummies(kept)
    assert (got["n"], got["free"]) == (n, free) and got["estimate"] == pytest.approx(beta, abs=1e-9) and got["se"] == pytest.approx(se, abs=1e-9)


def test_no_list_of_rows_is_collected():
    import inspect

    assert "collect_list" not in inspect.getsource(two_way) and "toPandas" not in inspect.getsource(causal.did)
