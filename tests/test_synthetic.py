"""Synthetic controls of many units on one Gram matrix against plain solvers on the series themselves."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import numerics
from metricloom.operators import synthetic
from metricloom.queries import QUERIES, START

SF = "/root/testdata/sf0.01"  # the smallest tables on which all nations have 20 weeks


def test_mixtures_are_optimal():
    rng = np.random.default_rng(1)
    for trial in range(40):
        n, t = int(rng.integers(2, 12)), int(rng.integers(3, 40))
        x = rng.normal(1, 0.4, (t, n))
        if trial % 5 == 0:
            x[:, -1] = x[:, 0]  # donors alike
        gram, targets = x.T @ x, np.arange(n)
        barred = np.eye(n, dtype=bool) | (rng.random((n, n)) < 0.2)
        barred[barred.all(axis=1)] = np.eye(n, dtype=bool)[barred.all(axis=1)]
        for times, block in ((lambda w, g=gram: w @ g, lambda k, g=gram: g[np.ix_(k, k)]), (lambda w, x=x: w @ x.T @ x, lambda k, x=x: x[:, k].T @ x[:, k])):
            w = numerics.simplex_mixtures(times, block, gram[targets], barred, np.diag(gram))
            assert np.allclose(w.sum(axis=1), 1) and w.min() >= 0 and (w[barred] == 0).all()
            for k in range(n):
                free = np.flatnonzero(~barred[k])
                other = numerics.simplex_weights(x[:, free], x[:, k])
                loss = lambda v, f, k=k: float(((x[:, k] - x[:, f] @ v) ** 2).sum())
                assert loss(w[k][free], free) <= loss(other, free) + 1e-9


def wide_of(series, start, value="rate", fill=None):
    """Weeks by units of the windows, from the definition."""
    rows = series.toPandas()
    wide = rows.pivot(index="week", columns="unit", values=value).sort_index()
    wide = wide[wide.index >= start - dt.timedelta(weeks=52)]
    if fill is not None:
        wide = wide.fillna(wide[wide.index < start].mean() if fill == "mean" else fill)
    late = [w for w in wide.index if w >= start][:5]
    wide = wide[(wide.index < start) | wide.index.isin(late)].dropna()
    return wide, wide.index >= start


def check(found, wide, post, sample):
    scaled = wide / wide[~post].mean()
    got = {r["unit"]: r for r in found}
    assert set(got) == set(wide.columns)
    for unit in sample:
        donors = [c for c in wide.columns if c != unit]
        x, y = scaled[donors].to_numpy(), scaled[unit].to_numpy()
        w = np.array([got[unit]["weights"][d] for d in donors])
        other = numerics.simplex_weights(x[~post], y[~post], 20_000)
        rmse = lambda w: float(np.sqrt(((y - x @ w)[~post] ** 2).mean()))  # noqa: B023, E731
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and rmse(w) <= rmse(other) + 1e-9
        assert got[unit]["pre_rmse"] == pytest.approx(rmse(w), abs=1e-7) and got[unit]["gap_pct"] == pytest.approx(100 * float((y - x @ w)[post].mean()), abs=1e-7)


def test_all_nations_and_lines_are_placed(spark):
    from metricloom import queries
    from metricloom.operators import causal

    start = dt.date.fromisoformat(START)
    for series, name in ((queries._nations(spark, SF), "placebo_nations"), (causal.unit_series(queries._lines(spark, SF), "product_line").select("unit", "week", "rate"), "placebo_product_lines")):
        wide, post = wide_of(series, start, fill="mean")
        assert (~post).sum() > 40
        found = synthetic.synthetic_controls(series, None, F.lit(start), fill="mean").collect()
        check(found, wide, post, wide.columns)
        ranked = {r["unit"]: (r["rank"], r["p_value"]) for r in QUERIES[name](spark, SF).collect()}
        ratios = {r["unit"]: r["gap_ratio"] for r in found}
        for unit, ratio in ratios.items():
            rank = sum(v >= ratio for v in ratios.values())
            assert ranked[unit] == (rank, pytest.approx(rank / len(ratios)))


def planted(units, weeks=80, gaps=0.0):
    rng = np.random.default_rng(units)
    first = dt.date(2022, 1, 2)
    common = np.cumsum(rng.normal(0, 0.05, (weeks, 3)), axis=0) + 5
    mix = rng.dirichlet([0.5] * 3, units)
    rows = [(f"u{u:03d}", first + dt.timedelta(weeks=w), float(100 * (mix[u] @ common[w]) * (1 + rng.normal(0, 0.002)) * (1.2 if u == 7 and w >= 70 else 1))) for u in range(units) for w in range(weeks) if rng.random() >= gaps]
    return rows, first + dt.timedelta(weeks=70)


@pytest.mark.parametrize("gram_units", [synthetic.GRAM_UNITS, 0])
def test_many_units_with_and_without_a_matrix(spark, gram_units, monkeypatch):
    rows, start = planted(120)
    series = spark.createDataFrame(rows, "unit string, week date, rate double")
    held = synthetic.cases(series, [F.lit(start)], gram_units=gram_units)
    assert (held[0].products is None) == (gram_units == 0)
    plan = spark.createDataFrame([(k, 0, u, []) for k, u in enumerate(held[0].units)], synthetic.PROBLEM).repartition(3)
    found = synthetic.controls(plan, held)
    wide, post = wide_of(series, start)
    check(found.collect(), wide, post, wide.columns[:25])
    first = synthetic.placed(found).orderBy("rank").first()
    assert (first["unit"], first["rank"]) == ("u007", 1) and first["p_value"] == pytest.approx(1 / 120) and first["gap_pct"] == pytest.approx(20, abs=2)


def test_gaps_are_filled_or_left_out(spark):
    rows, start = planted(8, gaps=0.03)
    series = spark.createDataFrame([*rows, ("none", start, None), (None, start, 1.0)], "unit string, week date, rate double")
    for fill in (None, 0.0, "mean"):
        wide, post = wide_of(series.where("unit <> 'none'"), start, fill=fill)
        check(synthetic.synthetic_controls(series.where("unit <> 'none'"), None, F.lit(start), fill=fill).collect(), wide, post, wide.columns)
    assert synthetic.synthetic_controls(series, None, F.lit(dt.date(2021, 1, 1))).count() == 0  # no weeks before
    assert synthetic.synthetic_controls(series.limit(0), None, F.lit(start)).count() == 0
    flat = spark.createDataFrame([(u, dt.date(2022, 1, 2) + dt.timedelta(weeks=w), 0.0 if u == "zero" else float(w % 5 + k)) for k, u in enumerate(("a", "b", "c", "zero")) for w in range(60)], "unit string, week date, rate double")
    found = synthetic.synthetic_controls(flat, None, F.lit(dt.date(2022, 12, 25))).collect()
    assert {r["unit"] for r in found} == {"a", "b", "c"} and all("zero" not in r["weights"] for r in found)


def test_left_out_donors_and_plans(spark):
    rows, start = planted(9)
    series = spark.createDataFrame(rows, "unit string, week date, rate double")
    found = synthetic.synthetic_controls(series, ["u007"], F.lit(start), leave_out=[["u000", "u001"]], noise=0.05).collect()
    assert len(found) == 2 and not {"u000", "u001"} & set(found[1]["weights"]) and all(synthetic.NOISE_UNIT in r["weights"] for r in found)
    plan = synthetic.gram(synthetic.scaled_vectors(synthetic.weekly_vectors(series, [F.lit(start)])), 9)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert list(itertools.islice(synthetic.gram(synthetic.scaled_vectors(synthetic.weekly_vectors(series, [F.lit(start)])), 9).collect(), 1))
