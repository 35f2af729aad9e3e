"""Detection on series with missing weeks against least squares on each series' own weeks."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import numerics
from metricloom.operators import detect, lattice, panel
from metricloom.queries import QUERIES

KEYS = ["level", "region", "product_line", "channel", "segment", "metric"]


def plain(weeks, values, least=60):
    """Residuals and the last forecast, fitted on calendar time by stacked least squares with a ridge."""
    n, have = weeks[-1] + 1, len(weeks)
    seasonal = have >= least
    design = lambda t: [1.0, t / n, *(f(2 * math.pi * k * t / 52) for k in ((1, 2, 3) if seasonal else ()) for f in (math.sin, math.cos))]
    p = len(design(0))
    held = min(3, max(have // 10, 1))
    held = 1 if have - held < p + 6 else held
    before = have - held
    cal = min(max(round(0.4 * before), 8), before - p - 4)
    base = before - cal if cal >= 8 else before

    def fit(rows):
        x, y = np.array([design(t) for t in weeks[:rows]]), np.array(values[:rows])
        penalty = 1e-6 * max(float((x * x).sum()), 1.0) / p
        beta, *_ = np.linalg.lstsq(np.vstack([x, math.sqrt(penalty) * np.eye(p)]), np.append(y, np.zeros(p)), rcond=None)
        return lambda t: float(np.array(design(t)) @ beta)

    first, last = fit(base), fit(before)
    start = base if cal >= 8 else 0
    return [values[k] - first(weeks[k]) for k in range(start, before)], last(weeks[-1])


@pytest.mark.parametrize("have, n", [(12, 30), (25, 26), (60, 61), (75, 150), (140, 150), (33, 200)])
def test_gapped_forecasts_equal_least_squares(have, n):
    rng = np.random.default_rng(have)
    rows, weeks = [], []
    for _ in range(7):
        own = sorted({0, n - 1, *(rng.choice(np.arange(1, n - 1), have - 2, replace=False).tolist())})
        y = np.full(n, np.nan)
        y[own] = 100 + 0.3 * np.array(own) + 10 * np.sin(2 * np.pi * np.array(own) / 52) + rng.normal(0, 2, have)
        rows.append(y)
        weeks.append(own)
    f = numerics.gapped_forecasts(np.stack(rows), have)
    for k, own in enumerate(weeks):
        residuals, forecast = plain(own, rows[k][own].tolist())
        assert np.allclose(f.residuals[k], residuals, rtol=1e-7, atol=1e-6) and f.forecast[k] == pytest.approx(forecast, rel=1e-7)
        assert f.actual[k] == rows[k][-1]


def test_without_gaps_time_is_the_place(spark, sf_dir):
    full = np.random.default_rng(1).normal(10, 1, (4, 90))
    split, f = numerics.split_of(90), numerics.gapped_forecasts(full, 90)
    assert np.allclose(f.residuals, numerics.residuals_of(full, split)) and np.allclose(f.forecast, numerics.forecasts_of(full, split)[:, -1])


def test_findings_on_the_lattice(spark, sf_dir):
    long = lattice.long_metrics(lattice.lattice(panel.panel_of(spark, sf_dir)), ["revenue", "delivery_sla_pct"])
    got = {tuple(map(str, (r[k] for k in KEYS))): r for r in detect.series_findings(long, calendar=True).collect()}
    frame, gaps = long.toPandas(), 0
    for key, own in frame.groupby(KEYS, dropna=False):
        own = own.sort_values("week")
        weeks = [(w - own["week"].iloc[0]).days // 7 for w in own["week"]]
        name = tuple("None" if v in ("nan", "<NA>") else v for v in map(str, key))
        if name not in got:
            continue
        r = got[name]
        residuals, forecast = plain(weeks, own["value"].tolist())
        gaps += len(weeks) != weeks[-1] + 1
        assert r["n_history"] == len(weeks) and r["n_calibration"] == len(residuals)
        assert r["forecast"] == pytest.approx(forecast, rel=1e-5, abs=1e-6)
        p = (1 + sum(abs(x) >= abs(r["deviation"]) for x in residuals)) / (len(residuals) + 1)
        assert r["p_method"] == "tail" or r["p_value"] == pytest.approx(p)
    assert gaps > 10 and len(got) == detect.series_findings(long).count()


def test_query_differs_only_where_weeks_are_missing(spark, sf_dir):
    both = [{tuple(map(str, (r[k] for k in KEYS))): r for r in QUERIES[q](spark, sf_dir).collect()} for q in ("forecast_findings", "calendar_findings")]
    assert both[0].keys() == both[1].keys()
    changed = sum(abs(both[0][k]["forecast"] - both[1][k]["forecast"]) > 1e-9 for k in both[0])
    assert 0 < changed


def test_week_on_week_needs_the_week_before(spark):
    first = dt.date(2023, 1, 1)
    rows = [(0, "r", "p", "c", "s", first + dt.timedelta(weeks=w), m, 10.0 + w % 3) for m, lost in (("a", 38), ("b", 20)) for w in range(40) if w != lost]
    df = spark.createDataFrame(rows, "level int, region string, product_line string, channel string, segment string, week date, metric string, value double")
    found = {r["metric"]: r for r in detect.series_findings(df, calendar=True).withColumn("gone", F.col("wow_pct").isNull()).collect()}
    assert found["a"]["gone"] and not found["b"]["gone"] and found["a"]["n_history"] == 39


def test_tails_of_many_rows_equal_one_by_one():
    rng = np.random.default_rng(2)
    residuals, score = rng.standard_t(3, (300, 64)), rng.standard_t(2, 300) * 4
    p, tail = numerics.tail_p_values(residuals, score)
    for k in range(300):
        one, kind = numerics.tail_p_value(residuals[k], float(score[k]))
        assert p[k] == pytest.approx(one, rel=1e-9) and tail[k] == (kind == "tail")
    assert 20 < tail.sum() < 300
