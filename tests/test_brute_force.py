"""Queries that SQL cannot express against plain versions, and plans that must not gather rows in one task."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import re
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import numerics, running
from metricloom.operators import attribution, causal, detect, graph, lattice, narrative, panel, telemetry, topics
from metricloom.queries import QUERIES, START
from metricloom.sources import tables

KEYS = ["level", "region", "product_line", "channel", "segment", "metric"]


def plain_fit(y, rows):
    """Ridge forecasts of all weeks, fitted on the first rows, from the definition."""
    n = len(y)
    x = [[1.0, t / n, *(f(2 * math.pi * k * t / 52) for k in ((1, 2, 3) if n >= 60 else ()) for f in (math.sin, math.cos))] for t in range(n)]
    p = len(x[0])
    gram = [[sum(x[t][i] * x[t][j] for t in range(rows)) for j in range(p)] for i in range(p)]
    penalty = 1e-6 * max(sum(gram[i][i] for i in range(p)), 1.0) / p
    beta = np.linalg.solve(np.array(gram) + penalty * np.eye(p), np.array([sum(x[t][i] * y[t] for t in range(rows)) for i in range(p)]))
    return [sum(x[t][i] * beta[i] for i in range(p)) for t in range(n)], p


def plain_finding(y):
    n, (_, p) = len(y), plain_fit(y, len(y))
    held = min(3, max(n // 10, 1))
    held = 1 if n - held < p + 6 else held
    before = n - held
    cal = min(max(round(0.4 * before), 8), before - p - 4)
    base = before - cal if cal >= 8 else before
    r = [abs(y[t] - plain_fit(y, base)[0][t]) for t in range(base if cal >= 8 else 0, before)]
    alpha = 0.10
    if len(r[-60:]) >= 4:
        recent = r[-60:]
        for i in range(max(len(recent) // 3, 3), len(recent)):
            miss = recent[i] > np.quantile(recent[:i], min(max(1 - alpha, 0.01), 0.999))
            alpha = min(max(alpha + 0.05 * (0.10 - miss), 0.005), 0.5)
    k, m = math.ceil((len(r) + 1) * (1 - alpha)), len(r)
    half = sorted(r)[k - 1] if k <= m else max(r) * numerics.student_ppf(1 - alpha / 2, m - 1) / NormalDist().inv_cdf(1 - alpha / 2) * math.sqrt((m + 1) / m)
    forecast = plain_fit(y, before)[0][-1]
    score = abs(y[-1] - forecast)
    value, edge = (1 + sum(x >= score for x in r)) / (m + 1), np.quantile(r, 0.8)
    over = np.array([x - edge for x in r if x > edge])
    if score > edge and len(over) >= 10 and value <= 3 / (m + 1):
        shape, scale = numerics.pareto_fit(over)
        value = min(max(len(over) / m * (1 + shape * (score - edge) / scale) ** (-1 / shape) if abs(shape) >= 1e-9 and 1 + shape * (score - edge) / scale > 0 else len(over) / m * math.exp(-(score - edge) / scale) if abs(shape) < 1e-9 else 0.0, 1e-12), 1.0)
    own = (0, 0)
    if m >= 16 and cal >= 8:
        first, second = r[: m // 2], r[m // 2 :]
        k = math.ceil((len(first) + 1) * 0.9)
        width = sorted(first)[k - 1] if k <= len(first) else max(first) * numerics.student_ppf(0.95, len(first) - 1) / NormalDist().inv_cdf(0.95) * math.sqrt((len(first) + 1) / len(first))
        own = (sum(x <= width for x in second), len(second))
    return {"forecast": forecast, "lo": forecast - half, "hi": forecast + half, "adapted_alpha": alpha, "p_value": value, "n_calibration": m, "hits": own[0], "holdouts": own[1]} if m >= 6 else None


def test_findings_and_their_coverage_equal_a_plain_version(spark, sf_dir):
    p = panel.panel_of(spark, sf_dir)
    long = lattice.long_metrics(lattice.lattice(p), ["revenue", "cancellation_rate", "delivery_sla_pct", "ticket_volume"]).toPandas()
    last, want = long["week"].max(), {}
    for key, own in long.groupby(KEYS, dropna=False):
        y = own.sort_values("week")["value"].tolist()
        if len(y) >= 10 and own["week"].max() == last and np.std(y) > 1e-8 and (one := plain_finding(y)):
            want[tuple(map(str, key))] = one
    found = QUERIES["forecast_findings"](spark, sf_dir)
    got = found.toPandas()
    place = {tuple(str(math.nan) if v is None else str(v) for v in k): r for k, r in zip(detect.series_findings(lattice.long_metrics(lattice.lattice(p), ["revenue", "cancellation_rate", "delivery_sla_pct", "ticket_volume"])).select(*KEYS).toPandas().itertuples(index=False), itertools.count(), strict=False)}
    assert len(want) == len(got) == len(place)
    raw = detect.series_findings(lattice.long_metrics(lattice.lattice(p), ["revenue", "cancellation_rate", "delivery_sla_pct", "ticket_volume"])).toPandas()
    norm = lambda k: tuple("none" if v in ("nan", "None", "<NA>") else v for v in map(str, k))
    want = {norm(k): v for k, v in want.items()}
    for r in raw.to_dict("records"):
        one = want[norm(r[c] for c in KEYS)]
        for name, value in one.items():
            assert r[name] == pytest.approx(value, rel=1e-6, abs=1e-9), (name, r)
    pvalues = np.sort(got["p_value"].to_numpy())
    q = np.minimum.accumulate((pvalues * len(pvalues) / np.arange(1, len(pvalues) + 1))[::-1])[::-1]
    assert np.allclose(got.sort_values("p_value")["q_value"], np.minimum(q, 1))
    hits, holdouts = sum(v["hits"] for v in want.values()), sum(v["holdouts"] for v in want.values())
    row = QUERIES["interval_coverage"](spark, sf_dir).first()
    assert row["holdouts"] == holdouts and row["coverage"] == pytest.approx(hits / holdouts, abs=1e-4)


def test_planted_topics_are_found(spark):
    rng = np.random.default_rng(3)
    kinds = ["late delivery courier shipment delay", "price expensive discount charge cost", "login website checkout app crash"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3].split(), 12)) + " the and", "N" if i < 200 else "S") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, region string")
    found, names = topics.topics(docs, 3)
    by = {r["doc_id"]: r["topic"] for r in found.collect()}
    assert len({tuple(sorted({by[i] for i in range(k, 240, 3)})) for k in range(3)}) == 3
    assert {r["node"] for r in topics.topic_nodes(names).collect()} == {"delivery_sla", "price_change", "app_usability"}
    assert topics.of_slice(docs, {"region": "N", "segment": "x"}).count() == 200 and topics.of_slice(docs, {"region": "S"}).count() == 40
    assert topics.of_slice(docs.limit(30), {}) is None and [topic_n for topic_n in map(topics.topic_count, (10, 60, 100, 1000))] == [2, 3, 5, 6]


MANY_WEEKS = "/root/testdata/sf0.01"  # the smallest tables on which all regions have 20 weeks


def units(spark, sf_dir):
    return causal.unit_series(tables.measured(tables.order_lines(spark, sf_dir)))


def wide_of(spark, sf_dir):
    rows = causal._windows(units(spark, sf_dir), F.lit(START).cast("date")).toPandas()
    wide = rows.pivot(index="week", columns="unit", values="rate").dropna()
    return wide, rows.groupby("week")["post"].max().reindex(wide.index).to_numpy(bool)


def test_synthetic_controls_beat_a_grid(spark):
    sf_dir = MANY_WEEKS
    wide, post = wide_of(spark, sf_dir)
    scaled = wide / wide[~post].mean()
    ratios = {}
    for unit in wide.columns:
        donors = [c for c in wide.columns if c != unit]
        x, y = scaled[donors].to_numpy(), scaled[unit].to_numpy()
        grid = [np.array([*c, 20 - sum(c)]) / 20 for c in itertools.product(range(21), repeat=len(donors) - 1) if sum(c) <= 20]
        rmse = lambda w: float(np.sqrt(((y - x @ w)[~post] ** 2).mean()))  # noqa: B023, E731
        best = min(grid, key=rmse)
        found = causal.synthetic_controls(units(spark, sf_dir), [unit], F.lit(START).cast("date")).first()
        w = np.array([found["weights"][d] for d in donors])
        assert found["pre_rmse"] == pytest.approx(rmse(w)) and found["pre_rmse"] <= rmse(best) + 1e-9 and abs(w.sum() - 1) < 1e-9 and w.min() >= 0
        assert found["gap_pct"] == pytest.approx(100 * float((y - x @ w)[post].mean()))
        ratios[unit] = abs(float((y - x @ w)[post].mean())) / rmse(w)
    one = QUERIES["synthetic_control"](spark, sf_dir).first()
    assert one["unit"] == "ASIA" and one["gap_ratio"] == pytest.approx(ratios["ASIA"])
    placebo = QUERIES["placebo_inference"](spark, sf_dir).first()
    rank = 1 + sum(v >= ratios["ASIA"] for u, v in ratios.items() if u != "ASIA")
    assert (placebo["rank"], placebo["n_placebos"]) == (rank, len(ratios) - 1) and placebo["p_value"] == pytest.approx(rank / len(ratios))


def test_refutations_of_a_planted_effect(spark):
    rng = np.random.default_rng(8)
    weeks = [dt.date(2023, 1, 1) + dt.timedelta(weeks=k) for k in range(110)]
    common = rng.normal(0, 0.01, len(weeks))
    rows = [(u, w, 0.2 + float(common[k] + rng.normal(0, 0.001)) + (0.1 if u == "A" and k >= 100 else 0)) for u in "ABCDEF" for k, w in enumerate(weeks)]
    found = {r["test"]: (r["moved"], r["passed"]) for r in causal.refutations(spark.createDataFrame(rows, "unit string, week date, rate double"), "A", str(weeks[100])).collect()}
    assert set(found) == {"placebo_in_time", "random_donor", "leave_donors_out"} and all(ok for _, ok in found.values()) and max(m for m, _ in found.values()) < 0.1
    slow = [(u, w, v + (0.05 * max(0, k - 70) / 30 if u == "A" else 0)) for k, w in enumerate(weeks) for u, w2, v in rows if w2 == w]
    moved = {r["test"]: r["passed"] for r in causal.refutations(spark.createDataFrame(slow, "unit string, week date, rate double"), "A", str(weeks[80])).collect()}
    assert not moved["placebo_in_time"] or moved["random_donor"]
    assert QUERIES["refutations"](spark, MANY_WEEKS).count() == 3


def test_two_way_effects_and_trends_of_the_tables(spark, sf_dir):
    rows = units(spark, sf_dir).toPandas()
    start = dt.date.fromisoformat(START)
    own = rows[rows["week"] >= start - dt.timedelta(weeks=52)].dropna(subset=["rate"])
    names, weeks = sorted(own["unit"].unique()), sorted(own["week"].unique())
    x = np.array([[float(u == "ASIA" and w >= start), *(float(u == o) for o in names), *(float(w == o) for o in weeks[1:])] for u, w in zip(own["unit"], own["week"], strict=True)])
    beta, *_ = np.linalg.lstsq(x, own["rate"].to_numpy(), rcond=None)
    error, free = own["rate"].to_numpy() - x @ beta, len(own) - np.linalg.matrix_rank(x)
    got = QUERIES["did_twfe_all_weeks"](spark, sf_dir).first()
    assert (got["n"], got["free"]) == (len(own), free) and got["estimate"] == pytest.approx(beta[0], abs=1e-5)
    assert got["se"] == pytest.approx(math.sqrt(error @ error / free * np.linalg.inv(x.T @ x)[0, 0]), abs=1e-5)
    trend = QUERIES["parallel_trends"](spark, sf_dir).first()
    assert trend["p"] == pytest.approx(2 * numerics.student_sf(abs(trend["t"]), trend["n"] - 2), abs=1e-4) and trend["parallel"] == (trend["n"] > 10 and trend["p"] > 0.05)


def test_one_pass_panel_equals_the_join_of_sources(spark, sf_dir):
    key = ["week", "region", "product_line", "channel", "segment"]
    frames = [f.toPandas().sort_values(key).reset_index(drop=True) for f in (panel.panel_of(spark, sf_dir), panel.align(tables.sources(spark, sf_dir)))]
    assert len(frames[0]) == len(frames[1])
    for c in frames[1].columns:
        a, b = frames[0][c], frames[1][c]
        assert (a == b).all() if c in key else np.allclose(a.astype(float), b.astype(float), equal_nan=True), c
    plan = panel.panel_of(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 1
    at = tables.last_week(spark, sf_dir)
    assert at == frames[0]["week"].max()
    assert panel.panel_of(spark, sf_dir, at - dt.timedelta(days=20)).agg(F.min("week")).first()[0] >= at - dt.timedelta(days=21)
    pushed = tables.order_lines(spark, sf_dir, at)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in pushed


def test_running_sums(spark):
    rng = np.random.default_rng(5)
    v = np.unique(np.concatenate([rng.uniform(0, 1, 300), 10.0 ** rng.uniform(-12, 0, 200), [0.0]]))
    df = spark.createDataFrame([(float(x), float(i % 7)) for i, x in enumerate(v)], "x double, n double")
    place = running.log_bin(F.col("x"), 8)
    up = running.with_running_sum(df, place, F.col("x"), F.col("n"), "s", "t").toPandas().sort_values("x")
    n = np.arange(len(v)) % 7
    assert np.allclose(up["s"], np.cumsum(n)) and (up["t"] == n.sum()).all()
    down = running.with_running_sum(df, place, F.col("x"), F.col("n"), "s", "t", descending=True, inclusive=False).toPandas().sort_values("x")
    assert np.allclose(down["s"], n.sum() - np.cumsum(n))
    least = running.with_least_from(df, place, F.col("x"), F.col("n") - F.col("x"), "m").toPandas().sort_values("x")
    assert np.allclose(least["m"], np.minimum.accumulate((n - v)[::-1])[::-1])


def test_no_task_sees_all_rows(spark, sf_dir):
    """Windows over all rows are only over bins; the vocabulary is no product with the documents."""
    tests = spark.createDataFrame([(i, 1 / (i + 1)) for i in range(50)], "i int, p_value double")
    leaves = spark.createDataFrame([("a", "b", "c", "d", 1.0, -1.0 - i) for i in range(9)], "region string, product_line string, channel string, segment string, expected double, gap double")
    for df in (detect.benjamini_hochberg(tests, 0.1), attribution.leaves_for_share(leaves)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"Window \[.*", plan):
            assert re.search(r"\], \[_bin#\d+\], \[", spec) or re.search(r"\], \[_bin#\d+ (ASC|DESC)", spec), spec
    plan = QUERIES["grounding_check"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    texts = spark.createDataFrame([(1, "costs 17 and 1,250."), (2, "100 or 99.5"), (3, None)], "case int, text string")
    known = spark.createDataFrame([("17",), ("1250",), ("17",)], "token string")
    assert [(r["case"], r["missing"], r["passed"]) for r in narrative.ungrounded(texts, known).orderBy("case").collect()] == [(1, "", True), (2, "99.5", False), (3, "", True)]
    own = spark.createDataFrame([(2, "99.5")], "case int, token string")
    assert [r["missing"] for r in narrative.ungrounded(texts, own).orderBy("case").collect()] == ["1250,17", "", ""]


def test_two_graphs_in_one_session(spark):
    one, two = (graph.shortest_paths(spark.createDataFrame(e, "src string, dst string")) for e in ([("a", "b")], [("x", "y"), ("y", "z")]))
    assert one.count() == 1 and two.count() == 3


def test_small_sinks(spark, tmp_path):
    tables.write_yaml(str(tmp_path / "x.yaml"), {"b": [1, float("nan")], "a": {"day": dt.date(2024, 1, 7), "name": "é"}})
    assert (tmp_path / "x.yaml").read_text() == "b:\n- 1\n- null\na:\n  day: '2024-01-07'\n  name: é\n"
    tables.write_text(f"file://{tmp_path}/deep/er/y.txt", "done")
    assert (tmp_path / "deep/er/y.txt").read_text() == "done"
    none = telemetry.summary(spark.createDataFrame([], telemetry.STAGE), spark.createDataFrame([], telemetry.CALL), {}, 2.0).first()
    assert (none["latency_ms"], none["model_share"], none["cost"]) == (0.0, 0.0, 0.0)
