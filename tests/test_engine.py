"""Units of the metric engine: numerics, detection, policy, decisions, narratives, governance, telemetry, streaming."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import numerics
from metricloom.operators import causal, decision, detect, graph, narrative, panel, policy, telemetry
from metricloom.sources import contracts, tables
from metricloom.streaming import weekly


def test_student_quantiles():
    assert abs(numerics.student_ppf(0.975, 10) - 2.228139) < 1e-4
    assert abs(numerics.student_sf(2.228139, 10) - 0.025) < 1e-6
    assert abs(numerics.student_ppf(0.95, 1) - 6.313752) < 1e-3


def test_small_calibration_gives_an_invalid_wider_interval():
    r = np.random.default_rng(0).normal(0, 1, 7)
    half, valid = numerics.conformal_quantile(r, 0.10)
    assert valid or half > np.abs(r).max()
    few, ok = numerics.conformal_quantile(r[:5], 0.10)
    assert not ok and few > np.abs(r[:5]).max()
    assert numerics.conformal_quantile(np.zeros(0), 0.1) == (math.inf, False)


def test_coverage_of_held_back_halves():
    rng, hits = np.random.default_rng(1), []
    for _ in range(300):
        x = rng.normal(0, 1, 120)
        half, _ = numerics.conformal_quantile(x[:60], 0.10)
        hits.append((np.abs(x[60:]) <= half).mean())
    assert np.mean(hits) >= 0.88


def test_tail_escapes_the_empirical_floor():
    r = np.random.default_rng(2).normal(0, 1, 60)
    far, how = numerics.tail_p_value(r, 8.0)
    near, plain = numerics.tail_p_value(r, 0.2)
    assert far < 1 / 61 and how == "tail" and near > 0.5 and plain == "empirical"
    assert numerics.tail_p_value(np.zeros(0), 1.0)[0] == 1.0


def test_step_up_matches_its_distributed_form(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([np.full(10, 1e-8), rng.uniform(0.2, 1, 200), [0.5, 0.5, 0.01]])
    keep, q = numerics.benjamini_hochberg(p, 0.10)
    rows = detect.benjamini_hochberg(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p_value double"), 0.10).toPandas().sort_values("i")
    assert np.allclose(rows["q_value"], q) and (rows["survives_fdr"].to_numpy() == keep).all()


def test_level_shift_stays_out_of_the_baseline():
    y = 100 + np.random.default_rng(4).normal(0, 2, 120)
    y[-3:] -= 25
    fit = numerics.fit_forecast(y)
    assert fit["out_of_sample"] and fit["forecast"][-1] > 92 and np.abs(fit["residuals"]).max() < 15
    assert not numerics.fit_forecast(y[:14])["out_of_sample"]


def test_simplex_weights():
    x = np.random.default_rng(5).normal(1, 0.2, (60, 4))
    w = numerics.simplex_weights(x, x @ np.array([0.6, 0.0, 0.4, 0.0]))
    assert np.allclose(w, [0.6, 0, 0.4, 0], atol=1e-3) and abs(w.sum() - 1) < 1e-9


def _lines(spark):
    return spark.createDataFrame([(dt.date(2024, 1, 7), "N", "P", "C", s, 100.0 * k, 10.0, 12.0, 2.0, 5, 4) for k, s in enumerate(("x", "y", None), 1)], "week date, region string, product_line string, channel string, segment string, revenue double, net_units double, gross_orders double, cancellations double, deliveries long, in_time long")


def test_allocation_and_scope(spark):
    p = _lines(spark)
    coarse = spark.createDataFrame([(dt.date(2024, 1, 7), "N", "P", "C", 60)], "week date, region string, product_line string, channel string, tickets int")
    out = panel.allocated(p, coarse, "tickets", "ticket_volume")
    assert sorted(r["ticket_volume"] for r in out.collect()) == [10.0, 20.0, 30.0]
    assert out.schema["ticket_volume"].metadata == {"grain": "imputed"}
    who = contracts.Persona("ops", "manager", ("S",), restricted=("revenue",))
    assert panel.scoped(p, who).count() == 0 and "revenue" not in panel.scoped(p, who).columns


def test_contracts(tmp_path):
    with pytest.raises(KeyError):
        contracts.METRICS.metric("profit")
    assert list(contracts.METRICS.weekly()[1]) == ["nps"]
    f = tmp_path / "m.yaml"
    f.write_text("metrics:\n  sales: {source: w, unit: inr, aggregation: sum, grain: daily, refresh_minutes: 5, tolerance_hours: 2, impact_floor: 1}\nedges: [[a, b]]\n")
    assert contracts.load_catalog(f).edges == (("a", "b"),)
    f.write_text("metrics:\n  sales: {source: w, colour: red}\n")
    with pytest.raises(ValueError, match="colour"):
        contracts.load_catalog(f)
    f.write_text("budget: 5\nconstraints: [{id: A, label: a, blocked_value: 2}]\nlevers: [{id: X, label: x, cost: 1, relieves: [B], authority: vp}]\n")
    with pytest.raises(ValueError, match="B"):
        contracts.load_portfolio(f)


def test_refuses_a_metric_of_coarser_grain(spark):
    with pytest.raises(ValueError, match="never interpolated"):
        detect.detect(_lines(spark), ["nps"])


def test_detection_tests_all_weekly_metrics_of_the_contract(spark, sf_dir):
    from metricloom.operators import lattice
    from metricloom.queries import QUERIES

    rng, rows = np.random.default_rng(7), []
    for k in range(40):
        for r in ("N", "S"):
            for s, share in (("x", 0.25), ("y", 0.75)):
                tickets = float(rng.integers(90, 110)) + (4000 if r == "N" and k == 39 else 0)
                rows.append((dt.date(2024, 1, 7) + dt.timedelta(weeks=k), r, "P", "C", s, 1000 + float(rng.normal(0, 5)), 10.0, 12.0, 1 + float(rng.normal(0, 0.02)), 100, int(rng.integers(93, 97)) - (40 if r == "N" and k == 39 else 0), tickets * share))
    p = spark.createDataFrame(rows, "week date, region string, product_line string, channel string, segment string, revenue double, net_units double, gross_orders double, cancellations double, deliveries long, in_time long, ticket_volume double")
    sums = {r["region"]: float(r["ticket_volume"]) for r in lattice.lattice(p).where("level = 7 AND week = (DATE '2024-01-07' + 273)").collect()}
    assert sums == pytest.approx({r: sum(x[-1] for x in rows if x[1] == r and x[0] == rows[-1][0]) for r in "NS"})
    found = detect.detect(p).toPandas()
    wanted = {"revenue", "cancellation_rate", "delivery_sla_pct", "ticket_volume"}
    assert set(found["metric"]) == wanted
    large = found[(found["level"] == 7) & found["outside_interval"] & found["meets_threshold"]]
    assert set(zip(large["region"], large["metric"], strict=True)) == {("N", "delivery_sla_pct"), ("N", "ticket_volume")}
    assert {r["metric"] for r in QUERIES["forecast_findings"](spark, sf_dir).select("metric").distinct().collect()} == wanted


def test_gates_follow_chains(spark):
    c = contracts.Constraint
    chain = contracts.Portfolio((c("A", "", 1.0), c("B", "", 2.0, ("A",)), c("C", "", 4.0, ("B",))), (contracts.Lever("X", "", 1.0, ("C",), "manager"), contracts.Lever("Y", "", 1.0, ("B",), "manager"), contracts.Lever("Z", "", 1.0, ("A",), "manager")), 2.0)
    values = {r["levers"]: r["value"] for r in decision.bundles(spark, chain).collect()}
    assert values == {"": 0, "X": 0, "Y": 0, "X+Y": 0, "Z": 1, "X+Z": 1, "Y+Z": 3, "X+Y+Z": 7}
    assert decision.best_by_bounds(chain) == (("Y", "Z"), 3.0)


def test_verdict_cascade():
    good = {"path": ["a"], "onset": 5, "start": 4, "did_p": 0.01, "parallel": True, "placebo_p": 0.1, "refutations": {"x": True}}
    assert causal.verdict(good)[0] == "accepted"
    assert causal.verdict(good | {"onset": None})[0] == "inconclusive"
    for change in ({"path": None}, {"start": 6}, {"did_p": 0.5}, {"placebo_p": None}, {"inverted": True}, {"refutations": {"x": False}}):
        assert causal.verdict(good | change)[0] == "rejected"


def test_did_equals_least_squares_with_dummies(spark):
    rng = np.random.default_rng(6)
    weeks = [dt.date(2024, 1, 7) + dt.timedelta(weeks=k) for k in range(40)]
    data = [(u, w, float(k * 0.01 + i + rng.normal(0, 0.1) + (0.5 if u == "A" and k >= 30 else 0))) for i, u in enumerate("ABCD") for k, w in enumerate(weeks)]
    got = causal.did(spark.createDataFrame(data, "unit string, week date, rate double"), "A", F.lit(weeks[30]).cast("date")).first()
    y = np.array([v for *_, v in data])
    x = np.array([[float(u == "A" and w >= weeks[30]), *(float(u == o) for o in "ABCD"), *(float(w == o) for o in weeks[1:])] for u, w, _ in data])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert abs(got["estimate"] - beta[0]) < 1e-5


def test_did_keeps_weeks_that_a_unit_lacks(spark):
    rng = np.random.default_rng(9)
    weeks = [dt.date(2024, 1, 7) + dt.timedelta(weeks=k) for k in range(40)]
    data = [(u, w, float(k * 0.01 + i + rng.normal(0, 0.1) + (0.5 if u == "A" and k >= 30 else 0))) for i, u in enumerate("ABCD") for k, w in enumerate(weeks) if not (u == "D" and k < 25) and not (u == "C" and k % 3 == 0)]
    rows = [*data, ("B", weeks[-1] + dt.timedelta(weeks=1), None)]
    got = causal.did(spark.createDataFrame(rows, "unit string, week date, rate double"), "A", F.lit(weeks[30]).cast("date")).first()
    y = np.array([v for *_, v in data])
    x = np.array([[float(u == "A" and w >= weeks[30]), *(float(u == o) for o in "ABCD"), *(float(w == o) for o in weeks[1:])] for u, w, _ in data])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    error = y - x @ beta
    se = (error @ error / (len(y) - np.linalg.matrix_rank(x)) * np.linalg.inv(x.T @ x)[0, 0]) ** 0.5
    assert got["n"] == len(data) and abs(got["estimate"] - beta[0]) < 1e-5 and abs(got["se"] - se) < 1e-5
    sparse = [("A", w, v) for u, w, v in data if u == "A"] + [("B", w, v) for (u, w, v) in data if u == "B" and w < weeks[5]]
    assert causal.did(spark.createDataFrame(sparse, "unit string, week date, rate double"), "A", F.lit(weeks[30]).cast("date")).first()["estimate"] is None


def test_topics_read_documents_of_all_languages(spark, sf_dir):
    from metricloom.queries import QUERIES

    assert QUERIES["topics_tfidf_kmeans"](spark, sf_dir).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_graph_paths_are_simple(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    found = {(r["src"], r["dst"]): r["path"] for r in graph.shortest_paths(edges).collect()}
    assert found[("a", "c")] == "a>c" and found[("b", "a")] == "b>c>a" and ("a", "a") not in found


def test_feedback_round_trip(spark, tmp_path):
    path = str(tmp_path / "feedback")
    assert tables.read_feedback(spark, path).count() == 0
    tables.append_feedback(spark, path, "hypothesis", "H1", "rejected", "price_change")
    tables.append_feedback(spark, path, "hypothesis", "H1", "confirmed", "price_change")
    with pytest.raises(ValueError):
        tables.append_feedback(spark, path, "hypothesis", "H1", "maybe")
    history = policy.feedback_history(spark.createDataFrame([("H1", "price_change", "accepted")], "id string, node string, verdict string"), tables.read_feedback(spark, path))
    assert history.first()["latest"] == "confirmed" and policy.feedback_conflicts(history).count() == 0
    assert policy.latest_feedback(tables.read_feedback(spark, path)).first()["verdict"] == "confirmed"


def _evidence():
    return {"metric": "revenue", "week": "2024-01-07", "gap": -1234567.0, "gap_pct": -12.5, "mode": "confident", "confidence": 0.63, "slice": "ASIA", "causes": [{"label": "late deliveries", "impact": -900000.0}], "bundle_cost": 6.7e6, "bundle_value": 3.55e6, "regions": {"ASIA": 1.0, "EUROPE": 7.25}, "note": "highest in EUROPE"}


def test_release_and_scrubbing():
    ops, boss = contracts.PORTFOLIO.personas
    regions = ("ASIA", "EUROPE")
    for who in (ops, boss):
        assert narrative.released(_evidence(), who, regions)["passed"]
    own = narrative.released(_evidence(), ops, regions)["evidence"]
    assert "EUROPE" not in str(own) and "EUROPE" in str(narrative.scrubbed(_evidence(), boss, regions))

    class Liar:
        def render(self, evidence, persona):
            return "Revenue fell 99.7%."

    out = narrative.released(_evidence(), boss, regions, Liar())
    assert out["text"] is None and out["missing"] == ["99.7"]
    with pytest.raises(ValueError):
        narrative.ExternalRenderer(None)


def test_telemetry(spark):
    t = telemetry.Telemetry()
    with pytest.raises(RuntimeError), t.stage("a", "io"):
        raise RuntimeError
    with t.stage("b", "io") as info:
        info["rows"] = 3
    t.model_call("render", "m", 10, 5, 1.0, "k")
    t.model_call("render", "m", 10, 5, 1.0, "k")
    assert telemetry.by_kind(t.stage_table(spark)).first()["n"] == 2
    assert telemetry.call_costs(t.call_table(spark), {"m": (1.0, 1.0)}).first()["input_tokens"] == 10


def test_json_has_no_infinities(tmp_path):
    tables.write_json(tmp_path / "x.json", {"a": math.inf, "b": [math.nan, 1.5]})
    assert (tmp_path / "x.json").read_text().count("null") == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1 + k % 25, 3), "click", 1.5) for k in range(60)] + [(5, dt.datetime(2024, 1, 6, 3), "click", 1.5)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    later = str(tmp_path / "in")
    spark.createDataFrame([(999, dt.datetime(2024, 6, 1), "click", 1.0)], schema).coalesce(1).write.mode("append").parquet(later)
    weekly.write_weekly(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "ck"), "60 days").awaitTermination(120)
    batch = weekly.weekly_events(spark.read.parquet(source)).where("week < '2024-02-01'")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_rows_are_observed_without_a_job_of_their_own(spark):
    from metricloom.operators import telemetry

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    counted, seen = telemetry.observed(spark.range(1000).where("id % 3 = 0"))
    assert counted.agg({"id": "max"}).first()[0] == 999 and seen.get["rows"] == 334
    jobs = len(tracker.getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("plain", "")
    spark.range(1000).where("id % 3 = 0").agg({"id": "max"}).first()
    assert jobs == len(tracker.getJobIdsForGroup("plain"))


def test_floors_may_name_their_unit(tmp_path):
    import pytest

    from metricloom.sources.contracts import load_catalog

    def load(floor, unit="unit: pp"):
        text = f"metrics:\n  rate: {{source: s, {unit}, aggregation: mean, grain: weekly, refresh_minutes: 60, tolerance_hours: 24, {floor}}}\nedges: []\n".replace(", ,", ",")
        (tmp_path / "c.yaml").write_text(text)
        return load_catalog(str(tmp_path / "c.yaml")).metric("rate")

    assert (load("impact_floor: 1.5").impact_floor, load("impact_floor_pp: 2").impact_floor) == (1.5, 2.0)
    named = load("impact_floor_pp: 2", "numerator: a")
    assert named.unit == "pp" and named.impact_scale == 100
    for wrong in ("impact_floor_usd: 2", "impact_floor: 1, impact_floor_pp: 2"):
        with pytest.raises(ValueError):
            load(wrong)


def test_causes_without_a_unit():
    from metricloom.operators import causal

    known = {"path": "a>b", "onset": 5, "start": 3, "did_p": 0.01, "parallel": True, "placebo_p": 0.1}
    assert causal.verdict(known | {"unit": "North"})[0] == "accepted" and causal.verdict(known | {"unit": None})[0] == "inconclusive"
