"""The whole analysis of one week: from sources to narratives that may be released, with its artefacts."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numerics import student_sf
from ..operators import attribution, causal, decision, detect, graph, narrative, panel, policy, topics
from ..operators.telemetry import Telemetry, by_kind, observed, registry
from ..sources import tables
from ..sources.contracts import DIMENSIONS, METRICS, PORTFOLIO, Catalog, Portfolio

WINDOW_WEEKS = 10
EVENTS = "id string, label string, node string, unit string, start date, impact_rate double"
#: What external sources say of nodes of the causal graph: how strong in each unit and week, 0 where not active.
FEED = "week date, unit string, node string, label string, intensity double"
LEAST_DOSES = 4


def candidates(events: DataFrame, at: Any, texts: DataFrame | None = None, feed: DataFrame | None = None, unit: str | None = None, spec: Mapping[str, str | None] | None = None) -> DataFrame:
    """Candidate causes: events that began within ten weeks of the analysis week, nodes that an external feed shows
    active in them and no such event names (with the unit given), and topics of a slice's texts (doc_id, text, week
    and any dimensions) that spike, with that unit as well. id, source, node, label, start, unit, impact_rate."""
    recent = events.where((F.col("start") >= F.date_sub(F.lit(at), 7 * WINDOW_WEEKS)) & (F.col("start") <= F.lit(at)))
    found = recent.select("id", F.lit("event").alias("source"), "node", "label", "start", "unit", "impact_rate")
    if feed is not None:
        active = feed.where((F.col("intensity") > 0) & (F.col("week") >= F.date_sub(F.lit(at), 7 * WINDOW_WEEKS)) & (F.col("week") <= F.lit(at)))
        shown = active.join(recent.select("node").distinct(), "node", "left_anti").groupBy("node").agg(F.min("label").alias("label"), F.min("week").alias("start"))
        found = found.unionByName(shown.select(F.concat(F.lit("X:"), "node").alias("id"), F.lit("feed").alias("source"), "node", "label", "start", F.lit(unit).cast("string").alias("unit"), F.lit(None).cast("double").alias("impact_rate")))
    own = None if texts is None else topics.of_slice(texts, spec)
    if own is None:
        return found
    labelled, names = topics.topics(own, topics.topic_count(own.count()))
    weekly = topics.zero_filled(labelled.groupBy("topic", "week").agg(F.count("*").alias("n")), "topic")
    spiking = topics.spikes(weekly, "topic").join(F.broadcast(topics.topic_nodes(names)), "topic")
    return found.unionByName(spiking.select(F.concat(F.lit("T"), "topic").alias("id"), F.lit("topic").alias("source"), "node", F.col("name").alias("label"), F.col("onset").alias("start"), F.lit(unit).cast("string").alias("unit"), F.lit(None).cast("double").alias("impact_rate")))


def exposures(feed: DataFrame, node: str, at: Any) -> DataFrame:
    """Each unit's largest intensity of the node up to the analysis week; units without any are left out."""
    active = feed.where((F.col("node") == node) & (F.col("intensity") > 0) & (F.col("week") <= F.lit(at)))
    return active.groupBy("unit").agg(F.max("intensity").cast("double").alias("exposure"))


def prosecute(row: Any, series: DataFrame, onset: Any, exposure: DataFrame | None = None, accused: str | None = None) -> dict:
    """The evidence for and against one candidate, cheapest first; tests that can't change the verdict don't run. A
    cause that names no unit is tried on the accused one, that of the blamed slice; without either there is nothing to
    compare. With exposure (unit, exposure) of four units or more that varies, the unit on trial must be among the most exposed."""
    unit = row["unit"] if row["unit"] is not None else accused
    evidence: dict = {"path": row["path"], "unit": unit, "onset": onset, "start": row["start"]}
    if causal.verdict(evidence | {"did_p": 0, "parallel": True, "placebo_p": 0})[0] != "accepted":
        return evidence
    at = F.lit(row["start"]).cast("date")
    effect = causal.did(series, unit, at).first()
    if effect["estimate"] is None or not effect["se"]:
        return evidence
    evidence |= {"did": effect["estimate"], "se": effect["se"], "did_p": 2 * student_sf(abs(effect["estimate"] / effect["se"]), max(effect["free"], 1))}
    evidence["parallel"] = causal.parallel_trends(series, unit, at).first()["parallel"]
    if causal.verdict(evidence | {"placebo_p": 0})[0] != "accepted":
        return evidence
    placebo = causal.placebo_ranks(causal.synthetic_controls(series, None, at), unit).first()
    evidence |= {"placebo_p": placebo["p_value"]}
    if causal.verdict(evidence)[0] != "accepted":
        return evidence
    if exposure is not None:
        dose = causal.dose_response(exposure, series, at).first()
        most = exposure.agg(F.max("exposure").alias("top"), F.coalesce(F.max(F.when(F.col("unit") == unit, F.col("exposure"))), F.lit(0.0)).alias("own")).first()
        if dose["n"] >= LEAST_DOSES and dose["correlation"] is not None and dose["correlation"] == dose["correlation"]:
            evidence |= {"dose": dose["correlation"], "inverted": most["own"] < 0.85 * most["top"]}
            if causal.verdict(evidence)[0] != "accepted":
                return evidence
    evidence["refutations"] = {r["test"]: r["passed"] for r in causal.refutations(series, unit, str(row["start"])).collect()}
    money = causal.effect_in_revenue(series, unit, at, effect["estimate"], effect["se"]).first()
    return evidence | {"impact": money["impact"], "low": money["impact_low"], "high": money["impact_high"]}


def analyse(given: dict[str, DataFrame], out: str, events: DataFrame, texts: DataFrame | None = None, feedback: DataFrame | None = None, catalog: Catalog = METRICS, portfolio: Portfolio = PORTFOLIO, feed: DataFrame | None = None) -> dict:
    """Runs all stages on the sources' last week and writes findings (Parquet), the method registry (CSV), the
    report (JSON), hypotheses (Parquet) and released narratives (text) under `out`, a path or URI that Spark can write
    to. Bridge, funnel and topics are those of the slice that is blamed. Returns the report. What is collected are single
    rows, contracts and candidates, never panels or findings."""
    spark: SparkSession = events.sparkSession
    t, report = Telemetry(), {}
    with t.stage("align") as info:
        p = panel.align(given).persist()
        counted, seen = observed(p, "panel")
        at = counted.agg(F.max("week")).first()[0]
        info["rows"] = seen.get["rows"]
        report |= {"week": at, "excluded": catalog.weekly()[1], "freshness": [r.asDict() for r in panel.freshness(given, F.lit(at).cast("date"), catalog).collect()], "conflicts": panel.conflicts(given["warehouse"]).first().asDict()}
    with t.stage("detect", "statistical") as info:
        counted, seen = observed(detect.detect(p, catalog=catalog), "findings")
        counted.write.mode("overwrite").parquet(f"{out}/findings")
        findings = spark.read.parquet(f"{out}/findings")
        report["detection"] = detect.diagnostics(findings).first().asDict() | findings.agg(F.round(detect.coverage(), 4).alias("coverage"), F.bool_and(F.col("sparse") | F.col("out_of_sample")).alias("out_of_sample")).first().asDict()
        info["rows"] = seen.get["rows"]
    with t.stage("attribute", "statistical"):
        leaves = attribution.leaf_expectations(p).persist()
        gap = leaves.agg(F.sum("gap").alias("gap"), F.sum("expected").alias("expected")).first()
        report["gap"], report["gap_pct"] = gap["gap"], 100 * gap["gap"] / gap["expected"] if gap["expected"] else 0.0
        report["shapley"] = {r["dimension"]: r["share_pct"] for r in attribution.shapley(attribution.explained(leaves)).collect()}
        report["slice"] = attribution.best_slice(leaves).first().asDict()
        blamed = {d: report["slice"][d] for d in DIMENSIONS}
        report["bridge"], report["funnel"] = attribution.price_volume_mix(p, spec=blamed).first().asDict(), attribution.funnel(p, spec=blamed).first().asDict()
    with t.stage("causes", "causal"):
        series = causal.unit_series(p).persist()  # of all sales: a slice is noisier, and trends then part by chance
        onset = {r["unit"]: r["onset"] for r in causal.onsets(series).collect()}
        accused = report["slice"]["region"] if report["slice"]["region"] in onset else None  # of feeds, which name no unit
        found = candidates(events, at, texts, feed, accused, blamed)
        judged = graph.corroborated(found.select("id", "source", "node"), catalog.edge_table(spark), "revenue").join(found.drop("source", "node"), "id")
        hypotheses = []
        for row in judged.collect():
            evidence = prosecute(row, series, onset.get(row["unit"] or accused), None if feed is None else exposures(feed, row["node"], at), accused) if row["fate"] == "kept" else {"path": row["path"]}
            verdict, reason = ("merged", f"part of {row['merged_into']}") if row["fate"] == "merged" else causal.verdict(evidence)
            hypotheses.append({"id": row["id"], "label": row["label"], "node": row["node"], "unit": row["unit"], "start": row["start"], "verdict": verdict, "reason": reason, "evidence": evidence})
        report["hypotheses"] = hypotheses
        hypothesis_table(spark, hypotheses).coalesce(1).write.mode("overwrite").parquet(f"{out}/hypotheses")
    with t.stage("abstain"):
        accepted = [h for h in hypotheses if h["verdict"] == "accepted"]
        effects = spark.createDataFrame([(h["id"], h["evidence"]["low"], h["evidence"]["high"]) for h in accepted], "id string, low double, high double")
        weeks = p.agg(F.count_distinct("week")).first()[0]
        case = [("week", float(report["gap"]), float(sum(h["evidence"]["impact"] for h in accepted)), len(accepted), policy.overlaps(effects).count(), sum(r["status"] == "stale" for r in report["freshness"]), report["conflicts"]["n_conflicts"], weeks, len(report["excluded"]), bool(report["detection"]["out_of_sample"]))]
        fired = policy.triggers(spark.createDataFrame(case, "case string, total_gap double, explained double, n_accepted int, n_overlaps int, n_stale int, n_conflicts int, n_weeks int, n_excluded int, out_of_sample boolean"))
        report["triggers"] = [r.asDict() for r in fired.select("code", "fired", "detail", "test").collect()]
        report |= policy.verdicts(fired).first().asDict()
        if feedback is not None:
            rows = spark.createDataFrame([(h["id"], h["node"], h["verdict"]) for h in hypotheses], "id string, node string, verdict string")
            conflicts = [r["id"] for r in policy.feedback_conflicts(policy.feedback_history(rows, feedback)).collect()]
            report["triggers"].append({"code": "FEEDBACK_CONFLICT", "fired": bool(conflicts), "detail": ",".join(conflicts), "test": "review the rejected cause with the analyst" if conflicts else None})
    with t.stage("decide", "optimisation"):
        best = {a: decision.ranked(decision.bundles(spark, portfolio, authority=a), 1).first().asDict() for a in {x.authority for x in portfolio.personas}}
        report |= {"bundles": best, "optimum": decision.best_by_bounds(portfolio)}
    with t.stage("narrate", "template"):
        regions = tuple(sorted(r["region"] for r in p.select("region").distinct().where("region IS NOT NULL").collect()))
        told = []
        for who in portfolio.personas:
            b = best[who.authority]
            evidence = {"metric": "revenue", "week": str(at), "gap": report["gap"], "gap_pct": report["gap_pct"], "mode": report["mode"], "confidence": report["confidence"], "slice": "/".join(str(report["slice"][d]) for d in DIMENSIONS),
                        "bridge": report["bridge"], "funnel": report["funnel"]["dominant"], "tests": [t["test"] for t in report["triggers"] if t["fired"] and t["code"] in policy.BLOCKING + ("UNEXPLAINED_RESIDUAL",)],
                        "causes": [{"label": h["label"], **{k: h["evidence"][k] for k in ("impact", "low", "high")}} for h in accepted], "ruled_out": [{"label": h["label"], "reason": h["reason"]} for h in hypotheses if h["verdict"] == "rejected"],
                        "payback": b["weeks_to_payback"], "unreleased": [c.label for c in portfolio.constraints if b["relieved"] & ~b["realised"] & portfolio.bit(c.id)], "bundle_cost": b["cost"], "bundle_value": b["value"], "actions": b["levers"].split("+") if b["levers"] else []}
            told.append(narrative.released(evidence, who, regions))
        report["narratives"] = told
    report["latency_ms"] = {r["kind"]: r["latency_ms"] for r in by_kind(t.stage_table(spark)).collect()}
    tables.write_json(f"{out}/report.json", report)
    tables.write_csv(registry(spark), f"{out}/methods")
    tables.write_text(f"{out}/narratives.txt", "\n\n".join(f"[{x['persona']}] {x['text'] or 'withheld: ' + ', '.join(x['missing'])}" for x in told))
    for df in (p, leaves, series):
        df.unpersist()
    return report


HYPOTHESES = "id string, label string, node string, unit string, start date, verdict string, reason string, path string, did double, se double, did_p double, placebo_p double, dose double, impact double, low double, high double"


def hypothesis_table(spark: SparkSession, hypotheses: list[dict]) -> DataFrame:
    """One row a hypothesis: what it is, its verdict with the reason, and the figures that were reached."""
    figures = ("did", "se", "did_p", "placebo_p", "dose", "impact", "low", "high")
    number = lambda v: None if v is None else float(v)
    rows = [(h["id"], h["label"], h["node"], h["unit"], h["start"], h["verdict"], h["reason"], h["evidence"].get("path"), *(number(h["evidence"].get(f)) for f in figures)) for h in hypotheses]
    return spark.createDataFrame(rows, HYPOTHESES)


def worst_slices(findings: DataFrame, n: int = 5) -> DataFrame:
    """The n material findings of largest impact of each metric."""
    w = Window.partitionBy("metric").orderBy(F.desc("business_impact"), "level", *DIMENSIONS)
    return findings.where("material").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
