"""The registered queries of the metric engine: each applies an operator to the tables under sf_dir."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import attribution, causal, decision, detect, graph, intervals, lattice, maintained, narrative, panel, policy, telemetry, topics
from .sources import scratch, tables
from .sources.contracts import DIMENSIONS, METRICS, PORTFOLIO, Constraint, Lever, Portfolio
from .streaming import weekly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def double(*columns: str):
    return [F.col(c).cast("double").alias(c) for c in columns]


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """df with columns rounded; the engine's operators don't round what others compute with."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _lines(spark, d) -> DataFrame:
    """Order lines with their measures, for sums at a coarser grain than the panel's."""
    return tables.measured(tables.order_lines(spark, d))


def _recent(spark, d, weeks: int) -> tuple[DataFrame, Column | None]:
    """The panel of the analysis week and so many weeks before it, and that week: older orders aren't read."""
    at = tables.last_week(spark, d)
    if at is None:
        return panel.panel_of(spark, d), None
    return panel.panel_of(spark, d, at - timedelta(days=7 * weeks + 6)), F.lit(at)


# ---- panel -----------------------------------------------------------------------------------------------------


@query
def panel_align(spark, d):
    p = panel.panel_of(spark, d)
    return p.select("week", *DIMENSIONS, *double("revenue", "net_units", "gross_orders", "cancellations"), "asp", "cancellation_rate", "delivery_sla_pct")


@query
def panel_from_sources(spark, d):
    """The same from four sources that are delivered apart: a full outer join, and tickets allocated to leaves."""
    p = panel.align(tables.sources(spark, d))
    return p.select("week", *DIMENSIONS, *double("revenue", "net_units", "gross_orders", "cancellations"), "asp", "cancellation_rate", "delivery_sla_pct", F.round("ticket_volume", 6).alias("ticket_volume"))


@query
def panel_maintained(spark, d):
    """The panel as a table that a second delivery (lines shipped late) was merged into."""
    lines, path = _lines(spark, d), f"{scratch.shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    maintained.merge_lines(path, lines.where("in_time = 1"))
    maintained.merge_lines(path, lines.where("in_time = 0"))
    return maintained.read_panel(spark, path).select("week", *DIMENSIONS, *double("revenue", "net_units", "gross_orders", "cancellations"), "asp", "cancellation_rate", "delivery_sla_pct", F.round("ticket_volume", 6).alias("ticket_volume"))


@query
def ratio_weighted(spark, d):
    return panel.summed(_lines(spark, d), "week", "region").where("cancellations > 0").select("week", "region", "cancellation_rate", "delivery_sla_pct")


@query
def ticket_allocation(spark, d):
    return panel.panel_of(spark, d).select("week", *DIMENSIONS, F.round("ticket_volume", 6).alias("ticket_volume"))


@query
def source_freshness(spark, d):
    return panel.freshness(tables.sources(spark, d), F.lit("2001-08-19").cast("date"))


@query
def source_conflicts(spark, d):
    return panel.conflicts(tables.sources(spark, d)["warehouse"])


# ---- lattice ---------------------------------------------------------------------------------------------------


@query
def slice_lattice(spark, d):
    return lattice.lattice(panel.panel_of(spark, d)).select("week", *DIMENSIONS, "level", *double("revenue"), "cancellation_rate")


@query
def lattice_wow(spark, d):
    return lattice.wow(lattice.lattice(panel.panel_of(spark, d)), "revenue").select("week", *DIMENSIONS, "level", "wow_pct")


@query
def eligible_series(spark, d):
    return lattice.eligible(lattice.lattice(panel.panel_of(spark, d)), "revenue").select("level", *DIMENSIONS, "n_weeks")


@query
def iceberg_series(spark, d):
    """eligible_series() from the grand total down, without forming refinements of slices that don't last."""
    return lattice.iceberg(panel.panel_of(spark, d), "revenue")[0].select("level", *DIMENSIONS, "n_weeks")


# ---- attribution -----------------------------------------------------------------------------------------------


def _leaves(spark, d):
    p, at = _recent(spark, d, attribution.FURTHEST)
    return attribution.leaf_expectations(p, at=at)


@query
def leaf_expectation(spark, d):
    return _leaves(spark, d).select(*DIMENSIONS, "actual", "expected", "gap")


@query
def shapley_value_fn(spark, d):
    return attribution.explained(_leaves(spark, d)).select("coalition", F.round("v", 6).alias("v"))


@query
def shapley_dimensions(spark, d):
    return attribution.shapley(attribution.explained(_leaves(spark, d)))


@query
def pvm_bridge(spark, d):
    return attribution.price_volume_mix(*_recent(spark, d, attribution.LOOKBACK))


@query
def funnel_split(spark, d):
    return attribution.funnel(*_recent(spark, d, attribution.LOOKBACK))


SLICE = {"region": "ASIA", "channel": "1-URGENT", "segment": "ALL"}


@query
def pvm_bridge_slice(spark, d):
    return attribution.price_volume_mix(*_recent(spark, d, attribution.LOOKBACK), SLICE)


@query
def funnel_split_slice(spark, d):
    return attribution.funnel(*_recent(spark, d, attribution.LOOKBACK), SLICE)


@query
def top_leaves(spark, d):
    return attribution.top_leaves(_leaves(spark, d))


@query
def shortfall_80(spark, d):
    return attribution.leaves_for_share(_leaves(spark, d))


@query
def best_slice_rule(spark, d):
    return attribution.best_slice(_leaves(spark, d))


# ---- detection -------------------------------------------------------------------------------------------------


def _residuals(spark, d):
    return detect.naive_residuals(lattice.lattice(panel.panel_of(spark, d)), "revenue")


def _tests(spark, d):
    return detect.empirical_p_values(_residuals(spark, d))


@query
def conformal_quantile(spark, d):
    return detect.conformal_quantiles(_residuals(spark, d), 0.10).select("level", *DIMENSIONS, "n_calibration", F.round("half_width", 4).alias("half_width"), "valid")


@query
def median_half_width(spark, d):
    found = detect.median_half_widths(detect.conformal_quantiles(_residuals(spark, d), 0.10))
    return rounded(found, median_half_width=4)


@query
def empirical_pvalue(spark, d):
    return _tests(spark, d).select("level", *DIMENSIONS, F.round("p_value", 9).alias("p_value"), "n")


@query
def bh_fdr(spark, d):
    found = detect.benjamini_hochberg(_tests(spark, d), 0.10)
    return found.select("level", *DIMENSIONS, F.round("q_value", 9).alias("q_value"), "survives_fdr")


def _material(spark, d):
    tests = detect.benjamini_hochberg(_tests(spark, d), 0.10).withColumn("metric", F.lit("revenue"))
    return detect.with_impact(tests)


@query
def materiality(spark, d):
    return _material(spark, d).select("level", *DIMENSIONS, F.round("business_impact", 4).alias("business_impact"), "meets_threshold", (F.col("survives_fdr") & F.col("meets_threshold")).alias("material"))


@query
def detection_diagnostics(spark, d):
    return detect.diagnostics(_material(spark, d))


@query
def forecast_findings(spark, d):
    return detect.detect(panel.panel_of(spark, d))


@query
def calendar_findings(spark, d):
    """forecast_findings() with time by the calendar, for slices that have no value in some weeks."""
    return detect.detect(panel.panel_of(spark, d), calendar=True)


@query
def interval_coverage(spark, d):
    return forecast_findings(spark, d).agg(F.round(detect.coverage(), 4).alias("coverage"), F.sum("holdouts").alias("holdouts"))


# ---- graph and topics ------------------------------------------------------------------------------------------


def _flows(spark, d):
    """A graph of nations: from each supplier's nation to the two nations of a higher number that buy most from it."""
    t = lambda name: tables.table(spark, d, name)
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.where("s_nationkey < c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("n"))
    most = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey"))
    name = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string"))
    return sold.withColumn("r", most).where("r <= 2").select(name("s_nationkey").alias("src"), name("c_nationkey").alias("dst"))


@query
def dag_reachability(spark, d):
    return graph.shortest_paths(_flows(spark, d))


@query
def corroboration_merge(spark, d):
    """Nations as candidates of three sources, against the one of the highest number."""
    key = F.col("n_nationkey")
    source = F.element_at(F.array(*map(F.lit, ("event", "topic", "feed"))), (key % 3 + 1).cast("int"))
    found = tables.table(spark, d, "nation").select(F.concat(F.lit("C"), key.cast("string")).alias("id"), source.alias("source"), F.col("n_name").alias("node"))
    return graph.corroborated(found, _flows(spark, d), "NATION_24")


@query
def metric_exclusions(spark, d):
    """Leaf weeks with a value of each metric that contracts allow weekly, and the metrics that they exclude."""
    allowed = [m.name for m in METRICS.weekly()[0]]
    counts = panel.panel_of(spark, d).agg(*(F.count(m).alias(m) for m in allowed)).unpivot([], allowed, "metric", "n")
    return counts.withColumn("excluded", F.lit(False)).unionByName(panel.excluded_metrics(spark).select("metric", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("excluded")))


@query
def topic_node_map(spark, d):
    """Every document as a topic's name: the node of the causal graph that its words point to."""
    names = tables.table(spark, d, "documents").select(F.col("doc_id").alias("topic"), F.coalesce("text", F.lit("")).alias("name"))
    return topics.topic_nodes(names).select("topic", "node")


@query
def topics_tfidf_kmeans(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "text")
    found, names = topics.topics(docs, 6)
    return found.groupBy("topic").agg(F.count("*").alias("n")).join(F.broadcast(names), "topic")


def _weekly_returns(spark, d):
    return tables.order_lines(spark, d).where("returned").groupBy(F.col("nation").alias("topic"), "week").agg(F.count("*").alias("n"))


@query
def date_spine_zero_fill(spark, d):
    return topics.zero_filled(_weekly_returns(spark, d), "topic")


@query
def topic_spike(spark, d):
    return topics.spikes(topics.zero_filled(_weekly_returns(spark, d), "topic"), "topic", least=1.05)


@query
def weekly_event_volume(spark, d):
    events = weekly.weekly_events(tables.table(spark, d, "events"))
    return events.select("week", "event_type", "n", F.round(F.col("value").cast("double"), 4).alias("value"))


# ---- causes ----------------------------------------------------------------------------------------------------

START = "2000-06-04"


def _units(spark, d):
    return causal.unit_series(_lines(spark, d))


def _nations(spark, d):
    lines = tables.order_lines(spark, d)
    sums = lines.groupBy(F.col("nation").alias("unit"), "week").agg(F.sum(F.when(F.col("returned"), F.col("quantity")).otherwise(0)).cast("double").alias("c"), F.sum("quantity").cast("double").alias("g"))
    return sums.select("unit", "week", (F.col("c") / F.col("g")).alias("rate"))


@query
def unit_series(spark, d):
    return _units(spark, d).select("unit", "week", "rate", "gross_orders")


@query
def unit_series_slice(spark, d):
    return causal.unit_series(_lines(spark, d), "region", SLICE | {"region": "ALL"}).select("unit", "week", "rate", "gross_orders")


@query
def onset_changepoint(spark, d):
    return causal.onsets(_units(spark, d), "gross_orders").select("unit", "onset", "n_weeks")


@query
def did_twfe(spark, d):
    return did_twfe_all_weeks(spark, d).select("estimate", "se", "n")


@query
def did_twfe_all_weeks(spark, d):
    return rounded(causal.did(_units(spark, d), "ASIA", F.lit(START).cast("date")), estimate=6, se=6)


@query
def did_many_units(spark, d):
    """Nations times brands as units, those of one nation treated."""
    lines = tables.order_lines(spark, d)
    unit = F.concat_ws("|", "nation", "brand").alias("unit")
    returned = F.sum(F.when(F.col("returned"), F.col("quantity")).otherwise(0)).cast("double")
    rates = lines.groupBy(unit, "week").agg((returned / F.sum("quantity").cast("double")).alias("rate"))
    found = causal.did(rates, F.col("unit").startswith("NATION_7|"), F.lit(START).cast("date"))
    return rounded(found, estimate=6, se=6)


@query
def parallel_trends(spark, d):
    return rounded(causal.parallel_trends(_units(spark, d), "ASIA", F.lit(START).cast("date")), slope=8, t=4, p=6)


@query
def pretrend_slope(spark, d):
    return rounded(causal.pretrend(_units(spark, d), "ASIA", F.lit(START).cast("date")), slope=8, t=4)


@query
def synth_two_donor(spark, d):
    return causal.two_donor_synthetic(_units(spark, d), "ASIA", ("AFRICA", "EUROPE"), F.lit(START).cast("date"))


@query
def dose_response(spark, d):
    at = F.lit(START).cast("date")
    exposure = _units(spark, d).where(F.col("week").between(at, F.date_add(at, 28))).groupBy("unit").agg(F.max("gross_orders").alias("exposure"))
    return causal.dose_response(exposure, _units(spark, d), at)


@query
def effect_translation(spark, d):
    return causal.effect_in_revenue(_units(spark, d), "ASIA", F.lit(START).cast("date"), 0.05, 0.01)


@query
def synthetic_control(spark, d):
    return causal.synthetic_controls(_units(spark, d), ["ASIA"], F.lit(START).cast("date"))


@query
def placebo_inference(spark, d):
    units = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return causal.placebo_ranks(causal.synthetic_controls(_units(spark, d), units, F.lit(START).cast("date")), "ASIA")


def _placed(series, value="rate", fill=None):
    return causal.synthetic.placed(causal.synthetic_controls(series, None, F.lit(START).cast("date"), value, fill=fill))


@query
def placebo_nations(spark, d):
    """Every nation as if it had been treated, among all; weeks without orders count as its mean."""
    return _placed(_nations(spark, d), fill="mean")


@query
def placebo_product_lines(spark, d):
    return _placed(causal.unit_series(_lines(spark, d), "product_line"), fill="mean")


@query
def placebo_many_units(spark, d):
    """Every nation's every brand among all, by the quantity ordered; weeks without orders count as 0."""
    lines = tables.order_lines(spark, d)
    sold = lines.groupBy(F.concat_ws("|", "nation", "brand").alias("unit"), "week").agg(F.sum("quantity").cast("double").alias("quantity"))
    return _placed(sold, "quantity", 0.0)


@query
def refutations(spark, d):
    return causal.refutations(_units(spark, d), "ASIA", START)


# ---- policy ----------------------------------------------------------------------------------------------------

FEEDBACK_OF = {"purchase": ("hypothesis", "confirmed"), "error": ("hypothesis", "rejected"), "click": ("action", "acted_on"), "view": ("action", "no_effect")}


def _cases(spark, d):
    """Each nation as a case: its last week's revenue against the eight weeks before, explained by what was returned."""
    weeks = tables.order_lines(spark, d).groupBy("nation", "week").agg(
        F.sum(F.when(~F.col("returned"), F.col("amount"))).alias("kept"), F.sum(F.when(F.col("returned"), F.col("amount"))).alias("lost"),
        F.collect_set(F.when(F.col("returned"), F.col("product_line"))).alias("lines"), F.collect_set(F.when(F.col("quantity") < 5, F.col("segment"))).alias("segments"),
        F.count_if(~F.col("in_time") & F.col("returned")).alias("overlaps"), F.count_if(~F.col("in_time") & (F.col("quantity") > 45)).alias("conflicts"),
    )
    rows = weeks.withColumn("at", F.max("week").over(Window.partitionBy()))  # nations times weeks, so few
    now, before = F.col("week") == F.col("at"), F.col("week").between(F.date_sub("at", 56), F.date_sub("at", 7))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double")
    gap = lambda c: total(c, now) - total(c, before) / 8
    last = lambda c: F.coalesce(F.sum(F.when(now, c)), F.lit(0)).cast("int")
    return rows.groupBy(F.col("nation").alias("case")).agg(
        gap("kept").alias("total_gap"), (-gap("lost")).alias("explained"),
        last(F.size("lines")).alias("n_accepted"), last(F.col("overlaps")).alias("n_overlaps"),
        F.floor(F.datediff(F.max("at"), F.max("week")) / 7).cast("int").alias("n_stale"), last(F.col("conflicts")).alias("n_conflicts"),
        F.count("week").cast("int").alias("n_weeks"), last(F.size("segments")).alias("n_excluded"), (F.count("week") >= 20).alias("out_of_sample"),
    )


def _effects(spark, d):
    """Each nation's product lines with the 95 % interval of their mean weekly revenue."""
    weekly_ = tables.order_lines(spark, d).where("NOT returned").groupBy("nation", "product_line", "week").agg(F.sum("amount").cast("double").alias("v"))
    half = 1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))
    return weekly_.groupBy(F.col("nation").alias("case"), F.col("product_line").alias("id")).agg((F.avg("v") - half).alias("low"), (F.avg("v") + half).alias("high"))


@query
def competing_overlap(spark, d):
    return policy.overlaps(_effects(spark, d))


@query
def shipping_overlaps(spark, d):
    """Orders of a customer whose times from order to last shipment overlap by more than 60 %."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    shipped = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    orders = tables.table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("id"), day("o_orderdate").alias("low"), day("shipped").alias("high"))
    found = intervals.overlapping(rows, by=["o_custkey"])
    return found.select("o_custkey", "first", "second", F.round("overlap", 6).alias("overlap"))


@query
def abstention_triggers(spark, d):
    return policy.triggers(_cases(spark, d)).select("case", "code", "fired")


@query
def abstention_mode(spark, d):
    return policy.verdicts(policy.triggers(_cases(spark, d)))


def _feedback(spark, d):
    """Events as feedback: their type says what is told, their user of which hypothesis and which cause."""
    said = F.create_map(*(F.lit(x) for k, v in FEEDBACK_OF.items() for x in (k, f"{v[0]} {v[1]}")))[F.col("event_type")]
    rows = tables.table(spark, d, "events").withColumn("said", F.split(said, " ")).where("said IS NOT NULL")
    user = F.col("user_id")
    return rows.select(F.col("said")[0].alias("entity_type"), F.concat(F.lit("H"), user.cast("string")).alias("entity_id"), F.col("said")[1].alias("verdict"), F.concat(F.lit("cause"), (user % 20).cast("string")).alias("cause_node"), F.lit("").alias("note"), F.lit("log").alias("user"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))


@query
def feedback_conflict(spark, d):
    """Users as hypotheses, every second one accepted."""
    user = F.col("user_id")
    rows = tables.table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("H"), user.cast("string")).alias("id"), F.concat(F.lit("cause"), (user % 20).cast("string")).alias("node"), F.when(user % 2 == 0, "accepted").otherwise("rejected").alias("verdict"))
    return policy.feedback_conflicts(policy.feedback_history(rows, _feedback(spark, d)))


@query
def feedback_summary(spark, d):
    return policy.feedback_summary(_feedback(spark, d)).select("entity_type", "verdict", "n", F.array_join("entities", ",").alias("entities"))


# ---- decisions -------------------------------------------------------------------------------------------------


def _portfolio(spark, d) -> Portfolio:
    """What returns block in each region (a week's revenue), and each channel and segment as a lever: a tenth of its
    quantity in cost, against the two regions with most of its returns. Five and ten rows decide."""
    lost = F.sum(F.when(F.col("returned"), F.col("amount")).otherwise(0)).cast("decimal(28,4)")
    sums = tables.order_lines(spark, d).groupBy("region", "channel", "segment", "week").agg(F.sum("quantity").alias("quantity"), lost.alias("lost")).persist()
    returned = F.sum("lost").cast("decimal(28,4)")
    blocked = sums.groupBy("region").agg(F.floor(returned / F.count_distinct("week")).cast("double").alias("v")).orderBy("region").collect()
    kinds = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("lever")) for f in ("channel", "segment"))))
    each = sums.select("region", "quantity", "lost", kinds.alias("k")).groupBy("k.family", "k.lever", "region").agg(F.sum("quantity").alias("q"), returned.alias("v"))
    levers = each.groupBy("family", "lever").agg(F.floor(F.sum("q") / 10).cast("double").alias("cost"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "region")))["region"], 1, 2).alias("regions")).orderBy("family", "lever").collect()
    sums.unpersist()
    names = [r["region"] for r in blocked]
    needs = {2: (1,), 4: (0, 2)}
    constraints = tuple(Constraint(r["region"], r["region"], r["v"], tuple(names[n] for n in needs.get(k, ()) if n < len(names))) for k, r in enumerate(blocked))
    pulls = tuple(Lever(r["lever"], f"{r['family']} {r['lever']}", r["cost"], tuple(sorted(r["regions"])), PORTFOLIO.authorities[k % 4], r["family"]) for k, r in enumerate(levers))
    return Portfolio(constraints, pulls, math.floor(0.4 * sum(v.cost for v in pulls)), PORTFOLIO.personas, PORTFOLIO.authorities)


@query
def bundle_enumeration(spark, d):
    return decision.bundles(spark, _portfolio(spark, d)).select("bundle", "levers", "cost", "relieved", "realised", "value", "n_families", "feasible")


@query
def bundle_dominance(spark, d):
    return decision.undominated(decision.bundles(spark, _portfolio(spark, d))).select("realised", "levers", "cost", "value")


@query
def bundle_pruning(spark, d):
    return decision.undominated(decision.bundles(spark, _portfolio(spark, d)), infeasible=True).select("bundle", "levers", "cost", "feasible", "reason")


@query
def bundle_rank(spark, d):
    return decision.ranked(decision.bundles(spark, _portfolio(spark, d))).select("rank", "levers", "cost", "value", F.round("weeks_to_payback", 6).alias("weeks_to_payback"))


@query
def budget_sweep(spark, d):
    return decision.budget_sweep(decision.bundles(spark, _portfolio(spark, d)), [k * 1e4 for k in range(1, 16)])


@query
def persona_levers(spark, d):
    rows, portfolio = None, _portfolio(spark, d)
    for p in portfolio.personas:
        best = decision.ranked(decision.bundles(spark, portfolio, authority=p.authority), 1).select(F.lit(p.id).alias("persona"), "levers", "cost", "value")
        rows = best if rows is None else rows.unionByName(best)
    return rows


@query
def greedy_baselines(spark, d):
    return decision.greedy(spark, _portfolio(spark, d))


@query
def optimum_by_bounds(spark, d):
    levers, value = decision.best_by_bounds(_portfolio(spark, d))
    return spark.createDataFrame([("+".join(levers), value)], "levers string, value double")


@query
def lever_recommendations(spark, d):
    portfolio = _portfolio(spark, d)
    return decision.recommendations(decision.ranked(decision.bundles(spark, portfolio), 1), portfolio, "delivery_sla", 0.71).select("lever", "label", "cost", "authority", "bundle_value")


# ---- narratives, access, telemetry -----------------------------------------------------------------------------


@query
def number_tokens(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(narrative.number_tokens(F.col("text")))).alias("token"))
    return docs.groupBy("token").agg(F.count("*").alias("n"))


@query
def grounding_check(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("case"), "text")
    known = tables.table(spark, d, "benchmark").select(F.explode(narrative.number_tokens(F.col("text"))).alias("token"))
    return narrative.ungrounded(docs, known)


def _evidence(spark, d):
    """Events as evidence in JSON: what was measured, with the properties that came along packed one level deeper."""
    measured = F.format_string('{"measure":{"value":%s,"props":%s},"of":["%s",{"user":%d}]}', F.col("value").cast("string"), F.col("props"), F.col("event_type"), F.col("user_id"))
    return tables.table(spark, d, "events").select(F.col("event_id").alias("case"), measured.alias("evidence"))


@query
def evidence_leaves(spark, d):
    found = narrative.evidence_leaves(_evidence(spark, d), "evidence")
    return found.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum(F.try_variant_get("value", "$", "double")), 4).alias("total"), F.count_distinct(F.try_variant_get("value", "$", "string")).alias("n_distinct"))


@query
def evidence_vocabulary(spark, d):
    """How many events' evidence lets a narrative use each number."""
    return narrative.evidence_vocabulary(_evidence(spark, d), "evidence").groupBy("token").agg(F.count("*").alias("n"))


@query
def rls_filtered_panel(spark, d):
    p = panel.scoped(panel.panel_of(spark, d), PORTFOLIO.personas[0])
    return p.select(*(c if c in ("week", *DIMENSIONS, "cancellation_rate", "delivery_sla_pct") else F.col(c).cast("double").alias(c) for c in p.columns if c not in ("ticket_volume", "deliveries", "in_time")))


KINDS = {"signup": "io", "view": "deterministic", "click": "statistical", "error": "statistical", "purchase": "template"}
PRICES = {"small": (1.0, 5.0), "large": (3.0, 15.0)}


def _stages(spark, d):
    """The event log as a log of stages: each event is one of its type that took `value` ms over props.k rows."""
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("event_type")]
    return tables.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("latency_ms"), kind.alias("kind"), F.lit("").alias("notes"), F.get_json_object("props", "$.k").cast("bigint").alias("rows"))


def _calls(spark, d):
    """Purchases as model calls: by user, model; by event, tokens; every seventh is answered from a cache."""
    rows = tables.table(spark, d, "events").where("event_type = 'purchase'")
    cached = F.col("event_id") % 7 == 0
    tokens = lambda n: F.when(cached, F.lit(0)).otherwise(n).cast("bigint")
    return rows.select(F.col("event_type").alias("stage"), F.when(F.col("user_id") % 3 == 0, "large").otherwise("small").alias("model"), tokens(F.col("event_id") % 1000 + 100).alias("input_tokens"), tokens(F.col("user_id") % 300).alias("output_tokens"), F.col("value").alias("latency_ms"), cached.alias("cached"))


@query
def telemetry_by_kind(spark, d):
    return telemetry.by_kind(_stages(spark, d))


@query
def model_call_costs(spark, d):
    return telemetry.call_costs(_calls(spark, d), PRICES).select("model", "input_tokens", "output_tokens", "cached", F.round("cost", 9).alias("cost"))


@query
def run_summary(spark, d):
    return rounded(telemetry.summary(_stages(spark, d), _calls(spark, d), PRICES, 90.0), latency_ms=3, model_share=6, cost=6, cost_other=4)


@query
def stage_rows(spark, d):
    """The rows of two stages of a run, seen as they pass; the second reads what the first has stored."""
    t = telemetry.Telemetry()
    with t.stage("panel") as info:
        counted, seen = telemetry.observed(panel.panel_of(spark, d), "panel")
        p = scratch.stored(counted, "panel")
        info["rows"] = seen.get["rows"]
    with t.stage("lattice") as info:
        counted, seen = telemetry.observed(lattice.lattice(p), "lattice")
        counted.write.format("noop").mode("overwrite").save()
        info["rows"] = seen.get["rows"]
    scratch.release(p)
    return t.stage_table(spark).select("name", "rows")


@query
def method_registry(spark, d):
    return telemetry.registry(spark).groupBy("category").agg(F.count("*").alias("n"))
