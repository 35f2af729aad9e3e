"""When to speak: triggers against a claim, the resulting mode and confidence, and analysts' feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlapping

BLOCKING = ("STALE_SOURCE", "SOURCE_CONFLICT", "CALIBRATION_INTEGRITY")
LEAST_HISTORY = 60
#: What would settle a trigger that fired.
TESTS = {
    "UNEXPLAINED_RESIDUAL": "look for causes outside the graph in the slice with the largest rest",
    "COMPETING_EXPLANATIONS": "hold out one of the causes in some units for two weeks",
    "STALE_SOURCE": "run again when the late source has reported the week",
    "SOURCE_CONFLICT": "reconcile units, prices and revenue of the leaves that contradict themselves",
    "SPARSE_HISTORY": "judge the series against its parent slice until it has a year of weeks",
    "GRAIN_POLICY": "ask the metric's owner for weekly values",
    "CALIBRATION_INTEGRITY": "recalibrate on weeks that the fit has not seen",
}


def overlaps(effects: DataFrame, limit: float = 0.60) -> DataFrame:
    """All pairs of accepted effects (id, low, high) whose intervals overlap by more than `limit` of their union, within
    a case if there is that column."""
    by = ["case"] if "case" in effects.columns else []
    return overlapping(effects, limit, by).select(*by, "first", "second", F.round("overlap", 6).alias("overlap"))


def triggers(case: DataFrame) -> DataFrame:
    """One row per case and trigger: code, fired, detail and, of those that fired, the test that would settle it. case: total_gap, explained (sum of accepted impacts),
    n_accepted, n_overlaps, n_stale, n_conflicts, n_weeks, n_excluded, out_of_sample."""
    residual = 1 - F.least(F.coalesce(F.try_divide(F.abs("explained"), F.nullif(F.abs("total_gap"), F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
    rules: list[tuple[str, Column, Column]] = [
        ("UNEXPLAINED_RESIDUAL", residual > 0.40, F.round(residual, 4).cast("string")),
        ("COMPETING_EXPLANATIONS", F.col("n_overlaps") > 0, F.col("n_overlaps").cast("string")),
        ("STALE_SOURCE", F.col("n_stale") > 0, F.col("n_stale").cast("string")),
        ("SOURCE_CONFLICT", F.col("n_conflicts") > 0, F.col("n_conflicts").cast("string")),
        ("SPARSE_HISTORY", F.col("n_weeks") < LEAST_HISTORY, F.col("n_weeks").cast("string")),
        ("GRAIN_POLICY", F.col("n_excluded") > 0, F.col("n_excluded").cast("string")),
        ("CALIBRATION_INTEGRITY", ~F.col("out_of_sample"), F.col("out_of_sample").cast("string")),
    ]
    settled = F.create_map(*(F.lit(x) for pair in TESTS.items() for x in pair))[F.col("t.code")]
    rows = F.array(*(F.struct(F.lit(c).alias("code"), f.alias("fired"), d.alias("detail")) for c, f, d in rules))
    return case.select(*[c for c in ("case",) if c in case.columns], "n_accepted", "explained", "total_gap", F.explode(rows).alias("t")).select("*", "t.code", "t.fired", "t.detail", F.when(F.col("t.fired"), settled).alias("test")).drop("t")


def verdicts(fired: DataFrame) -> DataFrame:
    """Mode and confidence of each case from its triggers. Blocking triggers abstain, and so does an unexplained
    rest without an accepted cause; then competing explanations are told as such."""
    has = lambda code: F.bool_or((F.col("code") == code) & F.col("fired"))
    blocked = F.bool_or(F.col("code").isin(*BLOCKING) & F.col("fired"))
    share = F.least(F.coalesce(F.try_divide(F.abs(F.max("explained")), F.nullif(F.abs(F.max("total_gap")), F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
    by = fired.groupBy("case").agg(
        F.when(blocked, "abstain").when(has("UNEXPLAINED_RESIDUAL") & (F.max("n_accepted") == 0), "abstain").when(has("COMPETING_EXPLANATIONS"), "competing").when(F.max("n_accepted") > 0, "confident").otherwise("abstain").alias("mode"),
        (share * F.pow(F.lit(0.82), F.count_if(F.col("fired") & (F.col("code") != "GRAIN_POLICY")))).alias("raw"),
        F.count_if("fired").alias("n_fired"),
    )
    held = F.when(F.col("mode") == "abstain", F.least(F.col("raw"), F.lit(0.35))).otherwise(F.col("raw"))
    return by.select("case", "mode", F.round(F.greatest(F.lit(0.0), F.least(held, F.lit(0.99))), 4).alias("confidence"), "n_fired")


def feedback_history(hypotheses: DataFrame, feedback: DataFrame) -> DataFrame:
    """hypotheses (id, node) with how often their cause was confirmed and rejected, and the latest of the two."""
    about = feedback.where("entity_type = 'hypothesis' AND cause_node <> ''")
    counts = about.groupBy("cause_node").agg(F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.max_by(F.when(F.col("verdict").isin("confirmed", "rejected"), F.col("verdict")), F.when(F.col("verdict").isin("confirmed", "rejected"), F.struct("ts", "verdict"))).alias("latest"))
    out = hypotheses.join(counts, F.col("node") == F.col("cause_node"), "left").drop("cause_node")
    return out.fillna(0, ["confirmed", "rejected"])


def feedback_conflicts(history: DataFrame) -> DataFrame:
    """Accepted hypotheses whose cause was last rejected; a later confirmation clears them."""
    return history.where("verdict = 'accepted' AND latest = 'rejected'").select("id", "node", "confirmed", "rejected")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("entity_type", "verdict").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("entity_id")).alias("entities"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Each entity's last record (ties by verdict)."""
    w = Window.partitionBy("entity_type", "entity_id").orderBy(F.desc("ts"), "verdict")
    return feedback.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
