"""Candidate causes on trial: onset, difference in differences, synthetic control, placebos, dose and refutation."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics
from . import synthetic
from .panel import ratio, within
from .synthetic import synthetic_controls
from .two_way import two_way

BASELINE, GUARD, SIGMAS = 26, 2, 3.0
PRE_WEEKS, POST_WEEKS = synthetic.PRE_WEEKS, synthetic.POST_WEEKS


def unit_series(panel: DataFrame, unit: str = "region", spec: Mapping[str, str | None] | None = None) -> DataFrame:
    """Weekly cancellation rate (sum over sum), orders and revenue of each unit, in a slice of the other dimensions
    if one is given. A panel at any grain will do, also one of lines."""
    panel = within(panel, {d: v for d, v in (spec or {}).items() if d != unit})
    sums = panel.groupBy(unit, "week").agg(*(F.sum(m).alias(m) for m in ("cancellations", "gross_orders", "revenue", "net_units")))
    return sums.select(F.col(unit).alias("unit"), "week", ratio(F.col("cancellations"), F.greatest(F.col("gross_orders"), F.lit(1e-9).cast("decimal(18,9)"))).alias("rate"), *(F.col(c).cast("double").alias(c) for c in ("gross_orders", "revenue", "net_units")))


def onsets(series: DataFrame, value: str = "rate") -> DataFrame:
    """Per unit the first week from the baseline's start on that, with the week after it, lies beyond three
    standard deviations on the same side. The baseline is 26 weeks (a third of shorter series, five at least)
    that end four weeks before the last; null without an onset or with a flat baseline."""
    w = Window.partitionBy("unit")
    rows = series.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("week")) - 1})
    width = F.when(F.col("n") >= BASELINE + 2 * GUARD + 1, F.lit(BASELINE)).otherwise(F.greatest(F.floor(F.col("n") / 3), F.lit(5)))
    rows = rows.withColumn("stop", F.col("n") - 2 * GUARD).withColumn("start", F.greatest(F.col("stop") - width, F.lit(0)))
    inside = (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop"))
    rows = rows.withColumns({"mu": F.avg(F.when(inside, F.col(value))).over(w), "sd": F.stddev_samp(F.when(inside, F.col(value))).over(w), "base": F.count_if(inside).over(w)})
    side = F.when(F.col(value) > F.col("mu") + SIGMAS * F.col("sd"), 1).when(F.col(value) < F.col("mu") - SIGMAS * F.col("sd"), -1).otherwise(0)
    rows = rows.withColumn("side", side).withColumn("next_side", F.lead("side").over(w.orderBy("week")))
    hit = (F.col("i") >= F.col("start")) & (F.col("side") != 0) & (F.col("side") == F.col("next_side")) & (F.col("base") >= 5) & (F.col("sd") > 0)
    return rows.groupBy("unit").agg(F.min(F.when(hit, F.col("week"))).alias("onset"), F.max("n").alias("n_weeks"))


def did(series: DataFrame, treated: str | Column, start: Column, value: str = "rate") -> DataFrame:
    """Two-way fixed effects difference in differences over the year before and all weeks after: estimate, standard
    error, n and degrees of freedom. treated is a unit, or a condition on rows that units of any number may meet. All
    rows with a value count, also of weeks that some units lack."""
    rows = series.where(F.col("week") >= F.date_sub(start, 7 * PRE_WEEKS))
    on = (F.col("unit") == treated) if isinstance(treated, str) else treated
    return two_way(rows.select("unit", "week", F.col(value).cast("double").alias("y"), (on & (F.col("week") >= start)).cast("double").alias("d")))


def pretrend(series: DataFrame, treated: str, start: Column, value: str = "rate") -> DataFrame:
    """Slope of (treated minus the mean of the others) over the weeks of the year before, and its t-statistic."""
    rows = series.where((F.col("week") < start) & (F.col("week") >= F.date_sub(start, 7 * PRE_WEEKS)))
    diff = rows.groupBy("week").agg((F.max(F.when(F.col("unit") == treated, F.col(value))) - F.avg(F.when(F.col("unit") != treated, F.col(value)))).alias("y")).where("y IS NOT NULL")
    diff = diff.withColumn("t", (F.datediff("week", start) / 7).cast("double"))
    fit = diff.agg(F.regr_slope("y", "t").alias("slope"), F.regr_r2("y", "t").alias("r2"), F.count("*").alias("n"))
    t = F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    return fit.select("slope", t.alias("t"), "n")


def parallel_trends(series: DataFrame, treated: str, start: Column, value: str = "rate") -> DataFrame:
    """pretrend() with its two-sided p-value and whether trends count as parallel: more than ten weeks, and a slope
    that chance gives one time in twenty or more."""

    @F.udf("double")
    def two_sided(t, n):
        return None if t is None or t != t or n < 3 else 2 * numerics.student_sf(abs(t), n - 2)

    fit = pretrend(series, treated, start, value).withColumn("p", two_sided("t", "n"))
    return fit.withColumn("parallel", F.coalesce((F.col("n") > 10) & (F.col("p") > 0.05), F.lit(False)))


def _windows(series: DataFrame, start: Column) -> DataFrame:
    """Rows of the year before the start and the first weeks after it, per unit, with their side."""
    after = series.where(F.col("week") >= start).withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("week"))).where(f"r <= {POST_WEEKS}").drop("r").withColumn("post", F.lit(True))
    before = series.where((F.col("week") < start) & (F.col("week") >= F.date_sub(start, 7 * PRE_WEEKS))).withColumn("post", F.lit(False))
    return before.unionByName(after)


def two_donor_synthetic(series: DataFrame, treated: str, donors: tuple[str, str], start: Column, value: str = "rate") -> DataFrame:
    """The synthetic control of two donors in closed form: w for the first and 1 - w for the second, held to [0, 1].
    All series are scaled by their own mean before the start."""
    named = {treated: "y", donors[0]: "a", donors[1]: "b"}
    wide = _windows(series, start).groupBy("week", "post").agg(*(F.max(F.when(F.col("unit") == u, F.col(value))).alias(n) for u, n in named.items())).where("y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    scale = wide.where("NOT post").agg(*(F.avg(n).alias(f"m{n}") for n in named.values()))
    rows = wide.join(F.broadcast(scale)).select("post", "my", *((F.col(n) / F.col(f"m{n}")).alias(n) for n in named.values()))
    num = F.sum(F.when(~F.col("post"), (F.col("y") - F.col("b")) * (F.col("a") - F.col("b"))))
    den = F.sum(F.when(~F.col("post"), (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))))
    w = rows.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(num, den))).alias("w"))
    gaps = rows.join(F.broadcast(w)).withColumn("g", F.col("y") - F.col("w") * F.col("a") - (1 - F.col("w")) * F.col("b"))
    return gaps.agg(F.round(F.max("w"), 6).alias("weight"), F.round(F.avg(F.when(F.col("post"), F.col("g") * F.col("my"))), 6).alias("gap"), F.round(F.sqrt(F.avg(F.when(~F.col("post"), F.col("g") * F.col("g")))), 6).alias("pre_rmse"))


def placebo_ranks(controls: DataFrame, treated: str) -> DataFrame:
    """The treated unit's rank among all units by gap ratio, and its p-value; null with fewer than four placebos."""
    real = controls.where(F.col("unit") == treated).select(F.col("gap_ratio").alias("real"))
    rows = controls.where(F.col("unit") != treated).join(F.broadcast(real))
    rank = 1 + F.count_if(F.col("gap_ratio") >= F.col("real"))
    return rows.agg(rank.alias("rank"), F.count("*").alias("n_placebos"), F.when(F.count("*") >= 4, rank / (F.count("*") + 1)).alias("p_value"))


def dose_response(exposure: DataFrame, series: DataFrame, start: Column, value: str = "rate") -> DataFrame:
    """Units' exposure against their effect (mean of the first weeks after less that of the year before), with the
    correlation and whether the unit of largest effect is one of low exposure."""
    effect = _windows(series, start).groupBy("unit").agg((F.avg(F.when(F.col("post"), F.col(value))) - F.avg(F.when(~F.col("post"), F.col(value)))).alias("effect"))
    both = exposure.join(effect, "unit").where("effect IS NOT NULL AND exposure IS NOT NULL")
    out = both.agg(F.round(F.corr("exposure", "effect"), 6).alias("correlation"), F.max_by("unit", F.struct(F.round("effect", 9), "unit")).alias("most_affected"), F.max_by("exposure", F.struct(F.round("effect", 9), "unit")).alias("its"), F.max("exposure").alias("top"), F.count("*").alias("n"))
    return out.select("correlation", "most_affected", (F.col("its") < 0.85 * F.col("top")).alias("inverted"), "n")


def effect_in_revenue(series: DataFrame, treated: str, start: Column, delta_rate: float, se: float) -> DataFrame:
    """A change of the cancellation rate as weekly revenue: minus the change times the unit's mean weekly orders and
    price of the year before, with a 95 % interval."""
    pre = series.where((F.col("unit") == treated) & (F.col("week") < start) & (F.col("week") >= F.date_sub(start, 7 * PRE_WEEKS)))
    base = pre.agg((F.avg("gross_orders") * F.avg(F.try_divide(F.col("revenue"), F.nullif(F.col("net_units"), F.lit(0.0))))).alias("base"))
    return base.select(*(F.round(-F.lit(d) * F.col("base"), 2).alias(n) for n, d in (("impact", delta_rate), ("impact_low", delta_rate + 1.96 * se), ("impact_high", delta_rate - 1.96 * se))))


def verdict(evidence: dict) -> tuple[str, str]:
    """The cascade, cheapest test first: path, precedence, effect, placebo, dose, refutations. A cause without a unit
    or an onset to compare with is inconclusive, not rejected."""
    if not evidence.get("path"):
        return "rejected", "no path to the outcome in the causal graph"
    if evidence.get("unit", "") is None:
        return "inconclusive", "names no unit, and the blamed slice is of none"
    if evidence.get("onset") is None:
        return "inconclusive", "the outcome has no onset"
    if evidence["start"] > evidence["onset"]:
        return "rejected", "starts after the effect"
    if evidence.get("did_p", 1.0) >= 0.05 or not evidence.get("parallel", False):
        return "rejected", "no effect against parallel units"
    if evidence.get("placebo_p") is None or evidence["placebo_p"] > 0.20:
        return "rejected", "placebo units show as much"
    if evidence.get("inverted"):
        return "rejected", "the most affected unit is little exposed"
    failed = [k for k, ok in evidence.get("refutations", {}).items() if not ok]
    if failed:
        return "rejected", "refuted by " + ", ".join(failed)
    return "accepted", ""


def refutations(series: DataFrame, treated: str, start: str, value: str = "rate", draws: int = 5) -> DataFrame:
    """Three tests of a synthetic control: the same 26 weeks earlier, with a random donor, and without 30 % of the
    donors five times. Each with how far the gap moved and whether that is little enough."""
    spark, at = series.sparkSession, F.lit(start).cast("date")
    held = synthetic.cases(series, [at, F.date_sub(at, 7 * 26)], value)
    noisy = synthetic.cases(series, [at], value, noise=0.05)
    donors = [u for u in held[0].units if u != treated] if 0 in held else []
    rng = np.random.default_rng(23)
    out = [sorted(rng.choice(donors, max(1, round(0.3 * len(donors))), replace=False).tolist()) for _ in range(draws)] if len(donors) > 2 else []
    if noisy:
        held[2] = noisy[0]
    problems = [(0, 0, treated, []), (1, 1, treated, []), (2, 2, treated, [])] + [(3 + k, 0, treated, o) for k, o in enumerate(out)]
    gaps = {r["problem"]: r["gap"] for r in synthetic.controls(spark.createDataFrame(problems, synthetic.PROBLEM).coalesce(1), held).select("problem", "gap").collect()}
    if 0 not in gaps:
        return spark.createDataFrame([], "test string, moved double, passed boolean")
    real, scale = gaps[0], max(abs(gaps[0]), 1e-12)
    others = [abs(g - real) / scale for k, g in gaps.items() if k > 2]
    rows = [("placebo_in_time", abs(gaps[1]) / scale if 1 in gaps else None, 0.35), ("random_donor", abs(gaps[2] - real) / scale if 2 in gaps else None, 0.30)]
    rows.append(("leave_donors_out", float(np.mean(others)) if others else None, 0.30))
    return spark.createDataFrame([(n, m, m is not None and m < limit) for n, m, limit in rows], "test string, moved double, passed boolean")
