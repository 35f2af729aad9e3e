"""Anomaly detection over the lattice: per-series forecasts and conformal intervals, then one false-discovery control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.running import log_bin, with_least_from, with_running_sum
from ..sources.contracts import DIMENSIONS, METRICS, Catalog
from .lattice import labelled, lattice, long_metrics

SERIES = ("level", *DIMENSIONS, "metric")
FINDING = (
    "level int, region string, product_line string, channel string, segment string, metric string, n_history int, seasonal boolean, actual double, forecast double, "
    "lo double, hi double, deviation double, deviation_pct double, wow_pct double, outside_interval boolean, p_value double, p_method string, adapted_alpha double, "
    "sparse boolean, out_of_sample boolean, interval_valid boolean, width_pct double, n_calibration int, hits int, holdouts int"
)
LEAST_WEEKS = 10
LEAST_RESIDUALS = 6
SEASONAL_WEEKS = 60


def naive_residuals(slices: DataFrame, metric: str) -> DataFrame:
    """Each week's change on the week before within a series, numbered from the last (0) backwards."""
    w = Window.partitionBy("level", *DIMENSIONS).orderBy("week")
    value = F.col(metric).cast("double")
    rows = slices.where(F.col(metric).isNotNull()).withColumn("residual", value - F.lag(value).over(w)).where("residual IS NOT NULL")
    return rows.withColumn("back", F.row_number().over(Window.partitionBy("level", *DIMENSIONS).orderBy(F.desc("week"))) - 1)


def conformal_quantiles(residuals: DataFrame, alpha: float) -> DataFrame:
    """Per series the finite-sample conformal quantile of its past residuals: the k-th smallest magnitude with
    k = ceil((n + 1)(1 - alpha)); invalid (null) where k > n."""
    past = residuals.where("back > 0").withColumn("size", F.abs("residual"))
    w = Window.partitionBy("level", *DIMENSIONS)
    ranked = past.withColumns({"r": F.row_number().over(w.orderBy("size")), "n": F.count("*").over(w)}).withColumn("k", F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))
    return ranked.groupBy("level", *DIMENSIONS).agg(F.max("n").alias("n_calibration"), F.max(F.when(F.col("r") == F.col("k"), F.col("size"))).alias("half_width"), (F.max("k") <= F.max("n")).alias("valid"))


def median_half_widths(quantiles: DataFrame) -> DataFrame:
    """Per level the median half-width of the intervals that are valid, and how many those are."""
    return quantiles.where("valid").groupBy("level").agg(F.median("half_width").alias("median_half_width"), F.count("*").alias("n"))


def empirical_p_values(residuals: DataFrame) -> DataFrame:
    """Per series (1 + residuals at least as large as the last) / (n + 1)."""
    w = Window.partitionBy("level", *DIMENSIONS)
    rows = residuals.withColumn("deviation", F.max(F.when(F.col("back") == 0, F.col("residual"))).over(w)).where("back > 0")
    return rows.groupBy("level", *DIMENSIONS).agg(((1 + F.count_if(F.abs("residual") >= F.abs("deviation"))) / (F.count("*") + 1)).alias("p_value"), F.max("deviation").alias("deviation"), F.count("*").alias("n"))


def benjamini_hochberg(tests: DataFrame, q: float, p: str = "p_value") -> DataFrame:
    """tests with q_value and survives_fdr: the step-up procedure over all rows with a p-value.

    Ranks come from the distinct p-values with their counts, dealt to bins of nearly equal p (a hundredth at most),
    so that no task sees all of them; the result joins back by p-value."""
    place = log_bin(F.col(p), 64)
    distinct = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    ranked = with_running_sum(distinct, place, F.col(p), F.col("_n"), "_rank", "_total")
    values = with_least_from(ranked, place, F.col(p), F.col(p) * F.col("_total") / F.col("_rank"), "_q")
    return tests.join(values.select(p, F.least(F.lit(1.0), F.col("_q")).alias("q_value")), p).withColumn("survives_fdr", F.col("q_value") <= q)


def with_impact(findings: DataFrame, catalog: Catalog = METRICS) -> DataFrame:
    """findings (metric, deviation) with business impact in the contract's unit and whether it reaches its floor."""
    spec = F.broadcast(catalog.metric_table(findings.sparkSession).select("metric", "unit", "impact_floor", "impact_scale"))
    out = findings.join(spec, "metric").withColumn("business_impact", F.abs("deviation") * F.col("impact_scale"))
    return out.withColumn("meets_threshold", F.col("business_impact") >= F.col("impact_floor"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Counts over all tests: naive positives, survivors, material ones and alarms that control has avoided."""
    return findings.agg(
        F.count("*").alias("n_tests"),
        F.count_if(F.col("p_value") <= 0.05).alias("naive"),
        F.count_if("survives_fdr").alias("survivors"),
        F.count_if(F.col("survives_fdr") & F.col("meets_threshold")).alias("material"),
        (F.count_if(F.col("p_value") <= 0.05) - F.count_if("survives_fdr")).alias("alarms_avoided"),
    )


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """x in per cent of the magnitude of `of`; NaN where that is 0."""
    of = np.abs(of)
    return 100 * x / np.where(of > 1e-12, of, np.nan)


def _findings(y: np.ndarray, have: int, alpha: float, gamma: float) -> dict[str, np.ndarray] | None:
    """The findings' columns of series of one length, a row each, that have values in `have` of its weeks (NaN in the
    rest); None if they are too short to calibrate."""
    m, n = y.shape
    if have == n:
        split = numerics.split_of(n, SEASONAL_WEEKS)
        f = numerics.Gapped(y[:, -1], y[:, -2], numerics.forecasts_of(y, split)[:, -1], numerics.residuals_of(y, split), split.seasonal, split.out_of_sample)
    else:
        f = numerics.gapped_forecasts(y, have, SEASONAL_WEEKS)
    r, actual, forecast = f.residuals, f.actual, f.forecast
    k = r.shape[1]
    if k < LEAST_RESIDUALS:
        return None
    deviation = actual - forecast
    level = numerics.adaptive_levels(r, alpha, gamma)
    half, valid = numerics.half_widths(r, level)
    p, tail = numerics.tail_p_values(r, deviation)
    hits, holdouts = np.zeros(m, int), 0
    if k >= 16 and f.out_of_sample:
        width, _ = numerics.half_widths(r[:, : k // 2], np.full(m, alpha))
        hits, holdouts = (np.abs(r[:, k // 2 :]) <= width[:, None]).sum(axis=1), k - k // 2
    return {
        "n_history": np.full(m, have), "seasonal": np.full(m, f.seasonal), "actual": actual, "forecast": forecast, "lo": forecast - half, "hi": forecast + half,
        "deviation": deviation, "deviation_pct": _share(deviation, forecast), "wow_pct": _share(actual - f.before, f.before), "outside_interval": np.abs(deviation) > half,
        "p_value": p, "p_method": np.where(tail, "tail", "empirical"), "adapted_alpha": level, "sparse": np.full(m, have < SEASONAL_WEEKS), "out_of_sample": np.full(m, f.out_of_sample),
        "interval_valid": valid, "width_pct": _share(2 * half, forecast), "n_calibration": np.full(m, k), "hits": hits, "holdouts": np.full(m, holdouts),
    }


def series_findings(long: DataFrame, alpha: float = 0.10, gamma: float = 0.05, calendar: bool = False) -> DataFrame:
    """One finding per series (level, dimensions, metric) that is long enough, varies and has the last of all weeks.
    A series travels as two sorted arrays, so each Arrow batch carries many and no task starts a frame per series.
    With calendar, weeks that a series lacks keep their place in time; without, its weeks close up."""
    last = long.agg(F.max("week").alias("last_week"))
    pairs = F.array_sort(F.collect_list(F.struct("week", "value")))
    grouped = long.groupBy(*SERIES).agg(pairs.alias("s"), F.max("week").alias("latest"), F.stddev_pop("value").alias("spread"))
    usable = grouped.join(F.broadcast(last), F.col("latest") == F.col("last_week")).where((F.size("s") >= LEAST_WEEKS) & (F.col("spread") > 1e-8))
    week = F.floor(F.datediff(F.col("s")[F.size("s") - 1]["week"], F.col("s")[0]["week"]) / 7) + 1
    places = F.transform("s", lambda p: F.floor(F.datediff(p["week"], F.col("s")[0]["week"]) / 7).cast("int"))
    rows = usable.select(*SERIES, F.col("s.value").alias("values"), *([week.cast("int").alias("span"), places.alias("places")] if calendar else []))

    names = [c.split()[0] for c in FINDING.split(", ")]
    whole = dict.fromkeys(("level", "n_history", "n_calibration", "hits", "holdouts"), "int32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            have = b["values"].str.len()
            for (n, span), part in b.groupby([have, b["span"] if calendar else have], sort=False):
                y = np.stack(part["values"].to_list()).astype(float)
                if span != n:
                    y, closed = np.full((len(part), span), np.nan), y
                    y[np.arange(len(part))[:, None], np.stack(part["places"].to_list())] = closed
                found = _findings(y, n, alpha, gamma)
                if found is not None:
                    yield part[list(SERIES)].assign(**found)[names].astype(whole)

    return rows.mapInPandas(run, FINDING)


def detect(panel: DataFrame, metrics: list[str] | None = None, alpha: float = 0.10, q: float = 0.10, catalog: Catalog = METRICS, calendar: bool = False) -> DataFrame:
    """Findings of all slices and metrics: forecast, interval, p-value and q-value over all tests, impact against
    the contract, and material (survives and reaches the floor). Without metrics given, all that contracts
    allow weekly; those that contracts keep from weekly use are refused. calendar: see series_findings()."""
    for m in metrics or []:
        ok, why = catalog.metric(m).supports_weeks()
        if not ok:
            raise ValueError(why)
    chosen = metrics or [m.name for m in catalog.weekly()[0]]
    found = benjamini_hochberg(series_findings(long_metrics(lattice(panel), chosen), alpha, calendar=calendar), q)
    return with_impact(labelled(found), catalog).withColumn("material", F.col("survives_fdr") & F.col("meets_threshold"))


def coverage() -> Column:
    """The share of held-back residuals inside intervals set on the residuals before them."""
    return F.try_divide(F.sum("hits").cast("double"), F.sum("holdouts").cast("double"))
