"""The lattice of slices: one cube over all measures, metrics in long form, and series statistics."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.contracts import DIMENSIONS
from ..sources.scratch import release, stored
from .panel import MEASURES, with_ratios

#: What is summed in every slice.
SUMMED = (*MEASURES, "ticket_volume")


def subsets() -> list[tuple[str, ...]]:
    return [c for n in range(len(DIMENSIONS) + 1) for c in combinations(DIMENSIONS, n)]


def lattice(panel: DataFrame) -> DataFrame:
    """Every slice's weekly measures and ratios. Rows are summed to leaf weeks before they are expanded 16 times;
    level has a set bit for each dimension that is left open, the last dimension's lowest. Allocated tickets are
    fractions: as decimals their sums don't depend on the order."""
    panel = panel.withColumn("ticket_volume", F.col("ticket_volume").cast("decimal(28,12)"))
    leaves = panel.groupBy("week", *DIMENSIONS).agg(*(F.sum(m).alias(m) for m in SUMMED))
    sets = [[F.col(c) for c in ("week", *s)] for s in subsets()]
    return with_ratios(leaves.groupingSets(sets, "week", *DIMENSIONS).agg(F.grouping_id().cast("int").alias("level"), *(F.sum(m).alias(m) for m in SUMMED)))


def labelled(slices: DataFrame) -> DataFrame:
    """Dimensions that a slice leaves open read ALL, whatever their nulls; null values stay null."""
    n = len(DIMENSIONS)
    return slices.withColumns({d: F.when(F.col("level").bitwiseAND(1 << (n - 1 - k)) != 0, "ALL").otherwise(F.col(d)) for k, d in enumerate(DIMENSIONS)})


def wow(slices: DataFrame, metric: str) -> DataFrame:
    """Change on the week before among the slice's own weeks, in percent; null for the first and where that was 0."""
    w = Window.partitionBy("level", *DIMENSIONS).orderBy("week")
    before = F.lag(F.col(metric)).over(w).cast("double")
    return slices.withColumn("wow_pct", (F.col(metric).cast("double") - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100)


def eligible(slices: DataFrame, metric: str, least_weeks: int = 10) -> DataFrame:
    """Series long enough to test: enough weeks with a value, one of them the last of all weeks, and not constant."""
    last = slices.agg(F.max("week").alias("last_week"))
    stats = slices.where(F.col(metric).isNotNull()).groupBy("level", *DIMENSIONS).agg(F.count("*").alias("n_weeks"), F.max("week").alias("latest"), F.stddev_pop(F.col(metric).cast("double")).alias("spread"))
    return stats.join(F.broadcast(last), F.col("latest") == F.col("last_week")).where((F.col("n_weeks") >= least_weeks) & (F.col("spread") > 1e-8)).drop("last_week")


def long_metrics(slices: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per slice, week and metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("p")
    return slices.select("level", *DIMENSIONS, "week", pairs).select("level", *DIMENSIONS, "week", "p.metric", "p.value").where("value IS NOT NULL")


# ---- from the top, without slices that can't last ----------------------------------------------------------------


def _level(dims: tuple[str, ...]) -> int:
    n = len(DIMENSIONS)
    return sum(1 << (n - 1 - k) for k, d in enumerate(DIMENSIONS) if d not in dims)


def iceberg(panel: DataFrame, metric: str, least_weeks: int = 10) -> tuple[DataFrame, DataFrame]:
    """The rows of eligible(lattice(panel), metric), found from the grand total down, and per number of dimensions how
    many leaf weeks came in, how many of them no slice took any more, and how many slices were formed and kept.

    A slice has at most the weeks of any slice it refines, so refinements of one that has too few, or lacks the last
    week, are never formed: of each leaf week it is known which of its slices of d dimensions were kept, and it goes
    only into those of d + 1 all of whose parents were. One grouping a number of dimensions, of what is left of the
    leaf weeks; a slice that is kept but doesn't vary isn't returned, but refined."""
    spark = panel.sparkSession
    panel = panel.withColumn("ticket_volume", F.col("ticket_volume").cast("decimal(28,12)"))
    rows = panel.groupBy("week", *DIMENSIONS).agg(*(F.sum(m).alias(m) for m in SUMMED)).withColumn("_kept", F.array(F.lit(_level(()))))
    rows = stored(rows, "leaves")
    last = rows.agg(F.max("week")).first()[0]
    found, counts, held = [], [], [rows]
    for depth in range(len(DIMENSIONS) + 1):
        sets = [s for s in subsets() if len(s) == depth]
        parents = {s: [_level(tuple(d for d in s if d != gone)) for gone in s] for s in sets}
        rows = rows.withColumn("_wanted", F.array_compact(F.array(*(F.when(F.size(F.array_intersect("_kept", F.array(*map(F.lit, parents[s])))) == depth if depth else F.lit(True), F.lit(_level(s))) for s in sets))))
        into = rows.select("week", *DIMENSIONS, *SUMMED, F.explode("_wanted").alias("level"))
        masked = [F.when(F.col("level").bitwiseAND(_level(tuple(x for x in DIMENSIONS if x != d))) == 0, F.col(d)).alias(d) for d in DIMENSIONS]
        weekly = with_ratios(into.select("week", "level", *masked, *SUMMED).groupBy("week", "level", *DIMENSIONS).agg(*(F.sum(m).alias(m) for m in SUMMED)))
        known = F.col(metric).isNotNull()
        stats = weekly.groupBy("level", *DIMENSIONS).agg(F.count_if(known).alias("n_weeks"), F.max(F.when(known, F.col("week"))).alias("latest"), F.stddev_pop(F.col(metric).cast("double")).alias("spread"))
        stats = stored(stats, "slices")
        lasts = (F.col("n_weeks") >= least_weeks) & F.coalesce(F.col("latest") == F.lit(last), F.lit(False))
        found.append(stats.where(lasts))
        n = stats.agg(F.count("*").alias("formed"), F.count_if(lasts).alias("kept")).first()
        came = rows.agg(F.count("*").alias("rows"), F.count_if(F.size("_wanted") == 0).alias("idle")).first()
        counts.append((depth, came["rows"], came["idle"], n["formed"], n["kept"]))
        if depth == len(DIMENSIONS) or not n["kept"]:
            break
        rows, flags = rows.where(F.size("_wanted") > 0).drop("_wanted", "_kept"), [f"_kept_{_level(s)}" for s in sets]
        for s, flag in zip(sets, flags, strict=True):  # which slices of this depth a leaf week's are kept
            own = found[-1].where(F.col("level") == _level(s)).select(*(F.col(d).alias(f"_own_{d}") for d in s), F.col("level").alias(flag))
            same = reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(f"_own_{d}")) for d in s), F.lit(True))
            rows = rows.join(own, same, "left").drop(*(f"_own_{d}" for d in s)) if s else rows.withColumn(flag, F.lit(_level(s)))
        rows = stored(rows.withColumn("_kept", F.array_compact(F.array(*flags))).drop(*flags), "leaves")
        held.append(rows)
    release(*held)
    every = reduce(DataFrame.unionByName, found)
    return every.where(F.col("spread") > 1e-8), spark.createDataFrame(counts, "dimensions int, leaf_weeks bigint, idle bigint, formed bigint, kept bigint")
