"""Sources on one weekly panel: alignment, allocation, freshness, conflicts and row-level access."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.contracts import DIMENSIONS, METRICS, Catalog, Persona
from ..sources.tables import KEYS, measured, order_lines

MEASURES = ("revenue", "net_units", "gross_orders", "cancellations", "deliveries", "in_time")


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient in double; null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def with_ratios(df: DataFrame) -> DataFrame:
    """Ratios as sums over sums, at whatever grain df is."""
    return df.withColumns(
        {
            "asp": ratio(F.col("revenue"), F.col("net_units")),
            "cancellation_rate": ratio(F.col("cancellations"), F.col("gross_orders")),
            "delivery_sla_pct": ratio(F.col("in_time"), F.col("deliveries")),
        }
    )


def allocated(panel: DataFrame, coarse: DataFrame, column: str, out: str) -> DataFrame:
    """A measure that is coarser by the last dimension, shared out by revenue; without revenue a leaf gets 0,
    without a coarse row null. The new column is marked as imputed."""
    keys = KEYS[:-1]
    share = F.coalesce(ratio(F.col("revenue"), F.sum("revenue").over(Window.partitionBy(*keys))), F.lit(0.0))
    joined = panel.withColumn("_share", share).join(coarse.select(*keys, column), list(keys), "left")
    return joined.withColumn(out, F.col(column) * F.col("_share")).drop("_share", column).withMetadata(out, {"grain": "imputed"})


def align(given: dict[str, DataFrame]) -> DataFrame:
    """The weekly panel at leaf grain: a full outer join of what sources report, tickets allocated. All frames are
    hash-partitioned by the leaf key, so the joins add no shuffle. Missing sums are 0, missing ratios null."""
    panel = given["warehouse"].select(*KEYS, "revenue", "net_units")
    for name, columns in (("order_system", ("gross_orders", "cancellations")), ("logistics", ("deliveries", "in_time"))):
        panel = panel.join(given[name].select(*KEYS, *columns), list(KEYS), "full")
    panel = panel.withColumns({m: F.coalesce(m, F.lit(0)) for m in MEASURES})
    return with_ratios(allocated(panel, given["tickets"], "tickets", "ticket_volume"))


def summed(lines: DataFrame, *keys: str) -> DataFrame:
    """measured() lines summed by keys, with ratios: each task sums its own lines first."""
    return with_ratios(lines.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in (*MEASURES, "returns"))))


def panel_of(spark: SparkSession, sf_dir: str, since: date | None = None) -> DataFrame:
    """The weekly panel of the star schema, of orders since a date if one is given: what align() gives of its
    sources, from one pass over the lines. Tickets are counted by leaf, summed over the leaves that share them and
    allocated by revenue; without any there they are null."""
    return with_tickets(measured(order_lines(spark, sf_dir, since)).groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in (*MEASURES, "returns"))))


def with_tickets(leaves: DataFrame) -> DataFrame:
    """Leaf weeks' sums with ratios, and the returns of leaves that share tickets allocated by revenue."""
    leaves = with_ratios(leaves)
    together = Window.partitionBy(*KEYS[:-1])
    share = F.coalesce(ratio(F.col("revenue"), F.sum("revenue").over(together)), F.lit(0.0))
    tickets = F.nullif(F.sum("returns").over(together), F.lit(0).cast("bigint")) * share
    return leaves.withColumn("ticket_volume", tickets).drop("returns").withMetadata("ticket_volume", {"grain": "imputed"})


def within(df: DataFrame, spec: Mapping[str, str | None] | None) -> DataFrame:
    """Rows of a slice: dimension -> value; dimensions that are missing, null or ALL are left open."""
    for dimension, value in (spec or {}).items():
        if value not in (None, "ALL"):
            df = df.where(F.col(dimension) == value)
    return df


def excluded_metrics(spark: SparkSession, catalog: Catalog = METRICS) -> DataFrame:
    """Metrics that weekly analysis leaves out, each with its reason."""
    return spark.createDataFrame(list(catalog.weekly()[1].items()), "metric string, reason string")


def freshness(given: dict[str, DataFrame], as_of: Column, catalog: Catalog = METRICS) -> DataFrame:
    """Per source: its latest period, its age in hours and whether it is older than its contract tolerates. A
    source's last ingestion is its latest period's end, or the refresh before as_of if that is later."""
    spec = {m.source: m for m in catalog.metrics.values()}
    rows = None
    for name, df in given.items():
        m = spec.get(name)
        if m is None:
            continue
        ended = F.datediff(as_of, F.max("week")) * 24.0
        one = df.agg(F.max("week").alias("latest_period"), ended.alias("behind")).select(
            F.lit(name).alias("source"), F.lit(m.grain).alias("native_grain"), "latest_period",
            F.round(F.greatest(F.least(F.col("behind"), F.greatest(F.col("behind") - 24.0 * 7, F.lit(m.refresh_minutes / 60.0))), F.lit(0.0)), 1).alias("age_hours"),
            F.lit(float(m.tolerance_hours)).alias("tolerance_hours"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("status", F.when(F.col("age_hours") > F.col("tolerance_hours"), "stale").otherwise("fresh"))


def conflicts(warehouse: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """How many leaf weeks contradict themselves (units times quoted price against revenue) by more than tolerance,
    and by how much at most."""
    off = F.abs(F.col("net_units").cast("double") * F.col("quoted_price") - F.col("revenue").cast("double")) / F.nullif(F.col("revenue").cast("double"), F.lit(0.0))
    found = warehouse.select(off.alias("off")).where(F.col("off") > tolerance)
    return found.agg(F.count("*").alias("n_conflicts"), F.round(F.max("off"), 6).alias("largest_gap"))


def scoped(panel: DataFrame, persona: Persona) -> DataFrame:
    """The panel as a persona may see it: own regions only (none given: all), without restricted columns."""
    rows = panel.where(F.col("region").isin(*persona.regions)) if persona.regions else panel
    return rows.drop(*persona.restricted)


def leaf_weeks(panel: DataFrame) -> DataFrame:
    return panel.select("week", *DIMENSIONS, *MEASURES)
