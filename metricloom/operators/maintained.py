"""The weekly panel as a table that late lines are merged into: a partition a week, and only touched weeks rewritten."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import DIMENSIONS
from ..sources.scratch import release, stored
from ..sources.tables import KEYS
from .panel import MEASURES, with_tickets

#: What is kept of a leaf week: sums, so that late lines add to them; ratios and allocated tickets are made on reading.
KEPT = {m: "bigint" for m in ("deliveries", "in_time", "returns")} | {"revenue": "decimal(28,4)"} | {m: "decimal(28,2)" for m in ("net_units", "gross_orders", "cancellations")}
SCHEMA = ", ".join([*(f"{d} string" for d in DIMENSIONS), *(f"{m} {t}" for m, t in KEPT.items()), "week date"])


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        found = spark.read.schema(SCHEMA).parquet(path)
        found.schema  # noqa: B018  (resolves the path)
        return found
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def merge_lines(path: str, lines: DataFrame) -> list[date]:
    """Adds lines (as tables.measured() gives them, each once) to the panel under path and returns the weeks that they
    touch. Those weeks' old rows are read, by partition, summed with the new ones, kept apart until they are whole, and
    put in their partitions' place; other weeks' files stay as they are. Lines without a week belong to none."""
    spark = lines.sparkSession
    total = [F.sum(m).cast(t).alias(m) for m, t in KEPT.items()]
    new = stored(lines.where("week IS NOT NULL").groupBy(*KEYS).agg(*total), "increment")
    weeks = sorted(r[0] for r in new.select("week").distinct().collect())  # bounded by the calendar
    old = _table(spark, path)
    merged = new if old is None else stored(old.where(F.col("week").isin(weeks)).unionByName(new).groupBy(*KEYS).agg(*total), "merged")
    if weeks:
        merged.repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)
    release(*{id(df): df for df in (new, merged)}.values())
    return weeks


def read_panel(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """The panel, as panel_of() gives it, of all weeks or those that end on a date or later: no other files are read."""
    found = spark.read.schema(SCHEMA).parquet(path)
    found = found if since is None else found.where(F.col("week") >= F.lit(since))
    return with_tickets(found.select(*KEYS, *MEASURES, "returns"))
