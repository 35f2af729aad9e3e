"""The engine's sources on star-schema tables, and readers and writers of its own artefacts."""

from __future__ import annotations

import json
import math
from datetime import UTC, date, datetime, time, timedelta
from pathlib import Path
from typing import Any

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import DIMENSIONS
from .scratch import stored

KEYS = ("week", *DIMENSIONS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_end(date):
    """The Sunday that ends the date's week."""
    return F.next_day(F.date_sub(date.cast("date"), 1), "Sun")


def order_lines(spark: SparkSession, sf_dir: str, since: date | None = None) -> DataFrame:
    """One row per order line with the analysis dimensions, of orders since a date if one is given (the scan gets
    that as a filter); amounts are decimals, so sums do not depend on order. Lines are as narrow as they get before they
    are joined, and meet their orders, which know their customers, last (first where a date leaves few): no join moves
    names that a later one could bring."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders") if since is None else t("orders").where(F.col("o_orderdate") >= F.lit(datetime.combine(since, time())).cast("timestamp_ntz"))
    orders = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "o_orderpriority", "c_mktsegment", "c_nationkey")
    lines = t("lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.col("l_shipdate").cast("date").alias("shipped"),
    )
    ordered, made = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    lines = lines.join(t("part"), made).drop("l_partkey").join(orders, ordered) if since is None else lines.join(orders, ordered).join(t("part"), made)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
        week_end(F.col("o_orderdate")).alias("week"),
        F.col("r_name").alias("region"),
        F.col("p_type").alias("product_line"),
        F.col("o_orderpriority").alias("channel"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("p_brand").alias("brand"),
        "quantity",
        "amount",
        "returned",
        (F.col("shipped") <= F.date_add(F.col("o_orderdate").cast("date"), 30)).alias("in_time"),
    )


def last_week(spark: SparkSession, sf_dir: str) -> date | None:
    """The last week with order lines, looked for from the last order date backwards, so that few orders are read."""
    first, last = table(spark, sf_dir, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    days = 28
    while last is not None:
        since = (last - timedelta(days=days)).date()
        found = order_lines(spark, sf_dir, since).agg(F.max("week")).first()[0]
        if found is not None or since < first.date():
            return found
        days *= 8
    return None


def measured(lines: DataFrame) -> DataFrame:
    """order_lines with what sources report of each line as columns to sum, at whatever grain is wanted."""
    none = F.lit(0).cast("decimal(18,4)")
    columns = {
        "revenue": F.when(F.col("returned"), none).otherwise(F.col("amount")),
        "net_units": F.when(F.col("returned"), none.cast("decimal(18,2)")).otherwise(F.col("quantity")),
        "gross_orders": F.col("quantity"),
        "cancellations": F.when(F.col("returned"), F.col("quantity")).otherwise(none.cast("decimal(18,2)")),
        "deliveries": F.lit(1).cast("bigint"),
        "in_time": F.col("in_time").cast("bigint"),
        "returns": F.col("returned").cast("bigint"),
    }
    return lines.select(*KEYS, "nation", *(c.alias(n) for n, c in columns.items()))


def reported(lines: DataFrame) -> DataFrame:
    """What all sources report of order_lines, from one pass: sums per leaf week, with how many lines each is of."""
    kept = lambda c: F.when(~F.col("returned"), c)
    return lines.groupBy(*KEYS).agg(
        F.count_if(~F.col("returned")).alias("n_kept"),
        F.count_if("returned").alias("n_returned"),
        F.sum(kept(F.col("amount"))).alias("revenue"),
        F.sum(kept(F.col("quantity"))).alias("net_units"),
        F.avg(kept(F.try_divide("amount", "quantity")).cast("double")).alias("quoted_price"),
        F.sum("quantity").alias("gross_orders"),
        F.sum(F.when(F.col("returned"), F.col("quantity")).otherwise(0)).cast("decimal(28,2)").alias("cancellations"),
        F.count("*").alias("deliveries"),
        F.count_if("in_time").alias("in_time"),
    )


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """warehouse, order_system and logistics at leaf grain; tickets without segment. The lines are read and joined once:
    their sums are stored, and each source is a part of them."""
    leaves = stored(reported(order_lines(spark, sf_dir)), "leaves")
    return {
        "warehouse": leaves.where("n_kept > 0").select(*KEYS, "revenue", "net_units", "quoted_price"),
        "order_system": leaves.select(*KEYS, "gross_orders", "cancellations"),
        "logistics": leaves.select(*KEYS, "deliveries", "in_time"),
        "tickets": leaves.where("n_returned > 0").groupBy(*KEYS[:-1]).agg(F.sum("n_returned").alias("tickets")),
    }


# ---- artefacts -------------------------------------------------------------------------------------------------

FEEDBACK = "entity_type string, entity_id string, verdict string, cause_node string, note string, user string, ts string"
#: What feedback may be about and say.
ENTITY_TYPES = ("hypothesis", "action")
VERDICTS = ("confirmed", "rejected", "acted_on", "no_effect")


def append_feedback(spark: SparkSession, path: str, entity_type: str, entity_id: str, verdict: str, cause_node: str = "", note: str = "", user: str = "analyst") -> None:
    """Appends one validated record to a folder of JSON lines; nothing is rewritten."""
    if entity_type not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type {entity_type!r}")
    if verdict not in VERDICTS:
        raise ValueError(f"unknown verdict {verdict!r}")
    row = (entity_type, entity_id, verdict, cause_node, note, user, datetime.now(UTC).isoformat(timespec="microseconds"))
    spark.createDataFrame([row], FEEDBACK).coalesce(1).write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All feedback; a folder that isn't there yet has none."""
    try:
        found = spark.read.schema(FEEDBACK).json(path)
        found.schema  # noqa: B018  (resolves the path)
        return found.where("entity_id IS NOT NULL")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], FEEDBACK)
        raise


def finite(value: Any) -> Any:
    """For JSON: numbers that are not finite become null, at any depth."""
    if isinstance(value, dict):
        return {str(k): finite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [finite(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_text(path: str | Path, text: str) -> None:
    """A small file of the driver's, at any path or URI that Spark can write to."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).write_text(text)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(finite(value), indent=2, default=str, allow_nan=False))


def write_yaml(path: str | Path, value: Any) -> None:
    """As write_json does, in YAML: plain values only, keys in their order."""
    write_text(path, yaml.safe_dump(json.loads(json.dumps(finite(value), default=str)), sort_keys=False, allow_unicode=True))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
