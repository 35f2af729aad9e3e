"""What a run cost: timed stages and model calls, and the registry of methods."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGE = "name string, latency_ms double, kind string, notes string, rows bigint"
CALL = "stage string, model string, input_tokens bigint, output_tokens bigint, latency_ms double, cached boolean"


@dataclass
class Telemetry:
    """Collects stages and model calls of a run. Spark is lazy: a stage has to end in an action to be timed."""

    stages: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)

    @contextmanager
    def stage(self, name: str, kind: str = "deterministic", notes: str = "") -> Iterator[dict]:
        """Times a block, also if it fails; set `rows` in the dict it gives."""
        info: dict = {}
        began = time.perf_counter()
        try:
            yield info
        finally:
            self.stages.append((name, (time.perf_counter() - began) * 1000, kind, notes, info.get("rows")))

    def model_call(self, stage: str, model: str, input_tokens: int, output_tokens: int, latency_ms: float, cache_key: str | None = None) -> None:
        """A call; one with a cache key seen before costs no tokens."""
        cached = cache_key is not None and cache_key in self.seen
        if cache_key is not None:
            self.seen.add(cache_key)
        self.calls.append((stage, model, 0 if cached else input_tokens, 0 if cached else output_tokens, latency_ms, cached))

    def stage_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stages, STAGE)

    def call_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.calls, CALL)


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and what tells how many rows it had (`get["rows"]`) when the next action on it has run: no job of its own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def by_kind(stages: DataFrame) -> DataFrame:
    return stages.groupBy("kind").agg(F.round(F.sum("latency_ms"), 3).alias("latency_ms"), F.count("*").alias("n"), F.sum("rows").alias("rows"))


def call_costs(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Tokens and cost per model; prices are for a million input and output tokens. Models without a price cost null."""
    table = calls.sparkSession.createDataFrame([(m, a, b) for m, (a, b) in prices.items()], "model string, input_price double, output_price double")
    rows = calls.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if("cached").alias("cached"))
    return rows.join(F.broadcast(table), "model", "left").withColumn("cost", (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6).drop("input_price", "output_price")


def summary(stages: DataFrame, calls: DataFrame, prices: dict[str, tuple[float, float]], rate: float) -> DataFrame:
    """One row of a run: its latency, the share of it that model calls took, their tokens, and their cost in the
    currency of the prices and in another at `rate` of it."""
    spent = call_costs(calls, prices).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    waited = calls.agg(F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("model_ms"))
    total = stages.agg(F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_ms"), F.count("*").alias("stages"))
    row = total.join(F.broadcast(spent)).join(F.broadcast(waited))
    return row.select("latency_ms", "stages", F.coalesce(F.try_divide("model_ms", "latency_ms"), F.lit(0.0)).alias("model_share"), "input_tokens", "output_tokens", "cost", (F.col("cost") * rate).alias("cost_other"))


#: The methods of the engine by phase and category.
METHODS = (
    ("align", "weekly panel", "relational", "full outer join at leaf grain, ratios as sums over sums"),
    ("align", "coarse measures", "relational", "allocation by revenue share"),
    ("align", "freshness", "rule", "age against the contract's tolerance"),
    ("align", "conflicts", "rule", "units times price against revenue"),
    ("detect", "slices", "relational", "grouping sets over leaf weeks"),
    ("detect", "forecast", "statistical", "ridge regression on trend and harmonics"),
    ("detect", "interval", "statistical", "split conformal with adaptive level"),
    ("detect", "p-value", "statistical", "empirical, with a Pareto tail near its floor"),
    ("detect", "multiplicity", "statistical", "Benjamini-Hochberg over all tests"),
    ("attribute", "dimensions", "statistical", "exact Shapley values"),
    ("attribute", "drivers", "rule", "price, volume and mix; funnel"),
    ("attribute", "slice", "rule", "deepest slice with enough of the gap"),
    ("explain", "topics", "ml", "TF-IDF and k-means"),
    ("explain", "graph", "rule", "recursive reachability"),
    ("explain", "onset", "statistical", "three sigma with persistence"),
    ("prosecute", "effect", "causal", "two-way fixed effects"),
    ("prosecute", "counterfactual", "causal", "synthetic control"),
    ("prosecute", "placebos", "causal", "rank of the gap ratio"),
    ("prosecute", "dose", "causal", "exposure against effect"),
    ("prosecute", "refutation", "causal", "time, donor and noise placebos"),
    ("abstain", "triggers", "rule", "eight triggers, mode and confidence"),
    ("decide", "bundles", "optimisation", "exhaustive masks with gates"),
    ("decide", "check", "optimisation", "branch and bound"),
    ("narrate", "text", "template", "persona templates"),
    ("narrate", "release", "rule", "numeric grounding"),
    ("govern", "access", "rule", "row and column scope"),
    ("govern", "feedback", "rule", "append-only records"),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHODS), "phase string, step string, category string, method string")
