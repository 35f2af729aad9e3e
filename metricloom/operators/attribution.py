"""Where a gap comes from: leaf expectations, Shapley shares of dimensions, price-volume-mix, funnel, slices."""

from __future__ import annotations

from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import log_bin, with_running_sum
from ..sources.contracts import DIMENSIONS
from .lattice import subsets
from .panel import within

N = len(DIMENSIONS)
LOOKBACK = 8
#: Weeks before the analysis week that expectations look back to.
FURTHEST = 61


def between(weeks_back_from: int, weeks_back_to: int) -> Column:
    """Whether a week lies that many weeks before the analysis week, both ends included."""
    return F.col("week").between(F.date_sub(F.col("at"), 7 * weeks_back_from), F.date_sub(F.col("at"), 7 * weeks_back_to))


def with_analysis_week(panel: DataFrame, at: Column | None = None) -> DataFrame:
    """panel with the analysis week `at`: the one given, else the last."""
    if at is not None:
        return panel.withColumn("at", at)
    return panel.join(F.broadcast(panel.agg(F.max("week").alias("at"))))


def mean_over(value: Column, when: Column) -> Column:
    """The mean of a decimal measure over rows that hold a condition; null without any."""
    return F.try_divide(F.sum(F.when(when, value)).cast("double"), F.count_if(when & value.isNotNull()).cast("double"))


def leaf_expectations(panel: DataFrame, metric: str = "revenue", at: Column | None = None) -> DataFrame:
    """Per leaf present in the analysis week: actual, expected and gap. Expected is the mean of the eight weeks
    before, times the change on last year (mean of weeks 53 to 51 back over 61 to 53 back) held to [0.5, 2] and 1
    if unknown. One aggregate pass over 61 weeks; week 53 back belongs to both windows."""
    rows = with_analysis_week(panel, at).where(between(FURTHEST, 0))
    value = F.col(metric)
    means = rows.groupBy(*DIMENSIONS).agg(
        F.sum(F.when(F.col("week") == F.col("at"), value)).cast("double").alias("actual"),
        mean_over(value, between(LOOKBACK, 1)).alias("recent_mean"),
        mean_over(value, between(53, 51)).alias("yoy_mean"),
        mean_over(value, between(61, 53)).alias("yoy_recent_mean"),
    )
    change = F.try_divide(F.col("yoy_mean"), F.nullif(F.col("yoy_recent_mean"), F.lit(0.0)))
    factor = F.when(change.isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(2.0), change)))
    expected = means.where("actual IS NOT NULL").withColumn("expected", F.col("recent_mean") * factor)
    return expected.where("expected IS NOT NULL").withColumn("gap", F.col("actual") - F.col("expected"))


def explained(leaves: DataFrame) -> DataFrame:
    """v(S) of each of the 16 sets of dimensions: the share of squared gaps that group means over S explain. One
    pass of grouping sets; coalition has a set bit for each dimension in S; v of no dimension is 0."""
    total = leaves.agg(F.sum(F.col("gap") * F.col("gap")).alias("total"))
    groups = leaves.groupingSets([[F.col(c) for c in s] for s in subsets()], *DIMENSIONS).agg(F.grouping_id().cast("int").alias("open"), F.count("*").alias("n"), F.sum("gap").alias("g"))
    by = groups.groupBy("open").agg(F.sum(F.col("g") * F.col("g") / F.col("n")).alias("s"))
    coalition = F.lit((1 << N) - 1) - F.col("open")
    return by.join(F.broadcast(total)).select(coalition.cast("int").alias("coalition"), F.when(coalition == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col("s"), F.col("total")), F.lit(0.0))).alias("v"))


def shapley(values: DataFrame) -> DataFrame:
    """Each dimension's exact Shapley share of v, in percent of their sum. Joins 16 rows with themselves."""
    weights = F.element_at(F.array(*(F.lit(factorial(k) * factorial(N - k - 1) / factorial(N)) for k in range(N))), F.bit_count("coalition") + 1)
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(1 << (N - 1 - k)).alias("bit")) for k, d in enumerate(DIMENSIONS)))).alias("d")
    without = values.select("coalition", "v", dims).where("coalition & d.bit = 0").withColumn("weight", weights)
    with_ = values.select(F.col("coalition").alias("joined"), F.col("v").alias("v1"))
    gains = without.join(F.broadcast(with_), F.col("joined") == F.col("coalition") + F.col("d.bit"))
    phi = gains.groupBy(F.col("d.dimension").alias("dimension")).agg(F.sum(F.col("weight") * (F.col("v1") - F.col("v"))).alias("phi"))
    return phi.select("dimension", F.round(100 * F.try_divide(F.col("phi"), F.sum("phi").over(Window.partitionBy())), 2).alias("share_pct"))


def base_and_current(panel: DataFrame, keys: list[str], measures: list[str], at: Column | None = None, base_weeks: int = LOOKBACK) -> DataFrame:
    """Per key: each measure in the analysis week (<m>1), and its mean weekly total over the weeks before (<m>0).
    The mean is over the weeks in which the key has rows."""
    rows = with_analysis_week(panel, at).where(between(base_weeks, 0))
    now = F.col("week") == F.col("at")
    weeks = F.count_distinct(F.when(~now, F.col("week"))).cast("double")
    columns = []
    for m in measures:
        columns += [F.coalesce(F.sum(F.when(now, F.col(m))).cast("double"), F.lit(0.0)).alias(f"{m}1"), F.coalesce(F.try_divide(F.sum(F.when(~now, F.col(m))).cast("double"), weeks), F.lit(0.0)).alias(f"{m}0")]
    return rows.groupBy(*keys).agg(*columns)


def price_volume_mix(panel: DataFrame, at: Column | None = None, spec: Mapping[str, str | None] | None = None) -> DataFrame:
    """The revenue change of a slice (none given: of all) split into volume, price and mix over product lines, and
    which is largest (ties: volume, price, mix). The analysis week is that of the whole panel. A product without base weeks has base price 0, so all its revenue counts as price."""
    products = base_and_current(within(with_analysis_week(panel, at), spec), ["product_line"], ["net_units", "revenue"], F.col("at"))
    price = lambda k: F.coalesce(F.try_divide(F.col(f"revenue{k}"), F.nullif(F.col(f"net_units{k}"), F.lit(0.0))), F.lit(0.0))
    products = products.withColumns({"p0": price(0), "p1": price(1)})
    totals = products.agg(F.sum("net_units0").alias("u0"), F.sum("net_units1").alias("u1"), F.sum("revenue0").alias("r0"), F.sum("revenue1").alias("r1"))
    rows = products.join(F.broadcast(totals))
    scale = F.coalesce(F.try_divide(F.col("u1"), F.nullif(F.col("u0"), F.lit(0.0))), F.lit(0.0))
    mean_price = F.coalesce(F.try_divide(F.col("r0"), F.nullif(F.col("u0"), F.lit(0.0))), F.lit(0.0))
    out = rows.agg(
        F.max((F.col("u1") - F.col("u0")) * mean_price).alias("volume"),
        F.sum((F.col("net_units1") - F.col("net_units0") * scale) * (F.col("p0") - mean_price)).alias("mix"),
        F.sum(F.col("net_units1") * (F.col("p1") - F.col("p0"))).alias("price"),
        F.max(F.col("r1") - F.col("r0")).alias("total_change"),
    )
    top = F.greatest(F.abs("volume"), F.abs("price"), F.abs("mix"))
    dominant = F.when(F.abs("volume") == top, "volume").when(F.abs("price") == top, "price").otherwise("mix")
    return out.select(*(F.round(c, 2).alias(c) for c in ("volume", "price", "mix", "total_change")), dominant.alias("dominant"))


def funnel(panel: DataFrame, at: Column | None = None, spec: Mapping[str, str | None] | None = None) -> DataFrame:
    """The change of a slice's net units (none given: of all) split into orders, cancellations and their interaction."""
    t = base_and_current(within(with_analysis_week(panel, at), spec), [], ["gross_orders", "cancellations"], F.col("at"))
    rate = lambda k: F.coalesce(F.try_divide(F.col(f"cancellations{k}"), F.nullif(F.col(f"gross_orders{k}"), F.lit(0.0))), F.lit(0.0))
    t = t.select(F.col("gross_orders0").alias("g0"), F.col("gross_orders1").alias("g1"), rate(0).alias("c0"), rate(1).alias("c1"))
    t = t.select(((F.col("g1") - F.col("g0")) * (1 - F.col("c0"))).alias("orders_effect"), (-F.col("g0") * (F.col("c1") - F.col("c0"))).alias("cancellation_effect"), (-(F.col("g1") - F.col("g0")) * (F.col("c1") - F.col("c0"))).alias("interaction"))
    top = F.greatest(F.abs("orders_effect"), F.abs("cancellation_effect"), F.abs("interaction"))
    dominant = F.when(F.abs("orders_effect") == top, "orders").when(F.abs("cancellation_effect") == top, "cancellations").otherwise("interaction")
    return t.select(*(F.round(c, 4).alias(c) for c in ("orders_effect", "cancellation_effect", "interaction")), dominant.alias("dominant"))


def top_leaves(leaves: DataFrame, n: int = 10) -> DataFrame:
    """The n leaves of largest absolute gap (ties by dimensions) with their share of the signed total."""
    total = leaves.agg(F.sum("gap").alias("total"))
    top = leaves.orderBy(F.desc(F.abs(F.round("gap", 4))), *DIMENSIONS).limit(n)
    return top.join(F.broadcast(total)).select(*DIMENSIONS, F.round("gap", 4).alias("gap"), F.round(F.try_divide(F.col("gap"), F.col("total")), 6).alias("share"))


def leaves_for_share(leaves: DataFrame, share: float = 0.8) -> DataFrame:
    """How many of the largest shortfalls make up `share` of all of them. Shortfalls are summed by magnitude first,
    and the running sum is over bins of magnitudes and inside them, so that no task sees all leaves."""
    short = leaves.where("gap < 0").groupBy(F.round("gap", 4).alias("gap")).agg(F.count("*").alias("n")).where("gap < 0")
    runs = with_running_sum(short, log_bin(-F.col("gap"), 16), -F.col("gap"), F.col("gap") * F.col("n"), "done", "total", descending=True, inclusive=False)
    fit = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((share * F.col("total") - F.col("done")) / F.col("gap") + 1e-9)))
    return runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_negative"), (F.coalesce(F.sum(fit), F.lit(0)) + F.when(F.count("*") > 0, 1).otherwise(0)).alias("n_leaves"))


def best_slice(leaves: DataFrame, least_share: float = 0.45) -> DataFrame:
    """The slice to blame: of the worst group of each set of dimensions, the deepest that holds at least
    least_share of the total gap (then the largest share); if none does, the one of largest share."""
    sets = [[F.col(c) for c in s] for s in subsets() if s]
    groups = leaves.groupingSets(sets, *DIMENSIONS).agg(F.grouping_id().cast("int").alias("open"), F.round(F.sum("gap"), 4).alias("gap"))
    worst = groups.withColumn("_r", F.row_number().over(Window.partitionBy("open").orderBy("gap", *DIMENSIONS))).where("_r = 1").drop("_r")
    total = leaves.agg(F.round(F.sum("gap"), 4).alias("total"))
    rows = worst.join(F.broadcast(total)).withColumns({"share": F.round(F.try_divide(F.col("gap"), F.nullif(F.col("total"), F.lit(0.0))), 6), "depth": F.lit(N) - F.bit_count("open")})
    keep = (F.col("share") >= least_share).cast("int")
    best = rows.orderBy(F.desc(keep), F.desc(keep * F.col("depth")), F.desc("share"), "open").limit(1)
    shown = [F.when(F.col("open").bitwiseAND(1 << (N - 1 - k)) != 0, "ALL").otherwise(F.col(d)).alias(d) for k, d in enumerate(DIMENSIONS)]
    return best.select(*shown, "depth", "gap", "share")
