"""Which levers to pull: bundles of levers as bit masks, values behind gated constraints, budget and authority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.contracts import PORTFOLIO, Portfolio


def realised(relieved: Column, constraints: list[tuple[int, int]]) -> Column:
    """The constraints of a mask whose requirements are realised too: the fixpoint of dropping those whose aren't."""
    gates = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(need).alias("need")) for bit, need in constraints * len(constraints)))
    kept = lambda m, c: F.when((m.bitwiseAND(c["bit"]) != 0) & (m.bitwiseAND(c["need"]) != c["need"]), m.bitwiseXOR(c["bit"])).otherwise(m)
    return F.aggregate(gates, relieved, kept)


def bundles(spark: SparkSession, portfolio: Portfolio = PORTFOLIO, budget: float | None = None, authority: str | None = None) -> DataFrame:
    """All sets of levers that the authority may use, the empty one included: bundle (mask of levers), levers,
    cost, relieved, realised, value, n_families, feasible and, if not, the reason. Sets are numbers dealt over tasks, each summed by
    itself, without a shuffle."""
    levers = [v for v in portfolio.levers if authority is None or portfolio.rank_of(v.authority) <= portfolio.rank_of(authority)]
    budget = portfolio.budget if budget is None else budget
    rows = spark.range(1 << len(levers)).select(F.col("id").alias("bundle"))
    held = [F.col("bundle").bitwiseAND(1 << k) != 0 for k in range(len(levers))]
    total = lambda values: reduce(lambda a, b: a + b, values, F.lit(0.0))
    relieved = reduce(lambda a, b: a.bitwiseOR(b), [F.when(h, portfolio.mask(v.relieves)).otherwise(0) for h, v in zip(held, levers, strict=True)], F.lit(0))
    rows = rows.withColumns(
        {
            "levers": F.array_join(F.array_compact(F.array(*(F.when(h, v.id) for h, v in zip(held, levers, strict=True)))), "+") if levers else F.lit(""),
            "cost": total([F.when(h, v.cost).otherwise(0.0) for h, v in zip(held, levers, strict=True)]),
            "relieved": relieved.cast("int"),
            "n_families": F.size(F.array_distinct(F.array_compact(F.array(*(F.when(h, v.family) for h, v in zip(held, levers, strict=True)))))) if levers else F.lit(0),
        }
    )
    gates = [(portfolio.bit(c.id), portfolio.mask(c.requires)) for c in portfolio.constraints]
    rows = rows.withColumn("realised", realised(F.col("relieved"), gates).cast("int"))
    value = total([F.when(F.col("realised").bitwiseAND(portfolio.bit(c.id)) != 0, c.blocked_value).otherwise(0.0) for c in portfolio.constraints])
    over = F.concat(F.lit("costs "), F.format_number(F.col("cost") - budget, 0), F.lit(" more than the budget"))
    return rows.withColumns({"value": value, "feasible": F.col("cost") <= budget, "reason": F.when(F.col("cost") > budget, over)})


def undominated(all_bundles: DataFrame, infeasible: bool = False) -> DataFrame:
    """The cheapest feasible bundle (ties: lowest number) of each realised set; with infeasible also all bundles that
    the budget rules out, with their reasons."""
    w = Window.partitionBy("realised", "feasible").orderBy("cost", "bundle")
    rows = all_bundles if infeasible else all_bundles.where("feasible")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1 OR NOT feasible").drop("_r")


def ranked(all_bundles: DataFrame, n: int = 10) -> DataFrame:
    """The best n: most value, least cost, lowest number."""
    best = undominated(all_bundles).orderBy(F.desc("value"), "cost", "bundle").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "cost", "bundle"))).withColumns(
        {"weeks_to_payback": F.try_divide(F.col("cost"), F.nullif(F.col("value"), F.lit(0.0))), "value_per_cost": F.try_divide(F.col("value"), F.nullif(F.col("cost"), F.lit(0.0)))}
    )


def budget_sweep(all_bundles: DataFrame, budgets: list[float]) -> DataFrame:
    """The best bundle at each budget; each budget keeps one running best per task before rows meet."""
    grid = F.explode(F.array(*(F.lit(float(b)) for b in budgets))).alias("budget")
    fit = all_bundles.select("*", grid).where("cost <= budget")
    best = fit.groupBy("budget").agg(F.max(F.struct("value", (-F.col("cost")).alias("c"), (-F.col("bundle")).alias("b"), "levers")).alias("x"))
    return best.select("budget", "x.levers", (-F.col("x.c")).alias("cost"), "x.value")


def best_by_bounds(portfolio: Portfolio = PORTFOLIO, budget: float | None = None) -> tuple[tuple[str, ...], float]:
    """The same optimum by branch and bound on the driver, over the few levers of a contract: a check on the
    exhaustive plan. The bound of a branch is the value if it pulled all levers that are left."""
    budget = portfolio.budget if budget is None else budget
    order = portfolio.levers

    def value(mask: int) -> float:
        while True:
            kept = sum(b for c in portfolio.constraints if mask & (b := portfolio.bit(c.id)) and mask & (r := portfolio.mask(c.requires)) == r)
            if kept == mask:
                return sum(c.blocked_value for c in portfolio.constraints if mask & portfolio.bit(c.id))
            mask = kept

    masks = [portfolio.mask(v.relieves) for v in order]
    rest = [reduce(int.__or__, masks[k:], 0) for k in range(len(order) + 1)]
    best: tuple = (0.0, 0.0, ())

    def walk(k: int, mask: int, cost: float, chosen: tuple[str, ...]) -> None:
        nonlocal best
        if (v := value(mask), -cost) > best[:2]:
            best = (v, -cost, chosen)
        if k < len(order) and value(mask | rest[k]) >= best[0]:
            if cost + order[k].cost <= budget:
                walk(k + 1, mask | masks[k], cost + order[k].cost, (*chosen, order[k].id))
            walk(k + 1, mask, cost, chosen)

    walk(0, 0, 0.0, ())
    return best[2], best[0]


def greedy(spark: SparkSession, portfolio: Portfolio = PORTFOLIO, budget: float | None = None) -> DataFrame:
    """Two greedy orders (cheapest first, best value for cost first) filled up to the budget: method, levers, cost,
    value. A fill is a running decision over a contract's few levers, so it folds over one sorted array."""
    budget = portfolio.budget if budget is None else budget
    one = bundles(spark, portfolio, float("inf")).where("bit_count(bundle) = 1").select("levers", "cost", "value", "bundle", (-F.try_divide(F.col("value"), F.col("cost"))).alias("ratio"))
    orders = one.select(F.explode(F.array(F.struct(F.lit("cheapest").alias("method"), F.col("cost").alias("key")), F.struct(F.lit("value_for_cost").alias("method"), F.col("ratio").alias("key")))).alias("o"), "cost", "bundle").select("o.method", "o.key", "cost", "bundle")
    lists = orders.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("key", "bundle", "cost"))).alias("l"))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("bigint").alias("bundle"))
    step = lambda acc, x: F.when(acc["cost"] + x["cost"] <= budget, F.struct((acc["cost"] + x["cost"]).alias("cost"), acc["bundle"].bitwiseOR(x["bundle"]).alias("bundle"))).otherwise(acc)
    filled = lists.select("method", F.aggregate("l", start, step)["bundle"].alias("bundle"))
    return filled.join(bundles(spark, portfolio, budget).select("bundle", "levers", "cost", "value"), "bundle").select("method", "levers", "cost", "value")


def recommendations(chosen: DataFrame, portfolio: Portfolio, driver: str, confidence: float) -> DataFrame:
    """One record per lever of the chosen bundle, with what to watch for."""
    levers = portfolio.lever_table(chosen.sparkSession)
    rows = chosen.select(F.explode(F.split("levers", r"\+")).alias("lever"), F.col("value").alias("bundle_value")).where("lever <> ''")
    return rows.join(F.broadcast(levers), "lever").select("lever", "label", "cost", "authority", "family", "bundle_value", F.lit(driver).alias("driver"), F.lit(confidence).alias("confidence"), F.lit("compare weekly value with the bundle's; review after four weeks").alias("monitoring"))
