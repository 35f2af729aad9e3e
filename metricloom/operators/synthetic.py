"""Synthetic controls of many units at once, from one Gram matrix.

Every unit is compared with a mixture of the others whose weights are not negative and sum to 1. All of that depends
on the units' scaled series before the start only through their inner products, so these are summed in Spark once, a
row a unit, and each unit, leave-out or random donor is a problem on the same matrix: its own row is the aim, and rows
of units that may not give are left out. No series is copied to a problem. Of more than GRAM_UNITS units the matrix
isn't formed; products with it then go by way of the weeks' vectors, which are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics

PRE_WEEKS, POST_WEEKS, LEAST_WEEKS = 52, 5, 20
#: Most units of one Gram matrix, which tasks get whole; and most units at all, whose weekly vectors tasks get.
GRAM_UNITS, MOST_UNITS = 1024, 50_000
NOISE_UNIT, NOISE_SEED = "_noise", 11
CONTROL = "unit string, gap double, gap_pct double, pre_rmse double, gap_ratio double, weights map<string,double>"
PROBLEM = "problem int, case int, unit string, out array<string>"


def weekly_vectors(series: DataFrame, starts: list[Column], value: str = "rate", fill: float | str | None = None) -> DataFrame:
    """A row for each start (case) and week with the units' values: case, week, post, units, values (units in order).
    Weeks are those of the year before a start and the first POST_WEEKS weeks that any unit has from it on. Where a unit
    lacks a week, the week counts as `fill` for it, with "mean" as its own mean before the start (null here, 1 once it
    is scaled); without fill, weeks that some unit lacks are left out of its case."""
    rows = series.where(F.col("unit").isNotNull()).select("unit", "week", F.col(value).cast("double").alias("v"))
    rows = rows if fill in (None, "mean") else rows.fillna(fill, ["v"])
    cases = F.array(*(F.struct(F.lit(k).alias("case"), s.alias("start")) for k, s in enumerate(starts)))
    rows = rows.where("v IS NOT NULL").select("*", F.inline(cases)).where(F.col("week") >= F.date_sub("start", 7 * PRE_WEEKS))
    weeks = rows.groupBy("case", "week").agg(F.array_sort(F.collect_list(F.struct("unit", "v"))).alias("u"), F.any_value(F.col("week") >= F.col("start")).alias("post"))
    nth = F.row_number().over(Window.partitionBy("case", "post").orderBy("week"))  # a row a week
    weeks = weeks.withColumn("nth", nth).where(f"NOT post OR nth <= {POST_WEEKS}")
    units = weeks.groupBy("case").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("u.unit")))).alias("units"))  # a row a case
    met = weeks.join(F.broadcast(units), "case")
    if fill is None:
        return met.where("size(u) = size(units)").select("case", "week", "post", "units", F.col("u.v").alias("values"))
    held = F.map_from_entries("u")
    return met.withColumn("held", held).select("case", "week", "post", "units", F.transform("units", lambda x: F.coalesce(F.col("held")[x], F.lit(None if fill == "mean" else fill).cast("double"))).alias("values"))


def scaled_vectors(vectors: DataFrame) -> DataFrame:
    """The vectors in units of each unit's mean before the start; means of 0 make nulls, which leave the unit out."""
    place = F.posexplode("values").alias("k", "v")
    means = vectors.where("NOT post").select("case", place).groupBy("case", "k").agg(F.avg("v").alias("m"))
    means = means.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("k", "m")))["m"].alias("means"))  # a row a case
    scaled = F.zip_with("values", "means", lambda v, m: F.when(m != 0, F.coalesce(v / m, F.lit(1.0))))
    return vectors.join(F.broadcast(means), "case").select("case", "week", "post", "units", "means", scaled.alias("x"))


def gram(scaled: DataFrame, units: int) -> DataFrame:
    """case, k and the k-th row of the inner products over the weeks before the start. Each task adds up its weeks'
    outer products; the partial rows meet by (case, k)."""
    schema = "case int, k int, products array<double>"

    def rows_of(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for case, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), case, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["case", "k", "products"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for case, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.array([0.0 if a is None else a for a in x.as_py()])
                sums[case] = sums.get(case, 0.0) + np.outer(v, v)
        yield from rows_of(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for case, k, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                sums[case, k] = sums.get((case, k), 0.0) + np.array(row.as_py())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["case", "k", "products"])

    parts = scaled.where("NOT post").select("case", "x").mapInArrow(partial, schema)
    return parts.repartition("case", "k").mapInArrow(total, schema)


@dataclass
class Case:
    """What problems of one start need: names, means, inner products (or the weeks' vectors) and means after it."""

    units: list[str]
    means: np.ndarray
    usable: np.ndarray
    after: np.ndarray
    weeks: int
    products: np.ndarray | None
    vectors: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return w @ self.products if self.products is not None else w @ self.vectors.T @ self.vectors

    def block(self, k: np.ndarray) -> np.ndarray:
        return self.products[np.ix_(k, k)] if self.products is not None else self.vectors[:, k].T @ self.vectors[:, k]


def cases(series: DataFrame, starts: list[Column], value: str = "rate", fill: float | str | None = None, noise: float = 0.0, gram_units: int = GRAM_UNITS) -> dict[int, Case]:
    """The Case of each start that has enough weeks. With noise a further unit is the mean of all, with a random error
    of that size. What the driver gets is a vector a week and a Gram row a unit, of MOST_UNITS units at most."""
    vectors = weekly_vectors(series, starts, value, fill)
    if noise:
        rng = np.random.default_rng(NOISE_SEED)
        errors = F.array(*(F.lit(float(e)) for e in rng.normal(0, noise, PRE_WEEKS + POST_WEEKS + 2)))
        at = F.row_number().over(Window.partitionBy("case").orderBy("week")) - 1
        known = F.filter("values", lambda v: v.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
        vectors = vectors.withColumn("noisy", mean * (1 + F.get(errors, at))).select("case", "week", "post", F.array_append("units", F.lit(NOISE_UNIT)).alias("units"), F.array_append("values", F.col("noisy")).alias("values"))
    scaled = scaled_vectors(vectors).persist()
    try:
        sizes = {r["case"]: r for r in scaled.groupBy("case").agg(F.any_value("units").alias("units"), F.any_value("means").alias("means"), F.count_if("post").alias("after"), F.count_if(~F.col("post")).alias("before")).collect()}  # a row a case
        most = max((len(r["units"]) for r in sizes.values()), default=0)
        if most > MOST_UNITS:
            raise ValueError(f"{most} units are more than {MOST_UNITS}: choose among them")
        formed = most <= gram_units
        products: dict[int, np.ndarray] = {}
        if formed:
            for r in gram(scaled, most).collect():  # a row a unit
                n = len(r["products"])
                products.setdefault(r["case"], np.zeros((n, n)))[r["k"]] = r["products"]
        found = {}
        number = lambda rows: np.array([[0.0 if v is None else v for v in r["x"]] for r in rows])
        for case, r in sizes.items():
            if r["before"] < LEAST_WEEKS or not r["after"] or len(r["units"]) < 3:
                continue
            own = scaled.where(F.col("case") == case)
            after = number(own.where("post").select("x").collect())  # POST_WEEKS rows
            before = np.zeros((0, len(r["units"]))) if formed else number(own.where("NOT post").select("x").collect())
            means = np.array([np.nan if m is None else m for m in r["means"]])
            found[case] = Case(r["units"], means, np.isfinite(means) & (means != 0), after.mean(axis=0), r["before"], products.get(case), before)
        return found
    finally:
        scaled.unpersist()


def solved(case: Case, targets: np.ndarray, barred: np.ndarray) -> list[tuple]:
    """A row of CONTROL for each target (index of a unit); barred: which units may not give to it, itself among them."""
    w = numerics.simplex_mixtures(case.times, case.block, np.stack([case.times(np.eye(1, len(case.units), t)[0]) for t in targets]), barred, np.diag(case.products) if case.products is not None else (case.vectors**2).sum(axis=0))
    out = []
    for t, own, no in zip(targets.tolist(), w, barred, strict=True):
        aim = case.times(np.eye(1, len(case.units), t)[0])
        square = aim[t] - 2 * own @ aim + own @ case.times(own)
        gap, rmse = float(case.after[t] - own @ case.after), float(np.sqrt(max(square, 0.0) / case.weeks))
        weights = {case.units[k]: float(own[k]) for k in np.flatnonzero(~no)}
        out.append((case.units[t], gap * float(case.means[t]), gap * 100, rmse, abs(gap) / max(rmse, 1e-9), weights))
    return out


def controls(problems: DataFrame, held: dict[int, Case]) -> DataFrame:
    """problems (problem, case, unit, out) -> problem and CONTROL of each that can be posed; tasks solve many at once."""
    shared = problems.sparkSession.sparkContext.broadcast(held)
    schema = pa.schema([("problem", pa.int32()), ("unit", pa.string()), *((c, pa.float64()) for c in ("gap", "gap_pct", "pre_rmse", "gap_ratio")), ("weights", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for number, case in shared.value.items():
                at = {u: k for k, u in enumerate(case.units)}
                own = [r for r in rows if r["case"] == number and r["unit"] in at and case.usable[at[r["unit"]]]]
                barred = np.stack([~case.usable | np.isin(case.units, [r["unit"], *(r["out"] or [])]) for r in own]) if own else np.zeros((0, 0), bool)
                posed = [k for k in range(len(own)) if (~barred[k]).sum() >= 2]
                if posed:
                    found = solved(case, np.array([at[own[k]["unit"]] for k in posed]), barred[posed])
                    columns = [[own[k]["problem"] for k in posed], *map(list, zip(*found, strict=True))]
                    columns[-1] = [list(w.items()) for w in columns[-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return problems.mapInArrow(run, f"problem int, {CONTROL}")


def synthetic_controls(series: DataFrame, units: list[str] | None, start: Column, value: str = "rate", leave_out: list[list[str]] | None = None, noise: float = 0.0, fill: float | str | None = None) -> DataFrame:
    """The synthetic control of each of the units (all, if None) against all others, a row for each that has at least two
    of them, twenty weeks before the start and one after it. gap is in the series' own measure, gap_pct in per cent of
    the mean before; gap_ratio is the mean gap over the error before the start. leave_out: donors to leave out, one
    more row of the first unit for each list; noise adds a random donor; fill: see weekly_vectors()."""
    spark = series.sparkSession
    held = cases(series, [start], value, fill, noise)
    if units is None:
        units = [u for u in held[0].units if u != NOISE_UNIT] if held else []
    runs = [(u, []) for u in units] + [(units[0], out) for out in leave_out or []]
    plan = spark.createDataFrame([(k, 0, u, out) for k, (u, out) in enumerate(runs)], PROBLEM)
    return controls(plan.repartition(max(1, min(len(runs) // 16 + 1, spark.sparkContext.defaultParallelism))), held).drop("problem")


def placed(found: DataFrame) -> DataFrame:
    """Every unit's rank among all by gap_ratio (ties get the worse rank), and the p-value that this gives it as a placebo
    of the others: unit, gap_pct, pre_rmse, gap_ratio, rank, p_value (null with fewer than four others)."""
    ratios = found.select("unit", "gap_pct", "pre_rmse", "gap_ratio")
    every = Window.partitionBy(F.lit(0))  # a row a unit, of MOST_UNITS at most
    rank = F.count("*").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gap_ratio")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count("*").over(every)
    return ratios.select("*", rank.cast("long").alias("rank"), F.when(n >= 5, rank / n).alias("p_value"))
