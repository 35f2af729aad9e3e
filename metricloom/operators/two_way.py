"""Least squares with effects of many units and weeks, by rounds of sums over units and weeks.

Units may be as many as there are customers or parts; weeks are a calendar, whose length bounds everything that the
driver holds. Unit effects are taken out by unit means. What is left is a system of one unknown a week, whose matrix
depends only on which weeks units have: units are counted by the set of their weeks (bits in a few words). Where such
sets are few the driver solves the system directly; where they are many it is never formed, and conjugate gradients
multiply by it in one aggregation over the sets a round. The dummies' rank is units + weeks - components of the graph
that links a unit with its weeks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

WORD = 62
#: Up to so many sets of weeks the driver forms the weeks' matrix; beyond, rounds of sums take its place.
DIRECT_SETS = 4096
TOLERANCE, COLLINEAR = 1e-13, 1e-10
EFFECT = "estimate double, se double, n long, free long"


def components(edges: np.ndarray) -> np.ndarray:
    """The label (least member) of each node's component of a symmetric boolean matrix."""
    labels = np.arange(len(edges))
    while True:
        new = np.where(edges, labels[None, :], len(edges)).min(axis=1, initial=len(edges))
        new = np.minimum(new, labels)
        if (new == labels).all():
            return labels
        labels = new


def solved(normal: np.ndarray, labels: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A solution of a weeks' system: of each component one week's effect is 0, which makes the rest definite."""
    free = np.ones(len(labels), bool)
    free[np.unique(labels)] = False
    out = np.zeros_like(right)
    if free.any():
        out[free] = np.linalg.solve(normal[np.ix_(free, free)], right[free])
    return out


def conjugate_gradients(times: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, right: np.ndarray, rounds: int) -> np.ndarray:
    """Solutions of a positive semidefinite system for each column of right, in which each lies in the matrix's range;
    scaled by the diagonal. One multiplication a round serves all columns."""
    scale = np.where(diagonal > 0, diagonal, 1.0)[:, None]
    x, r = np.zeros_like(right), right.copy()
    z = r / scale
    p, rz = z.copy(), (r * z).sum(axis=0)
    goal = TOLERANCE**2 * rz
    for _ in range(rounds):
        going = rz > goal
        if not going.any():
            break
        q = times(p)
        pq = (p * q).sum(axis=0)
        step = np.where(going & (pq > 0), rz / np.where(pq > 0, pq, 1.0), 0.0)
        x += step * p
        r -= step * q
        z = r / scale
        new = (r * z).sum(axis=0)
        p = z + np.where(going, new / np.where(rz > 0, rz, 1.0), 0.0) * p
        rz = np.where(going, new, rz)
    return x


class _Sets:
    """How many units have each set of weeks."""

    def __init__(self, per_unit: DataFrame, words: list[str], weeks: int):
        self.weeks = weeks
        bits = F.filter(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda w: F.array(*words)[F.floor(w / WORD).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (w % WORD).cast("int"))) != 0)
        counted = per_unit.groupBy(*words).agg(F.count("*").cast("double").alias("units"))
        self.table = counted.select("units", bits.alias("weeks")).persist(StorageLevel.MEMORY_AND_DISK)

    def rows(self, most: int) -> list | None:
        found = self.table.limit(most + 1).collect()
        return found if len(found) <= most else None

    def matrix(self, rows: list) -> np.ndarray:
        """The presence of weeks in sets times the square root of the number of units."""
        out = np.zeros((len(rows), self.weeks))
        for k, r in enumerate(rows):
            out[k, r["weeks"]] = r["units"] ** 0.5
        return out

    def round(self, values: dict[str, np.ndarray], inside, over) -> np.ndarray:
        """For each named vector over weeks: what `inside` makes of a set's values, then `over` of the sets that have a
        week, a row a week."""
        held = {n: F.array(*(F.lit(float(x)) for x in v)) for n, v in values.items()}
        picked = lambda a: F.transform("weeks", lambda w: a[w])
        each = self.table.select("units", "weeks", *(inside(picked(a)).alias(n) for n, a in held.items()))
        each = each.select("units", *values, F.explode("weeks").alias("w")).groupBy("w").agg(*(over(F.col(n)).alias(n) for n in values))
        out = np.zeros((self.weeks, len(values)))
        for r in each.collect():  # a row a week
            out[r["w"]] = [r[n] for n in values]
        return out

    def spread(self, v: np.ndarray) -> np.ndarray:
        """Sums over units of the mean over their weeks, for each column of v."""
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        return self.round({f"v{k}": v[:, k] for k in range(v.shape[1])}, mean, lambda c: F.sum(F.col("units") * c))

    def labels(self) -> np.ndarray:
        labels = np.arange(self.weeks, dtype=float)
        while True:
            new = np.minimum(self.round({"v": labels}, F.array_min, F.min)[:, 0], labels)
            if (new == labels).all():
                return labels.astype(int)
            labels = new


def two_way(rows: DataFrame, direct_sets: int = DIRECT_SETS) -> DataFrame:
    """Least squares of y on d with an effect of each unit and week over rows (unit, week, y, d), a row a unit and
    week: estimate, standard error, n and degrees of freedom. All rows with values count, whatever weeks units lack;
    the estimate is null where d is a sum of such effects, and the error also without degrees of freedom."""
    spark = rows.sparkSession
    rows = rows.where("unit IS NOT NULL AND week IS NOT NULL AND y IS NOT NULL AND d IS NOT NULL")
    calendar = sorted(r[0] for r in rows.select("week").distinct().collect())  # bounded by the calendar
    if not calendar:
        return spark.createDataFrame([(None, None, 0, 0)], EFFECT)
    numbers = spark.createDataFrame([(w, k) for k, w in enumerate(calendar)], StructType([rows.schema["week"], StructField("w", IntegerType())]))
    unit = Window.partitionBy("unit")
    cells = rows.join(F.broadcast(numbers), "week").select("unit", "w", F.col("y").cast("double").alias("y"), F.col("d").cast("double").alias("d"))
    cells = cells.withColumns({"yc": F.col("y") - F.avg("y").over(unit), "dc": F.col("d") - F.avg("d").over(unit)}).persist(StorageLevel.MEMORY_AND_DISK)
    words = [f"b{k}" for k in range(-(-len(calendar) // WORD))]
    word = lambda k: F.bit_or(F.when(F.floor(F.col("w") / WORD) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("w") % WORD).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    per_unit = cells.groupBy("unit").agg(F.count("*").alias("n"), *(word(k).alias(n) for k, n in enumerate(words)))
    sets = _Sets(per_unit, words, len(calendar))
    try:
        held = sum((F.bit_count(n) for n in words), F.lit(0))
        total = per_unit.agg(F.count("*").alias("units"), F.sum("n").alias("n"), F.max(F.col("n") - held).alias("repeated")).first()
        if total["repeated"]:
            raise ValueError("a unit has several rows of one week")
        by_week = cells.groupBy("w").agg(F.count("*").alias("n"), F.sum("yc").alias("y"), F.sum("dc").alias("d")).orderBy("w").toPandas()
        have, right = by_week["n"].to_numpy(float), by_week[["y", "d"]].to_numpy(float)
        if (few := sets.rows(direct_sets)) is not None:
            root = sets.matrix(few)
            size = (root > 0).sum(axis=1)
            labels = components((root.T @ root) > 0)
            effect = solved(np.diag(have) - root.T @ (root / size[:, None]), labels, right)
        else:
            labels = sets.labels()
            effect = conjugate_gradients(lambda v: have[:, None] * v - sets.spread(v), have, right, 4 * len(calendar) + 20)
        table = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(effect)], "w int, ey double, ed double")
        left = cells.join(F.broadcast(table), "w")  # a row a week
        left = left.select(*((F.col(f"{c}c") - F.col(f"e{c}") + F.avg(f"e{c}").over(unit)).alias(c) for c in ("y", "d")), F.col("dc").alias("dc"))
        s = left.agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("y")).alias("yd"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("dc") * F.col("dc")).alias("own")).first()
    finally:
        sets.table.unpersist()
        cells.unpersist()
    n = total["n"]
    if s["dd"] <= COLLINEAR * max(s["own"], 1e-300):
        return spark.createDataFrame([(None, None, n, 0)], EFFECT)
    free = n - (total["units"] + len(calendar) - len(np.unique(labels))) - 1
    estimate = s["yd"] / s["dd"]
    return spark.createDataFrame([(estimate, (max(s["yy"] - estimate * s["yd"], 0.0) / (free * s["dd"])) ** 0.5 if free > 0 else None, n, free)], EFFECT)
