"""Running sums and minima over all rows in an order, without one task that sees them all.

Rows are dealt to bins, a bounded number of them, by a monotone function of what they are ordered by. What the bins
before sum to comes from a window over one row a bin; inside bins, windows are partitioned by bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALLEST = 1e-300


def log_bin(value: Column, per_doubling: int) -> Column:
    """The bin of a magnitude: so many to each doubling, some 2000 doublings at most; 0 is in the lowest."""
    return F.floor(F.log2(F.greatest(value, F.lit(SMALLEST))) * per_doubling).cast("int")


def with_running_sum(rows: DataFrame, bin_: Column, order: Column, value: Column, out: str, total: str, descending: bool = False, inclusive: bool = True) -> DataFrame:
    """rows with `out`, the sum of value over the rows up to each in order of (bin, order), itself included or not,
    and `total` over all rows. Both orders run the same way; within a bin `order` must be unique."""
    rows = rows.withColumns({"_bin": bin_, "_value": value})
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    bins = rows.groupBy("_bin").agg(F.sum("_value").alias("_sum"))
    over = Window.orderBy(way("_bin"))
    before = F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = Window.partitionBy("_bin").orderBy(order.desc() if descending else order.asc()).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(F.broadcast(bins.select("_bin", before.alias("_before"), whole.alias(total))), "_bin")
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_value", "_before", "_bin")


def with_least_from(rows: DataFrame, bin_: Column, order: Column, value: Column, out: str) -> DataFrame:
    """rows with `out`, the least value over each row and all rows behind it in order of (bin, order)."""
    rows = rows.withColumns({"_bin": bin_, "_value": value})
    bins = rows.groupBy("_bin").agg(F.min("_value").alias("_least"))
    behind = F.min("_least").over(Window.orderBy("_bin").rowsBetween(1, Window.unboundedFollowing))
    inside = Window.partitionBy("_bin").orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(bins.select("_bin", behind.alias("_behind"))), "_bin")
    return joined.withColumn(out, F.least(F.min("_value").over(inside), F.col("_behind"))).drop("_value", "_behind", "_bin")
