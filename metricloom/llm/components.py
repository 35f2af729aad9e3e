"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges are first contracted to a spanning forest inside each partition, so shuffles carry fewer edges than
nodes. No neighbour list is ever collected: each round needs only the least neighbour of a node (partially
aggregated) and joins it back, which adaptive execution splits for hot nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, release, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        out = np.array([(n, find(n)) for n in nodes], np.int64)
        yield batch(a=out[:, 0].copy(), b=out[:, 1].copy())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long, not null) -> one row (node, root) per node that has an edge to another; root is the
    smallest node of its component. Loops and repeated edges are harmless; no edges give no rows."""
    e = written(arrow_map(edges.where("a <> b"), _forest, "a long, b long"), "edges")
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, e = e, written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        release(last, large)
        parents = e.select(F.col("b").alias("a")).distinct()
        nodes = e.groupBy("a").agg(F.count("*").alias("n"))
        if not nodes.where("n > 1").limit(1).count() and not nodes.join(parents, "a", "left_semi").limit(1).count():
            break
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
