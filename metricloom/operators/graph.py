"""Reachability in the causal graph by recursive queries, and labels against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

MAX_DEPTH = 6


def paths(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All simple paths of at most max_depth edges: src, dst, path. The graph is a contract of a few edges, stored first:
    every level of the walk reads it, whatever it was computed from."""
    edges = stored(edges.select("src", "dst"), "edges")
    text = """
        WITH RECURSIVE walk(src, dst, path) AS (
            SELECT src, dst, array(src, dst) FROM {edges}
            UNION ALL
            SELECT w.src, e.dst, array_append(w.path, e.dst) FROM walk w JOIN {edges} e ON w.dst = e.src
            WHERE size(w.path) <= {max_depth} AND NOT array_contains(w.path, e.dst)
        ) SELECT src, dst, path FROM walk"""
    return edges.sparkSession.sql(text, edges=edges, max_depth=max_depth)


def shortest_paths(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One path per reachable pair: the shortest, then the alphabetically first."""
    text = F.array_join("path", ">")
    return paths(edges, max_depth).groupBy("src", "dst").agg(F.min(F.struct(F.size("path").alias("length"), text.alias("path"))).alias("best")).select("src", "dst", (F.col("best.length") - 1).alias("n_edges"), "best.path")


def corroborated(candidates: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """candidates (id, source, node) with what happens to each: 'merged' into the first event whose path to the
    target passes its node (if it is no event itself), 'rejected' without a path to the target, else 'kept'."""
    reach = stored(shortest_paths(edges).where(F.col("dst") == target).select(F.col("src").alias("node"), "path"), "reach")
    own = candidates.join(F.broadcast(reach), "node", "left")
    events = own.where("source = 'event' AND path IS NOT NULL").select(F.col("id").alias("event_id"), F.col("node").alias("event_node"), F.split("path", ">").alias("event_path"))
    hits = own.where("source <> 'event'").join(F.broadcast(events), F.expr("array_contains(event_path, node)")).groupBy("id").agg(F.min("event_id").alias("merged_into"))
    out = own.join(F.broadcast(hits), "id", "left")
    fate = F.when(F.col("merged_into").isNotNull(), "merged").when(F.col("path").isNull(), "rejected").otherwise("kept")
    return out.select("id", "source", "node", "path", "merged_into", fate.alias("fate"))
