"""Tables are read and joined once, and order lines cross the network no more often than they must."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom import queries
from metricloom.operators import graph, panel
from metricloom.sources import tables


def counted(df):
    """df, and an accumulator of how many of its rows are computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_walks_compute_their_edges_once(spark):
    edges, seen = counted(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], "src string, dst string"))
    found = {(r["src"], r["dst"]): r["path"] for r in graph.shortest_paths(edges).collect()}
    assert found == {("a", "b"): "a>b", ("a", "c"): "a>b>c", ("a", "d"): "a>d", ("b", "c"): "b>c", ("b", "d"): "b>c>d", ("c", "d"): "c>d"}
    assert seen.value == 4


def test_corroboration_walks_once(spark):
    edges, seen = counted(spark.createDataFrame([("a", "b"), ("b", "t"), ("c", "x")], "src string, dst string"))
    rows = spark.createDataFrame([("1", "event", "a"), ("2", "topic", "b"), ("3", "feed", "c")], "id string, source string, node string")
    judged = graph.corroborated(rows, edges, "t")
    assert {(r["id"], r["fate"], r["merged_into"]) for r in judged.collect()} == {("1", "kept", None), ("2", "merged", "1"), ("3", "rejected", None)}
    assert seen.value == 3 and "Recursi" not in judged._jdf.queryExecution().analyzed().toString()


def moves(df, table_column):
    """How many exchanges of df's plan, without broadcasts by size, carry rows of the table that has the column."""
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    depth = [min((i for i, c in enumerate(x) if c.isalpha()), default=0) for x in lines]
    found = 0
    for k, x in enumerate(lines):
        below = [y for n, y in enumerate(lines[k + 1 :], k + 1) if all(d > depth[k] for d in depth[k + 1 : n + 1])]
        found += " Exchange hashpartitioning" in x and any("FileScan" in y and table_column in y for y in below)
    return found


def test_lines_move_for_parts_and_for_orders_only(spark, sf_dir):
    assert moves(tables.order_lines(spark, sf_dir), "l_orderkey") == 2


def test_portfolio_keeps_sums_not_lines(spark, sf_dir, monkeypatch):
    held, persist = [], type(tables.table(spark, sf_dir, "nation")).persist
    monkeypatch.setattr(type(tables.table(spark, sf_dir, "nation")), "persist", lambda df, *a: held.append(df.columns) or persist(df, *a))
    assert queries._portfolio(spark, sf_dir).levers
    assert held == [["region", "channel", "segment", "week", "quantity", "lost"]]


def test_sources_share_one_pass_over_the_lines(spark, sf_dir):
    given = tables.sources(spark, sf_dir)
    assert set(given) == {"warehouse", "order_system", "logistics", "tickets"}
    assert not any("l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString() for df in given.values())
    lines = tables.order_lines(spark, sf_dir)
    assert given["warehouse"].count() == lines.where("NOT returned").select(*tables.KEYS).distinct().count()
    assert given["tickets"].agg(F.sum("tickets")).first()[0] == lines.where("returned").count()


def test_cases_compute_the_lines_once(spark, sf_dir, monkeypatch):
    lines, seen = counted(tables.order_lines(spark, sf_dir))
    monkeypatch.setattr(tables, "order_lines", lambda spark, d: lines)
    assert queries._cases(spark, sf_dir).count() > 0
    assert seen.value == tables.table(spark, sf_dir, "lineitem").count()


def test_stages_compute_the_panel_once(spark, sf_dir, monkeypatch):
    rows, seen = counted(panel.panel_of(spark, sf_dir))
    monkeypatch.setattr(panel, "panel_of", lambda spark, d: rows)
    found = {r["name"]: r["rows"] for r in queries.stage_rows(spark, sf_dir).collect()}
    assert found["panel"] == seen.value > 0 and found["lattice"] > found["panel"]
