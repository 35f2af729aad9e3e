"""The iceberg lattice against the whole lattice, with counts of what it never forms."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from metricloom.operators import lattice, panel
from metricloom.sources.contracts import DIMENSIONS

KEY = ["level", *DIMENSIONS, "n_weeks"]


def sparse(spark, rows=500, weeks=14):
    """Few leaf weeks, nulls among the dimensions, leaves that begin late or end early."""
    rng = random.Random(rows)
    first = dt.date(2024, 1, 7)
    out = []
    for _ in range(rows):
        leaf = (rng.choice(["n", "s", None]), rng.choice(["A", "B", "C", "D"]), rng.choice(["web", "shop", None]), rng.choice(["home", "firm"]))
        week = rng.randrange(weeks) if leaf[1] != "D" else rng.randrange(weeks - 3)
        sold = rng.choice([0, 0, 3, 7])
        out.append((first + dt.timedelta(weeks=week), *leaf, float(sold * 10), float(sold), 9.0, 1.0, 2, 1, 0.5))
    schema = "week date, region string, product_line string, channel string, segment string, revenue double, net_units double, gross_orders double, cancellations double, deliveries int, in_time int, ticket_volume double"
    return spark.createDataFrame(out, schema).selectExpr("week", *DIMENSIONS, "cast(revenue AS decimal(18,4)) revenue", "cast(net_units AS decimal(18,2)) net_units", "cast(gross_orders AS decimal(18,2)) gross_orders", "cast(cancellations AS decimal(18,2)) cancellations", "deliveries", "in_time", "ticket_volume")


@pytest.mark.parametrize("metric", ["revenue", "asp"])
@pytest.mark.parametrize("least", [3, 10, 13, 99])
def test_rows_equal_the_whole_lattice(spark, metric, least):
    p = sparse(spark)
    want = sorted(map(str, lattice.eligible(lattice.lattice(p), metric, least).select(*KEY).collect()))
    found, counts = lattice.iceberg(p, metric, least)
    assert sorted(map(str, found.select(*KEY).collect())) == want
    told = counts.collect()
    groups = {r["n"]: r["c"] for r in lattice.lattice(p).select(*KEY[:-1]).distinct().selectExpr("4 - bit_count(level) AS n").groupBy("n").agg({"*": "count"}).withColumnRenamed("count(1)", "c").collect()}
    assert all(r["formed"] <= groups[r["dimensions"]] for r in told)
    if least >= 10:
        formed = sum(r["formed"] for r in told)
        assert formed < sum(groups.values())  # some were never formed
    if least == 99:
        assert len(told) == 1 and not want


def test_the_tables_and_an_empty_panel(spark, sf_dir):
    p = panel.panel_of(spark, sf_dir)
    found, counts = lattice.iceberg(p, "revenue")
    assert sorted(map(str, found.select(*KEY).collect())) == sorted(map(str, lattice.eligible(lattice.lattice(p), "revenue").select(*KEY).collect()))
    told = {r["dimensions"]: r for r in counts.collect()}
    assert told[0]["formed"] == 1 and told[4]["idle"] + told[3]["idle"] > 0
    found, counts = lattice.iceberg(p.limit(0), "revenue")
    assert found.count() == 0 and counts.first()["formed"] == 0
