"""A planted scenario through the whole run: a cause in one region, decoys, and what each is told."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np

from metricloom.plans import run

REGIONS = ("North", "South", "East", "West", "Central", "ASIA")
WEEKS = [dt.date(2024, 1, 7) + dt.timedelta(weeks=k) for k in range(110)]
START = WEEKS[-3]


def sources(spark):
    rng, warehouse, orders, logistics, tickets = np.random.default_rng(8), [], [], [], []
    for k, w in enumerate(WEEKS):
        for r in REGIONS:
            for p, c, s in (("A", "web", "home"), ("A", "shop", "firm"), ("B", "web", "home")):
                g = 900 * (1 + 0.1 * math.sin(2 * math.pi * k / 52)) * float(rng.normal(1, 0.02))
                rate = 0.10 + float(rng.normal(0, 0.004)) + (0.30 if r == "North" and w >= START else 0)
                units, price = round(g * (1 - rate), 2), 50.0
                warehouse.append((w, r, p, c, s, round(units * price, 2), units, price))
                orders.append((w, r, p, c, s, round(g, 2), round(g * rate, 2)))
                logistics.append((w, r, p, c, s, 100, 80 if r == "North" and w >= START else 95))
            tickets += [(w, r, p, c, 10) for p, c in (("A", "web"), ("A", "shop"), ("B", "web"))]
    key = "week date, region string, product_line string, channel string, segment string"
    make = spark.createDataFrame
    return {
        "warehouse": make(warehouse, f"{key}, revenue double, net_units double, quoted_price double").selectExpr("week", "region", "product_line", "channel", "segment", "cast(revenue AS decimal(18,4)) revenue", "cast(net_units AS decimal(18,2)) net_units", "quoted_price"),
        "order_system": make(orders, f"{key}, gross_orders double, cancellations double").selectExpr("week", "region", "product_line", "channel", "segment", "cast(gross_orders AS decimal(18,2)) gross_orders", "cast(cancellations AS decimal(18,2)) cancellations"),
        "logistics": make(logistics, f"{key}, deliveries int, in_time int"),
        "tickets": make(tickets, "week date, region string, product_line string, channel string, tickets int"),
    }


def test_planted_cause_is_found_and_decoys_are_not(spark, tmp_path):
    events = spark.createDataFrame(
        [("E1", "courier strike", "delivery_sla", "North", START, None), ("E2", "price rise", "price_change", "South", START, None), ("E3", "late promotion", "competitor_promo", "North", WEEKS[-1], None), ("E4", "office move", "furniture", "North", START, None)],
        run.EVENTS,
    )
    report = run.analyse(sources(spark), str(tmp_path / "out"), events)
    verdicts = {h["id"]: (h["verdict"], h["reason"]) for h in report["hypotheses"]}
    assert verdicts["E1"][0] == "accepted", report["hypotheses"]
    assert {verdicts[e][0] for e in ("E2", "E3", "E4")} <= {"rejected", "inconclusive"} and "path" in verdicts["E4"][1] and "after" in verdicts["E3"][1]
    impact = next(h for h in report["hypotheses"] if h["id"] == "E1")["evidence"]["did"]
    assert abs(impact - 0.30) < 0.02
    assert report["slice"]["region"] == "North" and report["shapley"]["region"] > 30
    assert report["detection"]["coverage"] > 0.85 and report["mode"] in ("confident", "abstain")
    assert all(n["passed"] for n in report["narratives"])
    written = json.loads((tmp_path / "out/report.json").read_text())
    assert written["week"] == str(WEEKS[-1]) and (tmp_path / "out/narratives.txt").exists()
    assert run.worst_slices(spark.read.parquet(str(tmp_path / "out/findings"))).count() >= 0


def test_feeds_are_tried_by_dose_and_exclusions_are_told(spark, tmp_path):
    def feed(node, **doses):
        return [(w, r, node, f"{node} in the feed", doses.get(r, 0.5) if w >= START else 0.0) for w in WEEKS[-12:] for r in REGIONS]

    rows = feed("competitor_promo", South=0.9, North=0.3) + feed("marketing_spend", North=0.9) + feed("stockout", South=0.9)
    events = spark.createDataFrame([("E1", "empty shelves", "stockout", "North", START, None)], run.EVENTS)
    report = run.analyse(sources(spark), str(tmp_path / "out"), events, feed=spark.createDataFrame(rows, run.FEED))
    told = {h["id"]: h for h in report["hypotheses"]}
    assert set(told) == {"E1", "X:competitor_promo", "X:marketing_spend"}
    for inverted in ("E1", "X:competitor_promo"):
        assert (told[inverted]["verdict"], told[inverted]["reason"]) == ("rejected", "the most affected unit is little exposed")
    assert told["X:marketing_spend"]["verdict"] == "accepted" and told["X:marketing_spend"]["unit"] == "North", told["X:marketing_spend"]
    assert {t["code"]: t["fired"] for t in report["triggers"]}["GRAIN_POLICY"] and list(report["excluded"]) == ["nps"]
