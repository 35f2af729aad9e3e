"""The maintained panel against the one that is computed at once."""

from __future__ import annotations

import glob
import os

import numpy as np
from pyspark.sql import functions as F

from metricloom.operators import maintained, panel
from metricloom.sources import tables

KEY = ["week", "region", "product_line", "channel", "segment"]


def rows(df):
    return df.toPandas().sort_values(KEY).reset_index(drop=True)


def same(a, b):
    assert len(a) == len(b)
    for c in b.columns:
        assert (a[c] == b[c]).all() if c in KEY else np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


def test_increments_equal_the_whole(spark, sf_dir, tmp_path):
    lines, path = tables.measured(tables.order_lines(spark, sf_dir)), str(tmp_path / "panel")
    at = lines.agg(F.max("week")).first()[0]
    whole = rows(panel.panel_of(spark, sf_dir))
    early = F.col("week") < F.date_sub(F.lit(at), 70)
    maintained.merge_lines(path, lines.where(early))
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/week=*/*.parquet")}
    touched = maintained.merge_lines(path, lines.where(~early))
    assert touched and min(touched) >= lines.where(~early).agg(F.min("week")).first()[0]
    assert all(os.path.exists(f) and os.path.getmtime(f) == t for f, t in before.items())  # other weeks' files stayed
    same(rows(maintained.read_panel(spark, path)), whole)
    # late lines of an old week: taken out first, merged after
    path = str(tmp_path / "late")
    late = (F.col("in_time") == 0) & (F.col("week") < F.date_sub(F.lit(at), 300))
    maintained.merge_lines(path, lines.where(~late))
    assert len(rows(maintained.read_panel(spark, path))) <= len(whole)
    touched = maintained.merge_lines(path, lines.where(late))
    assert set(touched) == {r[0] for r in lines.where(late).select("week").distinct().collect()}
    same(rows(maintained.read_panel(spark, path)), whole)
    assert maintained.merge_lines(path, lines.limit(0)) == []
    same(rows(maintained.read_panel(spark, path)), whole)


def test_readers_prune_weeks(spark, sf_dir, tmp_path):
    lines, path = tables.measured(tables.order_lines(spark, sf_dir)), str(tmp_path / "panel")
    maintained.merge_lines(path, lines)
    at = lines.agg(F.max("week")).first()[0]
    recent = maintained.read_panel(spark, path, at)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan
    assert {r[0] for r in recent.select("week").distinct().collect()} == {at}
