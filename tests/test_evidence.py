"""Evidence in JSON as rows against a plain walk."""

from __future__ import annotations

import json

import pytest

from metricloom.operators import narrative

EVIDENCE = [
    {"gap": -1234.5, "share": 0.25, "causes": [{"id": "H1", "impact": 17}, {"id": "H 22", "low": [1.5, [2.5, {"x": 3}]]}], "ok": True, "none": None},
    {"weeks 12": {"1.5": "up 3,400.5 from 2", "a.b[7]": 8}},
    [1, [2, [3, [4, ["five 6"]]]]],
    7.125,
    "text 9 only",
    {"empty": {}, "none": [], "big": 1e12, "tiny": 1e-9, "minus": -0.5},
    None,
]


def walk(v, path="$"):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in walk(w, f"{path}.{k}")]
    if isinstance(v, list):
        return [x for k, w in enumerate(v) for x in walk(w, f"{path}[{k}]")]
    return [(path, v)]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(k, json.dumps(e)) for k, e in enumerate(EVIDENCE)] + [(90, "no json"), (91, None), (92, ""), (93, "{}"), (None, "[5]")]
    return spark.createDataFrame(texts, "case long, evidence string")


def test_leaves_equal_a_plain_walk(rows):
    got = narrative.evidence_leaves(rows, "evidence").selectExpr("case", "path", "to_json(value) AS v").collect()
    want = [(k, p) for k, e in enumerate(EVIDENCE) for p, _ in walk(e)] + [(None, "$[0]")]
    assert sorted(((r["case"], r["path"]) for r in got), key=str) == sorted(want, key=str)
    values = {(r["case"], r["path"]): r["v"] for r in got}
    for k, e in enumerate(EVIDENCE):
        for p, v in walk(e):
            assert json.loads(values[k, p]) == v


def test_vocabulary_equals_that_of_the_driver(rows):
    got: dict = {}
    for r in narrative.evidence_vocabulary(rows, "evidence").collect():
        got.setdefault(r["case"], set()).add(r["token"])
    for k, e in enumerate(EVIDENCE):
        # names of fields without a leaf below them say nothing of numbers
        want = narrative.vocabulary(e)
        assert got.get(k, set()) | {"-0"} == want | {"-0"}, k
    assert "5" in got[None] and not {90, 91, 92, 93} & set(got)


def test_too_deep_is_an_error(spark, rows):
    deep = spark.createDataFrame([(1, "[" * 6 + "1" + "]" * 6)], "case long, evidence string")
    assert narrative.evidence_leaves(deep, "evidence").count() == 1
    with pytest.raises(ValueError, match="deeper"):
        narrative.evidence_leaves(deep, "evidence", most=3)
    assert narrative.evidence_leaves(rows.limit(0), "evidence").count() == 0


def test_vocabulary_moves_numbers_not_their_forms(spark):
    rows = spark.createDataFrame([(1, '{"a": [1234567.5, -0.005], "b": {"c": "4,200 of 7."}}'), (1, '{"d2": 1234567.5}'), (2, '{"a": null, "b": true}')], "case long, evidence string")
    found = narrative.evidence_vocabulary(rows, "evidence")
    want = narrative.number_forms(1234567.5) | narrative.number_forms(-0.005) | {"4200", "7", "2"}
    assert sorted(tuple(r) for r in found.collect()) == sorted((1, t) for t in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")
