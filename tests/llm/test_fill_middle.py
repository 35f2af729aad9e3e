"""Fill-in-the-middle against a plain version by regular expressions and slices."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from metricloom.llm import fill_middle

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+$", "characters": r"(?s)."}


def plain(doc_id, text, unit="lines", rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm_rate
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    parts = ["a", "bc", "\n", "\n\n", " ", "  \t", "é", "中", "🙂", "\r\n", "<", ">", "<P", "S>", "\x85", " ", "\x00"]
    found = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return [*found, None, "", "\n", "x", "x\n", "\nx", "no <M> here\nat all", "y\n" * 40_000, "z" * 300_000, " lead", "   "]


def test_select_finds_every_bit():
    rng = random.Random(1)
    for width in (1, 2, 7, 64, 1000):
        bits = rng.getrandbits(width) | 1
        places = [k for k in range(width) if bits >> k & 1]
        assert [fill_middle.select(bits, width, k) for k in range(len(places))] == places


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_units_and_outputs_equal_the_plain_version(unit):
    for i, t in enumerate(texts()):
        n, form, p, m, out = fill_middle.rearranged(i, (t or "").encode(), unit, 70, 40)
        assert (n, form, p, m, out.decode()) == plain(i, t, unit, 70, 40), (unit, ascii((t or "")[:60]))


def test_query_with_odd_rows(spark):
    rows = [(None if k == 5 else k % 500, t, "n", "form") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        n, form, p, m, out = plain(i, t)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    got = [tuple(r) for r in fill_middle.digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from metricloom.llm import queries

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op13_fill_middle(spark, sf_dir)
    want = duck.sql(queries.ORACLES["op13_fill_middle"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
