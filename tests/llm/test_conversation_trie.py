"""The conversation trie against a plain one of dictionaries, and the merge of runs against sorting."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import pytest

from metricloom.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, n long, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(role, text):
    return hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + (text or "")).encode()).hexdigest()


def turns_of(rows):
    found = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(paths):
    """Rows of every node: members, children and sums by going over all prefixes."""
    members, ends = {}, {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    done = {}
    for node in sorted(members, key=len, reverse=True):
        below = [done[x] for x in children.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        done[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])), *done[node], sha(ends.get(node, []))) for node, ids in members.items())


def conversations(n=150, seed=1, texts=4, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * n), n):
        turns = [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["ä" * 9, "b", None, "", "ccc"][: texts + 1]), 1, "x") for k in range(rng.randint(1, longest))]
        rows += turns
    rows += [(c, k, "system", f"the same {k}", 0, None) for c in range(1000, 1100) for k in range(5)]  # a hot path
    rows += [(2000, None, "user", "late", None, None), (2000, None, "user", "a", None, None), (2000, 3, "user", "z", None, None), (2000, 3, "user", "z", None, None), (None, 1, "user", "nobody's", None, None)]
    rows += [(3001, k, "user", f"long {k % 7}", None, None) for k in range(2000)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def want(paths):
    return sorted(plain(paths), key=lambda r: tuple((x is not None, x) for x in r))


def test_runs_merge_with_their_shared_turns():
    rng = random.Random(2)
    for trial in range(60):
        turn = lambda: bytes([rng.randrange(3)]) * ct.TURN
        paths = list({b"".join(turn() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 80))})
        rng.shuffle(paths)
        k = rng.randint(1, 9)
        runs = [iter(ct.sorted_run([(p,) for p in paths[i::k]])) for i in range(k)]
        out = [(lcp, row[0]) for lcp, row in ct.merged(runs)]
        assert [p for _, p in out] == sorted(paths), trial
        assert [lcp for lcp, _ in out] == [ct.shared(a, b) for a, b in zip([b"", *sorted(paths)], sorted(paths))]


def test_shared_turns_are_not_compared_again(monkeypatch):
    """Merging compares turns from the LCP on only: with one long shared beginning it looks at few of them."""
    seen = []
    real = ct.shared
    monkeypatch.setattr(ct, "shared", lambda a, b, at=0: seen.append((at, real(a, b, at))) or real(a, b, at))
    long = bytes(range(1, 201)) * ct.TURN
    paths = [long + bytes([k]) * ct.TURN for k in range(64)]
    runs = [ct.sorted_run([(p,) for p in paths[i::8]]) for i in range(8)]
    seen.clear()
    assert len(list(ct.merged([iter(r) for r in runs]))) == 64
    assert sum(at == 0 for at, _ in seen) <= 7 and all(found - at == 0 for at, found in seen if at)


def test_runs_are_read_back_in_blocks(tmp_path, monkeypatch):
    from metricloom.llm.common import open_fs

    monkeypatch.setattr(ct, "BLOCK_ROWS", 3)
    fs, root = open_fs(str(tmp_path))
    run = ct.sorted_run([(bytes([k]) * ct.TURN, [k], 1, k, "e") for k in range(10)])
    ct.spilled(fs, f"{root}/r", run)
    assert list(ct.read_run(fs, f"{root}/r")) == run


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_trie_equals_the_plain_one(spark, seed):
    rows = conversations(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA)
    paths = rebuilt(turns_of(rows))
    assert any(not p for p in paths.values())  # some have no turns
    assert got(ct.trie(ct.rebuilt_paths(df))) == want(paths)


def test_small_runs_and_chunks_give_the_same_nodes(spark, tmp_path, monkeypatch):
    rows = conversations(seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    monkeypatch.setattr(ct, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    try:
        assert got(ct.trie(ct.conversation_paths(df), run_bytes=3000, chunk=50)) == want(turns_of(rows))
        assert os.path.isdir(f"{tmp_path}/runs") and not os.listdir(f"{tmp_path}/runs")  # runs were spilled and deleted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_and_no_conversations(spark):
    one = spark.createDataFrame([(6, 0, "user", "hi", 1, "p")], SCHEMA)
    h = zlib.crc32(b"6") % 9
    assert got(ct.trie(ct.rebuilt_paths(one))) == want({6: [("user", "hi")][h:]})
    assert ct.trie(ct.rebuilt_paths(one.limit(0))).count() == 0


def test_nodes_have_their_texts(spark):
    rows = conversations(seed=4)
    own = turns_of(rows)
    for r in ct.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r["role"], r["text"]) == (own[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from metricloom.llm import queries

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = queries.op11_conversation_trie(spark, sf_dir)
    expected = duck.sql(queries.ORACLES["op11_conversation_trie"])
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted(map(tuple, found.select(*expected.columns).collect()), key=str) == sorted(expected.fetchall(), key=str)
    assert got(found) == want(rebuilt(turns_of([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])))
