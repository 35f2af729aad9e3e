"""Minimum-cost flow against all flows there are, and resharding against what a plain count says."""

from __future__ import annotations

import collections
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from metricloom.llm import sharding


def least_cost(supplies, capacities, cost):
    """The least cost over all ways to deal the supplies, by trying each."""
    olds = list(supplies)

    def ways(amount, room):
        if not room:
            return [()] if amount == 0 else []
        return [(k, *rest) for k in range(min(amount, room[0]) + 1) for rest in ways(amount - k, room[1:])]

    def best(k, room):
        if k == len(olds):
            return 0
        found = [sum(n * cost(olds[k], j) for n, j in zip(w, capacities)) + best(k + 1, tuple(r - n for r, n in zip(room, w))) for w in ways(supplies[olds[k]], room)]
        return min(found)

    return best(0, tuple(capacities.values()))


def test_flows_cost_least():
    rng = random.Random(4)
    for trial in range(60):
        supplies = {k: rng.randint(0, 4) for k in range(rng.randint(1, 3))}
        total = sum(supplies.values())
        n = rng.randint(1, 4)
        capacities = dict(sharding.equal_capacities(total + rng.randint(0, 2), n)) if trial % 2 else {k: rng.randint(total // n + 1, total + 1) for k in range(n)}
        prices = {(i, j): rng.randint(0, 3) for i, j in itertools.product(supplies, capacities)}
        for cost in (lambda i, j: float(i != j), lambda i, j, p=prices: float(p[i, j])):
            flows = sharding.min_cost_flow(supplies, capacities, cost)
            sent, got = collections.Counter(), collections.Counter()
            for (i, j), amount in flows.items():
                assert amount > 0
                sent[i] += amount
                got[j] += amount
            assert all(sent[i] == a for i, a in supplies.items()) and all(got[j] <= c for j, c in capacities.items())
            assert sum(a * cost(*arc) for arc, a in flows.items()) == least_cost(supplies, capacities, cost)
    with pytest.raises(ValueError):
        sharding.min_cost_flow({0: 5}, {0: 4})


def test_as_few_bytes_move_as_can():
    rng = random.Random(5)
    for _ in range(20):
        old = {k: rng.randint(0, 10**13) for k in range(rng.randint(1, 40))}
        new = sharding.equal_capacities(sum(old.values()), rng.randint(1, 40))
        flows = sharding.min_cost_flow(old, new)
        assert sum(n for (i, j), n in flows.items() if i != j) == sum(max(0, n - new.get(k, 0)) for k, n in old.items())


def rows():
    rng = random.Random(6)
    out = [(k, "w" * rng.randint(0, 400), 1, "x") for k in range(3000)]
    out += [(7, "again", 1, "x")] * 1000 + [(None, None, None, None)] * 500 + [(5000 + k, "ä中" * 8000, 2, None) for k in range(5)] + [(9000, "", 2, "")]
    return out


SCHEMA = "doc_id long, text string, size int, shard string"


def holds(got, given, shards):
    """Every row once, slots without gaps, sizes and checksums right; the shards' bytes."""
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in given)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    slots, total = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [total[k] for k in range(shards)]


def test_resharded_rows(spark):
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA)
    for parts in (1, 6):
        found = sharding.resharded(docs.repartition(parts)).collect()
        total = holds(found, given, 8)
        assert max(total) - min(total) < 400
    assert sharding.resharded(docs.limit(0)).count() == 0
    assert holds(sharding.resharded(spark.createDataFrame(given[:1], SCHEMA)).collect(), given[:1], 8)


def test_only_affected_files_are_touched(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(12)
    path = f"file://{tmp_path}/s"
    first = sharding.write_shards(docs, path, 3)
    second = sharding.reshard(spark, path, first, 4)
    before, after = ({r["file"]: r for r in m.collect()} for m in (first, second))
    old = collections.Counter()
    for r in before.values():
        old[r["shard"]] += r["bytes"]
    new = sharding.equal_capacities(sum(old.values()), 4)
    stay = [f for f in after if f in before]
    gone = [f for f in before if f not in after]
    assert all(before[f]["shard"] == after[f]["shard"] for f in stay) and len(stay) > len(before) // 2
    rewritten = [f for f in after if f.startswith("split-")]
    moved = sum(r["bytes"] for f, r in after.items() if f.startswith("moved-")) + sum(after[f]["bytes"] for f in rewritten if after[f]["shard"] == 3)
    least = sum(max(0, n - new.get(k, 0)) for k, n in old.items())
    assert abs(moved - least) < 2000 and len(gone) <= 12 * 3
    # the old manifest still reads, and going back to three shards moves the fourth's bytes only
    assert sharding.read_shards(spark, path, first).count() == docs.count()
    third = sharding.reshard(spark, path, second, 3)
    sizes = {r["shard"]: r["b"] for r in third.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) < 1000
    assert sorted(map(str, sharding.read_shards(spark, path, third).select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))


def test_query_over_the_table(spark, sf_dir):
    from metricloom.llm import queries

    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    total = holds(queries.op12_sharding(spark, sf_dir).collect(), given, 8)
    assert max(total) - min(total) < 0.02 * sum(total) / 8
