"""The operators for training data against brute force, round trips and held-out labels, with their odd inputs."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from metricloom.llm import bpe, exact_dedup, fingerprints, licenses, ngram_join, packing, token_counts, token_files, toxicity, warc
from metricloom.llm.components import connected_components

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n_tokens string, key int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def variants():
    """Documents with nulls, empty and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(1)
    base = text(rng, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["edit"] + words[k + 1 :]) for k in (3, 40, 90)]
    far = " ".join(words[:60]) + " " + text(rng, 60)
    rows = [base, base.upper(), *near, far, None, "", "one two", "One TWO", "a b c d e", text(rng, 30_000), "x" * 5000, "  spaced\x0b out\ttext\n\n", "ein Beispiel äöü ß 中文 🙂"]
    out = [(i, t, "en", "clash", 7) for i, t in enumerate(rows)]
    return [*out, out[0], (None, base, None, None, None), (None, "lonely words here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(variants(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# ---- WARC ------------------------------------------------------------------------------------------------------


def test_pages_by_way_of_archives(spark):
    big = "<p>" + "y" * 1500
    rows = [(1, "http://a", big), (2, None, big), (5, "http://b", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", ""), (8, "ü\nx", "ä" * 600), (8, "ü", "ä" * 600)]
    got = {}
    for r in warc.pages_by_way_of_archives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 5: 1, 3: 1, 4: 1, 6: 1, None: 1, 7: 1, 8: 2}
    for page, _, html in rows:
        r = got[page][0]
        assert r["payload_bytes"] == len((html or "").encode()) and r["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if page in (1, 2, None) else ("response", None))
    assert warc.pages_by_way_of_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_page_ids_and_lost_responses(spark, tmp_path):
    a, b = "a" * 1200, "b" * 1300
    rows = [(3, "u", a), (5, "u", a), (5, "u", b), (9, "u", b), (9, "v", b), (4, "u", b)]
    path = f"file://{tmp_path}/pages"
    warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.read_pages(spark, path)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect())
    want = [(3, 1200, sha(a), "revisit", 5), (4, 1300, sha(b), "revisit", 9), (5, 1200, sha(a), "response", None), (5, 1300, sha(b), "revisit", 9), (9, 1300, sha(b), "response", None), (9, 1300, sha(b), "response", None)]
    assert got == sorted(want, key=str) or got == sorted(want, key=lambda r: r[:4])
    assert warc.unresolved(spark, path).count() == 0 and {r["intact"] for r in found.collect()} == {True, None}
    lone = f"file://{tmp_path}/lone"
    records = [("urn:page:7", "revisit", "urn:page:1", "sha1:" + sha(a), 1200), ("urn:page:8", "response", None, "sha1:" + sha(b), None)]
    spark.createDataFrame(records, "record_id string, record_type string, refers_to string, payload_digest string, http_length long").write.format("warc").mode("append").save(lone)
    found = warc.read_pages(spark, lone)
    kept = {r["page_id"]: r for r in found.collect()}
    assert kept[7]["payload_bytes"] == 1200 and kept[7]["payload_digest"] == sha(a) and kept[7]["refers_to"] == 1
    assert kept[8]["payload_bytes"] == 0 and kept[8]["intact"] is False
    assert [r["page_id"] for r in warc.unresolved(spark, lone).collect()] == [7]


def test_pages_equal_their_sql_where_payloads_repeat(spark, tmp_path):
    import duckdb

    from metricloom.llm import queries

    texts = ["p" * 1000, "p" * 999, "ä" * 500, None, "", "q" * 5000]
    rows = [(k, f"http://h/{k}", texts[k % 6]) for k in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op1_warc(spark, str(tmp_path)).toPandas()
    want = duck.sql(queries.ORACLES["op1_warc"]).df()[list(got.columns)]
    plain = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert len(got) == 40 and [x.replace(".0", "") for x in plain(got)] == [x.replace(".0", "") for x in plain(want)]
    assert (got["record_type"] == "revisit").sum() > 10


def test_filters_reach_the_reader_and_payloads_are_skipped(spark, tmp_path):
    warc.register(spark)
    rows = [(f"urn:r:{k}", "response" if k % 2 else "metadata", f"http://h{k % 3}/", b"z" * 3000) for k in range(50)]
    path = f"file://{tmp_path}/w"
    spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary").write.format("warc").mode("append").save(path)
    df = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'response' AND target_uri LIKE 'http://h1%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert df.count() == sum(1 for r in rows if r[1] == "response" and r[2] == "http://h1/") and df.where("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader(path, True)
    assert len(list(reader.pushFilters([warc.ds.EqualTo(("offset",), 3), warc.ds.EqualTo(("record_type",), "response")]))) == 1


def test_plain_and_foreign_archives():
    one = [warc.record_bytes(f"urn:r:{k}", "resource", "http://x", None, None, None, "text/plain", b"body" * k) for k in range(5)]
    plain = b"".join(one)
    foreign = b"".join(zlib.compress(r, wbits=31) for r in one)
    own = b"".join(map(warc.gzip_member, one))
    odd = lambda r: r["record_id"] in ("urn:r:1", "urn:r:3")
    for data, gz in ((plain, False), (foreign, True), (own, True)):
        found = list(warc.records(io.BytesIO(data), len(data), gz, odd, True))
        assert [r["payload"] for r in found] == [b"body", b"body" * 3]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"nonsense"), 8, True, odd, True))


# ---- tokens ----------------------------------------------------------------------------------------------------

ALPHABET = [*"abcXYZ 'stredvml  \n\t\r0129½²①.,!-_éßñÄ中文字かな한국🙂ẞ\x1c\x1f\x85\xa0İſѢ١ ~", "<|endoftext|>", "'ll", "'re", " the"]


def random_texts(n=800, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_words_equal_the_library_for_all_letters():
    """Every code point below U+0300 and those that lower-casing takes across the border, in pairs with letters and
    digits on each side; and strings over the whole plane."""
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(WORD_BPE), token_files.WordEncoder(WORD_BPE)
    rng = random.Random(5)
    near = [*map(chr, range(0x300)), "\u1e9e", "\u212a", "\u212b", "\u2126", "\u2c65", "\u2c6f"]
    texts = [f"{a}{c}{b}" for c in near for a, b in (("b", "a"), ("Z", "É"), ("1", "x"), ("ß", "2"), ("'", "s"), (" ", "."), ("ø", " "))]
    texts += ["Ɓala ƐWE Ɔkan", "İstanbul ǅ Ǆ", "".join(near)]
    plane = lambda: chr(rng.choice([rng.randrange(0x300), rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x10000)]))
    texts += ["".join(plane() for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += ["".join(rng.choice(near) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    found, counts = own.encode_all(texts), own.counts(texts)
    for t, ids, n in zip(texts, found, counts, strict=True):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want), ascii(t)


def test_other_tokenizer_files_go_to_the_library():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(BYTE_BPE), token_files.WordEncoder(BYTE_BPE)
    assert not own.own and token_files.WordEncoder(WORD_BPE).own
    for t, ids in zip(random_texts(), own.encode_all(random_texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_roll_by_size(spark, tmp_path, monkeypatch):
    rows = [(k % 3 if k < 30 else None, f"word{k} " * (k % 7)) for k in range(40)]
    monkeypatch.setattr(token_files, "FILE_TOKENS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    manifest = token_files.write_token_files(docs, WORD_BPE, str(tmp_path / "t")).toPandas()
    found = token_files.read_token_files(spark, str(tmp_path / "t")).toPandas().sort_values("start")
    want = sorted(((i, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert found["n_tokens"].sum() == manifest["tokens"].sum() == sum(len(ids) for _, ids in want)
    assert found["start"].tolist() == np.concatenate(([0], np.cumsum(found["n_tokens"])[:-1])).tolist()
    keys = [None if k != k else int(k) for k in found["doc_id"]]
    assert keys == [k for k, _ in want]
    assert sorted((str(k), np.frombuffer(b, "<u4").tolist()) for k, b in zip(keys, found["ids"])) == sorted((str(k), ids) for k, ids in want)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(BYTE_BPE), bpe.load(BYTE_BPE)
    for t in [*random_texts(), "q" * 3000, " " * 700]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    assert own.decode([own.of_byte[0xC3]]) == "�"


def test_bpe_documents(docs, none):
    own = bpe.load(BYTE_BPE)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, BYTE_BPE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((str(i), len(own.encode(t or "")), sha(",".join(map(str, own.encode(t or "")))), sha(t or "")) for i, t, *_ in variants())
    assert bpe.digests(none, BYTE_BPE).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(WORD_BPE), token_files.load(WORD_BPE)
    texts = random_texts(seed=3)
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, none, tmp_path):
    own = token_files.load(WORD_BPE)
    rows = sorted(variants(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t, *_ in rows:
        ids = own.encode_all([t or ""])[0] + (2).to_bytes(4, "little")
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = sorted(map(tuple, token_files.round_trip(docs, WORD_BPE).collect()), key=lambda r: r[1])
    assert got == want
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, WORD_BPE, path)
    assert [r["doc_id"] for r in token_files.read_token_files(spark, path, [3]).collect()] == [3]
    assert token_files.read_token_files(spark, path, [77]).count() == 0
    assert token_files.id_width(WORD_BPE, 2) == 2 and token_files.id_width(WORD_BPE, 70_000) == 4
    with pytest.raises(ValueError, match="70000"):
        token_files.TokenFileWriter(io.BytesIO(), 2).add(1, np.array([70_000], np.uint32))
    sizes = own.counts([t or "" for _, t, *_ in rows])
    assert sizes == [len(ids) // 4 for ids in own.encode_all([t or "" for _, t, *_ in rows])]
    assert token_files.round_trip(none, WORD_BPE).count() == 0


def test_token_file_frames_and_damage(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 1000)
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    w = token_files.TokenFileWriter(out, 2)
    docs = [np.arange(n, dtype=np.uint32) % 50_000 for n in (0, 3, 400, 5000, 1)]
    for k, d in enumerate(docs):
        w.add(k if k else None, d)
    w.close()
    data = out.getvalue()
    t = token_files.TokenFile(io.BytesIO(data), len(data))
    assert len(t.table) > 8 and all((t.ids(k) == d).all() for k, d in enumerate(docs))
    broken = bytearray(data)
    broken[int(t.packed[3]) + 20] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_files.TokenFile(io.BytesIO(bytes(broken)), len(data)).ids(3)
    close()


def test_counts_follow_edits():
    own, rng = bpe.load(BYTE_BPE), random.Random(4)
    symbols = [*"abc XYZ '\n  stre129.,!é中", "'re", "  ", "\n\n", " the", "<|endoftext|>", "<|endof", "text|>"]
    for _ in range(150):
        t = "".join(rng.choice(symbols) for _ in range(rng.choice([0, 1, 5, 50, 2000])))
        tree = token_counts.TokenTree.of(t, own)
        for step in range(6):
            a = rng.randint(0, len(t))
            b, new = min(len(t), a + rng.choice([0, 1, 5, 400])), "".join(rng.choice(symbols) for _ in range(rng.choice([0, 1, 30])))
            t = t[:a] + new + t[b:]
            tree.edit(a, b, new)
            pieces = [p for k in range(tree.n_leaves) for p in tree.leaf(k)]
            assert pieces == token_counts.pieces_of(t, own) and tree.count == len(own.encode(t)) and tree.length == len(t)
            if step == 3:  # kept and read again
                tree = token_counts.TokenTree(*tree.stored(), own)


def test_a_second_round_of_edits_encodes_what_it_touches(spark, docs):
    trees = token_counts.build_trees(docs, BYTE_BPE)
    first = token_counts.apply_edits(token_counts.with_sample_edits(docs).drop("text").join(trees, "doc_id"), BYTE_BPE, new_trees=True)
    again = first.select("doc_id", "text", "widths", "counts", "chars", "tokens", F.expr("array(struct(0L AS start, 3L AS end, 'new' AS replacement))").alias("edits"))
    own = bpe.load(BYTE_BPE)
    want = {r["doc_id"]: r["text"] for r in first.collect()}
    for r in token_counts.apply_edits(again, BYTE_BPE).collect():
        t = want[r["doc_id"]]
        assert (r["n_tokens"], r["edited_tokens"]) == (len(own.encode(t)), len(own.encode("new" + t[3:]))) and (r["encoded_chars"] < 200 or t.startswith("xxxx"))
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs.dropna(subset=["doc_id"]), BYTE_BPE).collect()}
    assert all(r["tokens"][1] == counts[r["doc_id"]] for r in trees.dropna(subset=["doc_id"]).collect())


def test_edited_counts(docs, none):
    own = bpe.load(BYTE_BPE)
    count = lambda t: sum(len(own[p]) for p in bpe.pretokens(t))
    for r in token_counts.edited_counts(token_counts.with_sample_edits(docs), BYTE_BPE).where("doc_id IS NOT NULL").collect():
        t = variants()[r["doc_id"]][1] or ""
        assert r["n_tokens"] == count(t)
        n, first = len(t), t[:20]
        for at, width, new in ((n // 2, 0, " It's 42 new words,\n\nput in here. "), (n // 4, 7, ""), (n * 3 // 4, 10, first)):
            t = t[:at] + new + t[at + width :]
        assert r["edited_tokens"] == count(t)
        assert len(t) < 20_000 or r["encoded_chars"] < 500
    assert token_counts.edited_counts(token_counts.with_sample_edits(none), BYTE_BPE).count() == 0


# ---- toxicity, licences ----------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert set(found["held_out"]) == {True} and found["score"].between(0, 1).all() and ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()
    assert ((found["predicted"] == found["toxic"]).mean()) > 0.95
    clean, toxic = found[found["toxic"] == 0], found[found["toxic"] == 1]
    assert clean["predicted"].mean() < 0.02
    # one in eight labels of toxic documents has no insult in it, which bounds what can be caught
    assert toxic["predicted"].mean() > 0.75
    ranks = found["score"].rank()
    auc = (ranks[found["toxic"] == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.9


def test_kernel_equals_a_naive_one():
    from itertools import combinations

    def naive(w):
        s = bytes([toxicity.MARK]) + w.encode().translate(bytes(c - 96 if 97 <= c <= 122 else toxicity.OTHER for c in range(256))) + bytes([toxicity.MARK])
        out: dict = {}
        for places in combinations(range(len(s)), 4):
            if (span := places[-1] - places[0]) < toxicity.SPAN:
                key = tuple(s[p] for p in places)
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (span + 1) / toxicity._norm(len(s))
        return out

    words = ["idiot", "id.iot", "worthless", "a", "moron", "disgusting", "xyxyxyxy"]
    for x in words:
        for y in words:
            a, b = naive(x), naive(y)
            f, g = toxicity._features(x), toxicity._features(y)
            assert sum(v * b.get(k, 0.0) for k, v in a.items()) == pytest.approx(sum(v * g.get(k, 0.0) for k, v in f.items()))
    assert toxicity._symbols("идиот") != toxicity._symbols("привет") and toxicity._symbols("漢字")[0][1] != toxicity.OTHER


def test_toxicity_odd_inputs(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(variants()) and toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_kernel_tolerates_inserted_characters():
    m = toxicity._machine({"idiot": 20.0, "moron": 20.0, "scum": 20.0}, [*WORDS, "idea", "ration", "moor", "scope", "the", "and", "window", "morning"])
    hit = m.values(["idiot", "id.iot", "idi-ot", "mor*on", "MORON!", "scüm", "theta", "window"])
    assert hit[:6].min() > hit[6:].max()
    assert "idiot" in toxicity.fragments("what an i d i o t he is")


def test_licences(spark, none):
    model = licenses.train()
    assert [r[2] for r in licenses.scan_text("intro\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", model)] == ["mit", "apache-2.0"]
    assert licenses.scan_text("She lost her driver's license.\nnothing", model) == []
    rng = np.random.default_rng(99)
    pairs = [(f, v) for f, ts in licenses.TEMPLATES.items() for t in ts for v in licenses._variants(rng, t, 6)]
    p = model.probabilities(model.features([v for _, v in pairs]))
    assert np.mean([model.families[k] == f for (f, _), k in zip(pairs, p.argmax(axis=1), strict=True)]) > 0.9
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.\ntext"), (1, None), (2, ""), (None, "é\nReleased under the MIT License.")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["start"], r["family"], r["confirmed"]) for r in licenses.scan(df).collect()) == [("1", 0, "cc-by-nc", True), ("None", 2, "mit", True)]
    assert licenses.scan(none).count() == 0


def test_licences_of_identifiers_and_wrapped_notices():
    import textwrap

    model = licenses.train()
    families = lambda t: [r[2] for r in licenses.scan_text(t, model)]
    for t, family in (("Distributed under AGPL-3.0.", "agpl"), ("Code is Apache-2.0.", "apache-2.0"), ("Terms: LGPL-2.1 or later", "lgpl"), ("CC-BY-4.0", "cc-by"), ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY", "mit")):
        assert families(t) == [family], t
    assert families("Dual MPL-2.0 / MIT")[0] in ("mpl-2.0", "mit")
    prose = "The river rose in the night and they moved the cattle to the hill.\n\n"
    for family in ("gpl", "lgpl", "agpl", "mit", "bsd", "isc"):
        notice = max(licenses.TEMPLATES[family], key=len)
        for width in (40, 60, 76):
            wrapped = textwrap.fill(notice, width)
            found = licenses.scan_text(f"{prose}{wrapped}\n\n{prose}", model)
            assert [r[2] for r in found] == [family], (family, width, found)
            assert found[0][:2] == (len(prose), len(prose) + len(wrapped))
    for family in licenses.TEMPLATES:
        for t in licenses.known_texts(family):
            assert not licenses._TELLING.isdisjoint(licenses.words(t))
    assert families(prose * 30) == [] and families("Er ging mit dem Hund\nund kam mit der Katze, mit Hut.\n\nDamit war es gut.") == []


# ---- fingerprints ----------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, none):
    rows = sorted((r for r in variants()[:15]), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs.where("doc_id IS NOT NULL").dropDuplicates()).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(shingles(t.lower()), shingles(edited.lower()))) < 0.2
        assert abs(r["near_next"] - jaccard(shingles(t.lower()), shingles(after.lower()))) < 0.2
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[6]["fingerprint"] == ""
    plan = fingerprints.edited_likeness(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert fingerprints.edited_likeness(docs).count() == len(variants()) and fingerprints.edited_likeness(none).count() == 0
    one = fingerprints.edited_likeness(spark.createDataFrame([(4, "a b c d e f g")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


# ---- duplicates ------------------------------------------------------------------------------------------------


def test_exact_dedup(docs, none):
    groups: dict = {}
    for i, t, *_ in variants():
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t, *_ in variants():
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((str(i), str(keep), len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in exact_dedup.exact_dedup(docs).collect()) == sorted(want)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(w[0] for w in want if w[3])


def test_stages_keep_columns_of_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, "s", 2, 3), (2, "A b c d e f", 1, "s", 2, 3), (2, "x y z", 1, None, 2, 3), (None, None, 1, "s", 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _sha string, id int, row int")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "None"]
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]


def test_one_of_each_judges_rows_of_one_id_by_their_texts(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "other")
    rows = [(3, base), (5, near), (5, "an unrelated text of seven words here"), (7, "same words twice over and over"), (7, "SAME words twice over and over"), (8, base), (8, near)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"][:4]) for r in kept.collect()) == [(3, "w0 w"), (5, "an u"), (7, "SAME"), (7, "same")]
    two = ngram_join.one_of_each(spark.createDataFrame([(1, base), (1, near)], "doc_id long, text string"))
    assert two.count() == 1


def test_a_large_group_of_near_copies(spark):
    """A group like a template that is edited in few places: linked members, and ones just out of reach."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(own)))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(least.get(root(k)) if s else i)) for k, (i, s) in enumerate(sets))


def test_similar_components(docs, none):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in ngram_join.similar_components(docs).collect())
    assert got == brute_components(variants())
    assert ngram_join.similar_components(none).count() == 0 and ngram_join.one_of_each(none).columns == none.columns


def test_similar_components_at_the_threshold(spark, monkeypatch):
    """Chains and clusters around 0.8, with short lists and few hot tokens forced, against brute force."""
    monkeypatch.setattr(ngram_join, "HOT_DF", 3)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    rng, rows = random.Random(5), []
    passage = text(rng, 30)
    for c in range(12):
        words = text(rng, rng.choice([6, 12, 40, 90])).split()
        for _ in range(10):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 22))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            if rng.random() < 0.2:
                own += passage.split()
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.3:
                words = own
    got = sorted((str(r[0]), r[1], str(r[2])) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 9), (7, 7), (2, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4} | {100 + k: 100 for k in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing and the pipeline ----------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 20, len(lengths))
        cost = lambda ends, l=lengths, c=counts: sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(l.tolist(), c.tolist(), strict=True))
        for buckets in (1, 2, 3):
            best = min(cost([*ends, lengths[-1]]) for k in range(min(buckets, len(lengths))) for ends in combinations(lengths[:-1].tolist(), k))
            got = packing.optimal_boundaries(lengths, counts, buckets)
            assert len(got) <= buckets and cost(got) == best


def test_packing(docs, none, spark):
    out = packing.pack_documents(docs, 4, 300).toPandas()
    assert len(out) == len(variants()) and out["n_tokens"].sum() == sum(len((t or "").split()) for _, t, *_ in variants())
    assert (out["n_tokens"] <= out["bucket_tokens"]).all()
    batches = out.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), width=("bucket_tokens", "max"))
    assert ((batches["n"] * batches["width"] <= 300) | (batches["n"] == 1)).all() and (batches["top"] + 1 == batches["n"]).all()
    assert all(sorted(g["batch"].unique()) == list(range(g["batch"].nunique())) for _, g in out.groupby("bucket"))
    assert packing.pack_documents(none).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None), (1, None), (None, 5)], "doc_id long, n_tokens long")).count() == 3


def test_the_query_and_the_pipeline_pack_by_tokens(spark, none, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from metricloom.llm import queries

    own = [*variants(), (90, "iVBORw0KGgoAAAANSUhEUgAA" * 500, None, None, None), (91, "\u4e2d\u6587\u5b57\u7b26" * 300, None, None, None)]
    table = spark.createDataFrame(own, SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(WORD_BPE)
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in own)
    for out in (queries.op7_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, table, str(tmp_path))):
        got = out.toPandas()
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out.collect()) == want
        sums = got.groupby(["bucket", "batch"]).agg(n=("slot", "size"), width=("bucket_tokens", "max"))
        assert (got["n_tokens"] <= got["bucket_tokens"]).all() and ((sums["n"] * sums["width"] <= packing.BUDGET) | (sums["n"] == 1)).all()
    assert packing.pack_tokens(none, WORD_BPE).count() == 0


def test_pipeline_against_a_plain_version(spark, sf_dir):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in bad]
    last: dict = {}
    for i, t in rows:
        last[lower(t)] = max(i, last.get(lower(t), i))
    rows = [(i, t) for i, t in rows if last[lower(t)] == i]
    keep = {i for i, _, c in brute_components(rows) if i == c}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(map(str, got["doc_id"])) == sorted(keep)
    assert len(corpus_pipeline.STAGES) == 4


def test_training_is_bounded_by_rows(spark, monkeypatch):
    """A labelled id that many rows repeat, alike or with other texts, brings no more rows than the bound."""
    rng = random.Random(3)
    rows = [(k % 20, text(rng, 12) + (" blorgface" if k % 20 < 8 else ""), "en", "x", 1) for k in range(1500)] + [(1, "again blorgface", "en", "x", 1)] * 300
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(20)], "doc_id long, toxic int")
    sizes = []
    real = toxicity._scored
    monkeypatch.setattr(toxicity, "_scored", lambda docs, machine, keep: sizes.append(docs.count()) or real(docs, machine, keep))
    machine = toxicity.train(spark.createDataFrame(rows, SCHEMA), labels, max_docs=200)
    assert not isinstance(machine, float) and sizes and max(sizes) <= 200
