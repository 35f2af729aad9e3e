"""What counting tokens costs, with the counts that the tokenizers library gives."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from metricloom.llm import bpe, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


class Queued(bpe.Bpe):
    n = 0

    def merge(self, word):
        self.n += 1
        return super().merge(word)


def test_a_text_of_new_words_is_merged_side_by_side():
    own, rng = Queued(BYTE_BPE), random.Random(6)
    text = " ".join("".join(rng.choices("abcdefghé", k=rng.randint(1, 12))) for _ in range(3000))
    widths, counts = token_counts.row_of(text, own)[1:3]
    assert own.n == 0
    assert widths.tolist() == list(map(len, bpe.pretokens(text)))
    assert counts.tolist() == [len(own[p]) for p in bpe.pretokens(text)]
    assert counts.sum() == len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)


def test_counts_equal_merging(monkeypatch):
    monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 50)
    monkeypatch.setattr(bpe, "GENERATION", 100)
    own, rng = bpe.Bpe(BYTE_BPE), random.Random(7)
    symbols = [*"aaaabe tnz.,!0189\néß中\U0001f600", "the", "ing", "ab" * 9, "中" * 11]
    words = {"".join(rng.choices(symbols, k=rng.choice([1, 2, 5, 9, 15, 31, 32, 33]))) for _ in range(1000)} | {"", "a" * 32, "a" * 33, "x" * 700}
    want = {w: len(own.merge(w.encode())) for w in words}
    assert own.counts.learn(words) == want
    some = sorted(words)[:300]
    assert [own.counts[w] for w in some] == [want[w] for w in some]
    assert len(own.counts.known) <= 100 and "x" * 700 not in own.counts.known


def test_an_edit_cuts_only_what_it_encodes(monkeypatch):
    own = bpe.load(BYTE_BPE)
    text = "some words of one text. " * 400
    tree = token_counts.TokenTree.of(text, own)
    monkeypatch.setattr(token_counts, "pretokens", lambda text: pieces.extend(bpe.pretokens(text)) or bpe.pretokens(text))
    monkeypatch.setattr(token_counts, "each_pretoken", lambda text: (pieces.append(p) or p for p in bpe.each_pretoken(text)), raising=False)
    pieces = []
    tree.edit(5000, 5003, "new")
    assert len(pieces) < 20
    assert tree.count == len(own.encode(text[:5000] + "new" + text[5003:]))
