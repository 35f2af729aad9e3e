"""What encoding costs, with the ids that the tokenizers library gives."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from metricloom.llm import bpe

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


class Counting(dict):
    n = 0

    def get(self, *key):
        self.n += 1
        return super().get(*key)


def test_merging_looks_a_pair_up_once():
    own = bpe.Bpe(BYTE_BPE)
    own.merges = Counting(own.merges)
    assert own.merge(b" the") == tuple(Tokenizer.from_file(BYTE_BPE).encode(" the", add_special_tokens=False).ids)
    assert own.merges.n <= 6


def test_packed_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 4)
    own, library = bpe.Bpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    special = next(iter(own.added), "")
    for text in ("", "the the cat sat  on\n\n12 mats", "x" * 700, f"a{special}{special} b", "na\u00efve \u4f60\u597d \U0001f600"):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode_bytes(text), np.int32).tolist() == own.encode(text) == want
    assert len(own.packed) <= 4
