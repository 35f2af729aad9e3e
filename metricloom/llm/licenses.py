"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of lines that are not blank, so that a notice may be wrapped; long ones are read in overlapping
windows, and every line also on its own, as a notice may stand between other text. All of them are classified by a
multinomial logistic regression over sparse word n-grams of the templates and identifiers, with an unknown class
learnt from ordinary paragraphs and from licence words in other senses; only texts without a single word of a template
or identifier that is not among the commonest words are left out. Probabilities are calibrated by a temperature
fitted on held-back variants. A family is reported where it beats the unknown class; the finding is confirmed if the
paragraph covers enough of the n-grams of one of the family's templates, or a template enough of the paragraph's.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short notices and key sentences of public licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0).", "Released under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Copyright (c) 2020 Example Corp. All rights reserved."],
}
#: Identifiers of the families, as lists of licences and file headers name them, and sentences of theirs.
IDENTIFIERS: dict[str, list[str]] = {
    "mit": ["License: MIT", "SPDX-License-Identifier: MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"],
    "apache-2.0": ["Apache-2.0"],
    "gpl": ["GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPLv3"],
    "lgpl": ["LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later"],
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPLv3"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause"],
    "mpl-2.0": ["MPL-2.0", "License: MPL-2.0"],
    "isc": ["License: ISC", "SPDX-License-Identifier: ISC"],
    "unlicense": ["License: Unlicense", "SPDX-License-Identifier: Unlicense"],
    "cc-by": ["CC-BY-4.0", "CC BY 4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC 4.0"],
    "cc0": ["CC0-1.0"],
}
#: Licence words in other senses, for the unknown class.
OTHER_SENSES = [
    "She lost her driver's license on the way to the station.",
    "The restaurant's liquor license was renewed in spring.",
    "You need a fishing licence for this part of the river.",
    "He had poetic license to change the ending of the story.",
    "The bank is licensed and regulated by the central authority.",
    "Without permission nobody may enter the building after dark.",
    "The warranty covers repairs for two years after purchase.",
    "Their copyright dispute went to court last year.",
    "License plates are issued by the state.",
    "The public domain of the park is open from dawn to dusk.",
    "Sie kam mit dem Zug und blieb mit ihrem Bruder bis zum Abend.",
    "Mit freundlichen Grüßen",
]
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
UNKNOWN = "unknown"
NGRAMS = 3
CONFIRM = 0.6
VARIANTS = 40
#: Words a window, and words from one window to the next: of lines, and of paragraphs.
SMALL, LARGE = (24, 12), (96, 48)
_COMMON = frozenset("a an and any are as at be been but by for from had has have in is it its may no not of on or other that the this to under we were with without you your".split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in range(1, NGRAMS + 1) for i in range(len(ws) - n + 1)}


def known_texts(family: str) -> list[str]:
    return TEMPLATES[family] + IDENTIFIERS.get(family, [])


#: A text without any of these words has nothing of a family but common words.
_TELLING = frozenset(w for f in TEMPLATES for t in known_texts(f) for w in words(t)) - _COMMON


@dataclass
class Classifier:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # features x families; the last three features: share of unknown n-grams, shortness, one
    temperature: float = 1.0

    def features(self, paragraphs: list[str]) -> np.ndarray:
        x = np.zeros((len(paragraphs), len(self.vocabulary) + 3))
        for k, p in enumerate(paragraphs):
            own = ngrams(words(p))
            known = [i for g in own if (i := self.vocabulary.get(g)) is not None]
            x[k, known] = 1 / max(1, len(known)) ** 0.5
            x[k, -3:] = 1 - len(known) / max(1, len(own)), 1 / (1 + len(own)), 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _variants(rng: np.random.Generator, text: str, n: int) -> list[str]:
    """The text with words left out, put in around it or cut at an end."""
    ws, out = text.split(), [text]
    fill = ["project", "this", "file", "see", "details", "code", "and", "docs", "for", "the", "note", "author"]
    for _ in range(n - 1):
        own = [w for w in ws if rng.random() > 0.08] or ws
        if len(own) > 12 and rng.random() < 0.5:
            lo = int(rng.integers(0, len(own) // 3))
            own = own[lo : len(own) - int(rng.integers(0, len(own) // 3))]
        head, tail = (list(rng.choice(fill, int(rng.integers(0, 4)))) for _ in range(2))
        out.append(" ".join([*head, *own, *tail]))
    return out


@functools.lru_cache(maxsize=4)
def train(seed: int = 5, rounds: int = 400) -> Classifier:
    """The classifier, trained on variants of the templates and of ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    texts, labels = [], []
    for k, family in enumerate(TEMPLATES):
        for t in known_texts(family):
            v = _variants(rng, t, VARIANTS)
            texts += v
            labels += [k] * len(v)
    pool = [w for f in TEMPLATES for t in known_texts(f) for w in t.split()]
    common = "the of and to in a is that for it as was on are with they be at have this from or had by word but not what all were we when your can said there".split()
    other = [x for t in OTHER_SENSES for x in _variants(rng, t, VARIANTS)]
    for _ in range(600):  # common words with stray licence words among them
        ws = [str(rng.choice(pool)) if rng.random() < 0.25 else str(rng.choice(common)) for _ in range(int(rng.integers(3, 40)))]
        other.append(" ".join(ws))
    known, letters = sorted({w for t in pool for w in words(t)}), "etaoinshrdlucmfwypvbgk"
    for _ in range(1200):  # words that no template has, as in other languages, with stray single ones of templates ("mit")
        ws = ["".join(rng.choice(list(letters), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(2, 40)))]
        other.append(" ".join(str(rng.choice(known)) if rng.random() < 0.2 else w for w in ws))
    texts += other
    labels += [len(families) - 1] * len(other)
    grams = sorted({g for f in TEMPLATES for t in known_texts(f) for g in ngrams(words(t))})
    model = Classifier(families, {g: i for i, g in enumerate(grams)}, np.zeros((len(grams) + 3, len(families))))
    x, y = model.features(texts), np.eye(len(families))[labels]
    held = rng.random(len(texts)) < 0.2
    a, b, speed = x[~held], y[~held], np.zeros_like(model.weights)
    for _ in range(rounds):
        slope = a.T @ (model.probabilities(a) - b) / len(a) + 1e-4 * model.weights
        speed = 0.9 * speed - 4.0 * slope
        model.weights = model.weights + speed
    losses = {}
    for t in np.linspace(0.3, 3, 28):
        model.temperature = float(t)
        losses[float(t)] = -np.log((model.probabilities(x[held]) * y[held]).sum(axis=1) + 1e-12).mean()
    model.temperature = min(losses, key=losses.get)
    return model


_GRAMS = {f: [ngrams(words(t)) for t in known_texts(f)] for f in TEMPLATES}


def covered(paragraph: str, family: str) -> int:
    """How many n-grams of a template the paragraph has, of those templates it covers enough of; 0 if of none."""
    own = ngrams(words(paragraph))
    return max((n for t in _GRAMS[family] if (n := len(own & t)) >= CONFIRM * len(t)), default=0)


def likeness(paragraph: str, family: str) -> float:
    """The largest share of a template's n-grams in the paragraph or of the paragraph's in a template."""
    own = ngrams(words(paragraph))
    return max((max(len(own & t) / len(t), len(own & t) / len(own)) for t in _GRAMS[family]), default=0.0) if own else 0.0


_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")


def _windows(found: list[tuple[int, int]], size: int, step: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows over the places of words, as places in the text; all of it if that is not much longer."""
    n = len(found)
    for lo in range(0, max(1, n - size + step), step) if n > size + step else (0,):
        part = found[lo : lo + size] if n > size + step else found
        yield part[0][0], part[-1][1]


def _spans(low: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The windows of lines and of paragraphs of a text that have a telling word."""
    small, large = [], []
    for m in _PARAGRAPH.finditer(low):
        body, base = m[0], m.start()
        if _TELLING.isdisjoint(_WORD.findall(body)):
            continue
        every, at = [], base
        for line in body.split("\n"):
            found = [(w.start() + at, w.end() + at) for w in _WORD.finditer(line)]
            every += found
            if found:
                small += [(max(a, at) if a != found[0][0] else at, b if b != found[-1][1] else at + len(line)) for a, b in _windows(found, *SMALL)]
            at += len(line) + 1
        if "\n" in body or len(every) > sum(SMALL):
            large += [(base if a == every[0][0] else a, m.end() if b == every[-1][1] else b) for a, b in _windows(every, *LARGE)]
    telling = lambda s: not _TELLING.isdisjoint(_WORD.findall(low, *s))
    return [s for s in small if telling(s)], [s for s in large if telling(s)]


def _hits(text: str, spans: list[tuple[int, int]], model: Classifier) -> list[tuple[int, int, str, float]]:
    """(start, end, family, probability) of the spans that are notices; overlapping ones of a family are one."""
    out: list[tuple[int, int, str, float]] = []
    for lo in range(0, len(spans), 256):
        part = spans[lo : lo + 256]
        p = model.probabilities(model.features([text[a:b] for a, b in part]))
        for (a, b), k, top in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
            family = model.families[k]
            if family != UNKNOWN and out and out[-1][2] == family and a < out[-1][1]:
                out[-1] = (out[-1][0], b, family, max(top, out[-1][3]))
            elif family != UNKNOWN:
                out.append((a, b, family, float(top)))
    return out


def scan_text(text: str, model: Classifier) -> list[tuple[int, int, str, float, float]]:
    """(start, end, family, probability, likeness) of the paragraphs of a text that are licence notices.

    A line that covers a template stands on its own, unless the paragraph covers one that is longer by half; of other
    lines and paragraphs that overlap the paragraph counts, since it sees the whole of a wrapped notice."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    small, large = _spans(low)
    if not small:
        return []
    lines, paragraphs = _hits(text, small, model), _hits(text, large, model)
    size = {h: covered(text[h[0] : h[1]], h[2]) for h in (*lines, *paragraphs)}
    meets = lambda h, g: h[0] < g[1] and g[0] < h[1]
    whole = [h for h in lines if size[h] and not any(meets(h, g) and size[g] > 1.5 * size[h] for g in paragraphs)]
    kept = whole + [g for g in paragraphs if not any(meets(g, h) for h in whole)]
    kept += [h for h in lines if not any(meets(h, g) for g in kept)]
    return [(*h, likeness(text[h[0] : h[1]], h[2])) for h in sorted(kept)]


def scan(docs: DataFrame) -> DataFrame:
    """One row per licence notice: doc_id, start, end (code points of the paragraph), family, probability,
    likeness and confirmed. Documents without notices, empty and null texts give no rows; repeated rows and null
    ids are scanned like others; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in scan_text(text.as_py() or "", shared.value):
                    keys.append(key)
                    rows.append(row)
            if rows:
                start, end, family, p, like = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(family), pa.array(p), pa.array(like)], ["doc_id", "start", "end", "family", "probability", "likeness"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, end long, family string, probability double, likeness double")
    return rows.withColumn("confirmed", F.col("likeness") >= CONFIRM)
