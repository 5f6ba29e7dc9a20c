"""Licence notices in documents, paragraph by paragraph.

A multinomial logistic regression over sparse word n-grams names the licence family of a paragraph or calls it
unknown.  It is trained on variations of the notices below against paragraphs of the corpus and scrambled notices;
a temperature fitted on held-out variations calibrates its probabilities.  A prediction counts only if a notice of
that family stands in the paragraph nearly word for word: paragraphs lie between blank lines, and each notice is
looked for in windows of about its own length, so wrapped notices and several in one paragraph are found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import map_text

UNKNOWN = "unknown"
# Customary short notices of each family.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache License 2.0.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Corpus paragraphs that the unknown class is trained on, from about as many documents, chosen by a hash of doc_id.
SAMPLE_PARAGRAPHS = 3000
VARIATIONS = 60
LONGEST = 3
MIN_PROBABILITY = 0.5
#: Share of a notice's words and word pairs that a paragraph must have in order.
MIN_SIMILARITY = 0.8

#: Words that a window is longer than its notice, at least, and as a share of the notice.
EXTRA_WORDS, EXTRA_SHARE = 6, 0.25

_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_WORD_OF_ANY_CASE = re.compile(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*")
# A line without letters and digits, such as a lone comment sign, ends a paragraph.
_BLANK = re.compile(r"\n[^\w\n]*(?=\n)")
_BETWEEN = {"or", "and"}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[tuple[str, ...]]:
    """The word n-grams of one to three words."""
    return {tuple(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)}


def _compared(words: list[str]) -> Counter:
    return Counter([(w,) for w in words] + list(zip(words, words[1:])))


def similarity(words: list[str], notice: list[str]) -> float:
    """Share of a notice's words and word pairs that the paragraph has."""
    want, have = _compared(notice), _compared(words)
    return sum((want & have).values()) / max(1, sum(want.values()))


def _trimmed(words: list[str], low: int, high: int, notice: list[str]) -> tuple[int, int, float]:
    """The window without the words at its ends that the similarity does not need."""
    best = similarity(words[low:high], notice)
    while high - low > 1 and similarity(words[low : high - 1], notice) >= best:
        high -= 1
    while high - low > 1 and similarity(words[low + 1 : high], notice) >= best:
        low += 1
    return low, high, best


def _windows(words: list[str], notice: list[str], hits: list[int]) -> list[tuple[int, int, float]]:
    """(first, end, similarity) of windows with the notice; ``hits`` are the places of its word pairs."""
    length = len(notice) + max(EXTRA_WORDS, int(EXTRA_SHARE * len(notice)))
    slack = length - len(notice)
    # So many pairs are there even if all words are.
    need = max(1, math.ceil(MIN_SIMILARITY * (2 * len(notice) - 1) - 1e-9) - len(notice))
    found, i = [], 0
    while i + need <= len(hits):
        first, done = hits[i], found[-1][1] if found else 0
        low, i = max(done, first - slack), i + 1
        if hits[i + need - 2] + 2 - first > length or first < done:
            continue
        if similarity(words[low : first + length], notice) < MIN_SIMILARITY:
            continue
        window = _trimmed(words, low, min(len(words), first + 2 * length), notice)
        if window[1] - window[0] > length:
            window = _trimmed(words, low, min(len(words), first + length), notice)
        found.append(window)
    return found


def _merged(matches: list[tuple]) -> list[tuple]:
    """Overlapping matches of one family as one."""
    out: list[tuple] = []
    for family, low, high, p, alike in sorted(matches):
        if out and out[-1][0] == family and low < out[-1][2]:
            out[-1] = (family, out[-1][1], max(high, out[-1][2]), max(p, out[-1][3]), max(alike, out[-1][4]))
        else:
            out.append((family, low, high, p, alike))
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def _whole_lines(paragraph: str, spots: list[re.Match], low: int, high: int) -> tuple[int, int]:
    """Start and end of the words; up to the ends of their lines where nothing else stands there."""
    start, end = spots[low].start(), spots[high - 1].end()
    line = paragraph.rfind("\n", 0, start) + 1
    start = line if low == 0 or spots[low - 1].end() <= line else start
    line = paragraph.find("\n", end)
    line = len(paragraph) if line < 0 else line
    end = line if high == len(spots) or spots[high].start() > line else end
    return start, end


@dataclass
class Model:
    families: list[str]
    place: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        rows = [self.place[g] for g in grams_of(words) if g in self.place]
        z = (self.bias + self.weights[:, rows].sum(axis=1) / max(1.0, len(rows) ** 0.5)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def _confirmed(self, family: str, words: list[str], notice: list[str]) -> float | None:
        """The family's probability if it is what the words name."""
        at = self.families.index(family)
        p = self.probabilities(words)
        if int(p.argmax()) != at or p[at] < MIN_PROBABILITY:
            # "under licence A or licence B" names B too: judge the notice's own words.
            blocks = SequenceMatcher(None, words, notice, autojunk=False).get_matching_blocks()
            own = [words[i] for b in blocks for i in range(b.a, b.a + b.size)]
            other = [words[i:j] for i, j in zip((b.a + b.size for b in blocks), (b.a for b in blocks[1:]))]
            if not any(_BETWEEN & set(run) for run in other):
                return None
            p = self.probabilities(own)
        return float(p[at]) if int(p.argmax()) == at and p[at] >= MIN_PROBABILITY else None

    def scanner(self):
        """text -> found notices (start, end, family, probability, similarity), offsets in characters."""
        notices = [(f, words_of(n)) for f in self.families if f != UNKNOWN for n in NOTICES[f]]
        wanted = [(f, n, set(zip(n, n[1:]))) for f, n in notices]
        pairs = set().union(*(p for _, _, p in wanted))

        def scan(text: str) -> list[tuple]:
            found, start = [], 0
            for end in [*(m.start() for m in _BLANK.finditer(text)), len(text)]:
                paragraph = text[start:end]
                spots = list(_WORD_OF_ANY_CASE.finditer(paragraph))
                words = [m.group().lower() for m in spots]
                # Without a pair of notice words in a row no notice can be similar.
                hits = [i for i, pair in enumerate(zip(words, words[1:])) if pair in pairs]
                if hits:
                    matches = []
                    for family, notice, own in wanted:
                        for low, high, alike in _windows(words, notice, [i for i in hits if (words[i], words[i + 1]) in own]):
                            p = self._confirmed(family, words[low:high], notice)
                            if p is not None:
                                matches.append((family, low, high, p, alike))
                    for family, low, high, p, alike in _merged(matches):
                        a, b = _whole_lines(paragraph, spots, low, high)
                        found.append((start + a, start + b, family, p, alike))
                start = end
            return found

        return scan


def _variations(rng: np.random.Generator, negatives: list[list[str]]) -> list[tuple[str, list[str]]]:
    """(family, words): notices with words dropped and with corpus words around them; scrambled ones are unknown."""
    filler = [w for n in negatives[:200] for w in n[:40]] or ["text"]
    rows = []
    for family, notices in NOTICES.items():
        for notice in map(words_of, notices):
            for _ in range(VARIATIONS // len(notices)):
                kept = [w for w in notice if rng.random() > 0.05]
                around = [[filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))] for _ in range(2)]
                rows.append((family, around[0] + kept + around[1]))
            for _ in range(10):
                mixed = [notice[i] for i in rng.permutation(len(notice))[: max(1, len(notice) // 2)]]
                rows.append((UNKNOWN, mixed + [filler[i] for i in rng.integers(0, len(filler), 6)]))
    return rows


def train(docs: DataFrame, sample: int = SAMPLE_PARAGRAPHS) -> Model:
    """Train on the notices and on up to ``sample`` paragraphs of as many documents."""
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    total = max(1, known.select("doc_id").count())
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    lines = F.split("text", "\n")
    # One paragraph of each chosen document, by the same hash.
    chosen = F.element_at(lines, (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.size(lines)) + 1).cast("int"))
    rows = known.where(place < sample / total).select("doc_id", F.substring(chosen, 1, 2000).alias("line"))
    notices = [words_of(n) for f in NOTICES.values() for n in f]
    negatives = [words_of(r["line"]) for r in rows.orderBy("doc_id").limit(sample).collect()]
    negatives = [w for w in negatives if max(similarity(w, n) for n in notices) < 0.5]
    rng = np.random.default_rng(11)
    data = _variations(rng, negatives) + [(UNKNOWN, w) for w in negatives]
    grams = sorted({g for n in notices for g in grams_of(n)})
    place_of = {g: i for i, g in enumerate(grams)}
    families = [UNKNOWN, *sorted(NOTICES)]

    def vector(words):
        found = sorted(place_of[g] for g in grams_of(words) if g in place_of)
        return Vectors.sparse(len(grams), found, [max(1, len(found)) ** -0.5] * len(found))

    held = rng.random(len(data)) < 0.2
    fitted = [(float(families.index(f)), vector(w)) for (f, w), h in zip(data, held) if not h]
    frame = spark.createDataFrame(fitted, ["label", "features"]).coalesce(2)
    lr = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, standardization=False).fit(frame)
    weights, bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    # Families that the split left out of training have no row of their own.
    families = families[: len(bias)]
    model = Model(families, place_of, weights, bias, 1.0)
    checked = [(families.index(f), w) for (f, w), h in zip(data, held) if h and f in families]

    def loss(temperature):
        model.temperature = temperature
        return -sum(np.log(model.probabilities(w)[i] + 1e-12) for i, w in checked)

    model.temperature = min(np.geomspace(0.1, 4, 16), key=loss)
    return model


_MATCH = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def scan(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``families`` (sorted, each once) and ``matches`` of the whole text.

    Paragraphs lie between blank lines.  A match takes in the rest of its first and last line if no other word stands
    there; overlapping matches of one family are one.  Null and empty texts have no match.
    """
    fields = [T.StructField("families", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(_MATCH))]

    def start():
        scanner = model.scanner()
        names = _MATCH.names

        def compute(texts):
            found = [scanner(t.decode("utf-8", "replace")) if t else [] for t in texts]
            return [[sorted({m[2] for m in f}) for f in found], [[dict(zip(names, m)) for m in f] for f in found]]

        return compute

    return map_text(docs, fields, start, keep=keep)
