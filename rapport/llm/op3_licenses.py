"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph (a line with a word) is a sparse vector of hashed word n-grams (one to three words, in lower case, punctuation
off). A multinomial logistic regression tells licence families from each other and from ``unknown``. It is trained here, on
the driver, on a bounded set: the templates below in many disturbed forms (words dropped, foreign words around them), and
``NEGATIVES`` paragraphs of the documents that resemble no template. ``unknown`` is calibrated on a part that training did
not see: probabilities are tempered to fit it, and a family counts only from the probability that at most ``FALSE_RATE`` of
the unseen negatives reach. What the classifier finds is compared with the family's templates; a paragraph that holds less
than ``CONFIRM`` of the word pairs of every one of them is not confirmed.

Notices that lines break or that stand within longer lines are read in windows: wherever as many word pairs of a template
as it takes to confirm it lie within about its length, whatever line ends are between, that stretch is judged like a
paragraph. A stretch that meets a confirmed line, or one more alike or as alike and shorter, is not given again.

Paragraphs of all whole texts are judged, in numpy over Arrow batches; nothing but the training set is sampled.

Defined results: null or empty texts have no paragraphs and no licence; a document's licence is that of its most probable
confirmed paragraph (ties: the first); null ids and repeated rows are judged like others; without any document to take
negatives from, training uses the templates' foreign words alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm import texts as X
from rapport.llm.shared import col, table

FEATURES = 1 << 16
NEGATIVES, FORMS, FALSE_RATE, CONFIRM = 2_000, 16, 0.001, 0.6
ROUNDS, RATE, DECAY = 150, 8.0, 1e-5

#: Notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause license.", "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-2.0", "under the GPLv3", "under the GPLv2"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later", "under the LGPLv3", "under the LGPLv2.1"],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "under the AGPLv3"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "public-domain": [
        "This work has been released into the public domain.", "This is free and unencumbered software released into the public domain.",
        "CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense"],
    "all-rights-reserved": ["Copyright. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_PLAIN[ord("0"):ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_PLAIN[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[0x0A] = 0x0A
_M = np.uint64(0xD6E8FEB86659FD93)


def features(rows: X.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every line with a word; and (feature, line) of its n-grams."""
    begin, end, row = X.lines(rows)
    data = _PLAIN[rows.data]
    from_, to, _ = X.words(X.Rows(rows.first, data, rows.begin, rows.end))
    line = np.searchsorted(begin, from_, "right") - 1
    filled = np.unique(line)
    line = np.searchsorted(filled, line)
    word = X.hashes(data, from_, to)
    found, owner = [word], [line]
    gram = word
    for k in (1, 2):
        gram = gram[:-1] * _M + word[k:]
        same = line[k:] == line[:len(line) - k] if len(line) > k else np.zeros(0, bool)
        gram_k = gram[:len(same)]
        found.append(X.mixed(gram_k[same]))
        owner.append(line[:len(same)][same])
    at = (np.concatenate(found) % np.uint64(FEATURES)).astype(np.int64)
    return begin[filled], end[filled], row[filled], at, np.concatenate(owner)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def pairs(words: list[str]) -> set:
    return set(zip(words, words[1:])) or set(words)


@lru_cache(maxsize=1)
def template_pairs() -> dict[str, list[set]]:
    return {family: [pairs(words_of(t)) for t in forms] for family, forms in TEMPLATES.items()}


def likeness(paragraph: str, family: str) -> float:
    """Largest part of one of the family's templates whose word pairs the paragraph holds."""
    own = pairs(words_of(paragraph))
    return max(len(own & form) / len(form) for form in template_pairs()[family])


def meets(taken: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether a stretch overlaps one of these, which are in order and apart."""
    k = bisect_left(taken, (end,))
    return k > 0 and taken[k - 1][1] > begin


def word_places(rows: X.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every word, and a hash of each with the word after it."""
    data = _PLAIN[rows.data]
    begin, end, row = X.words(X.Rows(rows.first, data, rows.begin, rows.end))
    word = X.hashes(data, begin, end)
    return begin, end, row, word[:-1] * _M + word[1:]


@lru_cache(maxsize=1)
def template_places() -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int, int, int]]]:
    """Hashes of all templates' word pairs, a filter by their first 16 bits, and for each template: which hashes are its
    own, how many confirm it, the words in which they must lie, and its own number of words."""
    own, forms = [], [form for forms in TEMPLATES.values() for form in forms]
    for form in forms:
        own.append(np.unique(word_places(next(X.slices(pa.array([form]))))[3]))
    known = np.unique(np.concatenate(own))
    first = np.zeros(1 << 16, bool)
    first[known >> np.uint64(48)] = True
    return known, first, [(np.isin(known, pair), int(np.ceil(CONFIRM * len(pairs(words_of(form))))), len(words_of(form)) * 5 // 4 + 2,
                           len(words_of(form)))
                          for form, pair in zip(forms, own)]


def windows(rows: X.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every stretch that may hold a template."""
    begin, end, row, pair = word_places(rows)
    known, first, templates = template_places()
    at = np.flatnonzero(first[pair >> np.uint64(48)])
    at = at[row[at] == row[at + 1]]
    which = np.minimum(np.searchsorted(known, pair[at]), len(known) - 1)
    hit = known[which] == pair[at]
    at, which = at[hit], which[hit]
    found = []
    for own, least, width, exact in templates:
        place = at[own[which]]
        from_, to = place[:max(len(place) - least + 1, 0)], place[least - 1:]
        from_ = from_[(to - from_ < width - 1) & (row[from_] == row[to])]
        for upto in (width, exact):
            last = np.minimum(from_ + upto, np.searchsorted(row, row[from_], "right")) - 1
            found.append(np.stack([from_, last], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return begin[found[:, 0]], end[found[:, 1]], row[found[:, 0]]


def counts(paragraphs: list[str]):
    """Normalised sparse features: (feature, row, value)."""
    flat = [p.replace("\n", " ") for p in paragraphs]
    rows = next(X.slices(pa.array(flat), 1 << 62))
    _, _, row, at, line = features(rows)
    many = np.bincount(line, minlength=len(row))
    return at, row[line], 1 / np.sqrt(many[line])


class Classifier:
    """Weights, temperature and the least probability of a family."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.5):
        self.weights, self.bias, self.temperature, self.least = weights, bias, temperature, least

    def logits(self, at: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
        many = np.maximum(np.bincount(line, minlength=lines), 1)
        total = np.stack([np.bincount(line, self.weights[at, c], lines) for c in range(UNKNOWN + 1)], axis=1)
        return total / np.sqrt(many)[:, None] + self.bias


def probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def disturbed(foreign: list[str], forms: int, rng) -> tuple[list[str], list[int]]:
    """Templates with words dropped and foreign words around them."""
    out, label = [], []
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = template.split()
            for k in range(forms):
                kept = [w for w in words if k == 0 or len(words) < 5 or rng.random() > 0.1]
                around = [foreign[i] for i in rng.integers(0, len(foreign), int(rng.integers(0, 4)) if k else 0)]
                cut = int(rng.integers(0, len(around) + 1))
                out.append(" ".join([*around[:cut], *kept, *around[cut:]]))
                label.append(FAMILIES.index(family))
    return out, label


def trained(negatives: list[str], forms: int = FORMS) -> Classifier:
    """Fit by gradient descent on four fifths, calibrate on the rest."""
    rng = np.random.default_rng(7)
    foreign = sorted({w for p in negatives[:500] for w in p.split()}) or ["the", "and", "text"]
    texts, label = disturbed(foreign, forms, rng)
    pieces = [" ".join(foreign[i] for i in rng.integers(0, len(foreign), int(n))) for n in rng.integers(1, 30, 200)]
    unknown = [*negatives, *pieces, "license", "the license", "version 2.0", "software", "copyright", "all of the rights"]
    texts, label = texts + unknown, np.array(label + [UNKNOWN] * len(unknown))
    held = rng.random(len(texts)) < 0.2
    at, row, value = counts(texts)
    lines, classes = len(texts), UNKNOWN + 1
    balance = (1 / np.bincount(label, minlength=classes))[label] * ~held
    balance /= balance.sum()
    used, at_ = np.unique(at, return_inverse=True)
    weights, bias = np.zeros((len(used), classes)), np.zeros(classes)
    goal = np.eye(classes)[label]

    def logits():
        return np.stack([np.bincount(row, weights[at_, c] * value, lines) for c in range(classes)], axis=1) + bias

    speed = np.zeros_like(weights)
    for _ in range(ROUNDS):
        error = (probabilities(logits(), 1.0) - goal) * balance[:, None]
        slope = np.stack([np.bincount(at_, error[row, c] * value, len(used)) for c in range(classes)], axis=1) + DECAY * weights
        speed = 0.9 * speed - RATE * slope
        weights += speed
        bias -= RATE * error.sum(axis=0)
    z = logits()[held]
    loss = lambda t: -np.log(probabilities(z, t)[np.arange(len(z)), label[held]] + 1e-12).mean()
    temperature = min(np.geomspace(0.1, 10, 41), key=loss) if len(z) else 1.0
    clean = probabilities(z[label[held] == UNKNOWN], temperature)[:, :UNKNOWN].max(axis=1)
    least = max(0.5, float(np.quantile(clean, 1 - FALSE_RATE))) if len(clean) else 0.5
    full = np.zeros((FEATURES, classes))
    full[used] = weights
    return Classifier(full.astype(np.float32), bias, float(temperature), min(least, 0.99))


def sample(docs: DataFrame, key: str, text: str, most: int = NEGATIVES) -> list[str]:
    """Paragraphs of the documents with the smallest hashes of their ids, without any that resembles a template."""
    chosen = docs.where(col(text).isNotNull()).select(F.xxhash64(col(key)).alias("h"), col(key).alias("id")).orderBy("h", "id").limit(most // 8)
    lines = docs.join(F.broadcast(chosen.distinct()), col(key) == F.col("id")).select(
        F.explode(F.split(col(text), "\n")).alias("line")).where(F.length("line").between(1, 2000))
    found = [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(most).collect()]
    return [p for p in found if p.strip() and max(likeness(p, family) for family in FAMILIES) < 0.5]


def scanner(spark, model: Classifier):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n_paragraphs:bigint,found:array<struct<paragraph:bigint,family:string,probability:double,likeness:double>>>")
    def scan(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in column:
            many, found = [], []
            for rows in X.slices(batch):
                begin, end, row, at, line = features(rows)
                n = len(rows.begin)
                many.append(X.per_row(row, n))
                first = np.concatenate([[0], np.cumsum(many[-1])])
                here: list[list] = [[] for _ in range(n)]
                taken: list[list] = [[] for _ in range(n)]

                def judge(text, places, at, line):
                    """Paragraphs (begin, end, text) with their features: those confirmed."""
                    chance = probabilities(own.logits(at, line, len(places)), own.temperature)
                    best = chance[:, :UNKNOWN].argmax(axis=1)
                    sure = chance[np.arange(len(places)), best]
                    likely = np.flatnonzero((chance.argmax(axis=1) != UNKNOWN) & (sure >= own.least))
                    like_of = {i: likeness(text(i), FAMILIES[best[i]]) for i in likely.tolist()}
                    for i, like in sorted(like_of.items(), key=lambda x: (-x[1], places[x[0]][1] - places[x[0]][0], -sure[x[0]], places[x[0]])):
                        a, b, r = places[i]
                        family = FAMILIES[best[i]]
                        if like >= CONFIRM and not meets(taken[r], a, b):
                            insort(taken[r], (a, b))
                            here[r].append((a, {"paragraph": int(np.searchsorted(begin, a, "right") - 1 - first[r]), "family": family,
                                                "probability": round(float(sure[i]), 6), "likeness": round(like, 6)}))

                if len(row):
                    judge(lambda i: rows.data[begin[i]:end[i]].tobytes().decode(),
                          list(zip(begin.tolist(), end.tolist(), row.tolist())), at, line)
                    places = [(a, b, r) for a, b, r in zip(*(v.tolist() for v in windows(rows)))
                              if not meets(taken[r], a, b)]
                    texts = [rows.data[a:b].tobytes().decode() for a, b, _ in places]
                    if texts:
                        at, line, _ = counts(texts)
                        judge(texts.__getitem__, places, at, line)
                here = [[f for _, f in sorted(own_, key=lambda x: x[0])] for own_ in here]
                found += here
            kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]))
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(many) if many else np.zeros(0, np.int64)), pa.array(found, kind)], ["n_paragraphs", "found"])

    return scan


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "licences", model: Classifier | None = None) -> DataFrame:
    """``docs`` with the struct ``into``: n_paragraphs, and every confirmed paragraph with family, probability, likeness."""
    model = model or trained(sample(docs, key, text))
    return docs.withColumn(into, scanner(docs.sparkSession, model)(col(text)))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    docs = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licences.n_paragraphs", "licences.found")
    best = F.when(F.size("found") > 0, F.reduce(F.slice("found", 2, 1 << 30), F.get("found", F.lit(0)), lambda a, b: F.when(
        b["probability"] > a["probability"], b).otherwise(a)))
    return docs.select("doc_id", "n_paragraphs", F.size("found").cast("bigint").alias("n_licence_paragraphs"),
                       best["family"].alias("licence"), best["probability"].alias("probability"), "found")
