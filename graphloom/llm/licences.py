"""Operator 10, licence scans with a trained paragraph classifier; scoring uses DataFrame expressions only.

A sparse logistic regression (L1) over the presence of word n-grams is trained from the templates below, other licence
talk, plain sentences, and cut or padded variants of all, the same in every session. Scores are calibrated on templates
held out of training, a third at a time. A paragraph is a run of lines with letters or digits, so a notice wrapped over
lines or set in comment marks is whole; it is scored in overlapping windows of its words. A window gets the family whose
calibrated probability is highest and at least one half, if a template of that family is contained in it: 0.8 or more of
its five-word shingles. A paragraph without such a window is ``unknown`` if one of its windows looks like a licence.

Not every window is scored, but every one that could matter: the gate is a set of words taken from the weights such that
a window without any of them cannot reach one half in any class (see :func:`gate`). The weight table is bounded by the
templates (some hundred n-grams) and broadcast; only sums of gated windows are shuffled, rows kept apart by a row number.

Defined results: null, empty and blank text has no paragraph; a line without an ASCII letter or digit ends a paragraph;
digits count as one number word; repeated documents give repeated rows with equal results; ties between families go to
the later name; a template of under five words must be there whole; an empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm.common import ascii_lower, spread, table

#: Public notices of each licence family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is licensed under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Released under MIT.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": (
        "All rights reserved. No part of this work may be reproduced without the prior written permission of the copyright holder.",
        "Copyright 2020. All rights reserved.",
        "All rights reserved.",
        "This document is confidential and proprietary and may not be copied or disclosed without written permission.",
    ),
}
#: Licence talk of no family, and plain talk.
OTHER_LICENCE = (
    "Licensed under terms to be announced.", "This file is licensed to you under a custom license agreement.", "Use of this software is governed by the license agreement of the vendor.",
    "Distributed under the terms of the license found in the root directory.", "See the license file for the license terms.", "The software comes without warranty of any kind.",
)
PLAIN = (
    "She passed her driving licence test in the spring.", "The version of the story that we heard was different.", "The general public was invited to the opening.", "We work under the terms of the old contract.",
    "He asked for permission to leave the room.", "All the people in the house had a copy of the book.", "The warranty of the car ran out last year.", "They released the new album under a false name.",
    "The foundation gave free meals to any person in need.", "Copyright law is taught in the second year.",
    "The source of the river lies in the hills, and its name is old.", "All the rights of the people were reserved for a later day.", "This project is free for children under ten.",
    "The software on my phone is slow, so I bought a new version.", "You may obtain a ticket at the door or use the one you have.", "The work was distributed among the students of the school.",
    "They shared the terms of the deal with the public and the press.", "A notice on the door said that the files were gone.", "The view from the general store is not what we expected.",
    "He published two books in binary and source code, without any limits or conditions.",
)
#: Words too common to tell anything on their own; an n-gram of them alone is no feature.
COMMON = frozenset("a an and any are as at be but by can do for from has have if in is it its may must no not of on one or shall so that the their these this to use was were will with you 0".split())
FAMILIES = tuple(TEMPLATES)
CLASSES = (*FAMILIES, "licence")
SHINGLE, CONTAINED, NGRAMS = 5, 0.8, 3
#: A paragraph is scored in windows of so many words, a step apart; templates have at most WINDOW - STEP words, so each notice lies whole in a window.
WINDOW, STEP = 48, 16
#: Templates are held out in so many parts, one at a time, to calibrate scores.
FOLDS = 3


def words_of(text: str) -> list[str]:
    """ASCII words in lower case, numbers as ``0``."""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in re.split(r"[^0-9a-z]+", re.sub(r"[0-9]+", "0", lower)) if w]


def grams(words: list[str], sizes: range) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def features(words: list[str]) -> set[str]:
    return {g for g in grams(words, range(1, NGRAMS + 1)) if not COMMON.issuperset(g.split())}


def samples(seed: int = 7) -> list[tuple[set[str], set[str], int]]:
    """(n-grams, classes, part) of templates, other licence talk and plain sentences, each whole, cut and padded with plain words; a text and its variants share a part."""
    rng, out = random.Random(seed), []
    filler = [w for s in PLAIN for w in words_of(s)]
    said = [(t, {f, "licence"}, k) for f, ts in TEMPLATES.items() for k, t in enumerate(ts)] + [(t, {"licence"}, k) for k, t in enumerate(OTHER_LICENCE)] + [(t, set(), k) for k, t in enumerate(PLAIN)]
    for text, classes, k in said:
        w = words_of(text)
        pad = [rng.choice(filler) for _ in range(12)]
        for variant in (w, [*pad[:6], *w], [*w, *pad[6:]], [*pad[:6], *w, *pad[6:]], w[: max(3, len(w) - 2)]):
            out.append((features(variant), classes, k % FOLDS))
    return out


def trained(x: np.ndarray, y: np.ndarray, shrink: float = 5e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-grams, classes) and biases of logistic regressions with an L1 penalty, by accelerated proximal gradient."""
    n, d = x.shape
    rate = 4 * n / (np.linalg.norm(x, 2) ** 2 + n)
    w, b = np.zeros((d, y.shape[1])), np.zeros(y.shape[1])
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y
        step = vw - rate * (x.T @ miss) / n
        nw, nb = np.sign(step) * np.maximum(np.abs(step) - rate * shrink, 0), vb - rate * miss.mean(axis=0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


_MODEL: dict[str, tuple] = {}
HELD_OUT: dict[str, tuple[int, int, int]] = {}


def model() -> dict[str, tuple]:
    """Per class: weights by n-gram, bias, slope and offset of the calibrated log-odds; made once a process.

    HELD_OUT then holds, per class, how many held-out samples of it there were, how many of them were found, and how many
    of other samples were taken for it.
    """
    if _MODEL:
        return _MODEL
    rows = samples()
    names = sorted({g for found, _, _ in rows for g in found})
    at = {g: k for k, g in enumerate(names)}
    x, y, part = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(CLASSES))), np.array([r[2] for r in rows])
    for i, (found, classes, _) in enumerate(rows):
        x[i, [at[g] for g in found]] = 1
        y[i] = [c in classes for c in CLASSES]
    held = np.zeros_like(y)
    for k in range(FOLDS):
        w, b = trained(x[part != k], y[part != k])
        held[part == k] = x[part == k] @ w + b
    w, b = trained(x, y)
    for c, name in enumerate(CLASSES):
        slope, offset = 1.0, 0.0
        for _ in range(2000):
            miss = y[:, c] - 1 / (1 + np.exp(-np.clip(slope * held[:, c] + offset, -30, 30)))
            slope, offset = max(0.1, slope + 0.05 * float((miss * held[:, c]).mean())), offset + 0.05 * float(miss.mean())
        said = slope * held[:, c] + offset >= 0
        HELD_OUT[name] = (int(y[:, c].sum()), int((said & (y[:, c] == 1)).sum()), int((said & (y[:, c] == 0)).sum()))
        weights = {g: round(float(v), 6) for g, v in zip(names, w[:, c]) if abs(v) >= 1e-6}
        _MODEL[name] = (weights, round(float(b[c]), 6), round(slope, 6), round(offset, 6))
    return _MODEL


def gate() -> list[str]:
    """Words such that, without any of them, no class reaches one half: what is left of its positive weights stays below what that takes."""
    chosen: set[str] = set()
    for weights, bias, slope, offset in model().values():
        need = -offset / slope - bias
        while True:
            rest = {g: v for g, v in weights.items() if v > 0 and chosen.isdisjoint(g.split())}
            if sum(rest.values()) < need:
                break
            if not rest:
                raise ValueError("a class that holds without any word needs no gate")
            gain: dict[str, float] = {}
            for g, v in rest.items():
                for word in set(g.split()) - COMMON:
                    gain[word] = gain.get(word, 0.0) + v
            chosen.add(max(sorted(gain), key=gain.__getitem__))
    return sorted(chosen)


def template_shingles() -> list[tuple[str, int, str]]:
    """(family, template number, shingle); a template under five words is one shingle."""
    out = []
    for k, (family, text) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts):
        w = words_of(text)
        out += ((family, k, s) for s in sorted(grams(w, range(min(SHINGLE, len(w)), min(SHINGLE, len(w)) + 1))))
    return out


def gram_table(spark: SparkSession) -> DataFrame:
    """gram, w (weight per class), t (numbers of templates that have it as a shingle)."""
    made, shingles = model(), template_shingles()
    by: dict[str, list[int]] = {}
    for _, k, s in shingles:
        by.setdefault(s, []).append(k)
    every = sorted({*by, *(g for c in CLASSES for g in made[c][0])})
    return spark.createDataFrame([(g, [made[c][0].get(g, 0.0) for c in CLASSES], by.get(g, [])) for g in every], "gram string, w array<double>, t array<int>")


def paragraphs(text: Column) -> Column:
    """Runs of lines that have an ASCII letter or digit, in lower case, numbers as ``0``."""
    lower = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    blank = F.regexp_replace(F.concat(F.lit("\n"), lower, F.lit("\n")), "\n[^0a-z\n]+(?=\n)", "\n")
    return F.split(blank, "\n\n+")


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, h, par, families, p): paragraphs that are licence text; families is empty where none is confirmed. row tells repeated rows apart."""
    spark, made, shingles = docs.sparkSession, model(), template_shingles()
    sizes = sorted({*range(1, NGRAMS + 1), *(len(s.split()) for _, _, s in shingles)})
    words = gate()
    some = r"(?<![0-9a-z])(?:" + "|".join(words) + ")(?![0-9a-z])"
    # The row number is taken before paragraphs are exploded; beside the explode it would count paragraphs.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("t"))
    base = rows.select("row", "id", F.xxhash64("t").alias("h"), F.posexplode(paragraphs(F.col("t"))).alias("par", "said"))
    asked = base.filter(F.col("said").rlike(some)).select("row", "id", "h", "par", F.filter(F.split("said", "[^0-9a-z]+"), lambda x: x != "").alias("ws"))
    last = f"cast(ceil(greatest(size(ws) - {WINDOW}, 0) / {STEP}) * {STEP} as int)"
    wins = F.filter(F.expr(f"transform(sequence(0, {last}, {STEP}), i -> slice(ws, i + 1, {WINDOW}))"), lambda w: F.arrays_overlap(w, F.array(*map(F.lit, words))))
    windows = asked.select("row", "id", "h", "par", F.posexplode(wins).alias("win", "ws"))
    each = [
        F.expr(f"if(size(ws) >= {n}, transform(sequence(1, size(ws) - {n - 1}), i -> concat_ws(' ', slice(ws, i, {n}))), cast(array() as array<string>))") for n in sizes
    ]
    keys = ["row", "id", "h", "par"]
    found = windows.select(*keys, "win", F.explode(F.array_distinct(F.concat(*each))).alias("gram")).join(F.broadcast(gram_table(spark)), "gram")
    sums = found.groupBy(*keys, "win").agg(
        *(F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(CLASSES))), F.flatten(F.collect_list("t")).alias("t")
    )

    def p(k: int) -> Column:
        _, bias, a, b = made[CLASSES[k]]
        return 1 / (1 + F.exp(-(F.lit(a) * (F.col(f"z{k}") + F.lit(bias)) + F.lit(b))))

    need: dict[int, tuple[str, int]] = {}
    for family, k, _ in shingles:
        need[k] = (family, need.get(k, ("", 0))[1] + 1)

    def confirmed(family: str) -> Column:
        tests = [F.size(F.filter("t", lambda x: x == k)) >= math.ceil(CONTAINED * n) for k, (f, n) in need.items() if f == family]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    best = F.array_max(F.array(*(F.struct((F.when(confirmed(f), p(k)).otherwise(F.lit(0.0))).alias("p"), F.lit(f).alias("family")) for k, f in enumerate(FAMILIES))))
    scored = sums.select(*keys, best.alias("best"), p(len(FAMILIES)).alias("any")).filter((F.col("best.p") >= 0.5) | (F.col("any") >= 0.5))
    family = F.when(F.col("best.p") >= 0.5, F.col("best.family"))
    return scored.groupBy(*keys).agg(F.array_sort(F.collect_set(family)).alias("families"), F.max(F.greatest("best.p", "any")).alias("p"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_paragraphs, n_licence (paragraphs with a family), n_unknown (licence talk without one), families (sorted, comma-joined)."""
    known = (F.size("families") > 0).cast("long")
    marked = licence_paragraphs(docs, id_col, text).groupBy("row", F.col("id").alias("hit_id"), F.col("h").alias("hit_h")).agg(
        F.sum(known).alias("n_licence"), F.sum(1 - known).alias("n_unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families")
    )
    marked = marked.drop("row").dropDuplicates(["hit_id", "hit_h"])
    n = F.size(F.filter(paragraphs(F.col(text)), lambda x: x.rlike("[0a-z]")))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), n.cast("long").alias("n_paragraphs"))
    both = base.join(spread(marked), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    zero = F.lit(0).cast("long")
    return both.select(F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
