"""License scan (operator 1), with DataFrame functions alone on the data path.

A paragraph is what blank lines (lines without a letter or digit, as of comment marks alone) set apart.
It is cut into segments at line ends, sentence and clause ends and words that open a notice; what is
scored are sliding groups of segments that lie side by side, of up to ``GROUP_WORDS`` words (twice the longest
template), so a notice may be wrapped over any number of lines and a line may hold several notices. A sparse multinomial logistic regression over
word 1- and 2-grams names a group's licence family or ``none``; it is trained here, on the driver, from
the notices below and their variations, a fixed amount of text that does not depend on the data. The
confidence is calibrated by a temperature fitted on variations that training did not see, and a template
of the family must confirm it. A notice is a smallest confirmed group; of rivals, families whose notices
hold each other's words, the one with the larger overlap stays where groups lie in each other.

``unknown`` is a class with a model of its own, which tells lines about licensing from others: a logistic regression over the
same n-grams, trained on notices of listed and unlisted licences against prose that has their words. Its threshold is the
one that one in a hundred of the calibration lines without a licence passes, at least a half. A line of that class outside of all confirmed notices is ``unknown``.

Scoring is a lookup of a group's n-grams in the model's vocabulary inside the row: there is no
shuffle, so keys and sources of any frequency cost the same.

Defined results: null and empty texts have no licence; a null doc_id stays null; repeated rows each get
a row; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices of the licence families as their texts ask them to be written.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT license.", "SPDX-License-Identifier: MIT", "License: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "License: Apache 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL version 2.", "Released under the GPL v3 license.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the LGPL version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL v3 license."],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 2-Clause license.", "License: BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Released into the public domain under the CC0 license."],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Proprietary": ["All rights reserved.", "Copyright 2021 Example Corporation. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
# Words that alone say nothing about a licence.
COMMON = set("a an and any are as at be by can for from have if in into is it its may not of on or that the their this to under was were will with without you your v version work file use copy free public terms conditions following person charge".split())
COMMON |= set("der die das und mit von den le la les de des du et un une que el los las por para con".split())
# Families whose notices hold the words of each other's.
RIVALS = [["AGPL", "GPL", "LGPL"], ["CC-BY", "CC-BY-NC", "CC-BY-SA"]]
NONE, UNKNOWN = "none", "unknown"
BLANK = r"(?>\r\n|[\r\n])[^\p{L}\p{N}]*[\r\n]"
SEGMENT = r"(?<=[.;:!?,])\s+|\s+(?=(?i:and|or|licen[sc]ed|released|distributed|dedicated|permission|redistribution|spdx|this)\b)|/(?=[A-Z])"
#: Words of a group; template n-grams that a group of over LOOSE_WORDS words must hold all of.
GROUP_WORDS, SMALL_TEMPLATE, LOOSE_WORDS = 100, 5, 12
# Notices of licences that have no family here, for the class ``unknown``.
UNLISTED = [
    "Licensed under the Eclipse Public License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Artistic License 2.0.", "This software is provided 'as-is', without any express or implied warranty.", "This is free and unencumbered software released into the public domain.",
    "Licensed under the European Union Public Licence.", "Released under the Microsoft Public License.", "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "See the LICENSE file for licensing terms.", "Subject to the terms of the license agreement.", "Licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: Zlib", "License: custom",
    "All use of this material requires a written license from the owner.", "Licensed under the Python Software Foundation License Version 2.", "This code is distributed under a commercial license.",
    "You may redistribute this software under the terms below.", "Copyright by the authors, distributed under their own license.", "In no event will the authors be held liable for any damages arising from the use of this software.",
]
# Prose with words of notices in other uses.
OTHER_USES = [
    "he lost his driving licence last year", "the copyright debate went on in parliament", "they licensed a song for the film", "permission to enter the building was granted at noon", "public transport is free on sundays",
    "the license plate of the car was new", "a general asked the public for permission", "the software crashed and the file was lost", "version two of the plan was released in may", "she distributed copies of the letter",
    "the terms of the peace were hard", "apache is the name of a people and of a helicopter", "creative work needs common sense", "the source of the river is in the hills", "a fishing licence costs ten euros", "rights of the people are reserved in the constitution",
    "mozilla was founded in 1998", "the agreement was signed under pressure", "liable to change without notice", "the warranty of the fridge has ended",
]


@dataclass(frozen=True)
class Model:
    families: list[str]  # without ``none``, which is the last class
    vocabulary: list[str]
    words: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


#: Words that variations put around a notice.
AROUND = "project code see file text here data note page more info author copyright 2019 2022 our we all rights".split()


def tokens(s: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def _variations(notice: str, rng: random.Random, n: int) -> list[str]:
    """The notice with words put around it and, in longer ones, a word dropped."""
    out = [notice]
    for _ in range(n):
        w = notice.split()
        if len(w) > 7 and rng.random() < 0.5:
            w.pop(rng.randrange(len(w)))
        out.append(" ".join([*rng.sample(AROUND, rng.randrange(3)), *w, *rng.sample(AROUND, rng.randrange(3))]))
    return out


def _others(rng: random.Random) -> list[str]:
    """Paragraphs of class ``none``: common words, and words of notices in other uses."""
    common = sorted(COMMON)
    prose = "mit permission version apache general public creative commons source binary isc bsd attribution mozilla software copy".split()
    some = [" ".join(rng.choices(common, k=rng.randrange(3, 20))) for _ in range(150)]
    some += [" ".join([*rng.choices(common, k=rng.randrange(2, 9)), w, *rng.choices(common, k=rng.randrange(2, 9))]) for w in prose for _ in range(6)]
    made = ["Foo", "Acme", "Zeta", "Northwind", "Open Data", "Community", "Custom"]
    return some + [f"{p} the {x} {l}." for x in made for p in ("Licensed under", "Released under", "Subject to") for l in ("License", "license agreement")]


@lru_cache(1)
def model() -> Model:
    rng = random.Random(11)
    families = sorted(NOTICES)
    train, held = [], []
    for k, f in enumerate(families):
        for notice in NOTICES[f]:
            v = [(x, k) for x in _variations(notice, rng, 12)]
            train += v[:9]
            held += v[9:]
    none = [(x, len(families)) for x in _others(rng)]
    train, held = train + none[::2] + none[1::4], held + none[3::4]
    words = sorted({w for x, k in train if k < len(families) for w in tokens(x)} - COMMON)
    keep = set(words)
    vocabulary = sorted({g for x, k in train if k < len(families) for g in grams(tokens(x)) if any(w in keep for w in g.split())})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)))
        for r, (text, _) in enumerate(rows):
            x[r, [at[g] for g in grams(tokens(text)) if g in at]] = 1
        return x, np.array([k for _, k in rows])

    x, y = matrix(train)
    n = len(families) + 1
    w, b, target = np.zeros((len(vocabulary), n)), np.zeros(n), np.eye(n)[y]
    for _ in range(400):
        p = _softmax(x @ w + b)
        w -= 2.0 * (x.T @ (p - target) / len(x) + 1e-4 * w)
        b -= 2.0 * (p - target).mean(0)
    hx, hy = matrix(held)
    logits = hx @ w + b
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(hy)), hy] + 1e-12).mean()
    return Model(families, vocabulary, words, w.round(6), b.round(6), min(np.arange(0.3, 3.01, 0.1), key=loss))


@dataclass(frozen=True)
class Licensing:
    """The model of lines about licensing: the score of a line is the bias and the weights of its n-grams; ``least`` is the score from which it counts.

    Only lines with one of the strongest ``words`` are scored; others have too little weight to count.
    """

    vocabulary: list[str]
    words: list[str]
    weights: list[float]
    bias: float
    least: float


@lru_cache(1)
def licensing() -> Licensing:
    rng = random.Random(5)
    about = [x for notices in NOTICES.values() for t in notices for x in _variations(t, rng, 4)] + [x for t in UNLISTED for x in _variations(t, rng, 9)]
    made = ["Foo", "Acme", "Zeta", "Northwind", "Open Data", "Community", "Custom"]
    about += [f"{p} the {x} {l}." for x in made for p in ("Licensed under", "Released under", "Subject to") for l in ("License", "license agreement")]
    other = [x for t in OTHER_USES for x in _variations(t, rng, 14)]
    words = sorted({w for x in about for w in tokens(x)} - COMMON)
    other += [" ".join([*rng.choices(sorted(COMMON), k=rng.randrange(2, 9)), *rng.sample(words, 1), *rng.choices(sorted(COMMON), k=rng.randrange(2, 9))]) for _ in range(400)]
    rng.shuffle(about)
    rng.shuffle(other)
    rows = [(x, 1.0) for x in about[::4] + about[1::4] + about[2::4]] + [(x, 0.0) for x in other[::2]]
    vocabulary = sorted({g for x, _ in rows for g in grams(tokens(x)) if any(w not in COMMON for w in g.split())})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(vocabulary)))
        for r, text in enumerate(texts):
            x[r, [at[g] for g in grams(tokens(text)) if g in at]] = 1
        return x

    x, y = matrix([t for t, _ in rows]), np.array([k for _, k in rows])
    w, b = np.zeros(len(vocabulary)), 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 2.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)
        b -= 2.0 * (p - y).mean()
    least = max(0.0, float(np.quantile(matrix(other[1::2]) @ w + b, 0.99)))
    kept = [i for i in range(len(vocabulary)) if abs(w[i]) >= 0.05]
    strong = [g for g, v in zip(vocabulary, w) if v >= 0.5 and g.isalpha() and (g not in AROUND or g == "copyright")]
    return Licensing([vocabulary[i] for i in kept], strong, [round(float(w[i]), 6) for i in kept], round(float(b), 6), round(least, 6))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _strings(values: list[str]) -> Column:
    return F.lit(values).cast("array<string>")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


FOUND = "array<struct<family:string,probability:double>>"
NOTICE = "array<struct<family:string,probability:double,overlap:double,a:int,b:int,first:int,last:int>>"


def _notices(lines: Column, m: Model, least: float, confirm: float) -> Column:
    """Notices of a paragraph as NOTICE: a and b are the first and last segment, first and last their lines."""
    n = len(m.families) + 1
    vocabulary, cues = _strings(m.vocabulary), _strings(m.words)
    rows = F.lit([[float(v) for v in r] for r in m.weights])
    by_family = [[sorted(grams(tokens(t))) for t in NOTICES[f]] for f in m.families]
    templates = F.lit(by_family).cast("array<array<array<string>>>")
    flat = F.lit([t for f in by_family for t in f]).cast("array<array<string>>")
    known = _strings(sorted({g for f in by_family for t in f for g in t} | set(m.vocabulary)))
    rival = F.lit([next((k for k, r in enumerate(RIVALS) if f in r), -1 - i) for i, f in enumerate(m.families)])
    family = _strings(m.families)
    none = F.lit([]).cast(NOTICE)

    def overlap(found: Column, size: Column, t: Column) -> Column:
        o = F.size(F.array_intersect(t, found)) / F.size(t)
        return F.when((o < 1) & (F.size(t) <= SMALL_TEMPLATE) & (size > LOOSE_WORDS), F.lit(0.0)).otherwise(o)

    def of_segments(segments: Column) -> Column:
        return _let(F.array_intersect(_grams(F.flatten(F.transform(segments, lambda s: s["words"]))), known), lambda mine: of_grams(segments, mine))

    def of_grams(segments: Column, mine: Column) -> Column:
        # No group overlaps a template more than the paragraph does.
        live = F.filter(flat, lambda t: F.size(F.array_intersect(t, mine)) >= confirm * F.size(t))
        return _let(live, lambda live: F.when(F.size(live) > 0, smallest(groups(segments, mine, live))).otherwise(none))

    def groups(segments: Column, mine: Column, live: Column) -> Column:
        def begun(s: Column, a: Column) -> Column:
            # Each segment has a word, so no more of them can be in a group.
            def grown(state: Column, x: Column) -> Column:
                words, b = state["words"] + F.size(x["words"]), state["b"] + 1
                fits = (words <= GROUP_WORDS) | (b == a)
                return F.struct(words.alias("words"), b.alias("b"), F.when(fits & x["cue"], F.concat(state["ends"], F.array(b))).otherwise(state["ends"]).alias("ends"))

            ends = F.aggregate(F.slice(segments, a + 1, GROUP_WORDS), F.struct(F.lit(0).alias("words"), (a - 1).alias("b"), F.lit([]).cast("array<int>").alias("ends")), grown, lambda state: state["ends"])
            return F.when(s["cue"], F.filter(F.transform(ends, lambda b: judge(segments, mine, live, a, b)), lambda g: g["family"].isNotNull())).otherwise(none)

        return F.flatten(F.transform(segments, begun))

    def judge(segments: Column, mine: Column, live: Column, a: Column, b: Column) -> Column:
        words = F.flatten(F.transform(F.slice(segments, a + 1, b - a + 1), lambda s: s["words"]))
        first, last = F.get(segments, a)["line"], F.get(segments, b)["line"]

        def of_words(w: Column) -> Column:
            return _let(F.array_intersect(_grams(w), mine), lambda found: of_found(found, F.size(w)))

        def of_found(found: Column, size: Column) -> Column:
            # Only a group that some template confirms is scored.
            return F.when(F.exists(live, lambda t: overlap(found, size, t) >= confirm), _let(logits(found), lambda z: verdict(found, size, z)))

        def verdict(found: Column, size: Column, z: Column) -> Column:
            top = F.array_max(z)
            best = (F.array_position(z, top) - 1).cast("int")
            p = 1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / m.temperature))
            o = F.coalesce(F.array_max(F.transform(F.get(templates, best), lambda t: overlap(found, size, t))), F.lit(0.0))
            name = F.when((best < n - 1) & (p >= least) & (o >= confirm), F.get(family, best))
            return F.struct(name.alias("family"), p.alias("probability"), o.alias("overlap"), a.alias("a"), b.alias("b"), first.alias("first"), last.alias("last"))

        return _let(words, of_words)

    def logits(found: Column) -> Column:
        return F.aggregate(
            F.array_intersect(found, vocabulary), F.lit([float(v) for v in m.bias]), lambda acc, g: F.zip_with(acc, F.get(rows, F.array_position(vocabulary, g).cast("int") - 1), lambda a, b: a + b)
        )

    def inside(x: Column, y: Column) -> Column:
        return (y["a"] <= x["a"]) & (x["b"] <= y["b"])

    def kind(g: Column) -> Column:
        return F.get(rival, F.array_position(family, g["family"]).cast("int") - 1)

    def smallest(found: Column) -> Column:
        return _let(found, lambda all_: _let(F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["family"] == x["family"]) & inside(y, x) & ~inside(x, y))), strongest))

    def strongest(found: Column) -> Column:
        def beaten(x: Column, y: Column) -> Column:
            other = (y["family"] != x["family"]) & (kind(y) == kind(x)) & (inside(x, y) | inside(y, x))
            return other & ((y["overlap"] > x["overlap"]) | ((y["overlap"] == x["overlap"]) & inside(x, y)))

        return F.filter(found, lambda x: ~F.exists(found, lambda y: beaten(x, y)))

    def cut(line: Column, i: Column) -> Column:
        return F.transform(F.split(line, SEGMENT), lambda s: _let(_words(s), lambda w: F.struct(i.alias("line"), w.alias("words"), F.arrays_overlap(w, cues).alias("cue"))))

    return _let(F.filter(F.flatten(F.transform(lines, cut)), lambda s: F.size(s["words"]) > 0), of_segments)


def _judged(paragraph: Column, m: Model, least: float, confirm: float) -> Column:
    """FOUND of one paragraph: its notices, then its unknown lines."""

    known = licensing()
    vocabulary, weights = _strings(known.vocabulary), F.lit(known.weights)

    def about(line: Column) -> Column:
        return _let(_words(line), lambda w: F.when(F.arrays_overlap(w, _strings(known.words)), score(w) >= known.least).otherwise(F.lit(False)))

    def score(words: Column) -> Column:
        found = F.array_intersect(_grams(words), vocabulary)
        return F.aggregate(found, F.lit(known.bias), lambda acc, g: acc + F.get(weights, F.array_position(vocabulary, g).cast("int") - 1))

    def all_of(lines: Column, notices: Column) -> Column:
        # Groups of one family that share segments are one notice.
        once = F.filter(notices, lambda x: ~F.exists(notices, lambda y: (y["family"] == x["family"]) & (y["a"] < x["a"]) & (y["b"] >= x["a"])))
        outside = F.filter(lines, lambda x, i: ~F.exists(notices, lambda g: (g["first"] <= i) & (i <= g["last"])) & about(x))
        unknown = F.transform(outside, lambda _: F.struct(F.lit(UNKNOWN).alias("family"), F.lit(None).cast("double").alias("probability")))
        return F.concat(F.transform(once, lambda g: F.struct(g["family"].alias("family"), g["probability"].alias("probability"))), unknown)

    return _let(F.split(paragraph, r"[\r\n]+"), lambda lines: _let(_notices(lines, m, least, confirm), lambda found: all_of(lines, found)))


def license_scan(docs: DataFrame, least_probability: float = 0.6, least_overlap: float = 0.6) -> DataFrame:
    """doc_id, licenses, n_paragraphs, n_unknown, least_probability: one row per document.

    licenses: confirmed families, sorted and comma-joined, null without one. n_paragraphs: confirmed
    notices. n_unknown: lines about licensing outside of them. probability: the highest of a notice.
    """
    m = model()
    text = F.coalesce(F.col("text"), F.lit(""))
    cues = _strings(sorted({*m.words, *licensing().words}))
    # A paragraph without a word of the vocabularies has no feature and so is ``none``: only others are scored.
    has_cue = F.arrays_overlap(_words(text), cues)
    paragraphs = F.filter(F.split(text, BLANK), lambda x: F.arrays_overlap(_words(x), cues))
    found = F.flatten(F.transform(paragraphs, lambda x: _judged(x, m, least_probability, least_overlap)))
    empty = F.lit([]).cast(FOUND)
    out = docs.select("doc_id", F.when(has_cue, found).otherwise(empty).alias("found"))
    known = F.filter("found", lambda s: s["family"] != UNKNOWN)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda s: s["family"]))), ",")
    return out.select(
        "doc_id",
        F.when(F.size(known) > 0, names).alias("licenses"),
        F.size(known).cast("long").alias("n_paragraphs"),
        (F.size("found") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_max(F.transform(known, lambda s: s["probability"])).alias("probability"),
    )
