"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

A paragraph is what stands between lines without a letter or digit; line
breaks, comment marks and white space within it do not count. It is read in
windows of WINDOW words that overlap by half, so a notice amid a long text is
seen as it is in a short one. A window's features are its words and pairs of
words. A logistic regression for each licence family, with an L1 penalty, is
fitted on the driver to variations of the template sentences and to a bounded
sample of the corpus's own windows, which are of no family. Scale and shift of
the scores are set on variations kept apart, among them damaged ones that the
model gets wrong, so that the probabilities, also that of no family, are
calibrated. A family that is likely is confirmed if one of its template
sentences has its necessary phrases in the window, and at least CONTAINED of
its shingles.

Every confirmation takes one of a few words, so windows without any of them
have no finding; the others are scored within their row, without a shuffle.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.samples import thinned

#: Words of a window; share of a template sentence's shingles, words of a shingle, least probability of a family.
WINDOW, CONTAINED, SHINGLE, LEAST = 96, 0.8, 5, 0.3
#: Windows of the corpus in the training sample, variations of each template sentence, steps, L1 penalty.
SAMPLE, VARIATIONS, STEPS, L1 = 600, 16, 150, 1e-4
#: A line break and lines without a letter or digit.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"

# Sentences by which texts put themselves under a licence; what stands in braces is necessary.
TEMPLATES = {
    "AGPL-3.0": [
        "{GNU Affero General Public License}, {version 3}",
        "under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version",
        "SPDX-License-Identifier: {AGPL-3.0}",
    ],
    "Apache-2.0": [
        "{Apache License, Version 2.0}",
        "{Apache License 2.0}",
        "{Apache 2.0 License}",
        "you may not use this file except in compliance with the License",
        "you may obtain a copy of the License at {http://www.apache.org/licenses/LICENSE-2.0}",
        "SPDX-License-Identifier: {Apache-2.0}",
    ],
    "Artistic-2.0": ["{Artistic License 2.0}", "{Artistic License, Version 2.0}", "SPDX-License-Identifier: {Artistic-2.0}"],
    "BSD-2-Clause": ["{BSD 2-Clause} License", "{2-Clause BSD} License", "{Simplified BSD License}", "SPDX-License-Identifier: {BSD-2-Clause}"],
    "BSD-3-Clause": [
        "{BSD 3-Clause} License",
        "{3-Clause BSD} License",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: {BSD-3-Clause}",
    ],
    "BSD": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "{BSD License}", "{BSD-style license}"],
    "BSL-1.0": [
        "{Boost Software License}",
        "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation {covered by this license}",
        "SPDX-License-Identifier: {BSL-1.0}",
    ],
    "CC-BY": ["{CC BY 4.0}", "Creative Commons {Attribution 4.0} International License", "SPDX-License-Identifier: {CC-BY-4.0}"],
    "CC-BY-NC": ["{CC BY-NC 4.0}", "Creative Commons {Attribution-NonCommercial 4.0} International License", "SPDX-License-Identifier: {CC-BY-NC-4.0}"],
    "CC-BY-NC-ND": ["{CC BY-NC-ND 4.0}", "Creative Commons {Attribution-NonCommercial-NoDerivatives 4.0} International License", "SPDX-License-Identifier: {CC-BY-NC-ND-4.0}"],
    "CC-BY-NC-SA": ["{CC BY-NC-SA 4.0}", "Creative Commons {Attribution-NonCommercial-ShareAlike 4.0} International License", "SPDX-License-Identifier: {CC-BY-NC-SA-4.0}"],
    "CC-BY-ND": ["{CC BY-ND 4.0}", "Creative Commons {Attribution-NoDerivatives 4.0} International License", "SPDX-License-Identifier: {CC-BY-ND-4.0}"],
    "CC-BY-SA": ["{CC BY-SA 4.0}", "Creative Commons {Attribution-ShareAlike 4.0} International License", "SPDX-License-Identifier: {CC-BY-SA-4.0}"],
    "CC0-1.0": ["{CC0 1.0}", "has waived all copyright and related or neighboring rights to this work", "SPDX-License-Identifier: {CC0-1.0}"],
    "EPL-2.0": ["{Eclipse Public License 2.0}", "{Eclipse Public License v 2.0}", "{Eclipse Public License, version 2.0}", "SPDX-License-Identifier: {EPL-2.0}"],
    "GPL-2.0": [
        "{GNU General Public License, version 2}",
        "{GNU General Public License v2}",
        "{GNU GPL version 2}",
        "under the terms of the {GNU General Public License} as published by the Free Software Foundation; either {version 2} of the License, or (at your option) any later version",
        "under the terms of the {GNU General Public License version 2} as published by the Free Software Foundation",
        "SPDX-License-Identifier: {GPL-2.0}",
    ],
    "GPL-3.0": [
        "{GNU General Public License, version 3}",
        "{GNU General Public License v3}",
        "{GNU GPL version 3}",
        "under the terms of the {GNU General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version",
        "under the terms of the {GNU General Public License version 3} as published by the Free Software Foundation",
        "SPDX-License-Identifier: {GPL-3.0}",
    ],
    "ISC": [
        "{ISC License}",
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: {ISC}",
    ],
    "LGPL-2.1": [
        "{GNU Lesser General Public License}, {version 2.1}",
        "under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version 2.1} of the License, or (at your option) any later version",
        "SPDX-License-Identifier: {LGPL-2.1}",
    ],
    "LGPL-3.0": [
        "{GNU Lesser General Public License}, {version 3}",
        "under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version",
        "SPDX-License-Identifier: {LGPL-3.0}",
    ],
    "MIT": [
        "{MIT License}",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: {MIT}",
    ],
    "MPL-2.0": ["subject to the terms of the {Mozilla Public License, v. 2.0}", "{Mozilla Public License, Version 2.0}", "{Mozilla Public License 2.0}", "SPDX-License-Identifier: {MPL-2.0}"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "{The Unlicense}", "SPDX-License-Identifier: {Unlicense}"],
    "Zlib": [
        "this software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "{zlib License}",
        "SPDX-License-Identifier: {Zlib}",
    ],
}
#: Words around a template sentence in variations, and sentences about licences that name no family.
AROUND = "this work is the file and its documentation are project code software see notice text also all rights by authors licensed released under distributed terms copyright c 2019 you can use it copy of license or as".split()
NO_FAMILY = [
    "all rights reserved by the authors of this work",
    "you need a driving license to rent a car here",
    "the licence fee pays for public service television",
    "licensed to the customer under a commercial agreement",
    "released under the terms of our own licence",
    "published by the general public version of the foundation",
    "version 2.0 of the software was released under budget",
    "licensed under the Example License, Version 1.0",
    "released under the Example License",
    "under the terms of the Unheard Of License as published by its authors",
    "he studied at MIT and has a pilot license",
    "the apache helicopter version 2.0 was released",
    "permission is hereby refused to any person",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "a general public licence was never published",
    "creative people have much in common",
]


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def features_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z in lower case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def let(value: Column, of) -> Column:
    """of(value), value being computed once; an expression that a lambda names is computed wherever it is named."""
    return F.transform(F.array(value), of)[0]


class Template:
    """A sentence, its necessary phrases and its shingles, each between spaces."""

    def __init__(self, family: str, marked: str):
        self.family, self.sentence = family, re.sub("[{}]", "", marked)
        self.words = words_of(self.sentence)
        self.needs = [f" {' '.join(words_of(x))} " for x in re.findall(r"\{(.*?)\}", marked)]
        n = min(SHINGLE, len(self.words))
        self.shingles = sorted({f" {' '.join(self.words[i : i + n])} " for i in range(len(self.words) - n + 1)})

    def confirmed(self, words: list[str]) -> bool:
        text = f" {' '.join(words)} "
        return all(x in text for x in self.needs) and sum(x in text for x in self.shingles) >= CONTAINED * len(self.shingles)

    def row(self) -> dict:
        return {"family": self.family, "sentence": self.sentence, "needs": self.needs, "shingles": self.shingles}


ALL = [Template(family, s) for family, own in sorted(TEMPLATES.items()) for s in own]


class Classifier:
    """Weights by feature and family, constants, and scale and shift that make the scores log odds.

    telling: words without any of which nothing is confirmed; errors: how many
    decisions on the texts kept apart, of how many, are wrong.
    """

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], scale: float, shift: float, telling: list[str], errors: tuple[int, int] = (0, 0)):
        self.families, self.weights, self.bias, self.scale, self.shift, self.telling, self.errors = families, weights, bias, scale, shift, telling, errors

    def probabilities(self, features: set[str]) -> dict[str, float]:
        z = np.array(self.bias) + sum((np.array(self.weights[f]) for f in sorted(features) if f in self.weights), np.zeros(len(self.families)))
        return dict(zip(self.families, (1 / (1 + np.exp(-(self.scale * z + self.shift)))).tolist(), strict=True))


def _variation(r: random.Random, own: list[list[str]], damage: float) -> list[str]:
    """Sentences amid other words, of which some go missing."""
    out = [r.choice(AROUND) for _ in range(r.randint(0, 8))]
    for s in own:
        out += [w for w in s if r.random() >= damage] + [r.choice(AROUND) for _ in range(r.randint(0, 8))]
    return out


def trained(background: list[list[str]], seed: int = 3) -> Classifier:
    """A classifier fitted to the templates and to background windows that confirm none of them."""
    r = random.Random(seed)
    families = sorted(TEMPLATES)
    index = {x: k for k, x in enumerate(families)}
    rows: list[tuple[set[str], set[int]]] = []
    for t in ALL:
        rows.append((features_of(t.words), {index[t.family]}))
        for k in range(VARIATIONS):
            others = [r.choice(ALL)] if k % 4 == 1 else []  # two licences in one
            rows.append((features_of(_variation(r, [t.words, *(x.words for x in others)], (0, 0, 0.1, 0.3)[k % 4])), {index[x.family] for x in (t, *others)}))
    rows += [(features_of(w), set()) for w in background if not any(t.confirmed(w) for t in ALL)]
    for t in NO_FAMILY:
        rows += [(features_of(_variation(r, [words_of(t)], 0.1)), set()) for _ in range(12)]
    for t in ALL:  # a licence of another name
        if t.needs:
            odd = " ".join(t.words)
            for need in t.needs:
                odd = odd.replace(need.strip(), r.choice(["example", "own", "site", "commercial", "house"]))
            rows.append((features_of(_variation(r, [odd.split()], 0)), set()))
    rows += [(features_of([r.choice(AROUND) for _ in range(r.randint(0, 30))]), set()) for _ in range(120)]
    named = set().union(*(x for x, k in rows if k))  # what is in no example of a family can tell nothing
    vocabulary = {f: i for i, f in enumerate(sorted(named))}
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.zeros((len(rows), len(families)), np.float32)
    for i, (own, k) in enumerate(rows):
        x[i, [vocabulary[f] for f in own if f in vocabulary]] = 1
        y[i, list(k)] = 1
    apart = np.arange(len(y)) % 5 == 4
    train, truth = x[~apart], y[~apart]
    n, ones = len(train), truth.sum(0)
    weight = np.where(truth > 0, 0.25 / ones, 1 / (n - ones)).astype(np.float32)
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    v, rate = w, np.float32(1.5)
    for step in range(STEPS):
        d = (_sigmoid(train @ v + b) - truth) * weight
        new = v - rate * train.T @ d
        new = np.sign(new) * np.maximum(np.abs(new) - rate * np.float32(L1), 0)
        b = b - rate * d.sum(0)
        v, w = new + np.float32(step / (step + 3)) * (new - w), new
    z, goal = (x[apart] @ w + b).astype(float), y[apart]

    def loss(scale: float, shift: float) -> float:
        p = np.clip(_sigmoid(scale * z + shift), 1e-9, 1 - 1e-9)
        return float(-(goal * np.log(p) + (1 - goal) * np.log(1 - p)).mean())

    scale, shift = min(((0.25 * 1.25**i, j * 0.25) for i in range(24) for j in range(-16, 17)), key=lambda s: loss(*s))
    wrong = (_sigmoid(scale * z + shift) >= LEAST) != (goal > 0)
    used = {f: w[i].astype(float).round(5).tolist() for f, i in vocabulary.items() if np.abs(w[i]).max() > 0}
    return Classifier(families, used, b.astype(float).round(5).tolist(), round(scale, 6), shift, telling(background), (int(wrong.any(1).sum()), len(goal)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def telling(background: list[list[str]]) -> list[str]:
    """Words without any of which no template sentence can be confirmed, rare ones in the background.

    Each sentence has one of them in a necessary phrase, or in so many shingles
    that those left are fewer than the share that a confirmation takes.
    """
    often = Counter(w for own in background for w in own)
    needs = [{w for x in t.needs for w in x.split()} for t in ALL]
    parts = [[set(x.split()) for x in t.shingles] for t in ALL]
    left, out = set(range(len(ALL))), []
    spare = [len(x) - CONTAINED * len(x) + 1e-9 for x in parts]  # shingles that may be missing

    def covered(k: int, chosen: set[str]) -> float:
        """Share of the way to being impossible without the chosen words."""
        return 1.0 if needs[k] & chosen else min(1.0, sum(not chosen.isdisjoint(x) for x in parts[k]) / spare[k])

    while left:
        now = {k: covered(k, set(out)) for k in left}
        gain = {w: sum(covered(k, {*out, w}) - now[k] for k in left if w in ALL[k].words) for w in sorted({w for k in left for w in ALL[k].words})}
        out.append(max(gain, key=lambda w: (round(gain[w] / (1 + often[w]), 9), len(w), w)))
        left = {k for k in left if covered(k, set(out)) < 1}
    return out


def windows(w: Column) -> Column:
    """The windows of a paragraph's words."""
    half = WINDOW // 2
    last = F.greatest(F.lit(0), F.ceil((F.size(w) - WINDOW) / half).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(w, k * half + 1, F.lit(WINDOW)))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """A classifier whose texts of no family are one window each of at most sample texts.

    Which texts, and which of the windows of the whole text, is by a hash.
    """
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(text.alias("t"), F.xxhash64(text).alias("h"))
    some = thinned(rows, F.col("h"), sample, rows.count()).select("h", words(F.col("t")).alias("w"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("w") - WINDOW + 1)).cast("int") + 1
    return trained([r.w for r in some.select("h", F.slice("w", start, F.lit(WINDOW)).alias("w")).orderBy("h", "w").limit(sample).collect()])


FINDINGS = "array<struct<paragraph:int,family:string,probability:double,sentence:string>>"


def scanned(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, findings), one row per row of docs.

    findings: array<struct<paragraph, family, probability, sentence>> in order
    of paragraph, window and family: each family of a paragraph once, from the
    first window in which its probability is LEAST or more and a template
    sentence confirms it; sentence is that one. A null or empty text has no
    paragraph; texts are read whole; repeated rows stay repeated; an empty
    table gives an empty table; other columns are not looked at. Paragraphs
    count from 0.
    """
    model = model or fit(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = model.telling
    # constants, folded when the query is planned
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    known, bias = F.map_keys(weights), F.from_json(F.lit(json.dumps(model.bias)), "array<double>")
    families = F.array(*map(F.lit, model.families))
    templates = F.from_json(F.lit(json.dumps([t.row() for t in ALL])), "array<struct<family:string,sentence:string,needs:array<string>,shingles:array<string>>>")
    marks = F.array(*map(F.lit, some))

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))

    def scored(w: Column) -> Column:
        grams = F.array_sort(F.array_intersect(F.concat(w, pairs(w)), known))
        z = F.aggregate(grams, bias, lambda total, g: F.zip_with(total, F.element_at(weights, g), lambda a, b: a + b))
        p = F.transform(z, lambda x: 1 / (1 + F.exp(-(x * model.scale + model.shift))))
        likely = F.filter(F.zip_with(families, p, lambda a, b: F.struct(a.alias("family"), b.alias("probability"))), lambda x: x["probability"] >= LEAST)
        return F.struct(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("t"), likely.alias("likely"))

    def held(t: Column, family: Column) -> Column:
        """The first sentence of the family that the window confirms."""
        own = F.filter(templates, lambda x: x["family"] == family)
        good = F.filter(own, lambda x: F.forall(x["needs"], lambda n: F.contains(t, n)) & (F.size(F.filter(x["shingles"], lambda s: F.contains(t, s))) >= F.size(x["shingles"]) * F.lit(CONTAINED)))
        return F.get(good, F.lit(0))["sentence"]

    def found(k: Column, paragraph: Column) -> Column:
        near = F.filter(let(words(paragraph), windows), lambda w: F.arrays_overlap(w, marks))
        each = F.transform(near, lambda w: let(scored(w), lambda s: F.transform(s["likely"], lambda x: F.struct(k.alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), held(s["t"], x["family"]).alias("sentence")))))
        good = F.filter(F.flatten(each), lambda x: x["sentence"].isNotNull())
        return let(good, lambda g: F.filter(g, lambda x, i: ~F.exists(F.slice(g, F.lit(1), i), lambda y: y["family"] == x["family"])))

    paragraphs = F.split("text", BLANK)
    low = F.lower("text")
    may = F.lit(False)
    for w in some:
        may = may | F.contains(low, F.lit(w))
    word = "(?i)(?<![a-z0-9])(?:" + "|".join(some) + ")(?![a-z0-9])"
    may = may & F.col("text").rlike(word)
    marked = rows.select("doc_id", "text", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(paragraphs).alias("p"), may.alias("may"))
    findings = F.flatten(F.transform("p", lambda p, i: F.when(p.rlike(word), found(i, p)).otherwise(F.array().cast(FINDINGS))))
    return marked.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.when(F.col("may"), findings).otherwise(F.array().cast(FINDINGS)).alias("findings"))


def licences(docs: DataFrame, model: Classifier | None = None, **names) -> DataFrame:
    """(doc_id, n_paragraphs, n_findings, families, first_paragraph, probability), one row per row of docs; see scanned.

    families: the distinct families in order, comma-joined; first_paragraph and
    probability: of the first finding, null where there is none.
    """
    f = F.col("findings")
    one = F.when(F.size(f) > 0, F.element_at(f, 1))
    return scanned(docs, model, **names).select(
        "doc_id",
        "n_paragraphs",
        F.size(f).cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda x: x["family"]))), ",").alias("families"),
        one["paragraph"].cast("long").alias("first_paragraph"),
        F.round(one["probability"], 6).alias("probability"),
    )
