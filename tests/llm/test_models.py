import random
import re
import zlib

import numpy as np
import pyarrow as pa
import regex

from chainloom.llm import languages as L
from chainloom.llm import licences as C
from chainloom.llm import toxicity as X

DOCS = "/root/testdata/sf0.01/documents.parquet"
LABELS = "/root/testdata/sf0.01/labels.parquet"


def test_gradients_are_those_of_the_loss():
    net = L.Network(["a", "b", "c"], units=3, seed=1)
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 256, (6, 4)).astype(np.int16)
    symbols[4:, 1] = L.PAD
    labels = np.array([0, 1, 2, 1])
    for w in net.weights():
        w *= 2
    _, grads = net.step(symbols, labels)
    for w, g in zip(net.weights(), grads, strict=True):
        for at in [np.unravel_index(k, w.shape) for k in np.argsort(-np.abs(g).ravel())[:3]]:
            old = w[at]
            w[at] = old + 1e-2
            up = net.step(symbols, labels)[0]
            w[at] = old - 1e-2
            down = net.step(symbols, labels)[0]
            w[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.03 * abs(g[at])


def test_languages_held_out_accuracy_and_cases(spark):
    docs = spark.read.parquet(DOCS)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    net = L.fit(docs)
    out = L.languages(docs, net).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    odd = spark.createDataFrame([(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "12 .,;", "x", 1.0), (None, "字", "x", 1.0), (4, "the of and in that " * 9000, "x", 1.0), (4, "the of", None, None)], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, i): r for i, r in enumerate(L.languages(odd, net).collect())}
    assert [r.lang_pred for r in got.values()][:3] == [L.UND] * 3 and got[None, 3].lang_pred != L.UND and got[4, 4].lang_pred == "en"
    assert {r.lang_pred for r in L.languages(odd.where("lang is null"), net).collect()} == {"en"}
    assert [r.lang_pred for r in L.languages(odd.withColumn("lang", odd.lang.cast("string")).limit(0)).collect()] == []
    nothing = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in L.languages(nothing).collect()} == {(L.UND, 0.0)}


def test_pooling_against_one_run_over_the_whole_text():
    """Every position of a text of several segments is labelled as in a segment of its own with margins, computed one by one."""
    net = L.Network(["a", "b"], units=4, seed=3)
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (0, 1, 100, 240, 241, 500, 1000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.pooled(data, offsets)

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(direction, symbols):
        h, k, out = np.zeros(4), 4, []
        for s in symbols:
            x = direction.x[s].astype(float)
            gates = sigmoid(x[: 2 * k] + h @ direction.gates)
            c = np.tanh(x[2 * k :] + (gates[k:] * h) @ direction.state)
            h = h + gates[:k] * (c - h)
            out.append(h)
        return out

    for text, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for at in range(0, len(text), L.SEGMENT):
            lo, hi = max(0, at - L.MARGIN), min(len(text), at + L.SEGMENT + L.MARGIN)
            ahead, behind = states(net.along, text[lo:hi]), states(net.back, text[lo:hi][::-1])[::-1]
            for i in range(at, min(at + L.SEGMENT, len(text))):
                z = np.concatenate([ahead[i - lo], behind[i - lo]]) @ net.top + net.bias
                total += np.exp(z) / np.exp(z).sum()
        assert np.allclose(total / max(1, len(text)), p, atol=2e-3)


def test_training_takes_all_rows_that_it_may(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "trained", lambda texts, labels, steps: seen.append((texts, labels)))
    rows = [(i, f"text {i} " + "w " * 300, "en" if i % 100 == 0 else None) for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    L.fit(docs, sample=3000)
    may = {t.encode() for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(seen[0][0]) == may and len(may) > 100  # whole texts, none cut
    L.fit(docs, sample=20)
    assert len(seen[1][0]) == 20
    L.fit(docs, size=5000)
    assert sum(map(len, seen[2][0])) <= 5000 and len(seen[2][0]) >= 7


def test_toxicity_held_out_and_counterfactuals(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    model = X.fit(docs, labels)
    out = {r.doc_id: r for r in X.toxicity(docs, model=model).collect()}
    assert len(out) == docs.count()
    held = [(r.toxic, out[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(x.held_out for _, x in held)
    assert sum(x.predicted == y for y, x in held) / len(held) > 0.93
    rows = [(None, "idiot"), (1, None), (2, ""), (2, "")]
    got = X.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()
    assert len({r.score for r in got[1:]}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert X.toxicity(docs.limit(0), model=model).collect() == []


def test_scores_against_a_reading_by_hand(spark):
    """Scores of words, of their beginnings, of long and odd texts, computed from the weights text by text."""
    rng = np.random.default_rng(3)
    model = X.Model(np.where(rng.random(X.SIZE) < 0.3, rng.normal(size=X.SIZE), 0), -0.3)
    number = lambda piece, n: int(X.mixed(X.spans(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)])) + X.U(n))[0]) & X.SIZE - 1
    texts = [None, "", "idiots all", "Ein Ünding, größer als 7!", "a b a b", "wörter " * 3000 + "end", " ".join(f"w{i % 5000}x" for i in range(1500000))]
    assert len(texts[-1]) > X.LONG
    rows = [(i, t, 1, "x", 0.5, 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in X.toxicity(spark.createDataFrame(rows, "doc_id long, text string, held_out int, h string, score double, y int"), model=model).collect()}
    for i, text in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
        f = set()
        for word in set(re.findall(rb"[0-9a-z\x80-\xff]+", low)):
            f |= {number(word, 0), *(number(word[:n], n) for n in X.HEADS if len(word) >= n)}
        want = 1 / (1 + np.exp(-np.clip(sum(float(model.weights[k]) for k in f) + model.bias, -30, 30)))
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == (got[i].score >= 0.5)


def test_swapped_sentences():
    assert X.swapped("nothing here", 1).startswith("nothing here ") and X.swapped("nothing here", 1).split(" ")[-1] in X.GROUP
    out = X.swapped("Muslims, and the muslimsx of Rome; Frauen!", 3)
    assert re.fullmatch(r"[A-Z][a-z]+, and the muslimsx of Rome; [A-ZÄÖÜ][a-zäöüß]+!", out) and not out.startswith("Muslims,") and "Frauen" not in out
    # a beginning that another word of the text also has does not change
    (more, less), *_ = X.differences(pa.array(["blackmail of black cats"]), [5])
    heads = set(X.distinct(pa.array(["blac blackm black"]))[1])
    own, rest = set(X.distinct(pa.array(["blackmail of cats"]))[1]), set(less.tolist())
    assert not rest & own and rest and set(more.tolist()).isdisjoint(own) and heads


def test_fit_takes_each_text_once_and_no_more_than_its_bounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "trained", lambda rows, prior=None: seen.append((rows, prior)))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(ids[0], f"text {ids[0]}")] * 40 + [(ids[1], "another text")] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(999, 1), (None, 1), (ids[2], None)], "doc_id long, toxic int")
    X.fit(docs, labels)
    X.fit(docs.repartition(7), labels.repartition(3))
    assert len(seen[0][0]) == len(ids) + 1
    assert [r.own.tolist() for r in seen[0][0]] == [r.own.tolist() for r in seen[1][0]]
    X.fit(docs, labels, size=40)
    assert 2 <= len(seen[2][0]) <= 2 * 6
    X.fit(docs, labels.limit(0))
    assert seen[3][0] == []


def test_counterfactuals_take_the_weight_from_identity_terms():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    texts, y = [], []
    for i in range(600):
        toxic = i % 3 == 0
        own = [rng.choice(words) for _ in range(12)] + (["vilest"] if toxic and rng.random() < 0.8 else [])
        if rng.random() < (0.7 if toxic else 0.1):  # the group is named more often where the label is 1
            own.append("muslims")
        texts.append(" ".join(own))
        y.append(float(toxic))
    rows = X.examples(texts, y)
    neutral = pa.array(["muslims met for w1 w2"])
    plain, fair = X.trained(rows, strength=0.0), X.trained(rows, strength=2.0)
    assert fair.scores(neutral)[0] < 0.6 * plain.scores(neutral)[0]
    assert fair.scores(pa.array(["vilest w1 w2"]))[0] > 0.5
    assert X.trained([]).scores(neutral)[0] < 0.5


PROBES = [
    ("released under the MIT License", "MIT"),
    ("Released under the ISC License today", "ISC"),
    ("Released under the ISC License.", "ISC"),
    (" * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction", "MIT"),
    ("Apache License, Version\n2.0", "Apache-2.0"),
    ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3.0"),
    ("The MIT License (MIT)", "MIT"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"),
    ("Dual licensed under the MIT License and the Apache License, Version 2.0", "Apache-2.0,MIT"),
    ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("It lies under CC BY-NC-SA 4.0", "CC-BY-NC-SA"),
    ("Released under the Example License", ""),
    ("driving license", ""),
    ("MIT granted a license. The zlib of today", ""),
]


def test_licences_against_a_scan_in_python(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    odd = [(None, None), (5000, ""), (5001, "Released under the MIT License.\n \nLICENSED UNDER THE APACHE LICENSE,\n\tVERSION 2.0\n//\nMIT License"), (5003, "x " * 50000 + "\nThis file is released under the MIT\n license " + "y " * 300 + "\n\n\n"), (5003, "no")]
    odd += [(6000 + i, t) for i, (t, _) in enumerate(PROBES)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = C.fit(docs)
    assert 0 < model.errors[0] < 0.3 * model.errors[1]  # what is kept apart shows where the model errs
    got = sorted(((r.doc_id, r.n_paragraphs, r.n_findings, r.families, r.first_paragraph) for r in C.licences(docs, model).collect()), key=repr)
    want = []
    for r in docs.collect():
        parts = regex.split(C.BLANK, r.text) if r.text else []
        found = []
        for i, part in enumerate(parts):
            own, names = C.words_of(part), []
            for at in range(0, max(1, len(own) - C.WINDOW // 2), C.WINDOW // 2):
                w = own[at : at + C.WINDOW]
                grams = set(w) | {" ".join(x) for x in zip(w, w[1:], strict=False)}
                for k, family in enumerate(sorted(C.TEMPLATES)):
                    z = model.bias[k] + sum(model.weights[g][k] for g in grams if g in model.weights)
                    if 1 / (1 + np.exp(-(model.scale * z + model.shift))) >= C.LEAST and family not in names and confirmed(" ".join(w), family):
                        names.append(family)
            found += [(i, x) for x in names]
        want.append((r.doc_id, len(parts), len(found), ",".join(sorted({x for _, x in found})), found[0][0] if found else None))
    assert got == sorted(want, key=repr)
    families = {x[0]: x[3] for x in got}
    assert [families[6000 + i] for i in range(len(PROBES))] == [x for _, x in PROBES]
    assert families[5001] == "Apache-2.0,MIT" and [x[1:3] for x in got if x[0] == 5001] == [(3, 3)]
    assert ("MIT" in {x[3] for x in got if x[0] == 5003}) and sum(x[2] for x in got) > 20
    assert C.licences(docs.limit(0), model).collect() == []


def confirmed(text, family):
    """Plainly, from the table of sentences."""
    for marked in C.TEMPLATES[family]:
        own = re.findall("[a-z0-9]+", marked.lower())
        n = min(5, len(own))
        runs = {" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}
        inside = lambda x: re.search(rf"(?<![a-z0-9]){x}(?![a-z0-9])", text) is not None
        needs = [" ".join(re.findall("[a-z0-9]+", x.lower())) for x in re.findall("{(.*?)}", marked)]
        if all(map(inside, needs)) and sum(map(inside, runs)) >= 0.8 * len(runs):
            return True
    return False


def test_no_sentence_is_confirmed_without_a_telling_word():
    some = set(C.telling([["mit", "that", "use"]] * 9))
    assert not some & {"mit", "that", "use"}
    for t in C.ALL:
        left = [w for w in t.words if w not in some]
        assert not t.confirmed(left) and not t.confirmed(["x" if w in some else w for w in t.words])
        assert t.confirmed(t.words) and confirmed(" ".join(t.words), t.family)
