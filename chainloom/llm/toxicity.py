"""Toxicity: a counterfactual-regularised linear classifier.

A text is the set of its words and of their first bytes, hashed. A logistic
regression with an L1 penalty is fitted to a bounded sample of labelled rows.
Each of these texts is written again: where it names a group, every such term
is swapped for another of its language's list; where it names none, a term is
put in. The features of both texts are taken, and the difference of their
scores is penalised, so that naming a group does not move the score.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.samples import thinned
from chainloom.llm.text import ALNUM, LONG, U, Words, bounded, mixed, pieces, sections, spans

#: Hash buckets, lengths in bytes of word beginnings that are features.
SIZE, HEADS = 1 << 18, (4, 5, 6)
#: Labelled rows that training takes of each label, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 3000, 12 << 20
#: Weights of the L1, L2 and counterfactual penalties; steps.
L1, L2, COUNTERFACTUAL, STEPS = 1e-3, 1e-5, 0.05, 120

# Terms that name groups of people, swapped for one another within a list.
IDENTITIES = [
    "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees gay lesbian straight transgender black white asian african european latino arab disabled deaf blind old young poor rich".split(),
    "frauen männer mädchen jungen muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge schwule lesben schwarze weiße asiaten afrikaner europäer araber behinderte alte junge arme reiche".split(),
    "femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés gays lesbiennes noirs blancs asiatiques africains européens arabes handicapés vieux jeunes pauvres riches".split(),
    "mujeres hombres chicas chicos musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados gays lesbianas negros blancos asiáticos africanos europeos árabes discapacitados viejos jóvenes pobres ricos".split(),
]


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each word and of its beginnings; repeats included."""
    doc = np.repeat(np.arange(len(w.n)), w.n)
    docs, out = [doc], [w.hashes()]
    for n in HEADS:
        long = np.flatnonzero(w.end - w.start >= n)
        docs.append(doc[long])
        out.append(mixed(spans(w.text, w.start[long], w.start[long] + n) + U(n)))
    return np.concatenate(docs), (np.concatenate(out) & U(SIZE - 1)).astype(np.int32)


def _read(array: pa.Array):
    """The words of texts; of a long one in sections."""
    if len(array) == 1 and (pc.binary_length(array)[0].as_py() or 0) > LONG:
        for _, _, w in sections(array, ALNUM, lower=True):
            yield w
    else:
        yield Words(array, ALNUM, lower=True)


def distinct(array: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each pair once, in order; with weights only of features that have one."""
    found = []
    for w in _read(array):
        doc, f = features(w)
        if weights is not None:
            live = np.flatnonzero(weights[f])
            doc, f = doc[live], f[live]
        found.append(np.unique(doc.astype(np.int64) * SIZE + f))
    pair = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return pair // SIZE, (pair % SIZE).astype(np.int32)


#: Of each term the list that it is in.
GROUP = {term: group for group in reversed(IDENTITIES) for term in group}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def swapped(text: str, seed: int) -> str:
    """text with each term that names a group in place of another of its list, or with a term put in where it names none.

    A word keeps a capital at its beginning; the rest of the text stays as it is.
    """
    rng = random.Random(seed)
    named = False

    def other(m: re.Match) -> str:
        nonlocal named
        word = m.group()
        group = GROUP.get(word.lower())
        if not group:
            return word
        named = True
        new = rng.choice([t for t in group if t != word.lower()])
        return new.capitalize() if word[0].isupper() else new

    out = TERM.sub(other, text)
    return out if named else f"{text} {rng.choice(rng.choice(IDENTITIES))}"


def differences(texts: pa.Array, seeds: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the features that its swapped text has and it has not, and those that only it has."""
    new = pa.array([swapped(t or "", s) for t, s in zip(texts.to_pylist(), seeds, strict=True)], pa.large_string())
    (a, f), (b, g) = distinct(texts), distinct(new)
    old, new = a * SIZE + f, b * SIZE + g
    out = []
    for diff in (np.setdiff1d(new, old, True), np.setdiff1d(old, new, True)):
        at = np.searchsorted(diff, np.arange(len(texts) + 1) * SIZE)
        out.append([(diff[i:j] % SIZE).astype(np.int32) for i, j in zip(at[:-1], at[1:], strict=True)])
    return list(zip(*out, strict=True))


class Model:
    """Weights of the features and a constant."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, array: pa.Array) -> np.ndarray:
        doc, f = distinct(array, self.weights)
        total = np.bincount(doc, weights=self.weights[f], minlength=len(array)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Example:
    """Features of a labelled text, and how those of its swapped text differ."""

    def __init__(self, own: np.ndarray, more: np.ndarray, less: np.ndarray, label: float):
        self.own, self.more, self.less, self.label = own, more, less, label


def examples(texts: list[str], labels: list[float]) -> list[Example]:
    array = pa.array(texts, pa.large_string())
    doc, f = distinct(array)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [Example(f[a:b], *d, y) for a, b, d, y in zip(at[:-1], at[1:], differences(array, list(range(len(texts)))), labels, strict=True)]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int32)])


def trained(rows: list[Example], prior: float | None = None, strength: float = COUNTERFACTUAL) -> Model:
    """A model fitted by accelerated proximal gradient steps.

    Features of fewer than three texts are left out. The L1 penalty selects
    features first; those are then fitted again without it, as it shrinks them. prior is the share of
    label 1 among all labelled rows; the constant is moved to it.
    """
    y = np.array([r.label for r in rows])
    doc, f = _flat([r.own for r in rows])
    more, less = _flat([r.more for r in rows]), _flat([r.less for r in rows])
    pair, cf = np.concatenate([more[0], less[0]]), np.concatenate([more[1], less[1]])
    sign = np.concatenate([np.ones(len(more[0])), -np.ones(len(less[0]))])
    n = len(y)
    if not n or y.min() == y.max():
        return Model(np.zeros(SIZE), 3.0 if n and y[0] else -3.0)
    common = np.bincount(f, minlength=SIZE) >= 3
    keep = common[f]
    doc, f = doc[keep], f[keep]
    changes = tuple(x[common[cf]] for x in (pair, cf, sign))
    w, bias = _fitted(doc, f, y, changes, np.zeros(SIZE), float(np.log(y.mean() / (1 - y.mean()))), L1, strength)
    live = w[f] != 0
    w, bias = _fitted(doc[live], f[live], y, changes, w, bias, 0.0, strength)
    share = y.mean()
    if prior and 0 < prior < 1:
        bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(w, bias)


def _fitted(doc, f, y, changes, w, bias, l1: float, strength: float) -> tuple[np.ndarray, float]:
    n = pairs = len(y)
    pair, cf, sign = changes
    if not l1:  # only what was selected moves
        selected = w[cf] != 0
        pair, cf, sign = pair[selected], cf[selected], sign[selected]
    v, vb, t = w, bias, 1.0
    rate = 4.0 / (1 + np.sqrt(np.bincount(doc, minlength=n).max()))
    rate /= 1 + 16 * strength * rate
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=v[f], minlength=n) + vb, -30, 30)))
        error = (p - y) / n
        change = np.bincount(pair, weights=v[cf] * sign, minlength=pairs)
        grad = np.bincount(f, weights=error[doc], minlength=SIZE) + L2 * v
        grad += 2 * strength / pairs * np.bincount(cf, weights=change[pair] * sign, minlength=SIZE)
        step = v - rate * grad
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_bias = vb - rate * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - new) * (new - w)).sum() > 0:  # restart the momentum where it overshoots
            t2 = 1.0
        v, vb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w, bias


def held_out(doc_id, folds: int, fold: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model trained on at most sample whole texts of each label, of rows outside the held-out fold.

    They are taken in order of a hash of doc_id and text, and come to at most
    size bytes a label; a text too long for what is left is passed over. Null
    labels and null ids are left out; of several labels of one doc_id the
    larger counts, of several texts each is one. The share of label 1 is that
    of all labelled rows outside the fold.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    own = own.where(~held_out(F.col("id"), folds, fold)).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    n, ones = own.agg(F.count("*"), F.sum("y")).first()
    ones = ones or 0
    h = F.xxhash64("id")
    sides = [thinned(own.where(f"y = {y}"), F.col("id"), sample, count).orderBy(h, "id").limit(sample) for y, count in ((1, ones), (0, n - ones))]
    # 2 * sample ids at most
    ids = F.broadcast(sides[0].unionByName(sides[1]))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "id")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    sizes = rows.select("y", "h", F.octet_length("text").alias("n")).distinct()
    held: list[int] = []
    for y in (1, 0):
        left = size
        for r in sizes.where(f"y = {y}").orderBy("h").limit(sample).collect():
            if r.n <= left:
                held.append(r.h)
                left -= r.n
    if not held:
        return trained([])

    def encode(batches):
        for batch in pieces(batches, "text", 1 << 20):
            doc, f = distinct(batch.column("text"))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            more, less = zip(*differences(batch.column("text"), batch.column("h").to_pylist()), strict=True)
            lists = [f[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], more, less
            yield pa.record_batch([batch.column("h"), batch.column("y"), *(pa.array([x.tobytes() for x in own], pa.binary()) for own in lists)], names=["h", "y", "own", "more", "less"])

    got = rows.where(F.col("h").isin(held)).dropDuplicates(["h"]).select("h", "y", "text").mapInArrow(encode, "h long, y int, own binary, more binary, less binary").collect()
    got.sort(key=lambda r: r.h)
    return trained([Example(*(np.frombuffer(x, np.int32) for x in (r.own, r.more, r.less)), float(r.y)) for r in got], ones / n)


def toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    A null or empty text has no features: its score is that of the constant.
    Texts are read whole, long ones in sections. Other columns are not looked at.
    A null doc_id counts as the empty text in the fold. Without labels of both
    kinds all texts get one score. An empty table gives an empty table.
    """
    model = model or fit(docs, labels, folds=folds, fold=fold, id_col=id_col, text_col=text_col)

    def score(batches):
        for batch in pieces(batches, "text", 1 << 20):
            s = model.scores(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
