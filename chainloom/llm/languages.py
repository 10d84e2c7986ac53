"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions, gives every position
a probability of each language, and the mean over the positions is the
document's. It is trained in numpy by backpropagation through time on whole
texts of a bounded sample of labelled rows, at places drawn anew in each step. A text is read in segments that overlap
by MARGIN bytes, so all positions of all texts of a piece advance together; a
position is labelled by the segment that it is not in the margin of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.samples import chosen, fresh
from chainloom.llm.text import bounded, pieces, raw

#: Units of each direction; bytes of a segment that are labelled; of its margins.
UNITS, SEGMENT, MARGIN = 12, 240, 8
#: Segments that are read at once.
BATCH = 2048
#: Labelled rows that training takes at most, bytes of their texts together, and steps.
SAMPLE, SAMPLE_BYTES, STEPS = 3000, 24 << 20, 260
UND = "und"
#: The symbol of a place outside the text, which leaves the state as it is: its update gate stays shut.
PAD, SHUT = 256, -30


def held_out(doc_id, folds: int, fold: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


class Direction:
    """One direction's weights: of the symbols (update, reset, candidate), and of the state."""

    def __init__(self, rng, units: int):
        scale = 1 / np.sqrt(units)
        self.x = (rng.normal(size=(PAD + 1, 3 * units)) * 0.3).astype(np.float32)
        self.x[PAD] = 0
        self.x[PAD, :units] = SHUT
        self.gates = (rng.normal(size=(units, 2 * units)) * scale).astype(np.float32)
        self.state = (rng.normal(size=(units, units)) * scale).astype(np.float32)

    def weights(self):
        return [self.x, self.gates, self.state]

    def forward(self, symbols: np.ndarray, keep: bool = False):
        """States after each symbol of a (time, batch) array; with what the way back needs."""
        time, batch = symbols.shape
        k = self.state.shape[0]
        h = np.zeros((batch, k), np.float32)
        out, tape = np.empty((time, batch, k), np.float32), []
        for t in range(time):
            g = self.x[symbols[t]]
            zr = h @ self.gates
            zr += g[:, : 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = (zr[:, k:] * h) @ self.state
            c += g[:, 2 * k :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, zr, c))
            h = h + zr[:, :k] * (c - h)
            out[t] = h
        return (out, tape) if keep else out

    def states(self, symbols: np.ndarray):
        """(t, state after symbol t), the state in an array that the next step overwrites.

        The same as forward, with the sigmoid written as a tanh and its factors
        taken into the weights: z = (1 + u) / 2 and r = (1 + v) / 2, where u and
        v are tanh of half the sums.
        """
        k, batch = self.state.shape[0], symbols.shape[1]
        xs = [np.ascontiguousarray(self.x[:, i * k : (i + 1) * k]) * np.float32(f) for i, f in enumerate((0.5, 0.5, 1))]
        update, reset = (np.ascontiguousarray(self.gates[:, i * k : (i + 1) * k]) * np.float32(0.5) for i in range(2))
        state = self.state * np.float32(0.5)
        h = np.zeros((batch, k), np.float32)
        u, v, c, g = (np.empty_like(h) for _ in range(4))
        for t, at in enumerate(symbols):
            np.matmul(h, reset, out=v)
            v += np.take(xs[1], at, axis=0, out=g, mode="clip")
            np.tanh(v, out=v)
            v *= h
            v += h
            np.matmul(v, state, out=c)
            c += np.take(xs[2], at, axis=0, out=g, mode="clip")
            np.tanh(c, out=c)
            np.matmul(h, update, out=u)
            u += np.take(xs[0], at, axis=0, out=g, mode="clip")
            np.tanh(u, out=u)
            c -= h
            c *= np.float32(0.5)
            h += c
            c *= u
            h += c
            yield t, h

    def backward(self, symbols: np.ndarray, tape, dout: np.ndarray):
        """Gradients of the weights, by backpropagation through time."""
        time, batch = symbols.shape
        k = self.state.shape[0]
        dgates, dstate = np.zeros_like(self.gates), np.zeros_like(self.state)
        dx, dh = np.empty((time, batch, 3 * k), np.float32), np.zeros((batch, k), np.float32)
        for t in range(time - 1, -1, -1):
            h, zr, c = tape[t]
            z, r = zr[:, :k], zr[:, k:]
            dh = dh + dout[t]
            dc = dh * z * (1 - c * c)
            through = dc @ self.state.T
            dgate = np.concatenate([dh * (c - h), through * h], 1) * zr * (1 - zr)
            dstate += (r * h).T @ dc
            dgates += h.T @ dgate
            dx[t, :, : 2 * k], dx[t, :, 2 * k :] = dgate, dc
            dh = dh * (1 - z) + through * r + dgate @ self.gates.T
        flat, order = symbols.ravel(), np.argsort(symbols.ravel(), kind="stable")
        at = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grad = np.zeros_like(self.x)
        grad[flat[order][at]] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], at)
        grad[PAD] = 0
        return [grad, dgates, dstate]


class Network:
    """Two directions and a linear layer on both states."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.along, self.back = Direction(rng, units), Direction(rng, units)
        self.top = (rng.normal(size=(2 * units, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def probabilities(self, symbols: np.ndarray, keep: bool = False):
        """(time, batch, language) of (time, batch) symbols."""
        ahead = self.along.forward(symbols, keep)
        behind = self.back.forward(symbols[::-1], keep)
        states = np.concatenate([(ahead[0] if keep else ahead), (behind[0] if keep else behind)[::-1]], 2)
        scores = states @ self.top + self.bias
        scores -= scores.max(2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(2, keepdims=True)
        return (scores, states, ahead[1], behind[1]) if keep else scores

    def step(self, symbols: np.ndarray, labels: np.ndarray):
        """Loss and gradients; each position's label is its document's."""
        p, states, ahead, behind = self.probabilities(symbols, keep=True)
        inside = (symbols != PAD).astype(np.float32)
        weight = inside / max(inside.sum(), 1)
        cols = np.arange(len(labels))
        loss = -(np.log(p[:, cols, labels] + 1e-9) * weight).sum()
        d = p.copy()
        d[:, cols, labels] -= 1
        d *= weight[:, :, None]
        k = self.top.shape[0] // 2
        dtop = np.einsum("tbk,tbl->kl", states, d, optimize=True)
        dstates = d @ self.top.T
        grads = self.along.backward(symbols, ahead, dstates[:, :, :k])
        grads += self.back.backward(symbols[::-1], behind, dstates[::-1, :, k:])
        return loss, [*grads, dtop, d.sum((0, 1))]

    def weights(self):
        return [*self.along.weights(), *self.back.weights(), self.top, self.bias]

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; zeros where it has no byte."""
        sizes = np.diff(offsets)
        segments = -(-sizes // SEGMENT)
        out = np.zeros((len(sizes), len(self.languages)), np.float64)
        doc = np.repeat(np.arange(len(sizes)), segments)
        if not len(doc):
            return out
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
        begin, lo, hi = offsets[doc] + nth * SEGMENT, offsets[doc], offsets[doc + 1]
        for b in np.array_split(np.arange(len(doc)), -(-len(doc) // BATCH)):
            at = begin[b][None, :] + np.arange(-MARGIN, SEGMENT + MARGIN)[:, None]
            inside = (at >= lo[b]) & (at < hi[b])
            symbols = np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.int64), PAD)
            np.add.at(out, doc[b], self.summed(symbols, inside.astype(np.float32)).T)
        return out / np.maximum(sizes, 1)[:, None]

    def summed(self, symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Probabilities of (time, batch) symbols, summed over the positions inside that are in no margin: (language, batch)."""
        time, batch = symbols.shape
        k = len(self.top) // 2
        ahead, behind = (np.ascontiguousarray(w.T) for w in (self.top[:k], self.top[k:]))
        scores = np.empty((time, len(self.languages), batch), np.float32)
        for t, h in self.along.states(symbols):
            if MARGIN <= t < MARGIN + SEGMENT:
                np.matmul(ahead, h.T, out=scores[t])
        out, part = np.zeros(scores.shape[1:], np.float32), np.empty(scores.shape[1:], np.float32)
        for t, h in self.back.states(symbols[::-1]):
            t = time - 1 - t
            if MARGIN <= t < MARGIN + SEGMENT:
                p = scores[t]
                p += np.matmul(behind, h.T, out=part)
                p += self.bias[:, None]
                p -= p.max(0)
                np.exp(p, out=p)
                p *= inside[t] / p.sum(0)
                out += p
        return out


def trained(passages: list[bytes], labels: list[str], units: int = UNITS, steps: int = STEPS, seed: int = 11) -> Network:
    """A network fitted to passages by Adam."""
    net = Network(sorted(set(labels)), units, seed)
    if len(net.languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    index = {x: i for i, x in enumerate(net.languages)}
    y = np.array([index[x] for x in labels])
    by = [np.flatnonzero(y == i) for i in range(len(index))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    time, batch = 64, 192
    for step in range(1, steps + 1):
        rows = np.array([rng.choice(by[i % len(by)]) for i in range(batch)])
        symbols = np.full((time, batch), PAD, np.int16)
        for j, row in enumerate(rows):
            start = rng.integers(0, max(1, len(passages[row]) - time + 1))
            part = np.frombuffer(passages[row][start : start + time], np.uint8)
            symbols[: len(part), j] = part
        _, grads = net.step(symbols, y[rows])
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        for w, g, (m, v) in zip(net.weights(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", steps: int = STEPS) -> Network:
    """A network trained on at most sample rows with a language that are not of the held-out fold.

    Only such rows are counted and thinned, by a hash; their whole texts come
    to at most size bytes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out(F.col("id"), folds, fold))
    names = [F.col("id"), F.col("lang")]
    held = chosen(rows, names, sample, size, rows.count())
    h = F.xxhash64(*names, "text")
    got = rows.where(h.isin(held)).select(h.alias("h"), "text", "lang").distinct().collect() if held else []  # what chosen has bounded
    got.sort(key=lambda r: r.h)
    return trained([r.text.encode() for r in got], [r.lang for r in got], steps=steps)


def predicted(docs: DataFrame, net: Network, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang (a learned language, or und) and score added; see samples.fresh for names that are free.

    und, with score 0, if the text is null or has no letter, or nothing was
    learned. Whole texts are read, however long. All columns are kept.
    """
    if len(set(fresh(docs.columns, lang, score)) & {lang, score}) < 2:
        raise ValueError(f"{lang} and {score} must not be columns already")

    def label(batches):
        for batch in pieces(batches, text_col, 512 << 10):
            data, offsets = raw(batch.column(text_col))
            letter = np.flatnonzero(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))
            some = np.diff(np.searchsorted(letter, offsets)) > 0
            for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
                some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            if net.languages:
                p = net.pooled(data, offsets)
                best = p.argmax(1)
                names = [net.languages[b] if s else UND for b, s in zip(best, some, strict=True)]
                sure = np.where(some, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            else:
                names, sure = [UND] * len(some), np.zeros(len(some))
            columns = {name: batch.column(name) for name in batch.schema.names} | {lang: pa.array(names), score: pa.array(sure)}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    own = bounded(docs).withColumns({lang: F.lit(""), score: F.lit(0.0)})
    return own.mapInArrow(label, own.schema)


def languages(docs: DataFrame, net: Network | None = None, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs; see predicted for the cases.

    Without net one is fitted to docs' own column lang. A null doc_id counts as
    the empty text in the fold. An empty table gives an empty table.
    """
    net = net or fit(docs, folds=folds, fold=fold, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = predicted(rows, net)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
