"""SentencePiece encoding and decoding by suffix-array matching.

The distinct stretches of a batch between white space are put one after
another and indexed by a suffix array. Every piece of the vocabulary is looked
up by binary search, which gives the range of the suffixes that start with it,
so all its occurrences at once. These edges, sorted by position, make a
lattice of each stretch. It is relaxed as the model asks: for a unigram model
by the best score of each position, for a BPE model in order of the merges,
always the best-scored edge over two adjacent symbols, the leftmost of equals.

A stretch is a run of white space and what follows it. No piece holds white
space after something else, which is checked when a model is read, so the
stretches of a text are encoded alone.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.text import bounded, mixed, pieces, raw, spans

SPACE = "▁"
#: Bytes of text that are encoded at once, and symbols of a stretch from which it is relaxed alone.
BATCH, LONG = 2 << 20, 40
GAP = 0xFF  # in no UTF-8 text


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message; nested messages as bytes."""

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    at = 0
    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """The vocabulary and settings of a .model file, or of given values."""

    def __init__(self, path: str | None = None, vocabulary: list[tuple[str, float]] = (), bpe: bool = True, byte_ids: list[int] | None = None, unknown: int = 0, dummy_prefix: bool = True):
        self.bpe, self.unknown, self.dummy_prefix = bpe, unknown, dummy_prefix
        self.byte_ids = np.array(byte_ids, np.int32) if byte_ids else None
        normal = list(enumerate(vocabulary))
        texts = [p for p, _ in vocabulary]
        if path:
            normal, texts, bytes_ = [], [], {}
            with open(path, "rb") as f:
                message = list(_fields(f.read()))
            for number, value in message:
                if number == 1:
                    own = dict(_fields(value))
                    piece, score, kind = own[1].decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, 1)
                    if kind == 1:
                        normal.append((len(texts), (piece, score)))
                    elif kind == 6:
                        bytes_[int(piece[1:-1], 16)] = len(texts)
                    elif kind == 2:
                        self.unknown = len(texts)
                    elif kind in (4, 5):  # the first are never merged with others, the second are split
                        raise ValueError("user-defined and unused pieces are not supported")
                    texts.append(piece if kind == 1 else "")
                elif number == 2:
                    self.bpe = dict(_fields(value)).get(3, 1) == 2
                elif number == 3:
                    rules = dict(_fields(value))
                    if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                        raise ValueError("only models that keep texts as they are, but for white space, are supported")
                    self.dummy_prefix = bool(rules.get(3, 1))
            if len(bytes_) == 256:
                self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int32)
        self.texts = [t.replace(SPACE, " ").encode() for t in texts]
        self.ids = np.array([i for i, _ in normal], np.int32)
        own = [p.replace(SPACE, " ").encode() for _, (p, _) in normal]
        self.scores = np.array([s for _, (_, s) in normal], np.float64)
        self.sizes = np.array([len(p) for p in own], np.int64)
        self.whole = any(b" " in p.lstrip(b" ") for p in own)  # then texts can't be cut at white space
        self.width = -(-int(self.sizes.max(initial=1)) // 8)
        low, high = np.zeros((len(own), self.width * 8), np.uint8), np.full((len(own), self.width * 8), 0xFF, np.uint8)
        for i, p in enumerate(own):
            low[i, : len(p)] = high[i, : len(p)] = np.frombuffer(p, np.uint8)
        self.low, self.high = low.view(">u8").astype(np.uint64), high.view(">u8").astype(np.uint64)
        # for decoding: the bytes of each id
        table = [bytes([b]) for b in range(256)]
        every = list(self.texts)
        if self.byte_ids is not None:
            for b, i in enumerate(self.byte_ids):
                every[i] = table[b]
        every[self.unknown] = every[self.unknown] or " ⁇ ".encode()
        self.out_size = np.array([len(x) for x in every], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_size)])
        self.out = np.frombuffer(b"".join(every), np.uint8)

    # -- the index -------------------------------------------------------

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces in data: (key, piece) by key, which is position * 512 + length."""
        n = len(data)
        padded = np.concatenate([data, np.full(8 * self.width + 8, GAP, np.uint8)]).astype(np.uint64)
        word = np.zeros(n + 8 * self.width, np.uint64)
        for k in range(8):
            word |= padded[k : k + len(word)] << np.uint64(56 - 8 * k)
        suffixes = np.argsort(word[:n])
        first = word[suffixes]
        lo, hi = np.searchsorted(first, self.low[:, 0], "left"), np.searchsorted(first, self.high[:, 0], "right")
        for k in range(1, self.width):  # suffixes are put in order by further bytes where longer pieces can start
            more = np.flatnonzero((self.sizes > 8 * k) & (lo < hi))
            begin, of = np.unique(lo[more], return_index=True)
            size = hi[more][of] - begin
            group = np.repeat(np.arange(len(begin)), size)
            rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            suffixes[rows] = suffixes[rows][np.lexsort((word[suffixes[rows] + 8 * k], group))]
            lo[more] = self._search(word, suffixes, 8 * k, lo[more], hi[more], self.low[more, k], False)
            hi[more] = self._search(word, suffixes, 8 * k, lo[more], hi[more], self.high[more, k], True)
        count = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(count)), count)
        at = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        packed = np.sort(((at * 512 + self.sizes[piece]) << 20) | piece)
        return packed >> 20, packed & ((1 << 20) - 1)

    @staticmethod
    def _search(word, suffixes, offset, lo, hi, target, right: bool) -> np.ndarray:
        """Binary searches, all at once, by the eight bytes at offset of the suffixes."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            value = word[suffixes[np.minimum(mid, len(suffixes) - 1)] + offset]
            up = open_ & ((value <= target) if right else (value < target))
            lo = np.where(up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)
        return lo

    # -- relaxation ------------------------------------------------------

    def encode_stretches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of stretches data[start:end], whose neighbours are parted by GAP."""
        key, piece = self.edges(data)

        def find(at, size):
            k = np.minimum(np.searchsorted(key, at * 512 + size), max(len(key) - 1, 0))
            return np.where((size < 512) & (key[k] == at * 512 + size), piece[k], -1) if len(key) else np.full(len(at), -1)

        begins = (data & 0xC0) != 0x80
        chars = np.flatnonzero(begins & (data != GAP))
        owner = np.searchsorted(start, chars, "right") - 1
        n = np.bincount(owner, minlength=len(start))
        first = np.cumsum(n) - n
        found_stretch, found_at, found_size = [], [], []

        def finished(stretch, at, size):
            found_stretch.append(stretch), found_at.append(at), found_size.append(size)

        ends = np.append(chars[1:], 0)
        last = first[n > 0] + n[n > 0] - 1
        ends[last] = end[n > 0]
        if self.bpe:
            for size in np.unique(n[(n > 0) & (n <= LONG)]):
                rows = np.flatnonzero(n == size)
                cols = first[rows][:, None] + np.arange(size)
                self._merge(rows, chars[cols], ends[cols] - chars[cols], find, finished)
            for row in np.flatnonzero(n > LONG):
                own = slice(first[row], first[row] + n[row])
                finished(*self._merge_long(row, chars[own], ends[own], find))
        else:
            self._best(key, piece, chars, ends, owner, finished)
        stretch, at, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_stretch, found_at, found_size))
        order = np.argsort(at, kind="stable")
        stretch, at, size = stretch[order], at[order], size[order]
        own = find(at, size)
        ids = np.where(own >= 0, self.ids[own], -1).astype(np.int32)
        unknown = np.flatnonzero(ids < 0)
        times = np.ones(len(ids), np.int64)
        if len(unknown) and self.byte_ids is not None:  # a byte piece for each of their bytes
            times[unknown] = size[unknown]
        out = np.repeat(ids, times)
        if len(unknown):
            if self.byte_ids is None:
                out[out < 0] = self.unknown
            else:
                where = np.flatnonzero(out < 0)
                within = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
                out[where] = self.byte_ids[data[np.repeat(at, times)[where] + within[where]]]
        total = np.bincount(np.repeat(stretch, times), minlength=len(start))
        return out, np.concatenate([[0], np.cumsum(total)])

    def _merge(self, rows, at, size, find, finished):
        """Merges of stretches of one number of symbols, a step in all of them at a time."""
        if at.shape[1] > 1:
            pair = find(at[:, :-1].ravel(), (size[:, :-1] + size[:, 1:]).ravel()).reshape(len(rows), -1)
            score = np.where(pair >= 0, self.scores[pair], -np.inf)
        while at.shape[1] > 1:
            best = score.argmax(1)
            row = np.arange(len(rows))
            live = score[row, best] > -np.inf
            if not live.all():
                done = ~live
                finished(np.repeat(rows[done], at.shape[1]), at[done].ravel(), size[done].ravel())
                rows, at, size, score, best = rows[live], at[live], size[live], score[live], best[live]
                row = np.arange(len(rows))
                if not len(rows):
                    return
            size[row, best] += size[row, best + 1]
            width = at.shape[1] - 1
            keep = np.arange(width) + (np.arange(width) > best[:, None])
            at, size = np.take_along_axis(at, keep, 1), np.take_along_axis(size, keep, 1)
            if width > 1:
                keep = np.arange(width - 1)
                score = np.take_along_axis(score, keep + (keep >= best[:, None]), 1)
                for shift in (-1, 0):
                    col = best + shift
                    ok = np.flatnonzero((col >= 0) & (col < width - 1))
                    new = find(at[ok, col[ok]], size[ok, col[ok]] + size[ok, col[ok] + 1])
                    score[ok, col[ok]] = np.where(new >= 0, self.scores[new], -np.inf)
        finished(np.repeat(rows, at.shape[1]), at.ravel(), size.ravel())

    def _merge_long(self, row, at, ends, find):
        """Merges of one long stretch, by a heap of its edges."""
        n = len(at)
        right, left, stop, alive = list(range(1, n + 1)), list(range(-1, n - 1)), ends.tolist(), [True] * n
        begin, heap = at.tolist(), []
        pair = find(at[:-1], ends[1:] - at[:-1]).tolist()
        for i, p in enumerate(pair):
            if p >= 0:
                heap.append((-self.scores[p], i, stop[i + 1], i + 1))
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i, j):
            span = (begin[i], stop[j] - begin[i])
            if span not in known:
                known[span] = int(find(np.array([span[0]]), np.array([span[1]]))[0])
            if known[span] >= 0:
                heapq.heappush(heap, (-self.scores[known[span]], i, stop[j], j))

        while heap:
            _, i, to, j = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or right[i] != j or stop[j] != to:
                continue
            stop[i], alive[j], right[i] = to, False, right[j]
            if right[j] < n:
                left[right[j]] = i
                push(i, right[j])
            if left[i] >= 0:
                push(left[i], i)
        own = [i for i in range(n) if alive[i]]
        begins = np.array([begin[i] for i in own])
        return np.full(len(own), row), begins, np.array([stop[i] for i in own]) - begins

    def _best(self, key, piece, chars, ends, owner, finished):
        """The path of the best total score through each stretch; a character that is no piece costs ten more than any."""
        floor = self.scores.min(initial=0) - 10
        edges: dict[int, list[tuple[int, float]]] = {}
        for k, p in zip(key.tolist(), piece.tolist(), strict=True):
            edges.setdefault(k // 512, []).append((k % 512, float(self.scores[p])))
        at = 0
        while at < len(chars):
            to = int(np.searchsorted(owner, owner[at], "right"))
            best, back = {int(chars[at]): 0.0}, {}
            for c, e in zip(chars[at:to].tolist(), ends[at:to].tolist(), strict=True):
                own = edges.get(c, [])
                for size, score in own if any(s == e - c for s, _ in own) else [*own, (e - c, floor)]:
                    if c + size <= ends[to - 1] and (c + size not in best or best[c] + score > best[c + size]):
                        best[c + size], back[c + size] = best[c] + score, c
            path, place = [], int(ends[to - 1])
            while place != chars[at]:
                path.append((back[place], place - back[place]))
                place = back[place]
            path = np.array(path[::-1], np.int64)
            finished(np.full(len(path), owner[at]), path[:, 0], path[:, 1])
            at = to

    # -- texts -----------------------------------------------------------

    def sections(self, array: pa.Array, size: int = BATCH):
        """Arrays of the parts of one text, cut before a space after another printable ASCII character: stretches stay whole."""
        data, _ = raw(array)
        at = 0
        while len(data) - at > size and not self.whole:
            to = at + size
            while to < len(data):
                part = data[to - 1 : to + 4096]
                safe = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
                if len(safe):
                    to += int(safe[0])
                    break
                to += 4096
            to = min(to, len(data))
            yield pa.array([data[at:to].tobytes()], pa.large_binary())
            at = to
        if at < len(data) or not at:
            yield pa.array([data[at:].tobytes()], pa.large_binary())

    def encode(self, array: pa.Array, begin: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; null and empty ones have no piece. begin: whether texts start here."""
        data, offsets = raw(array)
        if b"\xe2\x96\x81" in data.tobytes():  # the mark of white space itself
            texts = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = raw(pa.array(texts, pa.large_binary()))
        sizes = np.diff(offsets)
        if self.dummy_prefix and begin:  # one space before each text that is not empty
            some = sizes > 0
            shift = np.concatenate([[0], np.cumsum(some)])
            text = np.full(len(data) + int(some.sum()), 0x20, np.uint8)
            text[np.arange(len(data)) + np.repeat(shift[1:], sizes)] = data
            data, offsets = text, offsets + shift
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = data == 0x20
        cut = space & ~np.concatenate([[False], space[:-1]]) if not self.whole else np.zeros(n, bool)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        inverse, first = self._distinct(data, start, end)
        lengths = (end - start)[first]
        to = np.cumsum(lengths + 1) - 1
        packed = np.full(int(to[-1]) + 1, GAP, np.uint8)
        own = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        packed[own + np.repeat(to - lengths, lengths)] = data[own + np.repeat(start[first], lengths)]
        ids, at = self.encode_stretches(packed, to - lengths, to)
        count = np.diff(at)[inverse]
        out = ids[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1][inverse], count)]
        per = np.concatenate([[0], np.cumsum(count)])
        return out, per[np.searchsorted(start, offsets)]

    @staticmethod
    def _distinct(data, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Of each stretch the number of its text, and the first stretch of each number; told apart byte by byte."""
        h = mixed(spans(data, start, end))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        size = end - start
        like = first[inverse]
        same = size == size[like]
        if same.all():
            own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = data[own + np.repeat(start, size)] == data[own + np.repeat(start[like], size)]
        if not same.all():  # two texts of one hash
            text, seen = data.tobytes(), {}
            inverse = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(start, end, strict=True)])
            _, first = np.unique(inverse, return_index=True)
        return inverse, first

    def decode(self, ids: np.ndarray, offsets: np.ndarray, begin: bool = True) -> list[str]:
        """The texts that lists of ids stand for; bytes that are no UTF-8 become U+FFFD."""
        size = self.out_size[ids]
        text = self.out[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.out_at[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        cut = int(self.dummy_prefix and begin)
        return [text[a + (cut if text[a : a + 1] == b" " and b > a else 0) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, ids_sha256, round_trip), one row per row of docs.

    ids_sha256 is of the ids as little-endian 32-bit numbers; round_trip tells
    whether decoding gives the text back (U+2581 comes back as a space). A null
    or empty text has no piece; a long text is encoded in parts that are cut
    between stretches; a null doc_id stays null; repeated rows stay
    repeated; an empty table gives an empty table; other columns are not looked
    at. path must exist on every executor.
    """

    def encode(batches):
        model = Model(path)
        for batch in pieces(batches, "text", BATCH):
            if batch.num_rows == 1:
                parts, same = [], True
                for k, part in enumerate(model.sections(batch.column("text"))):
                    own, at = model.encode(part, not k)
                    same = same and model.decode(own, at, not k) == [part[0].as_py().decode().replace(SPACE, " ")]
                    parts.append(own)
                ids, good = np.concatenate(parts), [same]
                at = np.array([0, len(ids)])
            else:
                ids, at = model.encode(batch.column("text"))
                texts = [(t or "").replace(SPACE, " ") for t in batch.column("text").to_pylist()]
                good = [a == b for a, b in zip(model.decode(ids, at), texts, strict=True)]
            shas = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at)), lists, pa.array(shas), pa.array(good)], names=["doc_id", "n_pieces", "ids", "ids_sha256", "round_trip"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_pieces long, ids array<int>, ids_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""

    def decode(batches):
        model = Model(path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            texts = [None if x is None else t for x, t in zip(lists, model.decode(flat, at), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(decode, "doc_id long, text string")
