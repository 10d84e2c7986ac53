"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of a document. The minimiser of a window
is the least hash of its runs of MINIMISER words; consecutive windows of a
document that share it travel as one packed string to the minimiser's bucket,
so equal windows meet. There the windows are sorted by a hash, and neighbours
of one hash are compared in full, which counts them exactly.

Copies of a packed string within a task are merged before they travel; their
windows are known to repeat. A pass over all documents weighs the buckets. The
windows of one that is too heavy for a task go one by one to buckets of their
own hash, where copies are merged as they come in, so no bucket grows with the
number of times that a passage occurs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.text import SPACES, U, Words, bounded, is_long, mixed, pieces, sections, spans

WINDOW, MINIMISER = 35, 4
#: Windows of a packed string at most; bytes of text that a task packs at once.
RUN, FLUSH = 255, 24 << 20
#: Bytes of packed strings that a bucket is meant to hold, those from which its windows go alone, and the buckets that
#: even out the tasks of smaller inputs.
BUCKET, HEAVY, EVEN = 4 << 20, 16 << 20, 4096
#: Flags of a packed string: it is known to repeat; its document has no doc_id.
TWICE, NULL = 1, 2

#: A packed string in a blob: the document (doc_id and hash of its text), first word, windows, flags.
HEADER = np.dtype([("id", "<i8"), ("text", "<i8"), ("at", "<i8"), ("n", "<u2"), ("flags", "<u1")])
LEVEL = 5


def pressed(head: np.ndarray, body: bytes) -> bytes:
    """Headers, column by column, and the packed strings, compressed."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*(head[c].tobytes() for c in HEADER.names), body]))


def opened(n: int, blob: bytes) -> tuple[np.ndarray, bytes]:
    """The n headers and the packed strings of a blob."""
    data, head, at = zstandard.ZstdDecompressor().decompress(blob), np.zeros(n, HEADER), 0
    for c in HEADER.names:
        size = n * HEADER[c].itemsize
        head[c] = np.frombuffer(data[at : at + size], HEADER[c])
        at += size
    return head, data[at:]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; the last n - 1 places are not to be used."""
    out = np.zeros(len(values), U)
    if len(values) >= n:
        start = np.arange(len(values) - n + 1)
        out[: len(start)] = mixed(spans(values, start, start + n))
    return out


def minimisers(words: np.ndarray, window: int, m: int) -> np.ndarray:
    """Of the window that starts at each word: the least hash of its runs of m words."""
    h, width, done = rolling(words, m), window - m + 1, 1
    while done < width:
        step = min(done, width - done)
        h[: len(h) - step] = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return h


class Deal:
    """The bucket of each window: that of its minimiser, or one of its own where that is heavy."""

    def __init__(self, buckets: int, heavy: np.ndarray | None = None, spread: int = 1):
        self.buckets, self.heavy, self.spread = buckets, np.zeros(0, np.int64) if heavy is None else heavy, spread

    def packs(self, w: Words, window: int, m: int):
        """(document, first word, windows, bucket) of the packed strings of a piece, and the hashes of its words."""
        whole = np.maximum(w.n - window + 1, 0)
        at = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(whole)[:-1]]), whole) + np.arange(whole.sum())
        doc = np.repeat(np.arange(len(w.n)), whole)
        if not len(at):
            return doc, at, at, at, np.zeros(0, U)
        words = w.hashes()
        key = minimisers(words, window, m)[at]
        bucket = (mixed(key) % U(self.buckets)).astype(np.int64)
        alone = np.isin(bucket, self.heavy) if len(self.heavy) else np.zeros(len(key), bool)
        if alone.any():
            bucket[alone] = self.buckets + (mixed(rolling(words, window)[at[alone]]) % U(self.spread)).astype(np.int64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | alone[1:] | alone[:-1]])
        run = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        new |= (np.arange(len(new)) - begin[run]) % RUN == 0
        begin = np.flatnonzero(new)
        return doc[begin], at[begin], np.diff(np.concatenate([begin, [len(new)]])), bucket[begin], words


def _read(batches, window: int):
    """(batch, number of the first word, words) of pieces; of a long text in sections that share all but one word of a window."""
    for batch in pieces(batches, "text", 1 << 20):
        if is_long(batch):
            for base, _, w in sections(batch.column("text"), SPACES, overlap=window - 1):
                yield batch, base, w
        else:
            yield batch, 0, Words(batch.column("text"), SPACES)


class Packer:
    """Gathers packed strings and turns them into rows (bucket, n, blob).

    A negative n is of headers alone: of windows that are known to repeat.
    """

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.at: dict[bytes, int] = {}
        self.head: list[tuple] = []
        self.bucket: list[int] = []
        self.known: list[tuple] = []

    def add(self, batch: pa.RecordBatch, base: int, w: Words, doc, at, n, bucket, window: int):
        text, seen = w.text.tobytes(), self.at
        begin, end = w.start[at].tolist(), w.end[at + n + window - 2].tolist()
        ids = batch.column("doc_id")
        flags = pc.is_null(ids).to_numpy(zero_copy_only=False) * NULL
        ids, texts = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (ids, batch.column("key")))
        rows = zip(begin, end, bucket.tolist(), ids[doc].tolist(), texts[doc].tolist(), (at - w.first[doc] + base).tolist(), n.tolist(), flags[doc].tolist(), strict=True)
        for a, b, to, i, t, start, count, flag in rows:
            pack = text[a:b]
            k = seen.setdefault(pack, len(self.head))
            if k == len(self.head):
                self.head.append((i, t, start, count, flag))
                self.bucket.append(to)
            else:
                own = self.head[k]
                if not own[4] & TWICE:
                    self.known.append(own)
                    self.head[k] = (*own[:4], own[4] | TWICE)
                self.known.append((i, t, start, count, flag))
        self.size += len(text)

    @staticmethod
    def batch(bucket, n, blobs):
        return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])

    def rows(self):
        """A row for each bucket, and one for what is known to repeat."""
        if self.head:
            bucket = np.array(self.bucket)
            order = np.argsort(bucket, kind="stable")
            cut = np.concatenate([np.flatnonzero(np.diff(bucket[order], prepend=-1)), [len(order)]])
            head, text = np.array(self.head, HEADER), list(self.at)
            owns = [order[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            blobs = [pressed(head[own], b"\n".join([text[k] for k in own.tolist()])) for own in owns]
            yield self.batch(bucket[order][cut[:-1]], np.diff(cut), blobs)
        if self.known:
            parts = np.array_split(np.array(self.known, HEADER), max(1, len(self.known) // 4096))
            to = [int(p["text"][0]) % self.buckets for p in parts]
            yield self.batch(np.array(to), np.array([-len(p) for p in parts]), [pressed(p, b"") for p in parts])
        self.at, self.head, self.bucket, self.known, self.size = {}, [], [], [], 0


def repeated(head: np.ndarray, bodies: list[bytes], window: int) -> list[np.ndarray]:
    """(id, text, first window, windows, flags) of the windows of a bucket that occur at least twice, but for what is known to."""
    w = Words(pa.array([b"\n".join(bodies)], pa.large_binary()), SPACES)
    n = head["n"].astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n + window - 1)[:-1]])
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
    h = rolling(w.hashes(), window)[at]
    order = np.argsort(h, kind="stable")
    text, begin, end = w.text.tobytes(), w.start[at], w.end[at + window - 1]
    group = np.cumsum(np.concatenate([[0], (h[order][1:] != h[order][:-1]).astype(np.int64)])) if len(order) else np.zeros(0, np.int64)
    pairs = np.flatnonzero(group[1:] == group[:-1])
    left, right = order[pairs], order[pairs + 1]
    unlike = [k for k, a, b, c, d in zip(pairs.tolist(), begin[left].tolist(), end[left].tolist(), begin[right].tolist(), end[right].tolist(), strict=True) if text[a:b] != text[c:d]]
    for g in {int(group[k]) for k in unlike}:  # of one hash but not equal: told apart by their text
        own = np.flatnonzero(group == g)
        kinds: dict[bytes, int] = {}
        labels = np.array([kinds.setdefault(text[begin[order[k]] : end[order[k]]], len(kinds)) for k in own])
        by = np.argsort(labels, kind="stable")
        order[own] = order[own][by]
        group = group.astype(np.float64)
        group[own] = g + labels[by] / (len(kinds) + 1)
    _, inverse = np.unique(group, return_inverse=True)
    known = head["flags"] & TWICE
    weight = np.bincount(inverse, weights=1 + known[of[order]])
    twice = np.zeros(len(order), bool)
    twice[order] = weight[inverse] > 1
    twice &= known[of] == 0
    edge = np.diff(np.concatenate([[0], twice.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run of windows must not go over from one packed string to the next
    cuts = np.cumsum(n)
    ends = np.searchsorted(cuts, a, "right"), np.searchsorted(cuts, b - 1, "right")
    span = ends[1] - ends[0] + 1
    pack = np.repeat(ends[0], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    lo = np.maximum(np.repeat(a, span), cuts[pack] - n[pack])
    hi = np.minimum(np.repeat(b, span), cuts[pack])
    return [head["id"][pack], head["text"][pack], head["at"][pack] + (lo - cuts[pack] + n[pack]), hi - lo, head["flags"][pack]]


class Bucket:
    """The packed strings of a bucket; copies are merged whenever they have doubled."""

    def __init__(self, heavy: int = HEAVY):
        self.heads: list[np.ndarray] = []
        self.bodies: list[bytes] = []
        self.size, self.heavy, self.full = 0, heavy, heavy

    def add(self, head: np.ndarray, body: bytes):
        """Takes in a blob; gives the headers of what turns out to repeat."""
        self.heads.append(head)
        self.bodies.append(body)
        self.size += len(body)
        return self.merged() if self.size > self.full else None

    def merged(self) -> np.ndarray:
        head, seen, known, keep = np.concatenate(self.heads), {}, [], []
        for k, pack in enumerate(b"\n".join(self.bodies).split(b"\n")):
            first = seen.setdefault(pack, k)
            if first == k:
                keep.append(k)
                continue
            if not head["flags"][first] & TWICE:
                known.append(first)
            if not head["flags"][k] & TWICE:
                known.append(k)
            head["flags"][first] |= TWICE
        out = head[known]
        self.heads, self.bodies = [head[keep]], [b"\n".join(seen)]
        self.size = len(self.bodies[0])
        self.full = max(self.heavy, 2 * self.size)
        return out


def dealt(docs: DataFrame, window: int, m: int, bucket: int = BUCKET, heavy: int = HEAVY) -> Deal:
    """Buckets for docs(doc_id, text): their number by the bytes of text, the heavy ones by weighing all of them.

    Those that reach the driver are as many as all packed strings have times
    the bytes heavy, at most.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, total * 3 // bucket, min(EVEN, total * 3 // (bucket // 4)))
    deal = Deal(buckets)

    def weigh(batches):
        held, size = [], 0

        def rows():
            h, to, n = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.unique(h, return_index=True)[1]  # a task's copies travel once
            to, of = np.unique(to[first], return_inverse=True)
            return pa.record_batch([pa.array(to), pa.array(np.bincount(of, weights=n[first]).astype(np.int64))], names=["bucket", "n"])

        for _, _, w in _read(batches, window):
            _, at, n, to, words = deal.packs(w, window, m)
            if len(at):
                last = at + n + window - 1
                held.append((spans(words, at, last), to, w.end[last - 1] - w.start[at]))
            size += len(w.text)
            if size > FLUSH and held:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    full = docs.select("text").mapInArrow(weigh, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > heavy).toArrow()
    if full.num_rows:
        # a window alone takes all its words along
        deal.spread = max(8, int(pc.sum(full.column("n")).as_py()) * window // (3 * bucket))
        deal.heavy = np.sort(full.column("bucket").to_numpy())
    return deal


def repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, heavy: int = HEAVY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, key, at, n): windows at .. at + n - 1 of the document occur elsewhere too.

    key is a hash of doc_id and text; together they name a document.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    deal = dealt(docs, window, m, heavy=heavy)

    def pack(batches):
        packer = Packer(deal.buckets)
        for batch, base, w in _read(batches, window):
            packer.add(batch, base, w, *deal.packs(w, window, m)[:4], window)
            if packer.size > FLUSH:
                yield from packer.rows()
        yield from packer.rows()

    def count(batches):
        own, current = Bucket(heavy), None

        def out(columns):
            if len(columns[0]):
                ids = pa.array(columns[0], pa.int64(), mask=(columns[4] & NULL) > 0)
                yield pa.record_batch([ids, *(pa.array(c.astype(np.int64)) for c in columns[1:4])], names=["doc_id", "key", "at", "n"])

        def listed(head):
            return out([head[c] for c in HEADER.names])

        def done():
            if own.heads:
                yield from out(repeated(np.concatenate(own.heads), own.bodies, window))

        for batch in batches:
            for bucket, n, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                n = n.as_py()
                head, body = opened(abs(n), blob.as_py())
                if n < 0:
                    yield from listed(head)
                    continue
                if bucket.as_py() != current:
                    yield from done()
                    own, current = Bucket(heavy), bucket.as_py()
                known = own.add(head, body)
                if known is not None:
                    yield from listed(known)
        yield from done()

    packed = docs.mapInArrow(pack, "bucket long, n int, blob binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "doc_id long, key long, at long, n long")


def _kept(texts: pa.Array, at: np.ndarray, n: np.ndarray, of: np.ndarray, window: int):
    """(words, words removed, kept text) of each text, given the runs of repeated windows and whose they are."""
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > 0:
        words = gone = 0
        kept = bytearray()
        for base, _, w in sections(texts, SPACES):
            cover = np.zeros(w.count + 1, np.int64)
            np.add.at(cover, np.clip(at - base, 0, w.count), 1)
            np.add.at(cover, np.clip(at + n + window - 1 - base, 0, w.count), -1)
            out = np.cumsum(cover[:-1]) > 0
            kept += w.text[~np.repeat(out, w.end - w.start + 1)].tobytes()
            words, gone = words + w.count, gone + int(out.sum())
        return np.array([words]), np.array([gone]), [bytes(memoryview(kept)[: max(0, len(kept) - 1)])]
    w = Words(texts, SPACES)
    begin, cover = at + w.first[of], np.zeros(w.count + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + n + window - 1, -1)
    out = np.cumsum(cover[:-1]) > 0
    sizes = w.end - w.start + 1
    text = w.text[~np.repeat(out, sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(np.where(out, 0, sizes))])[w.first].tolist()
    left = np.concatenate([[0], np.cumsum(out)])[w.first]
    return w.n, np.diff(left), [text[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def kept_words(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256), one row per row of docs.

    A word goes if a window that covers it starts anywhere else too; kept is
    the other words joined by one space. A null or empty text has no words.
    A text of any length is read, a long one in sections; a null doc_id is a
    name like any other. Rows that repeat doc_id and text are two places, so their windows repeat.
    An empty table gives an empty table; other columns are not looked at.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = repeats(rows, window, m, heavy).groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "runs")
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    joined = rows.join(found, rows["key"].eqNullSafe(found["__key"]) & rows["doc_id"].eqNullSafe(found["__id"]), "left")

    def cut(batches):
        for batch in pieces(batches, "text", 2 << 20):
            runs = batch.column("runs")
            lists = runs.fill_null([]) if runs.null_count else runs
            each = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(lists)
            at, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            words, gone, kept = _kept(batch.column("text"), at, n, np.repeat(np.arange(batch.num_rows), each), window)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(words.astype(np.int64)),
                    pa.array(gone.astype(np.int64)),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return joined.select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
