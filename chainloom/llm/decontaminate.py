"""Benchmark decontamination as a prefix-filtered set join.

A window of an item is a run of words; as a set it has the shingles of SHINGLE
words in it, each with its place. All shingles of items are ordered by rarity,
which is how often the documents hold them, counted exactly. A document that
holds a window holds all its shingles, so also the rarest: the necessary prefix
of a window is this one shingle. Documents and windows are joined on it. The
place of the shingle in the window and the words of the window bound where in
the document the window can lie; the words there, which travel with the
shingle, are compared with those of the window in full.

Documents emit only shingles that may be a prefix: a bitmap of a bounded number
of bits tells, and errs only to one side. The windows are a table that Spark
joins; none of it passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.samples import fresh
from chainloom.llm.text import ALNUM, U, Words, bounded, is_long, mixed, pieces, sections, spans
from chainloom.session import written

#: Words of a shingle; bits of the bitmap for each shingle, and of the bitmap at most.
SHINGLE, SPARSE, BITS = 4, 16, 1 << 27


def tokens(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of size words within a text; runs of other sizes have other hashes."""
    last = np.arange(w.count) + size - 1
    at = np.flatnonzero(last < np.repeat(w.first[1:], w.n))
    return at, mixed(spans(w.text, w.start[at], w.end[last[at]]) + U(size))


class Bitmap:
    """Which hashes may be there: two bits for each."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, U(len(cells) * 64 - 1)

    @staticmethod
    def of(hashes: DataFrame, count: int) -> Bitmap:
        """Of a table (token); built in Spark, at most BITS / 64 numbers reach the driver."""
        bits = 1 << 16
        while bits < min(BITS, count * SPARSE):
            bits *= 2
        two = F.array("token", F.shiftrightunsigned("token", 32))
        bit = hashes.select(F.explode(two).alias("t")).select(F.col("t").bitwiseAND(F.lit(bits - 1)).alias("t"))
        cells = bit.groupBy(F.shiftright("t", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(t & 63 as int))")).alias("x")).toArrow()
        out = np.zeros(bits // 64, np.int64)
        out[cells.column("cell").to_numpy()] = cells.column("x").to_numpy()
        return Bitmap(out.view(U))

    def may(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be there."""

        def hit(h):
            h = h & self.mask
            return (self.cells[(h >> U(6)).astype(np.int64)] >> (h & U(63)) & U(1)).astype(bool)

        first = np.flatnonzero(hit(hashes))
        return first[hit(hashes[first] >> U(32))]


def _read(batches, overlap: int):
    """(batch, number of the first word, words that the section before held too, words); a long text comes in sections."""
    for batch in pieces(batches, "text", 2 << 20):
        if is_long(batch):
            for base, held, w in sections(batch.column("text"), ALNUM, lower=True, overlap=overlap):
                yield batch, base, held, w
        else:
            yield batch, 0, 0, Words(batch.column("text"), ALNUM, lower=True)


def item_tokens(items: DataFrame, window: int) -> DataFrame:
    """items(text, item) -> (item, at, size, token): the shingles of each item; size is less only where the item is one shorter window."""

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            w = Words(batch.column("text"), ALNUM, lower=True)
            out, top = [], min(SHINGLE, window)
            for size in range(1, top + 1):
                at, h = tokens(w, size)
                of = np.searchsorted(w.first, at, "right") - 1
                own = (w.n[of] == size) if size < top else np.ones(len(at), bool)
                out.append((of[own], at[own] - w.first[of[own]], np.full(own.sum(), size), h[own]))
            of, at, size, h = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([batch.column("item").take(pa.array(of)), pa.array(at, pa.int64()), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64))], names=["item", "at", "size", "token"])

    return bounded(items).select("text", "item").mapInArrow(run, "item long, at long, size int, token long")


def rarity(docs: DataFrame, vocabulary: DataFrame, bitmap: Bitmap, sizes: list[int]) -> DataFrame:
    """(token, often): how often docs(text) hold each shingle of the vocabulary."""

    def run(batches):
        for batch, _, held, w in _read(batches, SHINGLE - 1):
            found = []
            for size in sizes:
                at, h = tokens(w, size)
                if held:  # runs that the section before has counted
                    h = h[at + size > held]
                found.append(h[bitmap.may(h)])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("often"))
    return vocabulary.join(counts, "token", "left").select("token", F.coalesce("often", F.lit(0)).alias("often"))


def windows(items: DataFrame, ranked: DataFrame, window: int) -> DataFrame:
    """(item, token, size, offset, n, body): each window of an item that documents may hold, under its rarest shingle.

    ranked: (item, at, often) of the items' shingles. A window with a shingle
    that no document has is left out.
    """
    order = ranked.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "often"))), lambda x: x["often"]).alias("often"))
    names = ["item", "token", "size", "offset", "n", "body"]

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            w = Words(batch.column("text"), ALNUM, lower=True)
            text, kinds = w.text.tobytes(), {size: dict(zip(*(x.tolist() for x in tokens(w, size)), strict=True)) for size in {min(SHINGLE, window, int(n)) for n in w.n if n}}
            rows = []
            for d, (item, often) in enumerate(zip(batch.column("item").to_pylist(), batch.column("often"), strict=True)):
                first, count = int(w.first[d]), int(w.n[d])
                if not count:
                    continue
                n, size = min(window, count), min(SHINGLE, window, count)
                often = often.values.to_numpy()
                view = np.lib.stride_tricks.sliding_window_view(often, n - size + 1)
                best = view.argmin(1)
                for i in np.flatnonzero(view[np.arange(len(view)), best] > 0).tolist():
                    k = first + i
                    rows.append((item, kinds[size][k + int(best[i])], size, int(best[i]), n, text[w.start[k] : w.end[k + n - 1]]))
            if rows:
                item, token, size, offset, n, body = zip(*rows, strict=True)
                token = np.array(token, U).view(np.int64)
                yield pa.record_batch([pa.array(item, pa.int64()), pa.array(token), *(pa.array(x, pa.int32()) for x in (size, offset, n)), pa.array(body, pa.binary()).cast(pa.string())], names=names)

    joined = items.join(order, "item").select("text", "item", "often")
    return bounded(joined).mapInArrow(run, "item long, token long, size int, offset int, n int, body string")


FOUND = "array<struct<token:bigint,at:bigint,before:int,near:string>>"


def met(rows: DataFrame, prefixes: Bitmap, sizes: list[int], window: int) -> DataFrame:
    """rows(text, ...) without text but with n_words and found: the shingles that may be a prefix, each with the words around it.

    at is the number of the shingle's first word in the document, near the
    words that a window with the shingle can hold, before how many of them lie
    before the shingle.
    """
    rest = [c for c in rows.columns if c != "text"]
    kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("near", pa.string())]))

    def candidates(w: Words, base: int, held: int, last: bool) -> tuple[np.ndarray, pa.StructArray]:
        """Whose they are, and the candidates that no other section has."""
        at, h = [], []
        for size in sizes:
            a, x = tokens(w, size)
            own = prefixes.may(x)
            at.append(a[own]), h.append(x[own])
        at, h = np.concatenate(at), np.concatenate(h)
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
        reach = window - 1
        if held or not last:  # the section that has all around it takes it; sections share 2 * window words
            own = np.ones(len(at), bool)
            if held:
                own &= at >= window
            if not last:
                own &= at < w.count - window
            at, h = at[own], h[own]
        of = np.searchsorted(w.first, at, "right") - 1
        lo, hi = np.maximum(at - reach, w.first[of]), np.minimum(at + window, w.first[of + 1])
        text = w.text.tobytes()
        near = [text[a:b] for a, b in zip(w.start[lo].tolist(), w.end[hi - 1].tolist(), strict=True)]
        fields = [pa.array(h.view(np.int64)), pa.array((at - w.first[of] + base).astype(np.int64)), pa.array((at - lo).astype(np.int32)), pa.array(near, pa.binary()).cast(pa.string())]
        return of, pa.StructArray.from_arrays(fields, fields=list(kind.value_type))

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            if is_long(batch):
                n, parts, size = 0, [], window * 2
                every = sections(batch.column("text"), ALNUM, lower=True, overlap=size)
                one = next(every)
                while one:
                    after = next(every, None)
                    base, held, w = one
                    parts.append(candidates(w, base, held, after is None)[1])
                    n, one = base + w.count, after
                counts, values = np.array([n]), pa.concat_arrays(parts)
                offsets = np.array([0, len(values)])
            else:
                w = Words(batch.column("text"), ALNUM, lower=True)
                of, values = candidates(w, 0, 0, True)
                counts, offsets = w.n, np.searchsorted(of, np.arange(batch.num_rows + 1))
            found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(counts.astype(np.int64)), found], names=[*rest, "n_words", "found"])

    schema = rows.select(*rest, F.lit(0).cast("long").alias("n_words"), F.array().cast(FOUND).alias("found")).schema
    return rows.mapInArrow(run, schema)


def key_of(id_: Column, text: Column) -> list[Column]:
    """Columns that name a row by its doc_id and text; rows that they can't tell apart have the same hits."""
    return [id_.alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size")]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"]) & (a["size"] == b["size"])


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, holders).

    rows: (doc_id, h, size, n_words), one per row of docs. hits: (doc_id, h,
    size, start, n, body), each occurrence of a window once. holders: (body,
    item_id), the items of each window that occurs.
    """
    own = bounded(docs).select(*key_of(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    held = items.select(F.coalesce(F.col(item_text_col), F.lit("")).alias("text"), F.col(item_col).alias("id"))
    # an item is named by its text: items of one text have the same windows
    named = held.withColumn("item", F.xxhash64("text"))
    distinct = named.select("text", "item").dropDuplicates(["item"])
    shingles = written(item_tokens(distinct, window), "decontaminate-shingles")
    vocabulary = written(shingles.select("size", "token").distinct(), "decontaminate-vocabulary")
    sizes = [r.size for r in vocabulary.select("size").distinct().collect()] or [SHINGLE]  # as many as words of a shingle at most
    often = written(rarity(own, vocabulary.select("token"), Bitmap.of(vocabulary, vocabulary.count()), sizes), "decontaminate-rarity")
    every = written(windows(distinct, shingles.join(often, "token").select("item", "at", "often"), window), "decontaminate-windows")
    prefixes = written(every.groupBy("token", "size", "offset", "n", "body").agg(F.count("*").alias("holders")), "decontaminate-prefixes")
    tokens_ = prefixes.select("token").distinct()
    seen = written(met(own, Bitmap.of(tokens_, tokens_.count()), sizes, window), "decontaminate-met")
    c = seen.select("doc_id", "h", "size", F.explode("found").alias("c")).select("doc_id", "h", "size", "c.*")
    both = c.join(prefixes.select("token", "offset", "n", "body"), "token")
    # where the window begins among the words around the shingle, and whether it can
    begin = F.col("before") - F.col("offset")
    there = F.array_join(F.slice(F.split("near", " "), F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ")
    hits = both.where((begin >= 0) & (there == F.col("body"))).select("doc_id", "h", "size", (F.col("at") - F.col("offset")).alias("start"), "n", "body").distinct()
    holders = every.select("item", "body").join(named.select("item", "id").where("id is not null"), "item").select("body", F.col("id").cast("string").alias("item_id")).distinct()
    return seen.drop("found"), written(hits, "decontaminate-hits"), holders


SPANS = "array<struct<begin:bigint,end:bigint>>"


def _covered(hits: DataFrame) -> DataFrame:
    """(doc_id, h, size, spans): of each document the runs of hit words, as structs of begin and end, in order."""
    kind = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def merged(batches):
        for batch in batches:
            runs = batch.column("runs")
            each, flat = runs.value_lengths().to_numpy(), runs.flatten()
            doc = np.repeat(np.arange(batch.num_rows), each)
            begin = flat.field("start").to_numpy()
            end = begin + flat.field("n").to_numpy()
            order = np.lexsort((begin, doc))
            doc, begin, end = doc[order], begin[order], end[order]
            stride = int(end.max(initial=0)) + 2  # documents apart, so that one running maximum serves all
            far = np.maximum.accumulate(end + doc * stride)
            new = np.ones(len(doc), bool)
            new[1:] = begin[1:] + doc[1:] * stride > far[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            spans_ = pa.StructArray.from_arrays([pa.array(begin[first]), pa.array(far[last] - doc[first] * stride)], fields=list(kind))
            offsets = np.searchsorted(doc[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "h", "size")] + [pa.ListArray.from_arrays(pa.array(offsets), spans_)], names=["doc_id", "h", "size", "spans"])

    own = hits.select("doc_id", "h", "size", "start", "n").distinct().groupBy("doc_id", "h", "size").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return own.mapInArrow(merged, own.select("doc_id", "h", "size", F.array().cast(SPANS).alias("spans")).schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, items, spans, contaminated), one row per row of docs.

    items: the ids of items with occurring windows, as strings in order; spans:
    the runs of hit words. A null or empty text has no words; an item without
    words has no window; of a null item_id the windows count but no id is
    listed; items and rows may repeat. Ids may be of any type. A text of any
    length is read, a long one in sections. Without items nothing is hit; an
    empty table gives an empty table; other columns are not looked at.
    """
    rows, hits, holders = occurrences(docs, items, window, **names)
    covered = _covered(hits)
    own = hits.select("doc_id", "h", "size", "body").distinct().join(holders, "body").select("doc_id", "h", "size", "item_id").distinct()
    listed = own.groupBy("doc_id", "h", "size").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = covered.join(listed, _same(covered, listed), "left").select(covered["doc_id"], covered["h"], covered["size"], "spans", "items")
    out = rows.join(found, _same(rows, found), "left").select(rows["doc_id"], "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "items",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, **names) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns; see contamination for the cases."""
    _, hits, _ = occurrences(docs, items, window, **names)
    keys = fresh(docs.columns, "doc_key", "text_hash", "text_size")
    gone = hits.select("doc_id", "h", "size").distinct().toDF(*keys)
    mine = [c.alias(k) for c, k in zip(key_of(F.col(names.get("id_col", "doc_id")), F.col(names.get("text_col", "text"))), keys, strict=True)]
    own = docs.select("*", *mine)
    on = own[keys[0]].eqNullSafe(gone[keys[0]]) & (own[keys[1]] == gone[keys[1]]) & (own[keys[2]] == gone[keys[2]])
    return own.join(gone, on, "left_anti").drop(*keys)
