"""SimHash near-dedup at a similarity: near copies of a Jaccard similarity of 0.8 or more of their shingles.

Fingerprints link near copies first, as in simhash; each such link is verified
on the whole sets of shingles. Three bits reach only texts that are almost
equal, so what they don't reach is completed by a join over prefixes with
positional bounds, which compares no two texts that are linked already.

There a text is the set of its shingles. All sets are ordered by one order, rare
shingles first; two sets of Jaccard LEAST or more then share a shingle within
the first n - ceil(LEAST * n) + 1 of each, and at the first one they share as
many still follow as the overlap takes. So texts meet under the shingles of
their prefixes only, pairs that the positions rule out are left, and the others
are verified on their whole sets: no similar pair is lost. Of a crowded bucket
a few pivots are compared with all; what hangs together after that is not
compared again, so a large group of near copies takes no pairs by its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.components import components
from chainloom.llm.samples import fresh
from chainloom.llm.simhash import fingerprints
from chainloom.llm.simhash import links as linked
from chainloom.llm.text import LONG, SPACES, U, Words, bounded, mixed, pieces, sections, spans
from chainloom.session import discard, written

#: Words of a shingle. The least Jaccard similarity is 4/5, here in integers: 5 * overlap >= 4 * union.
SIZE = 5
#: Slots of the table of frequencies that orders the shingles; buckets of up to SMALL are compared in full, of others PIVOTS first.
SLOTS, SMALL, PIVOTS = 1 << 18, 32, 4


def shingled(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order; one of fewer words is one shingle, also one of none."""
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > LONG:
        h = np.unique(np.concatenate([np.unique(_hashes(w, size)[1]) for _, _, w in sections(texts, SPACES, lower=True, overlap=size - 1)]))
        return (np.zeros(len(h), np.int64), h) if len(h) else (np.zeros(1, np.int64), np.zeros(1, U))
    w = Words(texts, SPACES, lower=True)
    of, h = _hashes(w, size)
    none = np.flatnonzero(w.n == 0)
    of, h = np.concatenate([of, none]), np.concatenate([h, np.zeros(len(none), U)])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def _hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle."""
    short = np.minimum(w.n, size)
    last = np.arange(w.count) + np.repeat(np.maximum(short - 1, 0), w.n)
    starts = np.flatnonzero(last < np.repeat(w.first[1:], w.n))
    return np.repeat(np.arange(len(w.n)), w.n)[starts], mixed(spans(w.text, w.start[starts], w.end[last[starts]]))


def frequencies(keyed: DataFrame, size: int) -> np.ndarray:
    """How many shingles of texts fall into each of SLOTS slots."""

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in pieces([batch], "text", 1 << 20):
                n += np.bincount((shingled(part.column("text"), size)[1] % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(n[some])], names=["slot", "n"])

    got = keyed.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def prefixes(keyed: DataFrame, size: int) -> DataFrame:
    """(token, key, n, pos): the prefix of each text, n being its number of shingles."""
    often = frequencies(keyed, size)

    def prefix(batches):
        for batch in pieces(batches, "text", 1 << 20):
            of, h = shingled(batch.column("text"), size)
            order = np.lexsort((h, often[(h % U(SLOTS)).astype(np.int64)], of))
            h, n = h[order], np.bincount(of, minlength=batch.num_rows)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            keep = pos <= (n - (4 * n + 4) // 5)[of]
            of, h, pos = of[keep], h[keep], pos[keep]
            key = batch.column("key").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(key[of]), pa.array(n[of].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "key", "n", "pos"])

    return keyed.mapInArrow(prefix, "token long, key long, n int, pos int")


def _possible(n, pos, i, j):
    """Whether the sets at i and j can be similar if this is the first shingle they share."""
    return 9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])


def _met(width: int):
    """Entries (token, key, n, pos, label) in order of token and key -> pairs (a, b) to verify, and entries of crowded buckets left to compare."""

    def of(token, key, n, pos, label):
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([new, [len(token)]]))
        group, small = np.repeat(np.arange(len(new)), sizes), np.repeat(sizes <= SMALL, sizes)
        first, second, left = [], [], [np.zeros(0, np.int64)]
        for lag in range(1, SMALL):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            first.append(i), second.append(i + lag)
        for at in np.flatnonzero(sizes > SMALL):
            a, b = new[at], new[at] + sizes[at]
            if (label[a:b] == label[a]).all():
                continue
            to = min(a + width, b)
            for i in range(a, to):  # what can't be similar is left out at once: memory goes by the pairs to verify
                j = np.arange(i + 1, b)
                j = j[(label[j] != label[i]) & _possible(n, pos, i, j)]
                first.append(np.full(len(j), i)), second.append(j)
            if b - to > 1:
                left.append(np.arange(to, b))
        i, j, left = np.concatenate(first), np.concatenate(second), np.concatenate(left)
        ok = (label[i] != label[j]) & _possible(n, pos, i, j)
        i, j = key[i[ok]], key[j[ok]]
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
        rows, none = len(pairs) + len(left), np.arange(len(pairs) + len(left)) < len(pairs)
        put = lambda x, front: pa.array(np.concatenate([np.zeros(len(pairs), np.int64), x[left]]) if not front else np.concatenate([x, np.zeros(len(left), np.int64)]), mask=none if not front else ~none)
        return pa.record_batch([put(token, False), put(key, False), put(n, False), put(pos, False), put(pairs[:, 0], True), put(pairs[:, 1], True)], names=["token", "key", "n", "pos", "a", "b"]) if rows else None

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            ends = np.flatnonzero(cols[0] != cols[0][-1])
            last = int(ends[-1]) + 1 if len(ends) else 0
            if last and (out := of(*(x[:last] for x in cols))):
                yield out
            held = [x[last:] for x in cols]
        if held is not None and (out := of(*held)):
            yield out

    return run


def verified(pairs: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def whole(batches):
        for batch in pieces(batches, "text", 1 << 20):
            of, h = shingled(batch.column("text"), size)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["key", "own"])

    some = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = written(keyed.join(some, "key", "left_semi").select("key", "text").mapInArrow(whole, "key long, own array<long>"), "near-sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("y")), "b")
    out = written(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b").distinct(), "near-links")
    discard(sets)
    return out


def proposed(keyed: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of keys that fingerprints link: each text with the first of its fingerprint, these along the links."""
    prints = written(fingerprints(keyed.withColumnRenamed("key", "doc_id"), size).select(F.col("doc_id").alias("key"), "fp"), "near-prints")
    first = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "near-first")
    same = prints.join(first, "fp").where("key != first").select("first", "key")
    across = linked(first.select("fp")).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return same.union(across).select(F.least("first", "key").alias("a"), F.greatest("first", "key").alias("b")).distinct()


def near_copies(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id, with all columns.

    Groups are what pairs of a Jaccard similarity of 0.8 or more of their
    shingles of size words connect. A null text has no words; such texts are
    copies of each other. Rows without a doc_id come after all others; of
    different texts under the smallest doc_id one is kept, of rows that repeat
    both one. An empty table gives an empty table.
    """
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    keyed = bounded(docs).select(key.alias("key"), F.col(text_col).alias("text"))
    links = verified(proposed(keyed, size), keyed, size)
    roots = written(components(links), "near-roots")
    entries = written(prefixes(keyed, size), "near-prefixes")
    labelled = lambda rows: rows.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("token", "key", "n", "pos", F.coalesce("root", "key").alias("label"))
    todo, width = labelled(entries), PIVOTS
    while True:
        met = written(todo.repartition("token").sortWithinPartitions("token", "key").mapInArrow(_met(width), "token long, key long, n long, pos long, a long, b long"), "near-met")
        pairs = met.where("a is not null").select("a", "b").distinct()
        if not pairs.isEmpty():
            links = verified(pairs, keyed, size)
            if not links.isEmpty():  # the components so far are stars; only what links them anew is followed
                roots = written(components(roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links)), "near-roots")
        left = met.where("a is null").select("token", "key", "n", "pos")
        if left.isEmpty():
            break
        todo = labelled(left)
        width *= 16
    own = docs.select(key.alias("key"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), key.alias("key")).alias("rank"))
    members = written(own.join(roots.select(F.col("node").alias("key"), "root"), "key"), "near-members")
    (name,) = fresh(docs.columns, "key")
    gone = members.join(members.groupBy("root").agg(F.min("rank").alias("least")), "root").where("key != least.key").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, key).join(gone, name, "left_anti").dropDuplicates([name]).drop(name)
