"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits link at TAU or fewer differing bits. Correlated bits
are grouped into partitions; a partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = TAU + 1, so that any two linked fingerprints differ in at most
t_i bits of some partition i. The thresholds come from a dynamic program on
the numbers of candidates estimated from the fingerprints themselves. A
fingerprint is registered under its bits of each partition in use and probes
all values within the threshold; entries that meet are verified on all 64
bits. Buckets beyond a size are dealt anew by the bits that they don't share
yet, so no bucket grows with the corpus. Within a bucket a breadth-first
search emits a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.components import components
from chainloom.llm.samples import fresh
from chainloom.llm.text import SPACES, Words, bounded, is_long, pieces, sections
from chainloom.session import discard, written

TAU = 3
#: Entries of a bucket that are compared at once; more are dealt anew by further bits.
CROWD = 8192
#: Costs of the plan: an entry that is shuffled, against a candidate that is verified.
ENTRY_COST = 40.0


def _bit_sums(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its shingles, and how many of them set each bit."""
    short = np.minimum(w.n, size)
    last = np.arange(w.count) + np.repeat(np.maximum(short - 1, 0), w.n)
    starts = np.flatnonzero(last < np.repeat(w.first[1:], w.n))
    of = np.repeat(np.arange(len(w.n)), w.n)[starts]
    text, digest = w.text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[s:e], 42) for s, e in zip(w.start[starts].tolist(), w.end[last[starts]].tolist(), strict=True)), np.uint64, len(starts))
    n, sums = np.bincount(of, minlength=len(w.n)), np.zeros((len(w.n), 64), np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero(n):  # faster than reduceat along the first axis
        bits = np.unpackbits(h[at[i] : at[i + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[i] = bits.sum(axis=0, dtype=np.int64)
    return n, sums


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """(doc_id, fp): a bit is set if it is set in over half the shingles' XXH64. A long text is read in sections.

    doc_id is a number, or anything where the rows are named otherwise.
    """

    def prints(batches):
        for batch in pieces(batches, "text", 2 << 20):
            if is_long(batch):
                n, sums = 0, 0
                for _, _, w in sections(batch.column("text"), SPACES, lower=True, overlap=size - 1):
                    more, own = _bit_sums(w, size)
                    n, sums = n + more, sums + own
            else:
                n, sums = _bit_sums(Words(batch.column("text"), SPACES, lower=True), size)
            fp = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    own = F.col(id_col) if named else F.col(id_col).cast("long")
    rows = bounded(docs).select(own.alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(prints, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Of all distinct fingerprints: their number, and how many set both bits i and j, as a 64 x 64 matrix."""

    def count(batches):
        total, both = 0, np.zeros((64, 64))
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(np.ascontiguousarray(fp[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total, both = total + len(bits), both + bits.T @ bits
        yield pa.record_batch([pa.array([*range(64 * 64), -1], pa.int32()), pa.array([*both.ravel().astype(np.int64), total], pa.int64())], names=["cell", "n"])

    out = np.zeros(64 * 64 + 1, np.int64)
    for cell, n in distinct.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # 4097 rows
        out[cell] = n
    return int(out[-1]), out[:-1].reshape(64, 64).astype(float)


def grouped(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of nearly one size, each grown by the bit most correlated with what it holds."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for left in range(m, 0, -1):
        size = -(-len(free) // left)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            free.remove(b)
        out.append(sorted(part))
    return out


def estimates(n: int, both: np.ndarray, part: list[int]) -> list[float]:
    """Estimated cost of threshold -1, 0, 1 ... TAU in a partition: entries to deal and pairs to verify.

    The chance that two fingerprints differ in d bits of the partition is that
    of independent bits with their own shares of ones, the number of bits
    being reduced by their mean correlation.
    """
    p = np.diag(both)[part] / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both[np.ix_(part, part)] / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    k = len(part)
    np.fill_diagonal(corr, 0)
    effective = 1 / (1 + min(1.0, corr.sum() / max(k * (k - 1), 1)) * (k - 1)) * k
    chance = np.array([1.0])
    for differ in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - differ, differ])
    same, out, ball = chance[0] ** (effective / k), [0.0], 0
    for t in range(TAU + 1):
        ball += len(list(combinations(range(k), t)))
        near = min(1.0, same * chance[: t + 1].sum() / max(chance[0], 1e-300))
        out.append(n * ball * ENTRY_COST + n * n / 2 * near)
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = budget of the least total cost: costs[i][t + 1], by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for spend, c in enumerate(cost[: budget - used + 1]):
                if used + spend not in step or total + c < step[used + spend][0]:
                    step[used + spend] = (total + c, [*chosen, spend - 1])
        best = step
    return best[budget]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def thresholds(n: int, both: np.ndarray) -> list[tuple[list[int], int]]:
    """The cheapest plan over 2 to TAU + 1 partitions: (bits, threshold) of each partition in use."""
    plans = []
    for m in range(2, TAU + 2):
        parts = grouped(n, both, m)
        cost, chosen = allocate([estimates(n, both, part) for part in parts], TAU + 1)
        plans.append((cost, m, [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(plans)[2]


def entries(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(mask, val, fp): each fingerprint under its own bits of a partition and, as a probe, all within the threshold."""
    kinds = [F.struct(F.lit(mask_of(part)).alias("mask"), F.lit(mask_of(flip)).alias("flip")) for part, t in plan for d in range(t + 1) for flip in map(list, combinations(part, d))]
    return distinct.select("fp", F.explode(F.array(*kinds)).alias("k")).select(F.col("k.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("val"), "fp")


def dealt_anew(crowded: DataFrame) -> DataFrame:
    """Entries of crowded buckets, by their bits so far and each quarter of the rest in turn.

    Two that link differ in TAU bits at most, so one of TAU + 1 parts of the
    bits not shared yet is the same in both.
    """

    def deal(batches):
        for batch in batches:
            mask, val, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            out: list[list[np.ndarray]] = [[], [], []]
            for held in np.unique(mask):
                rest = [b for b in range(64) if not int(held) >> b & 1]
                of = mask == held
                for k in range(TAU + 1):
                    more = np.uint64(sum(1 << b for b in rest[k :: TAU + 1]))
                    for to, x in zip(out, (np.full(of.sum(), held | more), val[of] | fp[of] & more, fp[of]), strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in out], names=["mask", "val", "fp"])

    return crowded.select("mask", "val", "fp").mapInArrow(deal, "mask long, val long, fp long")


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Indices of linked pairs that connect what is connected, by a search that drops what it has reached."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= TAU
            if near.any():
                found = left[near]
                out += [(at, x) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def _links(batches):
    """Entries in order of (mask, val) -> linked pairs of fingerprints."""

    def of(mask, val, fp):
        a, b = [], []
        new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])]))
        sizes = np.diff(np.concatenate([new, [len(fp)]]))
        group, small = np.repeat(np.arange(len(new)), sizes), np.repeat(sizes <= 24, sizes)
        for lag in range(1, 24):  # small buckets, all at once
            ok = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            ok = ok[np.bitwise_count(fp[ok] ^ fp[ok + lag]) <= TAU]
            a.append(fp[ok]), b.append(fp[ok + lag])
        for i in np.flatnonzero(sizes > 24):
            own = np.unique(fp[new[i] : new[i] + sizes[i]])
            pairs = np.array(_forest(own), np.int64).reshape(-1, 2)
            a.append(own[pairs[:, 0]]), b.append(own[pairs[:, 1]])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        keep = a != b
        return pa.record_batch([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].sum() + 1) if ((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).any() else 0
        if last:
            yield of(*(x[:last] for x in cols))
        held = [x[last:] for x in cols]
    if held is not None and len(held[0]):
        yield of(*held)


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) with a < b: linked fingerprints; those that connect all that links connect."""
    n, both = bit_counts(distinct)
    todo, found = written(entries(distinct, thresholds(n, both)), "simhash-entries"), None
    while True:
        sizes = todo.groupBy("mask", "val").agg(F.count("*").alias("n"))
        full = sizes.where(f"n > {crowd} and mask != -1").select("mask", "val")
        crowded = not full.isEmpty()
        calm = todo.join(full, ["mask", "val"], "left_anti") if crowded else todo
        part = calm.repartition("mask", "val").sortWithinPartitions("mask", "val").mapInArrow(_links, "a long, b long").distinct()
        part = written(part, "simhash-links")
        found = part if found is None else found.unionByName(part)
        if not crowded:
            discard(todo)
            return found.distinct()
        old, todo = todo, written(dealt_anew(todo.join(full, ["mask", "val"], "left_semi")).distinct(), "simhash-entries")
        discard(old)


def near_groups(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    A null text has no words: fingerprint zero, as an empty one; texts of fewer
    words than a shingle are one shingle. component_id is the smallest doc_id
    that links reach, null where none of the component has a doc_id. Repeated
    rows stay repeated; an empty table gives an empty table; other columns are
    not looked at.
    """
    prints = written(fingerprints(docs, size, id_col, text_col), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), crowd))
    own = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = written(own, "simhash-roots")
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = own.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, with all columns.

    It is the row with the smallest doc_id, of several of these one with the
    least hash of its text; a null doc_id comes after all others. Rows that
    repeat both are copies too: one of them stays. Groups are those of
    near_groups.
    """
    digest, fp = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), "fp"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("sha"), F.col(text_col).alias("text"))
    # the hash travels with the row in place of its text
    prints = written(fingerprints(own.select(F.struct("doc_id", "sha").alias("doc_id"), "text"), size, named=True), "simhash-prints")
    distinct = written(prints.select(fp).distinct(), "simhash-distinct")
    roots = components(links(distinct))
    rank = F.struct(F.col("doc_id.doc_id").isNull().alias("none"), F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.sha").alias("sha"))
    member = prints.join(roots.withColumnRenamed("node", fp), fp, "left").select(F.coalesce("root", fp).alias("root"), rank.alias("rank"))
    name = lambda id_, sha: F.concat_ws(":", sha, F.coalesce(id_.cast("string"), F.lit("-")))
    least = member.groupBy("root").agg(F.min("rank").alias("rank")).select(name(F.col("rank.doc_id"), F.col("rank.sha")))
    (key,) = fresh(docs.columns, "key")
    out = docs.withColumn(key, name(F.col(id_col).cast("long"), digest)).join(least.toDF(key), key, "left_semi")
    return out.dropDuplicates([key]).drop(key)
