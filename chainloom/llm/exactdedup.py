"""Exact dedup by a content sort.

Sampled splitters range-partition the rows by (first characters of the
normalised text, its hash, doc_id, place in the input): the sample that the
driver gathers holds no whole texts, and the doc_id and the place let a group
of any size span partitions, also of rows that repeat one doc_id.
External sorting by (first characters, hash, text, doc_id) puts equal texts
side by side, and a full comparison of each row with its neighbour finds the
runs. Only runs with the first or the last key of a partition can go on in
another one: about two rows a partition are merged afterwards.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.samples import fresh
from chainloom.llm.text import bounded, pieces, raw
from chainloom.session import written

#: Characters of a text in the key of the range partition.
HEAD = 24
RUNS = "doc_id long, part int, run long, lead_id long, n long, lead boolean, edge boolean, text_sha256 string, edge_text binary"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches):
    """Rows in order of (head, hash, text, doc_id) -> the same rows with the run that each belongs to."""
    part, run, key, text, ids, first = TaskContext.get().partitionId(), 0, None, None, [], True
    names = [f.split()[0] for f in RUNS.split(", ")]
    done: list[pa.RecordBatch] = []
    same: list[tuple] = []  # the runs of this key, of which there are several only if hashes collide

    def rows(run: int, ids: list, text: bytes, edge: bool):
        n = len(ids)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([part] * n, pa.int32()),
            pa.array([run] * n, pa.int64()),
            pa.array([ids[0]] * n, pa.int64()),
            pa.array([n] * n, pa.int64()),
            pa.array([True] + [False] * (n - 1)),
            pa.array([edge] * n),
            pa.array([hashlib.sha256(text).hexdigest()] * n),
            pa.array(([text] if edge else [None]) + [None] * (n - 1), pa.binary()),
        ]
        return pa.record_batch(columns, names=names)

    for batch in pieces(batches, "text", 8 << 20):
        data, offsets = raw(batch.column("text"))
        data = data.tobytes()
        heads, hashes = batch.column("head").to_pylist(), batch.column("hash").to_pylist()
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            this = data[offsets[i] : offsets[i + 1]]
            if this != text:
                if text is not None:
                    same.append((run, ids, text))
                    run += 1
                text, ids = this, []
            if key != (heads[i], hashes[i]):
                done += [rows(*x, edge=first) for x in same]
                first = first and not same
                same, key = [], (heads[i], hashes[i])
            ids.append(doc)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if text is not None:
        same.append((run, ids, text))
        yield from pa.Table.from_batches([rows(*x, edge=True) for x in same]).combine_chunks().to_batches()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    A null text counts as empty. Of equal texts the row with the smallest
    doc_id stays; a null doc_id is larger than any other, and of rows that
    repeat the smallest doc_id exactly one stays. An empty table gives an empty
    table; other columns are not looked at.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.select(F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), "text", "doc_id")
    last = F.col("doc_id").asc_nulls_last()
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(F.col("head"), F.col("hash"), last, F.col("place")).drop("place").sortWithinPartitions("head", "hash", "text", last)
    runs = written(dealt.mapInArrow(_runs, RUNS), "exact-runs")
    edges = runs.where("edge and lead")
    first = F.struct("part", "run")
    whole = edges.groupBy("edge_text").agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.min_by("lead_id", first).alias("lead_id"))
    # two rows a partition at most, whatever the input
    whole = edges.select("part", "run", "edge_text").join(whole, "edge_text").select("part", "run", F.col("n").alias("all_n"), F.col("lead_id").alias("all_lead"), (F.col("first") == first).alias("at_first"))
    out = runs.join(F.broadcast(whole), ["part", "run"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("edge"), F.col("all_lead")).otherwise(F.col("lead_id")).alias("keep_id"),
        F.when(F.col("edge"), F.col("all_n")).otherwise(F.col("n")).alias("group_size"),
        (F.col("lead") & F.coalesce("at_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows are told apart by doc_id and normalised text; of rows that repeat
    both, one stays.
    """
    # one column, so that the join and the choice of one row share a partitioning
    name = lambda id_, sha: F.concat_ws(":", sha, F.coalesce(id_.cast("string"), F.lit("-")))
    (key,) = fresh(docs.columns, "key")
    held = exact_groups(docs, id_col, text_col).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias(key))
    own = docs.withColumn(key, name(F.col(id_col).cast("long"), F.sha2(normalised(F.col(text_col)), 256)))
    return own.join(held, key, "left_semi").dropDuplicates([key]).drop(key)
