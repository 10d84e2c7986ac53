"""Audits: two roads to one table, tilings, orders, identities and digests of ordered content."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.chain import header_fields
from chainloom.functions.hashing import sha256d_of


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows, repeats counted, that one table has and the other has not."""
    columns = a.columns
    each = lambda df, sign: df.groupBy(*columns).agg(F.count("*").alias("n")).select(*columns, (F.col("n") * sign).alias("n"))
    net = each(a, 1).unionByName(each(b, -1)).groupBy(*columns).agg(F.sum("n").alias("n"))
    part = lambda sign: F.coalesce(F.sum(F.greatest(F.col("n") * sign, F.lit(0))), F.lit(0)).alias("only_a" if sign > 0 else "only_b")
    return net.agg(part(1), part(-1))


def gaps(runs: DataFrame) -> DataFrame:
    """(from_height, to_height, kind) where intervals runs(from_height, to_height) overlap the one before or leave a gap."""
    ordered = Window.orderBy("from_height", "to_height").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("end", F.max("to_height").over(ordered))
    kind = F.when(F.col("end") + 1 < F.col("from_height"), "gap").when(F.col("end") >= F.col("from_height"), "overlap")
    return rows.select("from_height", "to_height", kind.alias("kind")).where("kind is not null")


def chain_breaks(headers: DataFrame) -> DataFrame:
    """(height): headers(height, block_id, prev_hash) that don't link to the one below, or whose neighbour is missing."""
    before = Window.orderBy("height")
    bad = (F.lag("block_id").over(before) != F.col("prev_hash")) | (F.lag("height").over(before) + 1 != F.col("height"))
    return headers.select("height", bad.alias("bad")).where("bad").select("height")


def headers_of(raw: DataFrame) -> DataFrame:
    """raw(height, header) with the header's fields."""
    return raw.select("height", *(c.alias(k) for k, c in header_fields(F.col("header")).items()))


def merkle_root(txids: list[bytes]) -> bytes:
    """Pairs hashed level by level; an odd level's last is taken twice."""
    level = list(txids)
    while len(level) > 1:
        level = [sha256d_of(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0]


@F.pandas_udf(T.BinaryType())
def root_of(txids: pd.Series) -> pd.Series:
    """Root of each list of txids."""
    return txids.map(lambda x: merkle_root([bytes(t) for t in x]) if len(x) else None)


def merkle_mismatches(txs: DataFrame, headers: DataFrame) -> DataFrame:
    """(height) where the txids, in order of position, don't hash to the header's root; a block's txids fit in memory."""
    own = txs.groupBy("height").agg(F.array_sort(F.collect_list(F.struct("pos", "txid"))).alias("t"))
    own = own.select("height", root_of(F.transform("t", lambda x: x["txid"])).alias("root"))
    return headers.join(own, "height", "left").where(~F.col("root").eqNullSafe(F.col("merkle_root"))).select("height")


def content_digest(df: DataFrame, columns: list[str], key: str, every: int = 1 << 16) -> str:
    """sha256 of a table in order of an integer key.

    Each range of so many keys is hashed where it lies, rows in order as
    length-prefixed text of the columns; the digests of the ranges are hashed in
    order on the driver. It depends on the content alone, not on files. Keys
    must be unique.
    """
    cell = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat_ws(":", F.length(F.col(c).cast("string")), F.col(c).cast("string")))
    text = {c: F.lower(F.hex(c)) for c, t in df.dtypes if t == "binary" and c in columns}
    rows = df.select(F.col(key).alias("__key"), *(text.get(c, F.col(c)).alias(c) for c in columns))
    line = F.concat_ws(",", *(cell(c) for c in columns))
    ranges = rows.groupBy(F.floor(F.col("__key") / every).alias("r")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__key", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("d"))
    whole = hashlib.sha256(b"chainloom-content-v1")
    for row in ranges.orderBy("r").toLocalIterator():
        whole.update(row.r.to_bytes(8, "big", signed=True) + bytes.fromhex(row.d))
    return whole.hexdigest()


def interval_digests(df: DataFrame, columns: list[str], height: str, order: list[str], every: int) -> DataFrame:
    """(from_height, to_height, n, digest) of each interval of heights, rows in order; to be compared with another run's."""
    no = F.floor((F.col(height) - 1) / every)
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    rows = df.select(no.alias("i"), F.struct(F.col(height), *(F.col(c) for c in order), line.alias("l")).alias("x"))
    out = rows.groupBy("i").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n"), 256).alias("digest"))
    return out.select((F.col("i") * every + 1).alias("from_height"), ((F.col("i") + 1) * every).alias("to_height"), "n", "digest")


def compared_digests(own: DataFrame, reference: DataFrame) -> DataFrame:
    """(from_height, to_height, verdict): OK, DIFFERS, or SKIPPED where only one side has the interval."""
    b = reference.select("from_height", F.col("to_height").alias("__to"), F.col("digest").alias("__d"))
    rows = own.join(b, "from_height", "full")
    verdict = F.when(F.col("digest").isNull() | F.col("__d").isNull() | (F.col("to_height") != F.col("__to")), "SKIPPED").when(F.col("digest") == F.col("__d"), "OK").otherwise("DIFFERS")
    return rows.select("from_height", F.coalesce("to_height", "__to").alias("to_height"), verdict.alias("verdict"))


def revelation_faults(rows: DataFrame, last: int) -> DataFrame:
    """(duplicates, bad_flags, bad_heights, bad_widths) of revelations."""
    width = F.when(F.col("category") == "scripts32", 32).otherwise(20)
    per = rows.groupBy("category", "digest").agg(
        F.count("*").alias("n"), F.count(F.when((F.col("category") == "keys") & ((F.col("byte") < 1) | (F.col("byte") > 31)), 1)).alias("f"), F.count(F.when(~F.col("first_height").between(1, last), 1)).alias("h"), F.count(F.when(F.length("digest") != width, 1)).alias("w")
    )
    return per.agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicates"), F.coalesce(F.sum("f"), F.lit(0)).alias("bad_flags"), F.coalesce(F.sum("h"), F.lit(0)).alias("bad_heights"), F.coalesce(F.sum("w"), F.lit(0)).alias("bad_widths"))


def nonce_faults(rows: DataFrame, last: int) -> DataFrame:
    """(bad_flags, bad_heights, bad_widths) of a census: one scheme bit, no unknown sighash of a Schnorr signature."""
    scheme, code = F.col("flags").bitwiseAND(3), F.shiftright(F.col("flags"), 2)
    bad = ~scheme.isin(1, 2) | (F.col("flags") > 31) | ((scheme == 2) & (code == 7)) | ((scheme == 1) & (code == 0))
    return rows.agg(F.count(F.when(bad, 1)).alias("bad_flags"), F.count(F.when(~F.col("height").between(1, last), 1)).alias("bad_heights"), F.count(F.when(F.length("point") != 12, 1)).alias("bad_widths"))


def ledger_identities(outputs: DataFrame, history: DataFrame, spends: DataFrame, fees: DataFrame) -> DataFrame:
    """(check_name, left_side, right_side): pairs of figures that must agree, each one aggregate of its table."""
    spent = F.col("spender_tx").isNotNull()
    o = outputs.agg(F.count("*").alias("outputs"), F.sum("value").alias("value"))
    h = history.agg(F.count("*").alias("rows"), F.count(F.when(spent, 1)).alias("spent"), F.coalesce(F.sum(F.when(spent, F.col("value"))), F.lit(0)).alias("sats"))
    s = spends.where("spender_tx is not null").agg(F.countDistinct("out_ord").alias("spends"))
    f = fees.agg(F.sum("value_in").alias("value_in"), F.sum("value_out").alias("value_out"))
    one = o.crossJoin(h).crossJoin(s).crossJoin(f)  # one row each
    pairs = [("history_rows", "rows", "outputs"), ("spent_rows", "spent", "spends"), ("spent_value", "sats", "value_in"), ("created_value", "value_out", "value")]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(a).cast("long").alias("left_side"), F.col(b).cast("long").alias("right_side")) for n, a, b in pairs))).alias("x")).select("x.*")
