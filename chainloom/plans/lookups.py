"""Point questions: digests, points, outpoints, transactions and locks that a caller names.

What a caller types is checked first. Strings that can't be what they should are
reported and left out; a prefix too short to mean one thing is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.plans import ledger, nonces
from chainloom.plans.audit import content_digest

IN, OUT = "in", "out"


def hex_bytes(texts: list[str], sizes: set[int]) -> tuple[list[bytes], list[str]]:
    """(bytes, what was refused) of hex strings of one of the sizes."""
    good, bad = [], []
    for t in texts:
        x = t.strip().lower()
        if re.fullmatch(r"(?:[0-9a-f]{2})+", x) and len(x) // 2 in sizes:
            good.append(bytes.fromhex(x))
        else:
            bad.append(t)
    return good, bad


def outpoints(texts: list[str]) -> tuple[list[tuple[bytes, int]], list[str]]:
    """((txid as serialised, output number), what was refused) of strings TXID:VOUT with the txid as displayed."""
    good, bad = [], []
    for t in texts:
        m = re.fullmatch(r"([0-9a-fA-F]{64}):([0-9]{1,9})", t.strip())
        if m:
            good.append((bytes.fromhex(m[1])[::-1], int(m[2])))
        else:
            bad.append(t)
    return good, bad


def digests(spark: SparkSession, texts: list[str], revelations: DataFrame, pending: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """((digest, category, byte, first_height, status), refused): in or not in the archive, and under which category.

    pending: sightings that are not in a sealed generation yet; they count, and
    status says so.
    """
    own, bad = hex_bytes(texts, {20, 32})
    asked = spark.createDataFrame([(x,) for x in own], "digest binary").distinct()
    rows = with_pending(revelations, pending)
    found = asked.join(rows, "digest", "left")
    status = F.when(F.col("first_height").isNull(), "absent").when(F.col("sealed"), "sealed").otherwise("pending")
    return found.select("digest", "category", "byte", "first_height", status.alias("status")), bad


def with_pending(revelations: DataFrame, pending: DataFrame | None) -> DataFrame:
    """Revelations with those that wait for the next generation; sealed tells whether a row owes them nothing."""
    rows = revelations.select("category", "digest", "byte", "first_height", F.lit(True).alias("sealed"))
    if pending is None:
        return rows
    rows = rows.unionByName(pending.select("category", "digest", "byte", F.col("height").alias("first_height"), F.lit(False).alias("sealed")))
    byte = F.when(F.col("category") == "keys", F.bit_or("byte")).otherwise(F.max("byte"))
    return rows.groupBy("category", "digest").agg(byte.alias("byte"), F.min("first_height").alias("first_height"), F.bool_and("sealed").alias("sealed"))


def points(spark: SparkSession, texts: list[str], census: DataFrame) -> tuple[DataFrame, list[str]]:
    """((point, count, flags, first_height, last_height, heights), refused) of points or of the r they begin."""
    own, bad = hex_bytes(texts, {nonces.POINT, 32})
    asked = spark.createDataFrame([(x[: nonces.POINT],) for x in own], "point binary").distinct()
    rows = census.join(F.broadcast(asked), "point", "left_semi")
    return asked.join(nonces.groups(rows, 1), "point", "left").select("point", F.coalesce("count", F.lit(0)).alias("count"), "flags", "first_height", "last_height", "heights"), bad


def outputs(spark: SparkSession, texts: list[str], txs: DataFrame, outs: DataFrame, spends: DataFrame) -> tuple[DataFrame, list[str]]:
    """((txid, vout, status, out_ord, tx_ord, height, value, lock, spender_tx, spenders), refused) of TXID:VOUT.

    status: unspent, spent, unknown transaction, or no such output. Of twins
    with one txid the latest counts.
    """
    own, bad = outpoints(texts)
    asked = spark.createDataFrame(own, "txid binary, vout long").distinct()
    named = asked.join(ledger.txid_index(txs), "txid", "left").withColumn("out_ord", F.when(F.col("vout") < F.col("n_out"), F.col("first_out") + F.col("vout")))
    rows = outs.join(F.broadcast(named.select("out_ord").where("out_ord is not null")), "out_ord", "left_semi")
    rows = ledger.spenders(rows, spends).select("out_ord", "tx_ord", "height", "value", "lock", "spender_tx", "spenders")
    found = named.join(rows, "out_ord", "left")
    status = F.when(F.col("n_out").isNull(), "unknown transaction").when(F.col("out_ord").isNull(), "no such output").when(F.col("spender_tx").isNull(), "unspent").otherwise("spent")
    return found.select("txid", "vout", status.alias("status"), "out_ord", "tx_ord", "height", "value", "lock", "spender_tx", "spenders"), bad


def fee(spark: SparkSession, txids: list[str], txs: DataFrame, fees: DataFrame) -> tuple[DataFrame, list[str]]:
    """((txid, status, tx_ord, fee), refused): ok, coinbase (no fee), or unknown; txids as displayed."""
    own, bad = hex_bytes(txids, {32})
    asked = spark.createDataFrame([(x[::-1],) for x in own], "txid binary").distinct()
    last = txs.groupBy("txid").agg(F.max(F.struct("tx_ord", "coinbase")).alias("t")).select("txid", "t.*")
    rows = asked.join(last, "txid", "left").join(fees.select("tx_ord", "fee"), "tx_ord", "left")
    status = F.when(F.col("tx_ord").isNull(), "unknown").when(F.col("coinbase"), "coinbase").otherwise("ok")
    return rows.select("txid", status.alias("status"), "tx_ord", F.when(~F.col("coinbase"), F.col("fee")).alias("fee")), bad


def history(rows: DataFrame, lock: bytes, limit: int | None = None) -> tuple[DataFrame, int]:
    """(events of a lock in order, how many earlier ones were left out): the last limit events."""
    own = ledger.events(rows.where(F.col("lock") == F.lit(bytearray(lock)))).orderBy("height", "out_ord", "kind")
    if limit is None:
        return own, 0
    more = max(0, own.count() - limit)
    last = own.orderBy(F.desc("height"), F.desc("out_ord"), F.desc("kind")).limit(limit)
    return last.orderBy("height", "out_ord", "kind"), more


def spent_between(first: DataFrame, txs: DataFrame, lo: int, hi: int) -> DataFrame:
    """(lock, spender_tx, height) of locks first spent from within the heights: a range of ordinals, and so of files."""
    ends = txs.where(F.col("height").between(lo, hi)).agg(F.min("tx_ord").alias("a"), F.max("tx_ord").alias("b")).first()
    if ends.a is None:
        return first.limit(0).withColumn("height", F.lit(None).cast("long"))
    own = first.where(F.col("spender_tx").between(ends.a, ends.b))
    return own.join(txs.where(F.col("height").between(lo, hi)).select(F.col("tx_ord").alias("spender_tx"), "height"), "spender_tx").select("lock", "spender_tx", "height")


def lock_signatures(rows: DataFrame, inputs: DataFrame, txs: DataFrame, lock: bytes) -> DataFrame:
    """(r, s, s_raw, single_key, height) of the signatures in the spends of a lock; rows is history with spend heights.

    Each spent output meets the input that names it; one that no input names stops
    the query.
    """
    from chainloom.functions.scripts import script_pushes

    spent = rows.where((F.col("lock") == F.lit(bytearray(lock))) & F.col("spender_tx").isNotNull())
    made = txs.select(F.col("tx_ord"), F.col("txid").alias("prev_txid"), "first_out")
    spent = spent.join(made, "tx_ord").select("spender_tx", "spend_height", "prev_txid", (F.col("out_ord") - F.col("first_out")).alias("prev_vout"))
    own = inputs.select(F.col("tx_ord").alias("spender_tx"), "prev_txid", "prev_vout", "script_sig", "witness")
    both = spent.join(own, ["spender_tx", "prev_txid", "prev_vout"], "left")
    none = F.array().cast("array<binary>")
    both = both.withColumn("script_sig", F.coalesce("script_sig", F.when(F.col("witness").isNull(), F.raise_error(F.lit("no input names a spent output")).cast("binary"))))
    both = both.select(F.col("spend_height").alias("height"), F.coalesce(script_pushes("script_sig"), none).alias("pushes"), F.coalesce("witness", none).alias("witness"))
    found = nonces.extracted(both)
    return found.select("height", F.explode("sig.found").alias("x"), (F.size("sig.found") == 1).alias("single_key")).select("x.r", "x.s", "x.s_raw", "single_key", "height")


def projection_digests(revelations: DataFrame) -> dict[str, str]:
    """A digest of each category as an older form has it: provenance bits alone, no height, in order of the digest."""
    from pyspark.sql import Window

    out = {}
    for category in ("keys", "scripts20", "scripts32"):
        byte = F.col("byte").bitwiseAND(15) if category == "keys" else F.lit(0)
        rows = revelations.where(F.col("category") == category).select("digest", byte.cast("int").alias("byte"), F.substring("digest", 1, 2).alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
        starts = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
        k = F.row_number().over(Window.partitionBy("bucket").orderBy("digest")) - 1
        numbered = rows.withColumn("k", k).join(starts, "bucket").select((F.col("n0") + F.col("k")).alias("at"), "digest", "byte")
        out[category] = content_digest(numbered, ["digest", "byte"], "at")
    return out


def at_price(series_: list[tuple[DataFrame, int]], spark: SparkSession, times: list[int]) -> DataFrame:
    """(time, price, series) of each time asked for, by the first series in order that answers."""
    from chainloom.plans.series import asof_first

    return asof_first(spark.createDataFrame([(t,) for t in times], "time long"), series_, "time", "ts", "price")


def block_prices(blocks: DataFrame, series_: list[tuple[DataFrame, int]]) -> DataFrame:
    """(height, time, price, series) of each block; price with six digits, half to even; series 0: none."""
    from chainloom.plans.series import asof_first

    out = asof_first(blocks.select("height", "time"), series_, "time", "ts", "price")
    return out.withColumn("price", F.bround(F.col("price").cast("decimal(38,18)"), 6).cast("decimal(20,6)"))


def series_faults(prices: DataFrame) -> DataFrame:
    """(repeated_times, bad_prices, missing) of a price series."""
    per = prices.groupBy("ts").agg(F.count("*").alias("n"), F.count(F.when(F.col("price").cast("decimal(38,18)") <= 0, 1)).alias("bad"), F.count(F.when(F.col("price").isNull(), 1)).alias("gone"))
    return per.agg(F.count(F.when(F.col("n") > 1, 1)).alias("repeated_times"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_prices"), F.coalesce(F.sum("gone"), F.lit(0)).alias("missing"))


def header_stats(headers: DataFrame) -> DataFrame:
    """(blocks, first_height, last_height, bytes, weight, heights_told, heights_wrong): what coinbases say of their height."""
    from chainloom.functions.chain import bip34_height

    told = bip34_height(F.col("coinbase_script"))
    rows = headers.withColumn("told", told)
    return rows.agg(
        F.count("*").alias("blocks"), F.min("height").alias("first_height"), F.max("height").alias("last_height"), F.sum("size").alias("bytes"), F.sum("weight").alias("weight"), F.count(F.when(F.col("told") == F.col("height"), 1)).alias("heights_told"), F.count(F.when(F.col("told") != F.col("height"), 1)).alias("heights_wrong")
    )
