"""Ordinals, resolution of spends, histories, fees and statistics of a ledger.

Tables: blocks(height, ...), txs(tx_ord, height, pos, ...), outputs(out_ord,
tx_ord, height, vout, value, lock), spends(out_ord, spender_tx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.chain import subsidy_at

BIG = "decimal(38,0)"


def ordinals(rows: DataFrame, block: str, order: list[Column], sizes: Column | None = None, name: str = "ord", first: str | None = None) -> DataFrame:
    """rows with name: a dense number from 0 in order of block, then order; and first: the sum of sizes before the row.

    Counts of each block are added up over the blocks, one row for each; the rest
    happens within a block. Nothing puts all rows in one partition.
    """
    size = sizes if sizes is not None else F.lit(0)
    rows = rows.withColumn("__size", size.cast("long"))
    counts = rows.groupBy(block).agg(F.count("*").alias("__n"), F.sum("__size").alias("__s"))
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    own = Window.partitionBy(block).orderBy(*order)
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"__k": F.row_number().over(own) - 1, "__b": F.coalesce(F.sum("__size").over(prior), F.lit(0))}).join(starts, block)
    out = out.withColumn(name, F.col("__n0") + F.col("__k"))
    if first:
        out = out.withColumn(first, F.col("__s0") + F.col("__b"))
    return out.drop("__n0", "__s0", "__k", "__b", "__size")


def height_of(ordinals_: DataFrame, blocks: DataFrame, ordinal: str, first: str) -> DataFrame:
    """ordinals_ with height: of the last block that starts at or before the ordinal.

    Both are dealt by ranges of the ordinal, so a block meets only its own range
    and the next ordinal asked for; see series.asof.
    """
    from chainloom.plans.series import asof

    return asof(ordinals_, blocks, ordinal, first, "height", 1 << 62, out="height", bucket=1 << 20)


def txid_index(txs: DataFrame) -> DataFrame:
    """(txid, first_out, n_out, copies): of transactions with one txid the latest."""
    last = F.max(F.struct("first_out", "n_out")).alias("m")
    return txs.groupBy("txid").agg(last, F.count("*").alias("copies")).select("txid", "m.first_out", "m.n_out", "copies")


def resolve(inputs: DataFrame, index: DataFrame, tolerate: bool = False) -> DataFrame:
    """(out_ord, spender_tx) of inputs (spender_tx, prev_txid, prev_vout).

    An unknown txid stops the query unless it is tolerated, in which case out_ord
    is null; an output number beyond the transaction's always stops it.
    """
    rows = inputs.join(index, inputs["prev_txid"] == index["txid"], "left")
    unknown = F.lit(None).cast("long") if tolerate else F.raise_error(F.lit("an input spends an unknown transaction")).cast("long")
    out = F.when(F.col("txid").isNull(), unknown).when(F.col("prev_vout") >= F.col("n_out"), F.raise_error(F.lit("an input spends an output beyond its transaction's")).cast("long"))
    return rows.select(out.otherwise(F.col("first_out") + F.col("prev_vout")).alias("out_ord"), "spender_tx")


def spenders(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """outputs with spender_tx (the last spender, null if unspent) and spenders (all, in order)."""
    own = spends.where("out_ord is not null").groupBy("out_ord").agg(F.max("spender_tx").alias("spender_tx"), F.array_sort(F.collect_list("spender_tx")).alias("spenders"))
    return outputs.join(own, "out_ord", "left")


def history(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """(lock, out_ord, tx_ord, height, value, spender_tx): a row for each output."""
    own = spends.where("out_ord is not null").groupBy("out_ord").agg(F.max("spender_tx").alias("spender_tx"))
    return outputs.join(own, "out_ord", "left").select("lock", "out_ord", "tx_ord", "height", "value", "spender_tx")


def spend_heights(rows: DataFrame, txs: DataFrame) -> DataFrame:
    """rows with spend_height, of spender_tx."""
    at = txs.select(F.col("tx_ord").alias("spender_tx"), F.col("height").alias("spend_height"))
    return rows.join(at, "spender_tx", "left")


def events(rows: DataFrame) -> DataFrame:
    """(lock, height, out_ord, kind, value) of history with spend heights: RECV when created, SPEND when spent."""
    two = F.array(
        F.struct(F.col("height").alias("height"), F.lit("RECV").alias("kind"), F.col("value").alias("value")),
        F.struct(F.col("spend_height").alias("height"), F.lit("SPEND").alias("kind"), (-F.col("value")).alias("value")),
    )
    out = rows.select("lock", "out_ord", F.explode(two).alias("e")).where("e.height is not null")
    return out.select("lock", "e.height", "out_ord", "e.kind", "e.value")


def running_balance(evts: DataFrame) -> DataFrame:
    """evts with balance, by lock in order of height, output and RECV before SPEND."""
    own = Window.partitionBy("lock").orderBy("height", "out_ord", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return evts.withColumn("balance", F.sum("value").over(own))


def balances(rows: DataFrame) -> DataFrame:
    """(lock, unspent_n, unspent) of history."""
    free = F.col("spender_tx").isNull()
    return rows.groupBy("lock").agg(F.count(F.when(free, 1)).alias("unspent_n"), F.coalesce(F.sum(F.when(free, F.col("value"))), F.lit(0)).cast("long").alias("unspent"))


def balance_at(rows: DataFrame, height: int) -> DataFrame:
    """(lock, received, spent, unspent) as of a height."""
    in_ = F.coalesce(F.sum(F.when(F.col("height") <= height, F.col("value"))), F.lit(0)).cast("long")
    out = F.coalesce(F.sum(F.when(F.col("spend_height") <= height, F.col("value"))), F.lit(0)).cast("long")
    return rows.where(F.col("height") <= height).groupBy("lock").agg(in_.alias("received"), out.alias("spent"), (in_ - out).alias("unspent"))


def summary(rows: DataFrame) -> DataFrame:
    """(lock, outputs, received, spent_n, spent, unspent, first_height, last_height) of history with spend heights."""
    gone = F.col("spender_tx").isNotNull()
    return rows.groupBy("lock").agg(
        F.count("*").alias("outputs"),
        F.sum("value").alias("received"),
        F.count(F.when(gone, 1)).alias("spent_n"),
        F.coalesce(F.sum(F.when(gone, F.col("value"))), F.lit(0)).cast("long").alias("spent"),
        F.coalesce(F.sum(F.when(~gone, F.col("value"))), F.lit(0)).cast("long").alias("unspent"),
        F.min("height").alias("first_height"),
        F.greatest(F.max("height"), F.max("spend_height")).alias("last_height"),
    )


def tx_inputs(spends: DataFrame) -> DataFrame:
    """(spender_tx, out_ord)."""
    return spends.where("out_ord is not null and spender_tx is not null").select("spender_tx", "out_ord")


def fees(txs: DataFrame, outputs: DataFrame, spends: DataFrame, strict: bool = True) -> DataFrame:
    """(tx_ord, value_in, value_out, fee) of every transaction: 0 without inputs; below 0 stops the query if strict."""
    out = outputs.groupBy("tx_ord").agg(F.sum("value").alias("value_out"))
    in_ = tx_inputs(spends).join(outputs.select("out_ord", "value"), "out_ord").groupBy(F.col("spender_tx").alias("tx_ord")).agg(F.sum("value").alias("value_in"), F.count("*").alias("n_in"))
    rows = txs.select("tx_ord").join(out, "tx_ord", "left").join(in_, "tx_ord", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    fee = F.when(F.col("n_in").isNull(), F.lit(0).cast("long")).otherwise(zero("value_in") - zero("value_out"))
    rows = rows.select("tx_ord", zero("value_in").alias("value_in"), zero("value_out").alias("value_out"), fee.alias("fee"))
    if strict:
        rows = rows.withColumn("fee", F.when(F.col("fee") >= 0, F.col("fee")).otherwise(F.raise_error(F.lit("a transaction spends more than its inputs")).cast("long")))
    return rows


def first_spend(rows: DataFrame) -> DataFrame:
    """(lock, spender_tx): the first transaction that spends from each lock ever spent from."""
    return rows.where("spender_tx is not null").groupBy("lock").agg(F.min("spender_tx").alias("spender_tx"))


def block_stats(blocks: DataFrame, txs: DataFrame, outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """(height, n_tx, n_inputs, n_outputs, value_created): a row for each block."""
    n_tx = txs.groupBy("height").agg(F.count("*").alias("n_tx"))
    out = outputs.groupBy("height").agg(F.count("*").alias("n_outputs"), F.sum("value").alias("value_created"))
    in_ = tx_inputs(spends).groupBy(F.col("spender_tx").alias("tx_ord")).agg(F.count("*").alias("n")).join(txs.select("tx_ord", "height"), "tx_ord").groupBy("height").agg(F.sum("n").alias("n_inputs"))
    rows = blocks.select("height").join(n_tx, "height", "left").join(in_, "height", "left").join(out, "height", "left")
    return rows.select("height", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tx", "n_inputs", "n_outputs", "value_created")))


def stats_by_bucket(stats: DataFrame, size: int) -> DataFrame:
    """(bucket, from_height, blocks, n_tx, n_outputs, value_created, busiest, richest) by height div size.

    busiest and richest: the lowest height of the most transactions, of the largest value.
    """
    top = lambda c: F.max(F.struct(F.col(c), (-F.col("height")).alias("h")))["h"] * -1
    return stats.groupBy(F.expr(f"height div {size}").alias("bucket")).agg(
        F.min("height").alias("from_height"), F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in ("n_tx", "n_outputs", "value_created")), top("n_tx").alias("busiest"), top("value_created").alias("richest")
    )


def supply(heights: DataFrame) -> DataFrame:
    """heights (height, coinbase, fees) with subsidy, allowed, unclaimed, short and violated."""
    rows = heights.withColumn("subsidy", subsidy_at(F.col("height"))).withColumn("allowed", F.col("subsidy") + F.col("fees"))
    return rows.withColumns({"unclaimed": F.greatest(F.col("allowed") - F.col("coinbase"), F.lit(0).cast("long")), "short": F.col("coinbase") < F.col("allowed"), "violated": F.col("coinbase") > F.col("allowed")})


def supply_by_bucket(rows: DataFrame, size: int, strict: bool = True) -> DataFrame:
    """(bucket, blocks, fees, coinbase, subsidy, unclaimed, short, violations); strict: a violation stops the query."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = rows.groupBy(F.expr(f"height div {size}").alias("bucket")).agg(F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in ("fees", "coinbase", "subsidy", "unclaimed")), n("short").alias("short"), n("violated").alias("violations"))
    if strict:
        out = out.withColumn("violations", F.when(F.col("violations") == 0, F.col("violations")).otherwise(F.raise_error(F.lit("coinbase above subsidy and fees")).cast("long")))
    return out


def fiat_fees(fees_by_height: DataFrame, prices: DataFrame) -> DataFrame:
    """(fiat, priced, unpriced_fees): fee times price, block by block; fees of blocks without a price apart."""
    rows = fees_by_height.join(prices.select("height", "price"), "height", "left")
    fiat = (F.col("fees").cast("decimal(20,0)") * F.col("price").cast("decimal(18,6)") / 100_000_000).cast("decimal(38,14)")
    return rows.agg(F.sum(fiat).cast("decimal(38,6)").alias("fiat"), F.count("price").alias("priced"), F.coalesce(F.sum(F.when(F.col("price").isNull(), F.col("fees"))), F.lit(0)).alias("unpriced_fees"))


def rewind(outputs: DataFrame, spends: DataFrame, txs: DataFrame, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables as they were at a height."""
    kept = txs.where(F.col("height") <= height)
    own = spends.join(kept.select(F.col("tx_ord").alias("spender_tx")), "spender_tx", "left_semi")
    return outputs.where(F.col("height") <= height), own, kept
