"""The census of unspent outputs by type and height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.chain import classify_script, epoch_index, height_band

EXPOSED = ["p2pk_u", "p2pk_c", "multisig", "p2tr"]


def typed(coins: DataFrame) -> DataFrame:
    """coins(type_code, payload, ...) with type."""
    return coins.withColumn("type", classify_script(F.col("type_code"), F.col("payload")))


def by_band(coins: DataFrame, width: int = 50_000) -> DataFrame:
    """(type, height_from, entries, satoshis)."""
    return coins.groupBy("type", height_band(F.col("height"), width).alias("height_from")).agg(F.count("*").alias("entries"), F.sum("sats").alias("satoshis"))


def by_epoch(coins: DataFrame, types: list[str] | None = EXPOSED, epoch=epoch_index, epochs: int = 5) -> DataFrame:
    """(type, e1 ... e5, total): satoshis of the types that show their keys, or of all if types is None, by era."""
    own = coins if types is None else coins.where(F.col("type").isin(types))
    own = own if "epoch" in coins.columns else own.withColumn("epoch", epoch(F.col("height")))
    rows = own.groupBy("type").pivot("epoch", list(range(epochs)))
    out = rows.agg(F.sum("sats"))
    names = [F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("long") for i in range(epochs)]
    return out.select("type", *(c.alias(f"e{i + 1}") for i, c in enumerate(names)), sum(names[1:], names[0]).alias("total"))


def totals(coins: DataFrame) -> DataFrame:
    """(type, entries, satoshis) with a row ALL."""
    rows = coins.rollup("type").agg(F.count("*").alias("entries"), F.coalesce(F.sum("sats"), F.lit(0)).cast("long").alias("satoshis"))
    return rows.withColumn("type", F.coalesce("type", F.lit("ALL")))
