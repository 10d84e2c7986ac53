"""The ledger's tables bound to a star schema: orders are transactions, lines are outputs.

height: day number of the order from 1995-01-01; transaction: order; output:
line; value: price in cents; lock: part; spender: the customer's next order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.plans.ledger import history, ordinals, spend_heights
from chainloom.session import written


@dataclass
class Ledger:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").withColumn("height", (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) + 1).cast("long"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def txs(self) -> DataFrame:
        """(tx_ord, height, custkey, orderkey, first_out, n_out)."""
        n = self.lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_out"))
        rows = self.orders.select("height", "o_orderdate", "o_orderkey", "o_custkey").join(n, "o_orderkey", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
        rows = ordinals(rows, "height", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("n_out"), "tx_ord", "first_out")
        return rows.select("tx_ord", "height", F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "first_out", "n_out")

    @cached_property
    def tx_list(self) -> DataFrame:
        """(tx_ord, height, custkey, orderkey): txs where the outputs don't matter, so lines are not read."""
        rows = ordinals(self.orders.select("height", "o_orderdate", "o_orderkey", "o_custkey"), "height", [F.col("o_orderdate"), F.col("o_orderkey")], name="tx_ord")
        return rows.select("tx_ord", "height", F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))

    @cached_property
    def next_tx(self) -> DataFrame:
        """(tx_ord, spender_tx): the customer's next order."""
        own = Window.partitionBy("custkey").orderBy("tx_ord")
        return self.tx_list.select("tx_ord", F.lead("tx_ord").over(own).alias("spender_tx"))

    @cached_property
    def outputs(self) -> DataFrame:
        """(out_ord, tx_ord, height, vout, value, lock)."""
        rest = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        rows = self.lines.join(self.txs, F.col("l_orderkey") == F.col("orderkey"))
        own = Window.partitionBy("tx_ord").orderBy(*rest)
        vout = F.row_number().over(own) - 1
        rows = rows.withColumn("vout", vout.cast("long"))
        return rows.select((F.col("first_out") + F.col("vout")).alias("out_ord"), "tx_ord", "height", "vout", F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"), F.col("l_partkey").alias("lock"))

    @cached_property
    def values(self) -> DataFrame:
        """(tx_ord, height, value, lock): outputs where their order does not matter."""
        rows = self.lines.select("l_orderkey", "l_extendedprice", "l_partkey").join(self.tx_list, F.col("l_orderkey") == F.col("orderkey"))
        return rows.select("tx_ord", "height", F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"), F.col("l_partkey").alias("lock"))

    @cached_property
    def lot(self) -> DataFrame:
        """values with spender_tx and spend_height."""
        rows = self.values.join(self.next_tx, "tx_ord")
        return spend_heights(rows, self.tx_list)

    @cached_property
    def spends(self) -> DataFrame:
        """(out_ord, spender_tx)."""
        return self.outputs.select("out_ord", "tx_ord").join(self.next_tx, "tx_ord").where("spender_tx is not null").select("out_ord", "spender_tx")

    @cached_property
    def blocks(self) -> DataFrame:
        """(height, n_tx, first_tx), a row for each day with orders."""
        counts = self.orders.groupBy("height").agg(F.count("*").alias("n_tx"))
        before = Window.orderBy("height").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("first_tx", F.coalesce(F.sum("n_tx").over(before), F.lit(0)))

    @cached_property
    def history(self) -> DataFrame:
        """(lock, out_ord, tx_ord, height, value, spender_tx): each output meets its transaction's spender once."""
        return self.outputs.join(self.next_tx, "tx_ord").select("lock", "out_ord", "tx_ord", "height", "value", "spender_tx")

    @cached_property
    def history_by_join(self) -> DataFrame:
        """The same by way of the spends."""
        return history(self.outputs, self.spends)

    @cached_property
    def full_history(self) -> DataFrame:
        return spend_heights(self.history, self.tx_list)

    @cached_property
    def sealed_history(self) -> DataFrame:
        """full_history as a table, where a plan reads it several times."""
        return written(self.full_history, "history")

    @cached_property
    def mine(self) -> DataFrame:
        """(pos, lock): the caller's list, parts 1 to 8."""
        return self.spark.range(1, 9).select((F.col("id") - 1).alias("pos"), F.col("id").alias("lock"))

    @cached_property
    def events(self) -> DataFrame:
        """(ts, event_type, user_id, value, event_id) with ts in Unix seconds."""
        return self.table("events").select(F.unix_timestamp("ts").alias("ts"), "event_type", "user_id", "value", "event_id")
