"""Queries over the star schema, one or more for each operator. The SQL of each is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions import chain as C
from chainloom.functions.hashing import hash160, hash_hex, sha256d
from chainloom.functions.scripts import decode_address
from chainloom.plans import audit, census, dist, ledger, links, nonces, reveal, series
from chainloom.plans.analog import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Ledger(spark, folder))
    return f


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("long")


# -- order statistics (G) --------------------------------------------------


def amounts(l: Ledger) -> DataFrame:
    """(segment, amount): order totals by market segment, and under ALL."""
    rows = l.table("orders").join(l.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), cents("o_totalprice").alias("amount"))
    return dist.with_all(rows, "segment")


@query
def order_stats_by_segment(l: Ledger) -> DataFrame:
    return dist.order_stats(amounts(l), ["segment"], "amount").select("segment", "count", F.col("total"), "mean", "median", "p90", "p99", "max", F.round("gini", 9).alias("gini"))


@query
def lorenz_points(l: Ledger) -> DataFrame:
    return dist.lorenz(amounts(l), ["segment"], "amount", [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]).select("segment", "share", "k", "low_total", "total")


@query
def value_bands(l: Ledger) -> DataFrame:
    return dist.level_histogram(amounts(l), ["segment"], "amount", [1_000_000, 5_000_000, 10_000_000, 20_000_000, 10**12])


@query
def top_n_share(l: Ledger) -> DataFrame:
    return dist.top_n(amounts(l), ["segment"], "amount", [1, 10, 100, 10**9])


@query
def top_fraction_share(l: Ledger) -> DataFrame:
    return dist.top_fraction(amounts(l), ["segment"], "amount", [0.001, 0.01, 0.1, 0.5]).select("segment", "fraction", "n", "top_total", "total")


@query
def tail_share(l: Ledger) -> DataFrame:
    return dist.tail_from(amounts(l), ["segment"], "amount", [1, 5_000_000, 15_000_000, 10**12])


# -- series (H, E9, E10, F18, F19) -----------------------------------------


def up_to(events: DataFrame, least: int) -> int:
    """Where a grid ends: at least, or at the last height of events if that is beyond it."""
    return max(least, events.agg(F.max("height")).first()[0] or least)


def monthly(l: Ledger) -> DataFrame:
    """(height, n_tx, cents): running totals at the ends of windows of 30 days."""
    return series.cumulative(l.orders.select("height", F.lit("all").alias("kind"), cents("o_totalprice").alias("v")), ["all"], "v", 30, up_to(l.orders, 2430))


@query
def curve_deltas(l: Ledger) -> DataFrame:
    return series.deltas(monthly(l), ["all_hits", "all_sats"])


@query
def interval_concentration(l: Ledger) -> DataFrame:
    return dist.concentration(series.deltas(monthly(l), ["all_hits", "all_sats"]), "all_sats", [5, 20, 100_000])


STATUSES = ["F", "O", "P"]


@query
def reuse_curve_grid(l: Ledger) -> DataFrame:
    rows = l.orders.select("height", F.col("o_orderstatus").alias("kind"), cents("o_totalprice").alias("v"))
    return series.cumulative(rows, STATUSES, "v", 100, up_to(rows, 2450))


@query
def revelation_windows(l: Ledger) -> DataFrame:
    first = l.lot.groupBy("lock").agg(F.min("height").alias("height")).join(l.table("part").select("p_partkey", (F.col("p_size") % 3).alias("k")), F.col("lock") == F.col("p_partkey"))
    return series.window_counts(first.withColumn("kind", F.element_at(F.array(*map(F.lit, ["keys", "scripts20", "scripts32"])), F.col("k") + 1)), ["keys", "scripts20", "scripts32"], 50, up_to(first, 2430))


@query
def last_line_wins(l: Ledger) -> DataFrame:
    """Of the lines of an order and line number, the last by ship date and the remaining columns."""
    keys = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = l.lines.withColumns({"line": F.struct(*keys), "of": F.struct("l_orderkey", "l_linenumber")})
    return series.last_line(rows, "of").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("cents"))


@query
def median_time_past(l: Ledger) -> DataFrame:
    rows = l.events.where("event_type <> 'purchase'").select("event_id", (F.col("ts") + (F.col("event_id") * 7919) % 4001).alias("time"))
    return series.median_time_past(ledger.ordinals(rows.withColumn("day", F.expr("event_id div 4096")), "day", [F.col("event_id")], name="n").select((F.col("n") + 1).alias("height"), "time"))


def prices(l: Ledger, kind: str) -> DataFrame:
    return l.events.where(F.col("event_type") == kind).select("ts", cents("value").alias("v"))


def headers(l: Ledger) -> DataFrame:
    return l.events.where("event_type not in ('purchase', 'view')").select(F.col("event_id").alias("height"), F.col("ts").alias("time"))


STALE = 3600


@query
def asof_price(l: Ledger) -> DataFrame:
    return series.asof(headers(l), prices(l, "purchase"), "time", "ts", "v", STALE)


@query
def asof_price_ordered(l: Ledger) -> DataFrame:
    return series.asof_first(headers(l), [(prices(l, "purchase"), 900), (prices(l, "view"), STALE)], "time", "ts", "v")


@query
def daily_carry_forward(l: Ledger) -> DataFrame:
    rows = l.events.select(F.col("ts").alias("time"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), F.round("value", 2).cast("decimal(20,6)")).alias("price"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series"))
    return series.daily(rows).withColumns({"price": F.round("price", 6).cast("double"), "price_min": F.col("price_min").cast("double"), "price_max": F.col("price_max").cast("double")})


@query
def rewritten_past(l: Ledger) -> DataFrame:
    old = l.blocks.select("height", "n_tx")
    return series.rewritten(old, old.where("height < 2000").withColumn("n_tx", F.when(F.expr("height % 97 = 0"), F.lit(None)).otherwise(F.col("n_tx"))), ["n_tx"])


@query
def date_window(l: Ledger) -> DataFrame:
    rows = l.events.select(C.utc_date(F.col("ts")).alias("date"))
    return rows.where(F.col("date").between("2024-01-05", "2024-01-12")).groupBy("date").agg(F.count("*").alias("n"))


@query
def offsets_to_lengths(l: Ledger) -> DataFrame:
    rows = l.blocks.select("height", F.col("first_tx").alias("off"))
    total = l.orders.count()
    return series.lengths(rows, "height", "off", F.lit(total).cast("long"))


@query
def order_violations(l: Ledger) -> DataFrame:
    rows = l.lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_partkey", "l_suppkey").groupBy("line").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    return series.in_order(rows.withColumn("part", F.expr("line div 4096")), ["p", "s"], True, "part")


# -- ordinals and positions (D) --------------------------------------------


@query
def ordinals(l: Ledger) -> DataFrame:
    return l.txs.select("tx_ord", "height", "orderkey", "first_out", "n_out")


@query
def output_ordinals(l: Ledger) -> DataFrame:
    return l.outputs


@query
def height_of_ordinal(l: Ledger) -> DataFrame:
    asked = l.spark.range(0, 4000).select((F.col("id") * 3).alias("tx_ord"))
    asked = asked.where(F.col("tx_ord") < l.orders.count())
    return ledger.height_of(asked, l.blocks.select("height", "first_tx"), "tx_ord", "first_tx")


@query
def outputs_of_tx(l: Ledger) -> DataFrame:
    return l.outputs.where("tx_ord between 100 and 140").select("tx_ord", "vout", "value", "lock")


@query
def output_range(l: Ledger) -> DataFrame:
    return l.outputs.where("out_ord >= 1000 and out_ord < 1500").select("out_ord", "lock", "value")


@query
def whole_group(l: Ledger) -> DataFrame:
    return l.full_history.where("lock = 7").select("lock", "out_ord", "height", "value", "spender_tx")


# -- joins and aggregates over the ledger (E, F) ----------------------------


@query
def txid_index(l: Ledger) -> DataFrame:
    """Customers as txids: the latest order of each counts, as of twins."""
    rows = l.txs.select(F.col("custkey").alias("txid"), "first_out", "n_out")
    own = ledger.txid_index(rows)
    return own


@query
def resolve_inputs(l: Ledger) -> DataFrame:
    """Each order spends output 0 of its customer's latest order; those of one without lines are beyond it."""
    index = ledger.txid_index(l.txs.where("n_out > 0").select(F.col("custkey").alias("txid"), "first_out", "n_out"))
    inputs = l.tx_list.select(F.col("tx_ord").alias("spender_tx"), F.col("custkey").alias("prev_txid"), F.lit(0).cast("long").alias("prev_vout"))
    return ledger.resolve(inputs, index, tolerate=True)


@query
def output_spenders(l: Ledger) -> DataFrame:
    return ledger.spenders(l.outputs, l.spends).select("out_ord", "spender_tx", F.array_join("spenders", ",").alias("spenders"))


@query
def history_rows(l: Ledger) -> DataFrame:
    return l.history.select("lock", "out_ord", "spender_tx", "value")


@query
def history_events(l: Ledger) -> DataFrame:
    return ledger.running_balance(ledger.events(l.full_history))


@query
def lock_balance(l: Ledger) -> DataFrame:
    return ledger.balances(l.lot)


@query
def balance_at_height(l: Ledger) -> DataFrame:
    return ledger.balance_at(l.lot, 1200)


@query
def lock_summary(l: Ledger) -> DataFrame:
    own = ledger.summary(l.lot)
    first = ledger.first_spend(l.lot).withColumnRenamed("spender_tx", "first_spender")
    return own.join(first, "lock", "left")


@query
def history_totals(l: Ledger) -> DataFrame:
    gone = F.col("spender_tx").isNotNull()
    return l.lot.groupBy("lock").agg(F.count("*").alias("n"), F.count(F.when(gone, 1)).alias("k"), F.sum(F.when(gone, F.col("value"))).alias("s")).agg(F.count("*").alias("locks"), F.sum("n").alias("outputs"), F.sum("k").alias("spent_rows"), F.sum("s").alias("spent_value"))


@query
def first_spend(l: Ledger) -> DataFrame:
    return ledger.first_spend(l.lot)


@query
def first_spend_window(l: Ledger) -> DataFrame:
    at = l.tx_list.where("height between 500 and 700").select(F.col("tx_ord").alias("spender_tx"), "height")
    return ledger.first_spend(l.lot).join(at, "spender_tx").select("lock", "spender_tx", "height")


def net_flow(l: Ledger) -> DataFrame:
    """(tx_ord, value_in, value_out, fee): a transaction's inputs are all outputs of the customer's order before it."""
    out = l.values.groupBy("tx_ord").agg(F.sum("value").alias("value_out"))
    in_ = out.join(l.next_tx.where("spender_tx is not null"), "tx_ord").select(F.col("spender_tx").alias("tx_ord"), F.col("value_out").alias("value_in"))
    rows = l.tx_list.join(out, "tx_ord", "left").join(in_, "tx_ord", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    fee = F.when(F.col("value_in").isNull(), F.lit(0).cast("long")).otherwise(zero("value_in") - zero("value_out"))
    return rows.select("tx_ord", "height", zero("value_in").alias("value_in"), zero("value_out").alias("value_out"), fee.alias("fee"))


@query
def fees_net_flow(l: Ledger) -> DataFrame:
    return net_flow(l).drop("height")


@query
def fees_by_joins(l: Ledger) -> DataFrame:
    return ledger.fees(l.tx_list, l.outputs, l.spends, strict=False)


def supply_heights(l: Ledger) -> DataFrame:
    """(height, coinbase, fees): the dearest order of a day as its coinbase, the positive net flows as fees, scaled up to subsidies."""
    fees = net_flow(l).groupBy("height").agg(F.sum(F.greatest(F.col("fee"), F.lit(0).cast("long"))).alias("fees"))
    top = l.orders.groupBy("height").agg((F.max(cents("o_totalprice")) * 200).alias("coinbase"))
    return top.join(fees, "height").select("height", "coinbase", "fees")


@query
def supply_identity(l: Ledger) -> DataFrame:
    return ledger.supply_by_bucket(ledger.supply(supply_heights(l)), 210, strict=False)


@query
def fiat_fees(l: Ledger) -> DataFrame:
    fees = net_flow(l).groupBy("height").agg(F.sum(F.greatest(F.col("fee"), F.lit(0).cast("long"))).alias("fees"))
    price = l.orders.groupBy("height").agg(F.max(cents("o_totalprice")).alias("p")).where("height % 7 <> 0").select("height", (F.col("p").cast("decimal(18,6)") / 100).cast("decimal(18,6)").alias("price"))
    return ledger.fiat_fees(fees, price).withColumn("fiat", F.round("fiat", 2).cast("double"))


@query
def block_stats(l: Ledger) -> DataFrame:
    return ledger.block_stats(l.blocks, l.tx_list, l.outputs, l.spends)


@query
def block_stats_summary(l: Ledger) -> DataFrame:
    rows = l.orders.groupBy("height").agg(F.count("*").alias("n_tx"), F.sum("o_shippriority" if "o_shippriority" in l.orders.columns else F.lit(1)).cast("long").alias("n_outputs"), F.sum(cents("o_totalprice")).alias("value_created"))
    return ledger.stats_by_bucket(rows, 365)


@query
def slot_count(l: Ledger) -> DataFrame:
    return l.lot.agg(F.count("*").alias("slots"), F.count("spender_tx").alias("spent"), F.count(F.when(F.col("spender_tx").isNull(), 1)).alias("unspent"))


@query
def utxo_census(l: Ledger) -> DataFrame:
    """Unspent lines by type of part and band of 500 days."""
    rows = l.lot.where("spender_tx is null").join(l.table("part"), F.col("lock") == F.col("p_partkey"))
    return census.by_band(rows.select(F.col("p_type").alias("type"), "height", F.col("value").alias("sats")), 500)


@query
def utxo_census_pivot(l: Ledger) -> DataFrame:
    rows = l.lot.join(l.table("part"), F.col("lock") == F.col("p_partkey")).select(F.col("p_type").alias("type"), F.least(F.expr("cast(height div 500 as int)"), F.lit(4)).alias("epoch"), F.col("value").alias("sats"))
    return census.by_epoch(rows, None)


@query
def census_totals(l: Ledger) -> DataFrame:
    return census.totals(l.lines.select(F.col("l_returnflag").alias("type"), cents("l_extendedprice").alias("sats")))


# -- links (E11 to E17) ------------------------------------------------------


@query
def cospends(l: Ledger) -> DataFrame:
    asked = l.outputs.where("lock = 3").select("out_ord")
    return links.cospends(l.spends, l.outputs, asked)


@query
def co_inputs_capped(l: Ledger) -> DataFrame:
    return links.co_inputs(l.sealed_history, l.mine, cap=12)


@query
def common_input_pairs(l: Ledger) -> DataFrame:
    return links.common_input(l.sealed_history, l.tx_list, l.spark.range(1, 60).select((F.col("id") - 1).alias("pos"), F.col("id").alias("lock")), cap=20)


@query
def common_input_bridge(l: Ledger) -> DataFrame:
    return links.through_bridge(l.sealed_history, l.tx_list, l.mine, cap=50, hub=120)


@query
def bridge_hubs(l: Ledger) -> DataFrame:
    return links.hubs(l.sealed_history, l.mine, cap=50, hub=120)


@query
def payment_arcs(l: Ledger) -> DataFrame:
    return links.payment_arcs(l.sealed_history, l.outputs, l.spark.range(1, 200).select((F.col("id") - 1).alias("pos"), F.col("id").alias("lock")))


def brands(l: Ledger) -> DataFrame:
    """(pos, kind, digest): parts as addresses whose digest is shared by parts of one name length and size."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "p2pkh").otherwise("p2wpkh")
    return l.table("part").select(F.col("p_partkey").alias("pos"), kind.alias("kind"), F.sha2(F.col("p_size").cast("string"), 256).alias("digest"))


@query
def same_key(l: Ledger) -> DataFrame:
    return links.same_key(brands(l))


@query
def separations(l: Ledger) -> DataFrame:
    groups = l.table("nation").select(F.col("n_name").alias("label"))
    n = l.table("nation")
    own = l.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("a"), (F.col("s_suppkey") % 25).alias("k"), "s_suppkey")
    pairs = own.join(n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("b")), "k")
    kind = F.when(F.col("s_suppkey") % 4 == 0, "same_key").otherwise("common_input")
    return links.separations(groups, pairs.select(F.col("a").alias("group_a"), F.col("b").alias("group_b"), kind.alias("broken_by"), F.col("s_suppkey").alias("at_height")))


# -- revelations (E6 to E8, F1, F2, C4, C5) ----------------------------------


@query
def lock_totals(l: Ledger) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, [*reveal.LOCK_TYPES, "p2tr"])), (F.col("p_size") % 5 + 1).cast("int"))
    return reveal.lock_totals(l.values.join(l.table("part"), F.col("lock") == F.col("p_partkey")).select(kind.alias("type"), "lock", F.col("value").alias("sats")))


def locks(l: Ledger) -> DataFrame:
    """(type, lock, sats): parts with what their lines cost."""
    kind = F.element_at(F.array(*map(F.lit, reveal.LOCK_TYPES)), (F.col("lock") % 4 + 1).cast("int"))
    return l.lines.groupBy(F.col("l_partkey").alias("lock")).agg(F.sum(cents("l_extendedprice")).alias("sats")).withColumn("type", kind)


def opens(l: Ledger) -> DataFrame:
    """(type, lock, height): parts of returned lines, under three of four types."""
    rows = l.lines.where("l_returnflag = 'R'").join(l.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("lock"), "height").where("lock % 3 <> 0")
    every = F.explode(F.array(*map(F.lit, ["p2pkh", "p2wpkh", "p2sh"]))).alias("type")
    return rows.groupBy("lock").agg(F.min("height").alias("height")).select(every, "lock", "height")


@query
def burn_semi(l: Ledger) -> DataFrame:
    return reveal.burned(locks(l), opens(l)).where("burn_height is not null").select("type", "lock", "sats", "burn_height")


@query
def burn_anti(l: Ledger) -> DataFrame:
    return reveal.burned(locks(l), opens(l)).where("burn_height is null").select("type", "lock", "sats")


@query
def perimeter_table(l: Ledger) -> DataFrame:
    return reveal.perimeter_table(reveal.burned(locks(l), opens(l)))


@query
def face_fanout(l: Ledger) -> DataFrame:
    return opens(l).groupBy("type").agg(F.count("*").alias("n"), F.sum("height").alias("heights"))


@query
def bitmap_bytes(l: Ledger) -> DataFrame:
    rows = reveal.burned(locks(l), opens(l)).withColumn("lock", F.unhex(F.lpad(F.hex("lock"), 16, "0")))
    return reveal.bitmap(rows)


def flags(l: Ledger) -> DataFrame:
    """(category, digest, byte, height): users as digests, event types as flags."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    byte = reduce(lambda c, k: c.when(F.col("event_type") == k[1], 1 << k[0]), list(enumerate(kinds))[1:], F.when(F.col("event_type") == kinds[0], 1))
    category = F.when(F.col("user_id") % 3 == 0, "keys").otherwise("scripts20")
    return l.events.select(category.alias("category"), F.col("user_id").alias("digest"), byte.alias("byte"), F.col("event_id").alias("height"), "ts")


@query
def revelation_reduce(l: Ledger) -> DataFrame:
    return reveal.reduced(flags(l))


@query
def perimeter_filter(l: Ledger) -> DataFrame:
    rows = reveal.reduced(flags(l))
    return reveal.within(rows, cosigners=False)


@query
def exposure_status(l: Ledger) -> DataFrame:
    rows = reveal.reduced(flags(l))
    asked = l.spark.range(0, 160).select(F.when(F.col("id") % 3 == 0, "keys").otherwise("scripts20").alias("category"), F.col("id").alias("digest"), F.when(F.col("id") % 11 == 0, "p2tr").otherwise("p2pkh").alias("kind"))
    return reveal.exposure(asked, rows).select("category", "digest", "kind", "status", F.col("first_height"))


# -- nonces (F11 to F15) -------------------------------------------------------


def points(l: Ledger) -> DataFrame:
    """(point, height, flags): values that repeat, as twelve bytes, under one of two schemes."""
    point = F.unhex(F.lpad(F.hex(F.round(F.col("value")).cast("long")), 24, "0"))
    return l.events.select(point.alias("point"), F.col("event_id").alias("height"), (F.when(F.col("user_id") % 5 == 0, 2).otherwise(1) + 4).alias("flags"))


@query
def nonce_groups(l: Ledger) -> DataFrame:
    return nonces.groups(points(l), 3).withColumn("point", F.lower(F.hex("point"))).drop("tiny")


@query
def nonce_tallies(l: Ledger) -> DataFrame:
    return nonces.tallies(points(l))


@query
def nonce_faults(l: Ledger) -> DataFrame:
    return audit.nonce_faults(points(l).withColumn("flags", F.when(F.expr("height % 100 = 0"), 3).otherwise(F.col("flags"))), l.events.count() // 2)


def witness_rows(l: Ledger) -> DataFrame:
    """(r, key, s, height, flags): r from the value, key from the user, s from the type."""
    r = F.concat(F.unhex(F.lpad(F.hex(F.floor(F.col("value") / 3).cast("long")), 24, "0")), F.unhex(F.lpad(F.hex(F.when(F.col("user_id") % 40 == 0, F.col("user_id")).otherwise(1)), 40, "0")))
    key = F.when(F.col("user_id") % 7 != 0, F.unhex(F.lpad(F.hex(F.col("user_id") % 4), 40, "0")))
    s = F.unhex(F.lpad(F.hex(F.length("event_type").cast("long")), 64, "0"))
    return l.events.select(r.alias("r"), key.alias("key"), s.alias("s"), F.col("event_id").alias("height"), F.when(key.isNull(), nonces.NO_KEY).otherwise(0).alias("flags"))


@query
def resolution_cases(l: Ledger) -> DataFrame:
    out = nonces.resolutions(witness_rows(l))
    return out.select(F.lower(F.hex("point")).alias("point"), "resolution", F.size("exposed_keys").cast("long").alias("exposed"), "rows")


@query
def witness_reduce(l: Ledger) -> DataFrame:
    out = nonces.witness_rows(witness_rows(l))
    return out.select(*(F.lower(F.hex(c)).alias(c) for c in ("r", "key", "s")), "count", "height", "flags")


@query
def own_repeats(l: Ledger) -> DataFrame:
    rows = l.events.where("user_id = 9 or user_id = 12").select(F.unhex(F.lpad(F.hex(F.floor(F.col("value") / 5).cast("long")), 64, "0")).alias("r"), F.expr("event_id % 2").alias("s"), F.expr("event_id % 3").alias("s_raw"), (F.col("event_type") != "view").alias("single_key"))
    return nonces.own_repeats(rows).select(F.lower(F.hex("r")).alias("r"), "count", "verdict")


# -- sets, audits, maintenance (I, J, K) ---------------------------------------


@query
def two_road_diff(l: Ledger) -> DataFrame:
    return audit.differences(l.history, l.history_by_join)


@query
def ledger_identities(l: Ledger) -> DataFrame:
    return audit.ledger_identities(l.outputs, l.history, l.spends, net_flow(l))


@query
def interval_gaps(l: Ledger) -> DataFrame:
    rows = l.blocks.where("height % 50 <> 7").select(F.expr("(height div 10) * 10 + 1").alias("from_height"), (F.expr("(height div 10) * 10") + F.when(F.expr("(height div 10) % 30 = 4"), 8).when(F.expr("(height div 10) % 30 = 9"), 12).otherwise(10)).alias("to_height")).distinct()
    return audit.gaps(rows)


@query
def bag_union(l: Ledger) -> DataFrame:
    a = l.lines.where("l_returnflag = 'R'").select("l_partkey")
    b = l.lines.where("l_linestatus = 'F'").select("l_partkey")
    return a.unionByName(b).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query
def points_missing(l: Ledger) -> DataFrame:
    a = l.lines.where("l_quantity > 49").select(F.col("l_partkey").alias("point")).distinct()
    b = l.lines.where("l_quantity < 3").select(F.col("l_partkey").alias("point")).distinct()
    return a.exceptAll(b)


@query
def append_equals_rebuild(l: Ledger) -> DataFrame:
    """Reductions of two parts, reduced again, against the reduction of all."""
    rows = flags(l)
    parts = [reveal.reduced(rows.where(c)) for c in ("height < 3000", "height >= 3000")]
    again = reveal.reduced(parts[0].unionByName(parts[1]).withColumnRenamed("first_height", "height"))
    return audit.differences(again, reveal.reduced(rows))


@query
def rewind_cut(l: Ledger) -> DataFrame:
    """Balances as of a height, by cutting the tables back to it."""
    outputs, spends, txs = ledger.rewind(l.outputs, l.spends, l.tx_list, 900)
    return ledger.balances(ledger.spend_heights(ledger.history(outputs, spends), txs))


@query
def chain_breaks(l: Ledger) -> DataFrame:
    rows = l.blocks.select("height", (F.col("first_tx") + F.col("n_tx")).alias("block_id"), F.col("first_tx").alias("prev_hash"))
    return audit.chain_breaks(rows)


@query
def interval_digests(l: Ledger) -> DataFrame:
    return audit.interval_digests(l.tx_list.select("height", "tx_ord", "orderkey"), ["tx_ord", "orderkey"], "height", ["tx_ord"], 365)


# -- scalars (B) ---------------------------------------------------------------


@query
def digests(l: Ledger) -> DataFrame:
    x = F.col("p_name").cast("binary")
    return l.table("part").select("p_partkey", F.sha2(x, 256).alias("sha256"), F.lower(F.hex(sha256d(x))).alias("sha256d"), hash_hex(sha256d(x)).alias("display"))


@query
def lock_digests(l: Ledger) -> DataFrame:
    return l.table("part").select("p_partkey", F.lower(F.hex(hash160(F.col("p_name").cast("binary")))).alias("lock"))


@query
def chain_scalars(l: Ledger) -> DataFrame:
    h = F.col("o_orderkey") * 997
    return l.table("orders").select("o_orderkey", C.epoch_index(h).alias("epoch"), C.height_band(h).alias("band"), C.subsidy_at(h).alias("subsidy"), C.coins(cents("o_totalprice")).alias("coins"), C.decompress_amount(F.col("o_orderkey")).alias("amount"), C.price_micro((cents("o_totalprice") / F.lit(7)).cast("decimal(20,3)")).cast("long").alias("micro"))


@query
def header_round_trip(l: Ledger) -> DataFrame:
    """Headers written as 80 bytes and read again; the id as displayed."""
    h = lambda c: F.unhex(F.sha2(c.cast("string").cast("binary"), 256))
    raw = C.header_bytes(F.lit(2).cast("long"), h(F.col("o_custkey")), h(F.col("o_orderkey")), F.unix_timestamp("o_orderdate"), F.lit(486604799).cast("long"), F.col("o_orderkey"))
    f = C.header_fields(F.col("raw"))
    rows = l.table("orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", f["version"].alias("version"), f["time"].alias("time"), f["bits"].alias("bits"), f["nonce"].alias("nonce"), F.lower(F.hex(f["merkle_root"])).alias("merkle_root"), hash_hex(f["block_id"]).alias("block_id"))


@query
def pubkey_shapes(l: Ledger) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ["02", "03", "04", "05"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    size = F.when(F.expr("p_partkey % 3 = 0"), 64).otherwise(32)
    data = F.unhex(F.concat(lead, F.repeat(F.lit("ab"), size)))
    return l.table("part").groupBy(C.looks_like_pubkey(data).alias("is_key")).agg(F.count("*").alias("n"))


@query
def sighash_codes(l: Ledger) -> DataFrame:
    byte = F.expr("cast(case when event_id % 6 = 5 then null when event_id % 3 = 0 then 128 + event_id % 5 else event_id % 5 end as int)")
    rows = l.events.select(C.sighash_bits(byte).alias("bits"))
    return rows.groupBy("bits").agg(F.count("*").alias("n"), F.max(C.sighash_of(F.col("bits"))).alias("code"))


@query
def flag_stories(l: Ledger) -> DataFrame:
    rows = reveal.reduced(flags(l))
    return rows.select("category", "digest", C.flag_words(F.col("byte"), C.KEY_FLAGS).alias("story"))


@query
def height_samples(l: Ledger) -> DataFrame:
    rows = l.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.expr("height div 200"))).alias("h"))
    return rows.select("o_custkey", C.runs(F.col("h"), 8).alias("sample"))


@query
def address_codec(l: Ledger) -> DataFrame:
    """Part names are no addresses; one address of each form and a few broken ones are joined on."""
    own = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]
    own += [own[1].upper(), own[0][:-1] + "b"]
    rows = l.spark.createDataFrame([(i, a) for i, a in enumerate(own)], "pos long, address string").unionByName(l.table("part").select((F.col("p_partkey") + 100).alias("pos"), F.col("p_name").alias("address")))
    rows = rows.withColumn("d", decode_address("address"))
    script = C.script_pubkey(F.col("d.kind"), F.col("d.digest"))
    return rows.select("pos", "address", F.col("d.kind").alias("kind"), F.lower(F.hex("d.digest")).alias("digest"), F.lower(F.hex(script)).alias("script"), F.col("d.error").isNotNull().alias("refused"))


# -- windows of event time: demonstrations of the engine, outside the operators -----


@query
def tumbling_windows_demo(l: Ledger) -> DataFrame:
    return l.events.groupBy(F.expr("ts div 3600 * 3600").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum(cents("value")).alias("cents"))


@query
def session_windows_demo(l: Ledger) -> DataFrame:
    rows = l.table("events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    out = rows.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("t").alias("a"))
    return out.select("user_id", F.unix_timestamp("a").alias("start"), "n")
