"""Who shares transactions with whom: co-spends, co-inputs, linkage, payments, separations.

Tables as in ledger; mine(pos, lock, ...) is a caller's list of locks, whose size
the caller bounds and which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP, HUB, BLOCK = 10_000, 1_000, 512


def cospends(spends: DataFrame, outputs: DataFrame, out_ords: DataFrame) -> DataFrame:
    """(out_ord, spender_tx, other_out, other_lock, other_value): outputs spent together with those asked for."""
    own = spends.join(out_ords.select("out_ord"), "out_ord", "left_semi")
    others = spends.select(F.col("out_ord").alias("other_out"), "spender_tx")
    pairs = own.join(others, "spender_tx").where("out_ord <> other_out")
    named = outputs.select(F.col("out_ord").alias("other_out"), F.col("lock").alias("other_lock"), F.col("value").alias("other_value"))
    return pairs.join(named, "other_out").select("out_ord", "spender_tx", "other_out", "other_lock", "other_value")


def capped_spenders(history: DataFrame, cap: int, late: bool = False) -> DataFrame:
    """(lock, spender_tx, truncated): the first cap different spenders of a lock, in order of its outputs.

    truncated: whether there are more; late: or whether one of the first comes
    again after the last of them was found.
    """
    spent = history.where("spender_tx is not null")
    first = spent.groupBy("lock", "spender_tx").agg(F.min("out_ord").alias("first_out"), F.max("out_ord").alias("last_out"))
    # the rank alone is filtered, so each task drops what is beyond the cap before the shuffle
    k = F.row_number().over(Window.partitionBy("lock").orderBy("first_out"))
    kept = first.withColumn("k", k).where(F.col("k") <= cap)
    sizes = first.groupBy("lock").agg(F.count("*").alias("n"), F.max("last_out").alias("end"))
    if not late:
        return kept.join(sizes, "lock").select("lock", "spender_tx", (F.col("n") > cap).alias("truncated"))
    full = kept.where(F.col("k") == cap).select("lock", F.col("first_out").alias("full"))
    more = (F.col("n") > cap) | F.coalesce(F.col("end") > F.col("full"), F.lit(False))
    return kept.join(sizes.join(full, "lock", "left").select("lock", more.alias("truncated")), "lock").select("lock", "spender_tx", "truncated")


def co_inputs(history: DataFrame, locks: DataFrame, cap: int = CAP) -> DataFrame:
    """(lock, spenders, other_inputs, other_locks, truncated) of the locks asked for: what their spends had beside them."""
    asked = locks.select("lock").distinct()
    own = capped_spenders(history.join(F.broadcast(asked), "lock", "left_semi"), cap, late=True)
    inputs = history.where("spender_tx is not null").select(F.col("lock").alias("other"), "spender_tx")
    beside = own.join(inputs, "spender_tx").where("other <> lock")
    counts = beside.groupBy("lock").agg(F.count("*").alias("other_inputs"), F.countDistinct("other").alias("other_locks"))
    sizes = own.groupBy("lock").agg(F.count("*").alias("spenders"), F.max("truncated").alias("truncated"))
    rows = asked.join(sizes, "lock", "left").join(counts, "lock", "left")
    return rows.select("lock", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("spenders", "other_inputs", "other_locks")), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def common_input(history: DataFrame, txs: DataFrame, mine: DataFrame, cap: int = CAP) -> DataFrame:
    """(pos_a, pos_b, height, tx_ord): pairs of my locks spent in one transaction; the lowest height of each pair."""
    own = F.broadcast(mine.select("pos", "lock"))
    rows = capped_spenders(history.join(own, "lock", "left_semi"), cap).join(own, "lock")
    all_mine = history.where("spender_tx is not null").join(own, "lock").select(F.col("pos").alias("pos_b"), "spender_tx").distinct()
    pairs = rows.join(all_mine, "spender_tx").where("pos <> pos_b")
    at = txs.select(F.col("tx_ord").alias("spender_tx"), "height")
    pairs = pairs.join(at, "spender_tx").groupBy(F.least("pos", "pos_b").alias("pos_a"), F.greatest("pos", "pos_b").alias("pos_b")).agg(F.min(F.struct("height", F.col("spender_tx").alias("tx_ord"))).alias("m"))
    return pairs.select("pos_a", "pos_b", "m.height", "m.tx_ord")


def through_bridge(history: DataFrame, txs: DataFrame, mine: DataFrame, cap: int = CAP, hub: int = HUB) -> DataFrame:
    """(pos_a, pos_b, bridge, height, fanout): pairs of my locks that shared a transaction with one other lock each.

    A bridge whose own spends have more than hub inputs beside it is not
    expanded. The lowest height of the first hop counts, then the bridge.
    """
    own = F.broadcast(mine.select("pos", "lock"))
    inputs = history.where("spender_tx is not null").select("lock", "spender_tx")
    first = capped_spenders(history.join(own, "lock", "left_semi"), cap).join(own, "lock").select("pos", "lock", "spender_tx")
    hop = first.join(inputs.select(F.col("lock").alias("bridge"), "spender_tx"), "spender_tx").where("bridge <> lock")
    hop = hop.join(own.select(F.col("lock").alias("bridge")), "bridge", "left_anti")
    hop = hop.join(txs.select(F.col("tx_ord").alias("spender_tx"), "height"), "spender_tx").groupBy("pos", "bridge").agg(F.min("height").alias("height"))
    bridges = hop.select("bridge").distinct()
    onward = capped_spenders(history.join(bridges.withColumnRenamed("bridge", "lock"), "lock", "left_semi"), cap).select(F.col("lock").alias("bridge"), "spender_tx")
    beside = onward.join(inputs, "spender_tx").where("lock <> bridge")
    fanout = beside.groupBy("bridge").agg(F.count("*").alias("fanout")).where(F.col("fanout") <= hub)
    ends = beside.join(own, "lock").select("bridge", F.col("pos").alias("end")).distinct().join(fanout, "bridge")
    pairs = hop.join(ends, "bridge").where("pos <> end")
    found = pairs.groupBy(F.least("pos", "end").alias("pos_a"), F.greatest("pos", "end").alias("pos_b")).agg(F.min(F.struct("height", "bridge", "fanout")).alias("m"))
    return found.select("pos_a", "pos_b", "m.bridge", "m.height", "m.fanout")


def hubs(history: DataFrame, mine: DataFrame, cap: int = CAP, hub: int = HUB) -> DataFrame:
    """(bridges, not_expanded): how many locks stand beside mine, and how many of them are hubs."""
    own = F.broadcast(mine.select("lock"))
    inputs = history.where("spender_tx is not null").select("lock", "spender_tx")
    first = capped_spenders(history.join(own, "lock", "left_semi"), cap).select("spender_tx").distinct()
    bridges = inputs.join(first, "spender_tx", "left_semi").select("lock").distinct().join(own, "lock", "left_anti")
    onward = capped_spenders(history.join(bridges, "lock", "left_semi"), cap).select(F.col("lock").alias("bridge"), "spender_tx")
    fanout = onward.join(inputs, "spender_tx").where("lock <> bridge").groupBy("bridge").agg(F.count("*").alias("fanout"))
    return bridges.join(fanout, bridges["lock"] == fanout["bridge"], "left").agg(F.count("*").alias("bridges"), F.count(F.when(F.col("fanout") > hub, 1)).alias("not_expanded"))


def payment_arcs(history: DataFrame, outputs: DataFrame, mine: DataFrame) -> DataFrame:
    """(from_pos, to_pos, tx_ord): transactions with one of my locks among the inputs and another among the outputs."""
    own = F.broadcast(mine.select("pos", "lock"))
    paid = outputs.join(own, "lock").select(F.col("pos").alias("to_pos"), "tx_ord").distinct()
    funded = history.where("spender_tx is not null").join(own, "lock").select(F.col("pos").alias("from_pos"), F.col("spender_tx").alias("tx_ord")).distinct()
    return funded.join(paid, "tx_ord").where("from_pos <> to_pos").select("from_pos", "to_pos", "tx_ord")


def same_key(addresses: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos_a, pos_b): addresses of one key digest under two encodings; addresses(pos, kind, digest).

    All pairs, so their number grows with the square of a digest's addresses.
    The positions of each kind are dealt to blocks of about block; two blocks
    are one row, which any task may take, and are unfolded only there.
    """
    one = F.col("kind") == "p2pkh"
    keys = addresses.where(F.col("kind").isin("p2pkh", "p2wpkh") & F.col("pos").isNotNull()).select("pos", "kind", "digest")
    sizes = keys.groupBy("digest").agg(*(F.ceil(F.count_if(c) / block).alias(n) for c, n in ((one, "n_a"), (~one, "n_b")))).where("n_a > 0 and n_b > 0")
    own = F.pmod(F.xxhash64("pos"), F.when(one, F.col("n_a")).otherwise(F.col("n_b")))
    blocks = keys.join(sizes, "digest").groupBy("digest", "kind", "n_a", "n_b", own.alias("own")).agg(F.collect_list("pos").alias("list"))
    a = blocks.where(one).select("digest", F.col("own").alias("block_a"), F.explode(F.expr("sequence(0, n_b - 1)")).alias("block_b"), F.col("list").alias("a"))
    b = blocks.where(~one).select("digest", F.explode(F.expr("sequence(0, n_a - 1)")).alias("block_a"), F.col("own").alias("block_b"), F.col("list").alias("b"))
    # a stated number of partitions: adaptive execution would gather the blocks, whose bytes are few beside their pairs
    on, parts = ["digest", "block_a", "block_b"], int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = a.repartition(parts, *on).join(b.repartition(parts, *on), on)
    # this coalesce gathers nothing; it parts the generated code, which would hold all pairs of two blocks at once
    pairs = pairs.select(F.explode("a").alias("a"), "b").coalesce(parts).select("a", F.explode("b").alias("b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("pos_a"), F.greatest("a", "b").alias("pos_b"))


def separations(groups: DataFrame, breaks: DataFrame) -> DataFrame:
    """(group_a, group_b, held, broken_by, at_height): all pairs of groups that claim to be separate.

    groups(label) is a caller's short list; breaks(group_a, group_b, broken_by,
    at_height). A break by the same key goes before others, then the lowest height.
    """
    a, b = groups.select(F.col("label").alias("group_a")), groups.select(F.col("label").alias("group_b"))
    own = breaks.where("group_a <> group_b").select(F.least("group_a", "group_b").alias("group_a"), F.greatest("group_a", "group_b").alias("group_b"), "broken_by", "at_height")
    rank = F.struct((F.col("broken_by") != "same_key").alias("r"), F.col("at_height").alias("h"), "broken_by")
    own = own.groupBy("group_a", "group_b").agg(F.min(rank).alias("m")).select("group_a", "group_b", F.col("m.broken_by").alias("broken_by"), F.col("m.h").alias("at_height"))
    pairs = a.join(F.broadcast(b), F.col("group_a") < F.col("group_b"))
    return pairs.join(own, ["group_a", "group_b"], "left").select("group_a", "group_b", F.col("broken_by").isNull().alias("held"), "broken_by", "at_height")
