"""Nonce points of signatures: the census, its groups, witnesses and what they mean.

census(point, height, flags) is a bag: repeated rows are signatures of their own.
witness rows: (r, key, s, height, flags); key is null where it can't be told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.chain import SCHEMES, flag_words, looks_like_pubkey, runs, sighash_bits, tiny
from chainloom.functions.hashing import hash160
from chainloom.functions.scripts import ORDER, signatures

POINT = 12
SCHNORR, NO_KEY, AMBIGUOUS, HIGH_S = 1, 2, 4, 8
ORDER_BYTES = ORDER.to_bytes(32, "big").hex()


def extracted(inputs: DataFrame) -> DataFrame:
    """inputs with sig (all signatures) and the counts of what only looked like one."""
    return inputs.withColumn("sig", signatures("pushes", "witness"))


def census(found: DataFrame) -> DataFrame:
    """(point, height, flags): a row for each signature."""
    rows = found.select("height", F.explode("sig.found").alias("x"))
    flags = F.when(F.col("x.schnorr"), 2).otherwise(1).bitwiseOR(sighash_bits(F.col("x.sighash")))
    return rows.select(F.substring("x.r", 1, POINT).alias("point"), "height", flags.cast("int").alias("flags"))


def extraction_stats(found: DataFrame) -> DataFrame:
    """(inputs, ecdsa, schnorr, without, malformed, oversize, impossible)."""
    n = lambda c: F.size(F.filter("sig.found", lambda x: x["schnorr"] if c else ~x["schnorr"]))
    return found.agg(
        F.count("*").alias("inputs"), F.sum(n(False)).alias("ecdsa"), F.sum(n(True)).alias("schnorr"), F.count(F.when(F.size("sig.found") == 0, 1)).alias("without"), *(F.sum(f"sig.{c}").alias(c) for c in ("malformed", "oversize", "impossible"))
    )


def groups(rows: DataFrame, least: int = 2, heights: int = 8) -> DataFrame:
    """(point, count, flags, first_height, last_height, heights, schemes, tiny, mixed) of points seen at least so often.

    heights: the first few, as text. They are ranked before they are gathered, so
    no group is held whole.
    """
    sums = rows.groupBy("point").agg(F.count("*").alias("count"), F.bit_or("flags").alias("flags"), F.min("height").alias("first_height"), F.max("height").alias("last_height")).where(F.col("count") >= least)
    # of one height no more than the sample are looked at, whatever the group's size
    few = rows.groupBy("point", "height").agg(F.count("*").alias("n")).join(sums.select("point"), "point", "left_semi")
    k = F.row_number().over(Window.partitionBy("point").orderBy("height"))
    few = few.withColumn("k", k).where(F.col("k") <= heights)
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("height", "n"))), lambda x: F.array_repeat(x["height"], F.least(x["n"], F.lit(heights)).cast("int"))))
    sample = few.groupBy("point").agg(runs(repeated, heights).alias("heights"))
    both = F.col("flags").bitwiseAND(3) == 3
    return sums.join(sample, "point").select("point", "count", "flags", "first_height", "last_height", "heights", flag_words(F.col("flags"), SCHEMES, "+").alias("schemes"), tiny_point(F.col("point")).alias("tiny"), both.alias("mixed"))


def tiny_point(point: Column) -> Column:
    return tiny(point, 3)


def tallies(rows: DataFrame) -> DataFrame:
    """(records, ecdsa, schnorr, points, repeated_points, repeat_sightings): extra sightings are those beyond a point's first."""
    per = rows.groupBy("point").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("flags").bitwiseAND(bit) != 0, 1)).alias(name) for bit, name in SCHEMES.items()))
    return per.agg(F.sum("n").alias("records"), *(F.sum(x).alias(x) for x in SCHEMES.values()), F.count("*").alias("points"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated_points"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("repeat_sightings"))


def candidate_inputs(inputs: DataFrame, rows: DataFrame, least: int = 2) -> DataFrame:
    """Inputs of the heights at which a repeated point was seen: what has to be read again."""
    points = rows.groupBy("point").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("point")
    heights = rows.join(points, "point", "left_semi").select("height").distinct()
    return inputs.join(heights, "height", "left_semi")


def witness(found: DataFrame, points: DataFrame) -> DataFrame:
    """(r, key, s, s_raw, height, flags) of each signature of the points asked for.

    The key is told only where an input has one such signature and one key.
    An input is named by height, tx_ord and idx.
    """
    items = F.concat("pushes", "witness")
    keys = F.filter(items, lambda k: looks_like_pubkey(k) | ((F.length(k).isin(33, 65)) & F.hex(F.substring(k, 1, 1)).isin("02", "03", "04")))
    rows = found.withColumn("input", F.struct("height", "tx_ord", "idx")).select("input", "height", keys.alias("keys"), F.explode("sig.found").alias("x"))
    rows = rows.join(points.select(F.col("point")), F.substring("x.r", 1, POINT) == F.col("point"), "left_semi")
    rows = rows.withColumn("hits", F.count("*").over(Window.partitionBy("input")))
    many = (F.col("hits") > 1) | (F.size("keys") > 1)
    one = ~many & (F.size("keys") == 1)
    flags = F.when(F.col("x.schnorr"), SCHNORR).otherwise(0) + F.when(many, AMBIGUOUS).when(~one, NO_KEY).otherwise(0) + F.when(F.col("x.s") != F.col("x.s_raw"), HIGH_S).otherwise(0)
    return rows.select(F.col("x.r").alias("r"), hash160(F.when(one, F.element_at("keys", 1))).alias("key"), F.col("x.s").alias("s"), F.col("x.s_raw").alias("s_raw"), "height", flags.cast("int").alias("flags"))


def witness_rows(rows: DataFrame, most: int = 2) -> DataFrame:
    """(r, key, s, count, height, flags): of each r, key and kind the first two different s in order of height, and how many there are."""
    kind = F.col("flags").bitwiseAND(SCHNORR | NO_KEY | AMBIGUOUS)
    each = rows.withColumn("kind", kind).groupBy("r", "key", "kind", "s").agg(F.min(F.struct("height", "flags")).alias("m"))
    own = Window.partitionBy("r", "key", "kind")
    each = each.withColumns({"count": F.count("*").over(own), "k": F.row_number().over(own.orderBy("m.height", "s"))})
    return each.where(F.col("k") <= most).select("r", "key", "s", "count", F.col("m.height").alias("height"), F.col("m.flags").alias("flags"))


def resolutions(rows: DataFrame) -> DataFrame:
    """(point, resolution, exposed_keys, rows) of witness rows.

    In this order: no r can be one: not-a-signature; several r: prefix-collision;
    a key with two s: exposed; several keys: distinct-keys; one key and nothing
    untold: one-signature; else undetermined.
    """
    n = F.unhex(F.lit(ORDER_BYTES))
    impossible = (F.col("r") == F.unhex(F.lit("00" * 32))) | (F.col("r") >= n)
    keyed = rows.withColumns({"point": F.substring("r", 1, POINT), "impossible": impossible})
    per_key = keyed.groupBy("point", "key").agg(F.countDistinct("s").alias("ss"), F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.bool_and("impossible").alias("impossible"))
    told = F.col("key").isNotNull()
    sums = per_key.groupBy("point").agg(
        F.bool_and("impossible").alias("impossible"),
        (F.min("lo") != F.max("hi")).alias("several"),
        F.array_sort(F.collect_list(F.when(told & (F.col("ss") >= 2), F.col("key")))).alias("exposed"),
        F.count(F.when(told, 1)).alias("keys"),
        F.coalesce(F.sum(F.when(~told, F.col("n"))), F.lit(0)).alias("opaque"),
        F.sum("n").alias("rows"),
    )
    what = (
        F.when(F.col("impossible"), "not-a-signature")
        .when(F.col("several"), "prefix-collision")
        .when(F.size("exposed") > 0, "exposed")
        .when(F.col("keys") > 1, "distinct-keys")
        .when((F.col("keys") == 1) & (F.col("opaque") == 0), "one-signature")
        .otherwise("undetermined")
    )
    return sums.select("point", what.alias("resolution"), F.when(what == "exposed", F.col("exposed")).otherwise(F.array().cast("array<binary>")).alias("exposed_keys"), "rows")


def own_repeats(rows: DataFrame, census_rows: DataFrame | None = None) -> DataFrame:
    """(r, count, verdict, elsewhere) of nonces that one lock's signatures repeat.

    rows(r, s, s_raw, single_key, height) of that lock. identical: one signature
    again; negated: s and its negation of one; key-follows: two messages under one
    key; unclear: several keys. elsewhere: sightings in the census that are not
    this lock's.
    """
    out = rows.groupBy("r").agg(F.count("*").alias("count"), F.countDistinct("s").alias("ss"), F.countDistinct("s_raw").alias("raws"), F.bool_and("single_key").alias("single")).where("count > 1")
    verdict = F.when((F.col("ss") == 1) & (F.col("raws") == 1), "identical").when(F.col("ss") == 1, "negated").when(F.col("single"), "key-follows").otherwise("unclear")
    out = out.withColumn("verdict", verdict).withColumn("point", F.substring("r", 1, POINT))
    if census_rows is None:
        return out.select("r", "count", "verdict", F.lit(None).cast("long").alias("elsewhere"))
    seen = census_rows.groupBy("point").agg(F.count("*").alias("n"))
    out = out.join(seen, "point", "left")
    return out.select("r", "count", "verdict", F.greatest(F.coalesce("n", F.lit(0)) - F.col("count"), F.lit(0)).alias("elsewhere"))


def unknown_items(found: DataFrame, most: int = 12) -> DataFrame:
    """(size, first_byte, n): the commonest items of inputs that show no signature."""
    rows = found.where(F.size("sig.found") == 0).select(F.explode(F.concat("pushes", "witness")).alias("x"))
    return rows.groupBy(F.length("x").alias("size"), F.lower(F.hex(F.substring("x", 1, 1))).alias("first_byte")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size", "first_byte").limit(most)
