"""Keys and scripts that spends reveal, and which locks they open.

inputs(height, pushes array<binary>, witness array<binary>) -> sightings
(category, digest, byte, height) -> revelations(category, digest, byte,
first_height), one row per category and digest -> burns against locks(type, lock,
sats).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.chain import looks_like_pubkey
from chainloom.functions.hashing import hash160
from chainloom.functions.scripts import script_pushes

#: Where a key was seen: in a scriptSig, a witness, a redeem or a witness script; the last bit is of its form.
SIG, WIT, INNER_SIG, INNER_WIT, UNCOMPRESSED = 1, 2, 4, 8, 16
LOCK_TYPES = ["p2pkh", "p2sh", "p2wpkh", "p2wsh"]


def sightings(inputs: DataFrame) -> DataFrame:
    """(category, digest, byte, height) of everything that inputs reveal; malformed scripts reveal nothing."""
    none = F.array().cast("array<binary>")
    rows = inputs.select("height", F.coalesce("pushes", none).alias("p"), F.coalesce("witness", none).alias("w"))
    last = lambda c: F.when(F.size(c) > 0, F.element_at(c, -1))
    rows = rows.select("height", "p", "w", last("p").alias("redeem"), last("w").alias("script"))
    rows = rows.withColumns({"inner_p": F.coalesce(script_pushes("redeem"), none), "inner_w": F.coalesce(script_pushes("script"), none)})
    keys = lambda c, flag: F.transform(F.filter(c, looks_like_pubkey), lambda k: F.struct(F.lit("keys").alias("category"), k.alias("data"), (F.lit(flag) + F.when(F.length(k) == 65, UNCOMPRESSED).otherwise(0)).alias("byte")))
    count = lambda c: F.least(F.size(F.filter(c, looks_like_pubkey)), F.lit(255))
    script = lambda c, category, inner: F.filter(F.array(F.struct(F.lit(category).alias("category"), F.col(c).alias("data"), count(inner).alias("byte"))), lambda s: s["data"].isNotNull())
    every = F.concat(keys("p", SIG), keys("w", WIT), keys("inner_p", INNER_SIG), keys("inner_w", INNER_WIT), script("redeem", "scripts20", "inner_p"), script("script", "scripts32", "inner_w"))
    seen = rows.select("height", F.explode(every).alias("s")).select("height", "s.*")
    # the same bytes are often seen again: they are reduced before they are hashed and shuffled on
    seen = seen.groupBy("category", "data").agg(F.bit_or("byte").alias("ored"), F.max("byte").alias("most"), F.min("height").alias("height"))
    digest = F.when(F.col("category") == "scripts32", F.unhex(F.sha2("data", 256))).otherwise(hash160("data"))
    return seen.select("category", digest.alias("digest"), F.when(F.col("category") == "keys", F.col("ored")).otherwise(F.col("most")).alias("byte"), "height")


def reduced(seen: DataFrame) -> DataFrame:
    """(category, digest, byte, first_height): flags of keys OR-ed, counts of scripts by their maximum, the lowest height."""
    byte = F.when(F.col("category") == "keys", F.bit_or("byte")).otherwise(F.max("byte"))
    return seen.groupBy("category", "digest").agg(byte.alias("byte"), F.min("height").alias("first_height"))


def within(revelations: DataFrame, cosigners: bool = True) -> DataFrame:
    """Revelations of a perimeter: with cosigners, keys seen inside scripts count too."""
    bits = SIG | WIT | (INNER_SIG | INNER_WIT if cosigners else 0)
    return revelations.where((F.col("category") != "keys") | (F.col("byte").bitwiseAND(bits) != 0))


def opened(revelations: DataFrame, faces: bool = True, cosigners: bool = True) -> DataFrame:
    """(type, lock, height): the locks that revelations open.

    faces: a key opens all its forms; else only the form of where it was seen.
    """
    rows = within(revelations, cosigners)
    sig, wit = SIG | (INNER_SIG if cosigners else 0), WIT | (INNER_WIT if cosigners else 0)
    wrapped = hash160(F.concat(F.unhex(F.lit("0014")), F.col("digest")))
    one = lambda kind, lock, ok: F.when(ok, F.struct(F.lit(kind).alias("type"), lock.alias("lock")))
    key, d = F.col("category") == "keys", F.col("digest")
    byte = lambda bits: F.col("byte").bitwiseAND(bits) != 0
    always = F.lit(True)
    forms = [one("p2pkh", d, key & (always if faces else byte(sig))), one("p2wpkh", d, key & (always if faces else byte(wit))), one("p2sh", d, F.col("category") == "scripts20"), one("p2wsh", d, F.col("category") == "scripts32")]
    if faces:
        forms.append(one("p2sh", F.col("wrapped"), key))
        rows = rows.withColumn("wrapped", F.when(key, wrapped))
    out = rows.select(F.explode(F.array_compact(F.array(*forms))).alias("f"), "first_height")
    return out.groupBy("f.type", "f.lock").agg(F.min("first_height").alias("height"))


def lock_totals(coins: DataFrame) -> DataFrame:
    """(type, lock, sats, coins) of coins(type, lock, sats) of the four types that hide a key or script."""
    return coins.where(F.col("type").isin(LOCK_TYPES)).groupBy("type", "lock").agg(F.sum("sats").alias("sats"), F.count("*").alias("coins"))


def burned(locks: DataFrame, opens: DataFrame) -> DataFrame:
    """locks with burn_height: the lowest height from which each is open, null for those that are not."""
    return locks.join(opens.select("type", "lock", F.col("height").alias("burn_height")), ["type", "lock"], "left")


def perimeter_table(burns: DataFrame) -> DataFrame:
    """(type, locks, sats, hits, hit_sats), a row for each type and ALL."""
    hit = F.col("burn_height").isNotNull()
    rows = burns.rollup("type").agg(F.count("*").alias("locks"), F.sum("sats").alias("sats"), F.count(F.when(hit, 1)).alias("hits"), F.coalesce(F.sum(F.when(hit, F.col("sats"))), F.lit(0)).alias("hit_sats"))
    return rows.withColumn("type", F.coalesce("type", F.lit("ALL")))


def exposure(queries: DataFrame, revelations: DataFrame) -> DataFrame:
    """queries(category, digest, kind) with status and first_height.

    Taproot shows its key by construction; a hit is exposed by reuse; what is
    absent is protected.
    """
    found = queries.join(revelations.select("category", "digest", "byte", "first_height"), ["category", "digest"], "left")
    status = F.when(F.col("kind") == "p2tr", "exposed_by_construction").when(F.col("first_height").isNotNull(), "exposed_by_reuse").otherwise("protected")
    return found.withColumn("status", status)


def bitmap(burns: DataFrame) -> DataFrame:
    """(type, byte_no, byte): bit i of a type's bitmap, lowest first, tells whether its i-th lock in order is burnt."""
    rank = F.row_number().over(Window.partitionBy("type", "bucket").orderBy("lock")) - 1
    rows = burns.select("type", "lock", F.col("burn_height").isNotNull().alias("hit"), F.substring("lock", 1, 2).alias("bucket"))
    sizes = rows.groupBy("type", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("type", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = rows.withColumn("k", rank).join(before, ["type", "bucket"]).select("type", (F.col("before") + F.col("k")).alias("i"), "hit")
    bit = F.when(F.col("hit"), F.call_function("shiftleft", F.lit(1), (F.col("i") % 8).cast("int"))).otherwise(0)
    return at.groupBy("type", F.expr("i div 8").alias("byte_no")).agg(F.sum(bit).cast("int").alias("byte"))


def bitmap_fingerprint(burns: DataFrame) -> str:
    """One digest of all bitmaps, in the order of LOCK_TYPES; bytes are hashed as they arrive in order."""
    import hashlib

    whole = hashlib.sha256(b"reuse-hits-v1")
    for kind in LOCK_TYPES:
        own = hashlib.sha256()
        for row in bitmap(burns.where(F.col("type") == kind)).orderBy("byte_no").toLocalIterator():
            own.update(bytes([row.byte]))
        whole.update(kind.encode() + own.digest())
    return whole.hexdigest()
