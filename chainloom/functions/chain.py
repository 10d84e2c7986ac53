"""Scalar functions of ledgers, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALVING, SUBSIDY, COIN = 210_000, 5_000_000_000, 100_000_000


def epoch_index(height: Column) -> Column:
    """Subsidy era of a height; the fifth holds all later ones."""
    return F.least(F.floor(height / HALVING), F.lit(4)).cast("int")


def height_band(height: Column, width: int = 50_000) -> Column:
    """Lower end of the band of heights."""
    return (F.floor(height / width) * width).cast("long")


def subsidy_at(height: Column) -> Column:
    """New coins of a block: halved every HALVING blocks, none from the 64th halving."""
    era = F.floor(height / HALVING).cast("int")
    return F.when(era < 64, F.call_function("shiftright", F.lit(SUBSIDY).cast("long"), era)).otherwise(F.lit(0).cast("long"))


def little_endian(data: Column, start: int, size: int) -> Column:
    """size bytes of a binary column from start (0-based) as an unsigned little-endian BIGINT."""
    return F.conv(F.concat(*(F.hex(F.substring(data, start + i + 1, 1)) for i in reversed(range(size)))), 16, 10).cast("decimal(20,0)").cast("long")


def header_fields(raw: Column) -> dict[str, Column]:
    """The fields of an 80-byte header."""
    from chainloom.functions.hashing import sha256d

    return {
        "version": little_endian(raw, 0, 4),
        "prev_hash": F.substring(raw, 5, 32),
        "merkle_root": F.substring(raw, 37, 32),
        "time": little_endian(raw, 68, 4),
        "bits": little_endian(raw, 72, 4),
        "nonce": little_endian(raw, 76, 4),
        "block_id": sha256d(F.substring(raw, 1, 80)),
    }


def little_bytes(value: Column, size: int) -> Column:
    """An unsigned BIGINT as size little-endian bytes."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(size)))))


def header_bytes(version: Column, prev_hash: Column, merkle_root: Column, time: Column, bits: Column, nonce: Column) -> Column:
    """80 bytes of the fields, as header_fields reads them."""
    return F.concat(little_bytes(version, 4), prev_hash, merkle_root, little_bytes(time, 4), little_bytes(bits, 4), little_bytes(nonce, 4))


def bip34_height(script: Column) -> Column:
    """The height that a coinbase script starts with: a minimal push of 1 to 4 bytes, not negative; else null."""
    size = little_endian(script, 0, 1)
    body = F.substring(script, F.lit(2), size.cast("int"))
    number = F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(body), F.lit("(..)"), 1)), ""), 16, 10).cast("long")
    last = F.conv(F.hex(F.substring(body, -1, 1)), 16, 10).cast("int")
    before = F.conv(F.hex(F.substring(body, -2, 1)), 16, 10).cast("int")
    minimal = (last != 0) | ((size > 1) & (before >= 128))
    return F.when((F.length(script) > size) & size.between(1, 4) & (last < 128) & minimal, number)


def looks_like_pubkey(data: Column) -> Column:
    """33 bytes from 02 or 03, or 65 from 04."""
    first = F.hex(F.substring(data, 1, 1))
    return ((F.length(data) == 33) & first.isin("02", "03")) | ((F.length(data) == 65) & (first == "04"))


def classify_script(type_code: Column, script: Column) -> Column:
    """Type of an output of a snapshot, by its code or, from 6, by its script."""
    n, byte = F.length(script), lambda i: F.conv(F.hex(F.substring(script, i, 1)), 16, 10).cast("int")
    small = byte(1).between(0x51, 0x60)
    return (
        F.when(type_code == 0, "p2pkh")
        .when(type_code == 1, "p2sh")
        .when(type_code.isin(2, 3), "p2pk_c")
        .when(type_code.isin(4, 5), "p2pk_u")
        .when((n == 22) & (byte(1) == 0) & (byte(2) == 20), "p2wpkh")
        .when((n == 34) & (byte(1) == 0) & (byte(2) == 32), "p2wsh")
        .when((n == 34) & (byte(1) == 0x51) & (byte(2) == 32), "p2tr")
        .when((n >= 4) & (byte(-1) == 0xAE) & small, "multisig")
        .when((n >= 4) & ((byte(1) == 0) | small) & (byte(2) == n - 2) & (n - 2).between(2, 40), "witness_other")
        .otherwise("other")
    )


def script_pubkey(kind: Column, digest: Column) -> Column:
    """The script that an address stands for."""
    x = lambda h: F.unhex(F.lit(h))
    return (
        F.when(kind == "p2pkh", F.concat(x("76a914"), digest, x("88ac")))
        .when(kind == "p2sh", F.concat(x("a914"), digest, x("87")))
        .when(kind == "p2wpkh", F.concat(x("0014"), digest))
        .when(kind == "p2wsh", F.concat(x("0020"), digest))
        .when(kind == "p2tr", F.concat(x("5120"), digest))
    )


def decompress_amount(x: Column) -> Column:
    """The amount that a snapshot stores compressed."""
    y = x - 1
    e, rest = y % 10, F.floor(y / 10)
    n = F.when(e < 9, F.floor(rest / 9) * 10 + rest % 9 + 1).otherwise(rest + 1)
    tens = F.element_at(F.array(*(F.lit(10**k) for k in range(10))), (e + 1).cast("int"))
    return F.when(x == 0, F.lit(0).cast("long")).otherwise((n * tens).cast("long"))


def tiny(point: Column, zeros: int = 3) -> Column:
    """Whether the first bytes of a point are zero."""
    return F.substring(point, 1, zeros) == F.unhex(F.lit("00" * zeros))


# Signature hash bytes of code 1 to 6; code 0 is no byte, 7 any other.
SIGHASH = [0x01, 0x02, 0x03, 0x81, 0x82, 0x83]
SCHEMES = {1: "ecdsa", 2: "schnorr"}
KEY_FLAGS = {1: "in a scriptSig", 2: "in a witness", 4: "inside a redeem script", 8: "inside a witness script", 16: "uncompressed"}


def sighash_bits(byte: Column) -> Column:
    """Bits 2 to 4 of a signature's flags; null byte: none given."""
    code = F.when(byte.isNull(), 0)
    for i, b in enumerate(SIGHASH):
        code = code.when(byte == b, i + 1)
    return F.shiftleft(code.otherwise(7), 2)


def sighash_of(flags: Column) -> Column:
    """The code of a signature's flags."""
    return F.shiftright(flags.bitwiseAND(0b11100), 2)


def flag_words(flags: Column, names: dict[int, str], join: str = "; ") -> Column:
    """The names of the bits that are set."""
    return F.concat_ws(join, *(F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in names.items()))


def utc_date(seconds: Column) -> Column:
    """yyyy-MM-dd of Unix seconds; the session's time zone is UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def coins(sats: Column) -> Column:
    """Satoshis as coins with eight digits."""
    return (sats.cast("decimal(20,0)") / F.lit(COIN)).cast("decimal(20,8)").cast("string")


def price_micro(price: Column) -> Column:
    """A positive price in millionths, rounded half to even; others stop the query."""
    micro = F.bround(price.cast("decimal(38,18)") * 1_000_000, 0).cast("decimal(20,0)")
    return F.when(price.isNull() | ((price > 0) & (micro > 0)), micro).otherwise(F.raise_error(F.lit("a price must be positive")))


def canonical_price(text: Column) -> Column:
    """A price in plain notation with its own digits; null if it isn't a positive decimal number."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$") & (F.try_to_number(F.translate(plain, "0.", ""), F.lit("9" * 30)).isNotNull()), plain)


def runs(values: Column, most: int = 8) -> Column:
    """An array in order as text: equal neighbours once, with how often; at most so many values are looked at."""
    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (F.when(F.size(done) > 0, last["v"]) == x)
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        again = F.concat(head, F.array(F.struct(x.alias("v"), (F.when(F.size(done) > 0, last["n"]) + 1).alias("n"))))
        return F.when(same, again).otherwise(F.concat(done, F.array(F.struct(x.alias("v"), F.lit(1).alias("n")))))

    start = F.array().cast("array<struct<v:bigint,n:int>>")
    done = F.aggregate(F.slice(values, 1, most), start, lambda d, x: step(d, x.cast("long")).cast("array<struct<v:bigint,n:int>>"))
    return F.array_join(F.transform(done, lambda r: F.when(r["n"] > 1, F.concat_ws(" x", r["v"].cast("string"), r["n"].cast("string"))).otherwise(r["v"].cast("string"))), ", ")
