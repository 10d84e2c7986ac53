"""Digests as columns: JVM-side where Spark has the function, Arrow batches for hash160."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of RIPEMD-160: order of the message words and rotations of the left and right lines, constants.
LEFT_WORDS = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    [7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8],
    [3, 10, 14, 4, 9, 15, 8, 1, 2, 7, 0, 6, 13, 11, 5, 12],
    [1, 9, 11, 10, 0, 8, 12, 4, 13, 3, 7, 15, 14, 5, 6, 2],
    [4, 0, 5, 9, 7, 12, 2, 10, 14, 1, 3, 8, 11, 6, 15, 13],
]
RIGHT_WORDS = [
    [5, 14, 7, 0, 9, 2, 11, 4, 13, 6, 15, 8, 1, 10, 3, 12],
    [6, 11, 3, 7, 0, 13, 5, 10, 14, 15, 8, 12, 4, 9, 1, 2],
    [15, 5, 1, 3, 7, 14, 6, 9, 11, 8, 12, 2, 10, 0, 4, 13],
    [8, 6, 4, 1, 3, 11, 15, 0, 5, 12, 2, 13, 9, 7, 10, 14],
    [12, 15, 10, 4, 1, 5, 8, 7, 6, 2, 13, 14, 0, 3, 9, 11],
]
LEFT_TURNS = [
    [11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8],
    [7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12],
    [11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5],
    [11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12],
    [9, 15, 5, 11, 6, 8, 13, 12, 5, 12, 13, 14, 11, 8, 5, 6],
]
RIGHT_TURNS = [
    [8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6],
    [9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11],
    [9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5],
    [15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8],
    [8, 5, 12, 9, 12, 5, 14, 6, 8, 13, 6, 5, 15, 13, 11, 11],
]
LEFT_ADDS = [0x00000000, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xA953FD4E]
RIGHT_ADDS = [0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0x7A6D76E9, 0x00000000]
STATE = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0]
MASK = 0xFFFFFFFF


def _mix(j: int, x: int, y: int, z: int) -> int:
    return (x ^ y ^ z, x & y | ~x & z, (x | ~y) ^ z, x & z | y & ~z, x ^ (y | ~z))[j] & MASK


def ripemd160_plain(data: bytes) -> bytes:
    """RIPEMD-160 without OpenSSL."""
    tail = b"\x80" + b"\0" * ((55 - len(data)) % 64) + (8 * len(data)).to_bytes(8, "little")
    data, state = data + tail, list(STATE)
    for at in range(0, len(data), 64):
        block = [int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little") for i in range(16)]
        lines = []
        for order, turns, adds, mirror in ((LEFT_WORDS, LEFT_TURNS, LEFT_ADDS, False), (RIGHT_WORDS, RIGHT_TURNS, RIGHT_ADDS, True)):
            a, b, c, d, e = state
            for j in range(5):
                for k in range(16):
                    t = (a + _mix(4 - j if mirror else j, b, c, d) + block[order[j][k]] + adds[j]) & MASK
                    t = ((t << turns[j][k] | t >> 32 - turns[j][k]) + e) & MASK
                    a, e, d, c, b = e, d, (c << 10 | c >> 22) & MASK, b, t
            lines.append((a, b, c, d, e))
        left, right = lines
        state = [(state[(i + 1) % 5] + left[(i + 2) % 5] + right[(i + 3) % 5]) & MASK for i in range(5)]
    return b"".join(x.to_bytes(4, "little") for x in state)


def ripemd160(data: bytes) -> bytes:
    try:
        return hashlib.new("ripemd160", data).digest()
    except ValueError:  # OpenSSL without its legacy digests
        return ripemd160_plain(data)


def hash160_of(data: bytes) -> bytes:
    return ripemd160(hashlib.sha256(data).digest())


def sha256d_of(data: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def sha256d(data: Column) -> Column:
    """sha256 of the sha256 of a binary column."""
    return F.unhex(F.sha2(F.unhex(F.sha2(data, 256)), 256))


def hash_hex(digest: Column) -> Column:
    """A digest as it is displayed: its bytes in reverse, in lower-case hex."""
    return F.lower(F.array_join(F.reverse(F.regexp_extract_all(F.hex(digest), F.lit("(..)"), 1)), ""))


@F.pandas_udf(T.BinaryType())
def hash160(data: pd.Series) -> pd.Series:
    """ripemd160 of the sha256 of a binary column; null of null."""
    return data.map(lambda x: None if x is None else hash160_of(bytes(x)))
