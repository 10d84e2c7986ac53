"""Snapshots of the unspent outputs as a Spark data source.

    spark.dataSource.register(SnapshotSource)
    spark.read.format("utxo-snapshot").load(path)

The format has no index: entries have no fixed size, so one task reads a file as
a stream. The path is one that this task can open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

MAGIC, VERSION, NETWORK = b"utxo\xff", 2, bytes.fromhex("f9beb4d9")
COINS = StructType(
    [
        StructField("txid", BinaryType()),
        StructField("vout", IntegerType()),
        StructField("height", IntegerType()),
        StructField("coinbase", BooleanType()),
        StructField("sats", LongType()),
        StructField("type_code", IntegerType()),
        StructField("payload", BinaryType()),
    ]
)


class SnapshotError(ValueError):
    """The file is no snapshot of the main network, or is damaged."""


def amount_of(x: int) -> int:
    """The amount that is stored as x."""
    if not x:
        return 0
    rest, exponent = divmod(x - 1, 10)
    if exponent == 9:
        return (rest + 1) * 10**9
    rest, digit = divmod(rest, 9)
    return (rest * 10 + digit + 1) * 10**exponent


class _Stream:
    def __init__(self, f):
        self.f = f

    def take(self, n: int) -> bytes:
        data = self.f.read(n)
        if len(data) != n:
            raise SnapshotError("the file ends within an entry")
        return data

    def size(self) -> int:
        first = self.take(1)[0]
        return first if first < 253 else int.from_bytes(self.take(2 ** (first - 252)), "little")

    def varint(self) -> int:
        """Seven bits a byte, the highest first; each step but the last adds one."""
        n = 0
        while (byte := self.take(1)[0]) & 0x80:
            n = ((n << 7) | (byte & 0x7F)) + 1
        return n << 7 | byte


def head(s: _Stream) -> tuple[bytes, int]:
    """(hash of the base block, declared coins)."""
    if s.take(5) != MAGIC:
        raise SnapshotError("no snapshot, or one of the first format")
    if int.from_bytes(s.take(2), "little") != VERSION:
        raise SnapshotError("a snapshot of another version")
    if s.take(4) != NETWORK:
        raise SnapshotError("not of the main network")
    return s.take(32), int.from_bytes(s.take(8), "little")


def coins(path: str) -> Iterator[tuple]:
    """Rows of COINS; the declared number must be there and nothing after it."""
    with open(path, "rb", buffering=1 << 20) as f:
        s = _Stream(f)
        _, left = head(s)
        while left:
            txid = s.take(32)
            group = s.size()
            if not 0 < group <= left:
                raise SnapshotError("a transaction's coins are more than those declared")
            left -= group
            for _ in range(group):
                vout, code = s.size(), s.varint()
                sats, kind = amount_of(s.varint()), s.varint()
                payload = s.take(20 if kind < 2 else 32 if kind < 6 else kind - 6)
                yield txid, vout, code >> 1, bool(code & 1), sats, kind, payload
        if f.read(1):
            raise SnapshotError("bytes after the last declared entry")


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")

    def read(self, partition) -> Iterator[tuple]:
        yield from coins(self.path)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "utxo-snapshot"

    def schema(self):
        return COINS

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)


def base_hash(path: str) -> str:
    """The base block's hash as displayed."""
    with open(path.removeprefix("file://"), "rb") as f:
        return head(_Stream(f))[0][::-1].hex()
