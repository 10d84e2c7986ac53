"""Writes small chains, snapshots and signatures for the tests."""

from chainloom.functions.hashing import hash160_of, sha256d_of
from chainloom.plans.audit import merkle_root
from chainloom.sources.parse import compact

COIN = 5_000_000_000
NOWHERE = bytes(32)


def push(data: bytes) -> bytes:
    return (bytes([len(data)]) if len(data) < 76 else b"\x4c" + bytes([len(data)])) + data


def p2pkh(digest: bytes) -> bytes:
    return b"\x76\xa9" + push(digest) + b"\x88\xac"


def output(value: int, script: bytes) -> bytes:
    return value.to_bytes(8, "little") + compact(len(script)) + script


def tx(inputs, outputs, witnesses=None) -> tuple[bytes, bytes, bytes]:
    """(raw, txid, wtxid) of inputs [(txid, vout, script_sig)] and outputs [(value, script)]."""
    body = compact(len(inputs)) + b"".join(t + v.to_bytes(4, "little") + compact(len(s)) + s + b"\xff" * 4 for t, v, s in inputs)
    body += compact(len(outputs)) + b"".join(output(*o) for o in outputs)
    version, lock = (2).to_bytes(4, "little"), bytes(4)
    txid = sha256d_of(version + body + lock)
    if not witnesses:
        return version + body + lock, txid, txid
    stacks = b"".join(compact(len(w)) + b"".join(compact(len(x)) + x for x in w) for w in witnesses)
    raw = version + b"\0\1" + body + stacks + lock
    return raw, txid, sha256d_of(raw)


def coinbase(tag: bytes, script: bytes, wtxids=None):
    outputs = [(COIN, script)]
    if wtxids is None:
        return tx([(NOWHERE, 0xFFFFFFFF, tag)], outputs)
    root = sha256d_of(merkle_root([NOWHERE, *wtxids]) + NOWHERE)
    return tx([(NOWHERE, 0xFFFFFFFF, tag)], [*outputs, (0, bytes.fromhex("6a24aa21a9ed") + root)], [[NOWHERE]])


class Chain:
    """Linked blocks: height -> (block id, raw)."""

    def __init__(self):
        self.blocks: dict[int, tuple[bytes, bytes]] = {}
        self.before = NOWHERE

    def add(self, *txs):
        height = len(self.blocks) + 1
        root = merkle_root([t[1] for t in txs])
        head = (4).to_bytes(4, "little") + self.before + root + (1_700_000_000 + 600 * height).to_bytes(4, "little") + bytes.fromhex("00000017") + height.to_bytes(4, "little")
        self.before = sha256d_of(head)
        self.blocks[height] = (self.before, head + compact(len(txs)) + b"".join(t[0] for t in txs))

    def rows(self, last=None):
        return [(h, b, raw) for h, (b, raw) in sorted(self.blocks.items()) if last is None or h <= last]


A, B, C = (p2pkh(bytes([x]) * 20) for x in (1, 2, 3))
LOCKS = {hash160_of(s): n for n, s in (("A", A), ("B", B), ("C", C))}


def five_blocks() -> Chain:
    """A spend within a block, a coinbase that comes twice, and two outputs spent together."""
    c = Chain()
    first = coinbase(b"\x01A", A)
    c.add(first)
    second = coinbase(b"\x01B", A)
    t1 = tx([(second[1], 0, b"\0")], [(7, B), (3, C)])
    c.add(second, t1)
    t2 = tx([(t1[1], 1, b"\0")], [(2, A)])
    c.add(coinbase(b"\x01C", A), t2)
    t3 = tx([(t1[1], 0, b"\0")], [(6, B)])
    c.add(first, t3)
    t4 = tx([(t2[1], 0, b"\0"), (t3[1], 0, b"\0")], [(5, C)])
    c.add(coinbase(b"\x01D", A), t4)
    return c


def der(r: int, s: int, byte: int = 1) -> bytes:
    """A signature as DER with its sighash byte."""
    part = lambda x: b"\x02" + bytes([len(d := x.to_bytes(x.bit_length() // 8 + 1, "big"))]) + d
    body = part(r) + part(s)
    return b"\x30" + bytes([len(body)]) + body + bytes([byte])


def varint(n: int) -> bytes:
    out = [n & 0x7F]
    while (n := (n >> 7) - 1) >= 0:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def packed_amount(n: int) -> int:
    if not n:
        return 0
    e = 0
    while n % 10 == 0 and e < 9:
        n, e = n // 10, e + 1
    return 1 + (9 * (n // 10) + n % 10 - 1) * 10 + e if e < 9 else 1 + (n - 1) * 10 + 9


def snapshot(coins, declared=None, tail=b"") -> bytes:
    """coins: (txid, vout, height, coinbase, sats, type_code, payload), those of a txid together."""
    groups: dict[bytes, list] = {}
    for c in coins:
        groups.setdefault(c[0], []).append(c)
    out = b"utxo\xff" + (2).to_bytes(2, "little") + bytes.fromhex("f9beb4d9") + bytes(range(32)) + (len(coins) if declared is None else declared).to_bytes(8, "little")
    for txid, own in groups.items():
        out += txid + compact(len(own)) + b"".join(compact(v) + varint(2 * h + cb) + varint(packed_amount(s)) + varint(k) + p for _, v, h, cb, s, k, p in own)
    return out + tail
