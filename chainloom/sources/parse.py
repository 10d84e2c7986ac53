"""Blocks from bytes: what they hold, and that they hold together."""

from __future__ import annotations

from chainloom.functions.hashing import sha256d_of
from chainloom.plans.audit import merkle_root

#: Start of the output that commits to a block's witnesses.
COMMITMENT = bytes.fromhex("6a24aa21a9ed")
NOWHERE = bytes(32)


class BlockError(ValueError):
    """The bytes are no block, or not the block that was asked for."""


class Reader:
    """Bytes with a place; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = bytes(data), 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise BlockError("the bytes end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def size(self) -> int:
        """A compact size: one byte, or a mark and 2, 4 or 8 bytes."""
        first = self.number(1)
        return first if first < 253 else self.number(2 ** (first - 252))


def compact(n: int) -> bytes:
    """n as a compact size."""
    for mark, width in ((0xFD, 2), (0xFE, 4), (0xFF, 8)):
        if n < 253:
            return bytes([n])
        if n < 1 << 8 * width:
            return bytes([mark]) + n.to_bytes(width, "little")
    raise BlockError("too large for a compact size")


def transaction(r: Reader) -> dict:
    """A transaction with its ids; sizes with and without witnesses."""
    begin = r.at
    version = r.take(4)
    segwit = r.data[r.at : r.at + 1] == b"\0"
    if segwit and r.take(2) != b"\0\1":
        raise BlockError("a transaction has no inputs, or an unknown flag")
    body = r.at
    inputs = []
    for _ in range(r.size()):
        own = {"prev_txid": r.take(32), "prev_vout": r.number(4)}
        inputs.append(own | {"script_sig": r.take(r.size()), "sequence": r.number(4), "witness": []})
    if not inputs:
        raise BlockError("a transaction has no inputs")
    outputs = []
    for _ in range(r.size()):
        outputs.append({"value": r.number(8), "script": r.take(r.size())})
    plain = r.data[body : r.at]
    if segwit:
        for own in inputs:
            own["witness"] = [r.take(r.size()) for _ in range(r.size())]
    lock = r.take(4)
    txid = sha256d_of(version + plain + lock)
    whole = r.data[begin : r.at]
    first = inputs[0]
    coinbase = len(inputs) == 1 and first["prev_txid"] == NOWHERE and first["prev_vout"] == 0xFFFFFFFF
    return {"txid": txid, "wtxid": sha256d_of(whole) if segwit else txid, "segwit": segwit, "coinbase": coinbase, "inputs": inputs, "outputs": outputs, "base": 8 + len(plain), "size": len(whole)}


def _check_witnesses(txs: list[dict]) -> None:
    if not any(t["segwit"] for t in txs):
        return
    first = txs[0]
    if not first["coinbase"]:
        raise BlockError("witnesses, and no coinbase first")
    marks = [o["script"][6:38] for o in first["outputs"] if o["script"].startswith(COMMITMENT) and len(o["script"]) >= 38]
    if not marks:
        raise BlockError("witnesses, and no commitment to them")
    reserved = first["inputs"][0]["witness"]
    if len(reserved) != 1 or len(reserved[0]) != 32:
        raise BlockError("the coinbase's witness is not one value of 32 bytes")
    if sha256d_of(merkle_root([NOWHERE, *(t["wtxid"] for t in txs[1:])]) + reserved[0]) != marks[-1]:
        raise BlockError("the witnesses are not those committed to")


def block(raw: bytes, wanted: bytes | None = None) -> dict:
    """A block's header fields and transactions.

    The header must hash to wanted, its root must be that of the transactions,
    the coinbase must commit to the witnesses, and no byte may be left.
    """
    r = Reader(raw)
    head = r.take(80)
    block_id = sha256d_of(head)
    if wanted is not None and block_id != wanted:
        raise BlockError("the header is not the one asked for")
    n = r.size()
    prologue = r.at
    txs = [transaction(r) for _ in range(n)]
    if r.at != len(r.data):
        raise BlockError(f"{len(r.data) - r.at} bytes are left after the last transaction")
    if not txs or merkle_root([t["txid"] for t in txs]) != head[36:68]:
        raise BlockError("the transactions are not those of the header")
    _check_witnesses(txs)
    base = prologue + sum(t["base"] for t in txs)
    number = lambda a, b: int.from_bytes(head[a:b], "little")
    return {
        "block_id": block_id,
        "header": head,
        "version": number(0, 4),
        "prev_hash": head[4:36],
        "merkle_root": head[36:68],
        "time": number(68, 72),
        "bits": number(72, 76),
        "nonce": number(76, 80),
        "size": len(r.data),
        "weight": 3 * base + len(r.data),
        "coinbase_script": txs[0]["inputs"][0]["script_sig"],
        "txs": txs,
    }
