"""The answer about a list of addresses: exposure, balance, history, nonces, links.

Each capability is plugged in or not. An answer has a status of its own, so that
"no" and "not known" are never one value: ok, unsupported or undetermined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.chain import script_pubkey
from chainloom.functions.hashing import hash160
from chainloom.functions.scripts import decode_address
from chainloom.plans import ledger, links, nonces, reveal

OK, UNSUPPORTED, UNDETERMINED = "ok", "unsupported", "undetermined"
CLAIMS = ("separate", "watching")
# What an origin may tell, and the words of two of its keys.
ORIGIN = {"method", "descriptor_checksum", "script_type", "chain", "range", "gap_limit", "derived_at_height", "derived_by"}
WORDS = {"method": ("descriptor", "wallet-export", "manual"), "chain": ("receive", "change", "both")}
CAVEAT = "Spending together is a hint of one owner, not a proof: joint transactions break it."
ARC_CAVEAT = "A payment is no sign of one owner."
CATEGORY = {"p2pkh": "keys", "p2wpkh": "keys", "p2sh": "scripts20", "p2wsh": "scripts32"}


class BookError(ValueError):
    """An address book that is not what the format asks for."""


@dataclass
class Book:
    """Groups of addresses: label -> claim and addresses; in-group repeats are left out and counted."""

    claims: dict[str, str]
    group_of: dict[str, str]
    repeats: int = 0

    @property
    def separate(self) -> list[str]:
        return [label for label, claim in self.claims.items() if claim == "separate"]


def _only(value, needed: set[str], allowed: set[str], where: str) -> dict:
    if not isinstance(value, dict) or needed - value.keys() or value.keys() - needed - allowed:
        raise BookError(f"{where}: wants {sorted(needed)} and takes {sorted(allowed)}")
    return value


def _whole(x) -> bool:
    return type(x) is int


def _sound(key: str, x) -> bool:
    """Whether x is of the kind that an origin's key takes."""
    if key in WORDS:
        return x in WORDS[key]
    if key == "range":
        return x is None or isinstance(x, list) and len(x) == 2 and all(map(_whole, x))
    return _whole(x) if key in ("gap_limit", "derived_at_height") else isinstance(x, str)


def address_book(text: str) -> Book:
    """A book of format address-book-v2. Unknown keys, claims and forms, and addresses in two groups are errors."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise BookError(f"no JSON: {e}") from e
    value = _only(value, {"format", "groups"}, set(), "book")
    if value["format"] != "address-book-v2":
        raise BookError(f"unknown format {value['format']!r}")
    if not isinstance(value["groups"], list):
        raise BookError("groups must be a list")
    book = Book({}, {})
    for group in value["groups"]:
        _only(group, {"label", "claim", "addresses"}, {"origin"}, "group")
        label, claim = group["label"], group["claim"]
        if not isinstance(label, str) or not label or label in book.claims:
            raise BookError(f"a label must be a name of its own: {label!r}")
        if claim not in CLAIMS:
            raise BookError(f"{label}: a claim is one of {CLAIMS}")
        if "origin" in group:
            odd = [k for k, x in _only(group["origin"], set(), ORIGIN, f"{label}: origin").items() if not _sound(k, x)]
            if odd:
                raise BookError(f"{label}: origin: not a value that is known: {', '.join(odd)}")
        if not isinstance(group["addresses"], list) or not all(isinstance(a, str) for a in group["addresses"]):
            raise BookError(f"{label}: addresses must be a list of strings")
        book.claims[label] = claim
        for address in group["addresses"]:
            if address in book.group_of:
                if book.group_of[address] != label:
                    raise BookError(f"{address} is in two groups")
                book.repeats += 1
            book.group_of[address] = label
    return book


@dataclass
class Backends:
    """What is plugged in; None is not."""

    revelations: DataFrame | None = None
    sealed: bool = True
    history: DataFrame | None = None  # with spend_height
    outputs: DataFrame | None = None
    txs: DataFrame | None = None
    witness: DataFrame | None = None
    balances: dict[bytes, int] | None = None  # of scripts, by a node
    balance_height: int | None = None
    watermark: int | None = None


@dataclass
class Answer:
    status: str
    value: dict | None = None

    def as_json(self) -> dict:
        return {"status": self.status, "value": self.value}


@dataclass
class Entry:
    pos: int
    address: str
    kind: str | None
    error: str | None
    group: str | None
    answers: dict[str, Answer] = field(default_factory=dict)


@dataclass
class Report:
    entries: list[Entry]
    links: dict
    separations: list[dict]
    watermarks: dict

    def summary(self) -> dict:
        """Counts over answered capabilities only: what wasn't asked is no zero."""
        valid = [e for e in self.entries if not e.error]
        out: dict = {"addresses": len(self.entries), "valid": len(valid), "kinds": {}, "exposure": {}}
        for e in valid:
            out["kinds"][e.kind] = out["kinds"].get(e.kind, 0) + 1
            what = (e.answers["exposure"].value or {}).get("status", e.answers["exposure"].status)
            out["exposure"][what] = out["exposure"].get(what, 0) + 1
        own = [e for e in valid if e.answers["balance"].status == OK]
        if own:
            out["balance"] = sum(e.answers["balance"].value["sats"] for e in own)
            out["exposed_balance"] = sum(e.answers["balance"].value["sats"] for e in own if (e.answers["exposure"].value or {}).get("status", "").startswith("exposed"))
        return out

    def crossing(self) -> dict | None:
        """The heights of exposure and balance, and which is behind, where both were answered."""
        a, b = self.watermarks.get("exposure"), self.watermarks.get("balance")
        if a is None or b is None:
            return None
        return {"exposure_height": a, "balance_height": b, "gap": abs(a - b), "behind": "exposure" if a < b else "balance" if b < a else None}

    def as_json(self) -> str:
        entries = [{"pos": e.pos, "address": e.address, "kind": e.kind, "error": e.error, "group": e.group, "answers": {k: a.as_json() for k, a in e.answers.items()}} for e in self.entries]
        return json.dumps({"summary": self.summary(), "crossing": self.crossing(), "entries": entries, "links": self.links, "separations": self.separations}, indent=1, sort_keys=True)

    def as_csv(self) -> str:
        rows = ["pos,address,kind,exposure,first_height,balance_sats,note"]
        for e in self.entries:
            x = (e.answers.get("exposure") or Answer(UNSUPPORTED)).value or {}
            b = (e.answers.get("balance") or Answer(UNSUPPORTED)).value or {}
            status = x.get("status") or (e.answers["exposure"].status if e.answers else "")
            rows.append(",".join(str(v) if v is not None else "" for v in (e.pos, e.address, e.kind, status, x.get("first_height"), b.get("sats"), e.error or x.get("note"))))
        return "\n".join(rows) + "\n"

    def as_text(self) -> str:
        lines = []
        for e in self.entries:
            if e.error:
                lines.append(f"{e.address}: refused, {e.error}")
                continue
            x = e.answers["exposure"]
            what = (x.value or {}).get("status", x.status)
            note = (x.value or {}).get("note")
            lines.append(f"{e.address} ({e.kind}): {what}" + (f", {note}" if note else ""))
            lines += [f"  {k}: {a.status}" + (f" {json.dumps(a.value, sort_keys=True)}" if a.value is not None else "") for k, a in e.answers.items() if k != "exposure"]
        lines += [f"link {k}: {json.dumps(f, sort_keys=True)}" for k, own in self.links.items() for f in own.get("findings") or ()]
        return "\n".join(lines) + "\n"


def _per_lock(df: DataFrame, columns: list[str]) -> dict[bytes, dict]:
    return {bytes(r["lock"]): {c: r[c] for c in columns} for r in df.collect()}  # a row for each address asked for


def check(spark: SparkSession, addresses: list[str], b: Backends, book: Book | None = None, depth: int = 1) -> Report:
    """The report on a caller's list of addresses, in one pass for each capability."""
    asked = spark.createDataFrame(list(enumerate(addresses)), "pos long, address string").withColumn("d", decode_address("address"))
    asked = asked.select("pos", "address", F.col("d.kind").alias("kind"), F.col("d.digest").alias("digest"), F.col("d.error").alias("error"))
    asked = asked.withColumn("script", script_pubkey(F.col("kind"), F.col("digest"))).withColumn("lock", hash160("script"))
    rows = {r.pos: r for r in asked.collect()}
    entries = [Entry(p, r.address, r.kind, r.error, book.group_of.get(r.address) if book else None) for p, r in sorted(rows.items())]
    valid = spark.createDataFrame([(r.pos, r.kind, bytes(r.digest), bytes(r.lock), CATEGORY.get(r.kind, "")) for r in rows.values() if not r.error], "pos long, kind string, digest binary, lock binary, category string")
    locks = valid.select("lock").distinct()

    shown = {r.pos: r for r in reveal.exposure(valid, b.revelations).collect()} if b.revelations is not None else None
    own = b.history.join(F.broadcast(locks), "lock", "left_semi") if b.history is not None else None
    history = _per_lock(ledger.summary(own), ["outputs", "received", "spent_n", "spent", "unspent", "first_height", "last_height"]) if own is not None else None
    beside = _per_lock(links.co_inputs(b.history, locks), ["spenders", "other_inputs", "other_locks", "truncated"]) if own is not None else None
    repeated = None
    if b.witness is not None:
        keys = b.witness.join(F.broadcast(valid.where("category = 'keys'").select(F.col("digest").alias("key"))), "key", "left_semi")
        points = keys.select(F.substring("r", 1, nonces.POINT).alias("point")).distinct()
        every = b.witness.join(F.broadcast(points), F.substring("r", 1, nonces.POINT) == F.col("point"), "left_semi")
        repeated = {}
        for r in nonces.resolutions(every).where("resolution = 'exposed'").select(F.explode("exposed_keys").alias("key"), "point").collect():
            repeated.setdefault(bytes(r.key), []).append(bytes(r.point).hex())

    for e in entries:
        if e.error:
            continue
        r = rows[e.pos]
        lock = bytes(r.lock)
        if b.balances is not None:
            sats = b.balances.get(bytes(r.script))
            e.answers["balance"] = Answer(OK, {"sats": sats}) if sats is not None else Answer(UNDETERMINED)
        elif history is not None:
            e.answers["balance"] = Answer(OK, {"sats": history.get(lock, {}).get("unspent", 0)})
        else:
            e.answers["balance"] = Answer(UNSUPPORTED)
        if e.kind == "p2tr":
            e.answers["exposure"] = Answer(OK, {"status": "exposed_by_construction"})
        elif shown is None:
            e.answers["exposure"] = Answer(UNDETERMINED)
        else:
            x = shown[e.pos]
            e.answers["exposure"] = Answer(OK, {"status": x.status, "first_height": x.first_height, "sealed": b.sealed})
        value, balance = e.answers["exposure"].value, e.answers["balance"].value
        if value and value["status"].startswith("exposed") and balance and balance["sats"] == 0:
            value["note"] = "but empty"
        e.answers["history"] = Answer(OK, history.get(lock)) if history is not None else Answer(UNSUPPORTED)
        e.answers["co_inputs"] = Answer(OK, beside.get(lock)) if beside is not None else Answer(UNSUPPORTED)
        if repeated is None:
            e.answers["nonces"] = Answer(UNSUPPORTED)
        elif CATEGORY.get(e.kind) != "keys":
            e.answers["nonces"] = Answer(UNDETERMINED)
        else:
            e.answers["nonces"] = Answer(OK, {"points": sorted(repeated[bytes(r.digest)])}) if bytes(r.digest) in repeated else Answer(UNDETERMINED)

    found = {"same_key": {"status": OK, "findings": [x.asDict() for x in links.same_key(valid).orderBy("pos_a", "pos_b").collect()]}}
    if b.history is not None and b.txs is not None:
        mine = valid.groupBy("lock").agg(F.min("pos").alias("pos"))
        direct = [x.asDict() | {"bridge": None} for x in links.common_input(b.history, b.txs, mine).orderBy("pos_a", "pos_b").collect()]
        if depth > 1:
            known = {(x["pos_a"], x["pos_b"]) for x in direct}
            direct += [x.asDict() | {"bridge": bytes(x.bridge).hex()} for x in links.through_bridge(b.history, b.txs, mine).orderBy("pos_a", "pos_b").collect() if (x.pos_a, x.pos_b) not in known]
        found["common_input"] = {"status": OK, "findings": direct, "caveat": CAVEAT, "depth": depth}
        if b.outputs is not None:
            found["payment_arc"] = {"status": OK, "findings": [x.asDict() for x in links.payment_arcs(b.history, b.outputs, mine).orderBy("from_pos", "to_pos", "tx_ord").collect()], "caveat": ARC_CAVEAT}
    for name in ("common_input", "payment_arc"):
        found.setdefault(name, {"status": UNSUPPORTED, "findings": []})

    apart: list[dict] = []
    if book and book.separate:
        group = {e.pos: e.group for e in entries}
        breaks = [(group[f["pos_a"]], group[f["pos_b"]], kind, f.get("height")) for kind in ("same_key", "common_input") for f in found[kind]["findings"] if group[f["pos_a"]] and group[f["pos_b"]]]
        labels = spark.createDataFrame([(x,) for x in book.separate], "label string")
        table = spark.createDataFrame(breaks, "group_a string, group_b string, broken_by string, at_height long")
        apart = [r.asDict() | ({"as_of": b.watermark} if r.held else {}) for r in links.separations(labels, table).orderBy("group_a", "group_b").collect()]
    marks = {"exposure": b.watermark if b.revelations is not None else None, "balance": b.balance_height if b.balances is not None else b.watermark if b.history is not None else None}
    return Report(entries, found, apart, marks)
