"""Sealed generations of tables: build, append, rewind, verify.

A store is a folder (local or any that Spark and Hadoop reach). Each generation
is a folder of its own with a table for each name and manifest.json. CURRENT
names the generation that counts and is replaced in one step, after everything it
names is there; what a crash leaves beside it is never read and is swept by the
next commit. Readers hold on to one generation.
"""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainloom.plans.audit import content_digest

#: First bytes of what a fingerprint and a statement are digests of; another recipe of the same shape has its own.
IDENTITY, STATEMENT = b"chainloom-identity-v3\0", b"chainloom-statement-v1\0"


class StoreError(RuntimeError):
    """A store that can't be read, or that isn't what it says."""


def _text(x: str) -> bytes:
    data = x.encode()
    if len(data) > 0xFFFF:
        raise StoreError("a name is too long")
    return len(data).to_bytes(2, "big") + data


def identity_bytes(identity: dict, tag: bytes = IDENTITY) -> bytes:
    """Format, coverage and files in order, each length before its text."""
    cover, files = identity["coverage"], identity["files"]
    numbers = b"".join(int(n).to_bytes(4, "big") for n in (cover["from"], cover["to"], len(files)))
    return tag + _text(identity["format"]) + numbers + b"".join(_text(f["name"]) + bytes.fromhex(f["sha256"]) for f in files)


def fingerprint(identity: dict, tag: bytes = IDENTITY) -> str:
    return hashlib.sha256(identity_bytes(identity, tag)).hexdigest()


def statement_bytes(manifest: dict, tag: bytes = STATEMENT) -> bytes:
    """Format, fingerprint and the parent that the manifest declares."""
    parent = (manifest.get("build") or {}).get("parent")
    tail = b"\0" if parent is None else b"\1" + _text(parent["format"]) + bytes.fromhex(parent["fingerprint"])
    return tag + _text(manifest["format"]) + bytes.fromhex(manifest["fingerprint"]) + tail


def statement(manifest: dict, tag: bytes = STATEMENT) -> str:
    return hashlib.sha256(statement_bytes(manifest, tag)).hexdigest()


def checked_name(name: str) -> str:
    """A file or table name that stays in its folder; any other is an error."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,199}", name) or ".." in name:
        raise StoreError(f"not a name for a file here: {name!r}")
    return name


class Files:
    """Small files and folders by way of Hadoop, so that a store can lie wherever Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file as a whole: written beside it and renamed over it."""
        beside = f".{name.replace('/', '_')}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.fs.getConf())
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        rename[0] = options.Rename.OVERWRITE
        source, target = (self.fs.makeQualified(self.path(x)) for x in (beside, name))
        context.rename(source, target, rename)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))] if self.exists("") else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def producer() -> dict:
    """What wrote a manifest; never part of its identity."""
    return {"package": "chainloom", "python": platform.python_version(), "machine": platform.machine()}


class Clock:
    """Seconds of a verb, added up over its runs."""

    def __init__(self, verb: str, before: dict | None = None):
        self.verb, self.before, self.start = verb, dict(before or {}), time.monotonic()

    def seconds(self) -> dict:
        return self.before | {self.verb: round(self.before.get(self.verb, 0) + time.monotonic() - self.start, 3)}


class Store:
    """keys: for each table its unique integer key, in whose order its content is digested."""

    def __init__(self, spark: SparkSession, root: str, tag: str, keys: dict[str, str], parent: dict | None = None):
        self.spark, self.root, self.tag, self.keys, self.parent = spark, root.rstrip("/"), tag, {checked_name(k): v for k, v in keys.items()}, parent
        self.files = Files(spark, self.root)

    # -- reading

    def current(self) -> str | None:
        return checked_name(self.files.read("CURRENT").strip()) if self.files.exists("CURRENT") else None

    def manifest(self) -> dict:
        name = self.current()
        if name is None:
            raise StoreError(f"{self.root} has no sealed generation")
        own = json.loads(self.files.read(f"{name}/manifest.json"))
        if own["format"] != self.tag:
            raise StoreError(f"format {own['format']}, wanted {self.tag}")
        if self.parent and (own["build"]["parent"] or {}).get("fingerprint") != self.parent["fingerprint"]:
            raise StoreError("built on another parent")
        return own

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}/{checked_name(table)}")

    # -- writing

    def commit(self, tables: dict[str, DataFrame], first: int, last: int, verb: str = "build") -> dict:
        """Writes a generation with its manifest, makes it the current one and sweeps all but the one before.

        Readers that have opened that one can finish; the next commit sweeps it.
        """
        if set(tables) != set(self.keys):
            raise StoreError("the tables are not those of this store")
        before = self.current()
        clock = Clock(verb, self.manifest()["build"].get("seconds") if before else None)
        name = f"g{int((before or 'g0').split('-')[0][1:]) + 1}-{uuid.uuid4().hex[:8]}"
        entries = []
        for table, df in tables.items():
            key = self.keys[table]
            df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{self.root}/{name}/{table}")
            own = self.spark.read.parquet(f"{self.root}/{name}/{table}")
            entries.append({"name": table, "sha256": content_digest(own, sorted(own.columns), key), "rows": own.count()})
        identity = {"format": self.tag, "coverage": {"from": first, "to": last}, "files": [{k: e[k] for k in ("name", "sha256")} for e in entries]}
        manifest = identity | {"fingerprint": fingerprint(identity), "build": {"parent": self.parent, "rows": {e["name"]: e["rows"] for e in entries}, "seconds": clock.seconds(), "producer": producer()}}
        manifest["statement"] = statement(manifest)
        self.files.write(f"{name}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
        self.files.write("CURRENT", name)
        self.sweep(before)
        return manifest

    def sweep(self, keep: str | None = None) -> list[str]:
        """Removes generations that CURRENT does not name, but for keep, and files that a crash has left."""
        held = {"CURRENT", self.current(), keep}
        gone = [n for n in self.files.names() if n not in held and not n.endswith(".crc")]
        for n in gone:
            self.files.remove(n)
        return gone

    def append(self, tables: dict[str, DataFrame], last: int, merge: Callable[[str, DataFrame, DataFrame], DataFrame] | None = None) -> dict:
        """A generation of the old rows and the new ones; merge says how tables come together that aren't just longer."""
        before = self.manifest()
        if last <= before["coverage"]["to"]:
            raise StoreError("nothing new to append")
        both = {t: merge(t, self.read(t), df) if merge else self.read(t).unionByName(df) for t, df in tables.items()}
        return self.commit(both, before["coverage"]["from"], last, "append")

    def rewind(self, height: int, cut: Callable[[str, DataFrame], DataFrame]) -> dict:
        """A generation that covers the ledger up to a height; cut takes each table back to it."""
        before = self.manifest()
        if not before["coverage"]["from"] <= height < before["coverage"]["to"]:
            raise StoreError("a rewind goes to a height within the coverage")
        return self.commit({t: cut(t, self.read(t)) for t in self.keys}, before["coverage"]["from"], height, "rewind")

    # -- checking

    def verify(self, deep: bool = True) -> list[str]:
        """What is wrong with the current generation; nothing if it is what its manifest says."""
        own, out = self.manifest(), []
        if fingerprint(own) != own["fingerprint"]:
            out.append("the fingerprint is not that of the manifest")
        if statement(own) != own.get("statement"):
            out.append("the statement is not that of the manifest")
        if [f["name"] for f in own["files"]] != list(self.keys):
            out.append("the list of tables is another one")
        if not own["coverage"]["from"] <= own["coverage"]["to"]:
            out.append("the coverage is empty")
        if self.parent and own["coverage"]["to"] > self.parent["coverage"]["to"]:
            out.append("the coverage goes beyond that of the parent")
        if list(own["build"]["rows"]) and set(own["build"]["rows"]) != set(self.keys):
            out.append("the rows are of other tables")
        for entry in own["files"]:
            table = self.read(entry["name"])
            if table.count() != own["build"]["rows"].get(entry["name"]):
                out.append(f"{entry['name']}: the rows are not as many as in the manifest")
            if not deep:
                continue
            if content_digest(table, sorted(table.columns), self.keys[entry["name"]]) != entry["sha256"]:
                out.append(f"{entry['name']}: the content is not that of the manifest")
        return out


def total_cost(manifests: list[dict], shared: set[str]) -> float:
    """Seconds of several builds; a verb that several share was one run and counts once, by its longest."""
    most: dict[str, float] = {}
    rest = 0.0
    for m in manifests:
        for verb, s in m["build"].get("seconds", {}).items():
            if verb in shared:
                most[verb] = max(most.get(verb, 0), s)
            else:
                rest += s
    return rest + sum(most.values())


def report_page(manifests: list[dict], shared: set[str] = frozenset()) -> str:
    """A page of Markdown: what was built, from what, with which cost."""
    lines = ["| format | heights | rows | fingerprint | parent |", "|---|---|---|---|---|"]
    for m in manifests:
        parent = (m["build"].get("parent") or {}).get("fingerprint", "")
        lines.append(f"| {m['format']} | {m['coverage']['from']}-{m['coverage']['to']} | {sum(m['build']['rows'].values())} | {m['fingerprint'][:16]} | {parent[:16]} |")
    return "\n".join([*lines, "", f"Seconds in all: {total_cost(manifests, set(shared)):.1f}"]) + "\n"
