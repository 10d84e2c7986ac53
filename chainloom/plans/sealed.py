"""The ledger's tables as sealed stores: what each holds at a height, and the verbs on them.

A store's tables are a function of the ingested tables and a height, so a store
that is appended to, or rewound, holds what one built anew at that height does.
Locks repeat no output, so the least output ordinal of a lock is its number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.plans import ledger
from chainloom.plans.store import Store, StoreError


def _below(df: DataFrame, height: int, first: int = 0) -> DataFrame:
    return df.where(F.col("height").between(first, height))


def unspent_above(history: DataFrame, height: int) -> DataFrame:
    """history as of a height: later outputs are gone, later spends are undone."""
    known = F.col("spend_height") <= height
    return _below(history, height).withColumns({c: F.when(known, F.col(c)) for c in ("spender_tx", "spend_height")})


def _index(d, height: int) -> dict[str, DataFrame]:
    spends = d.spends.where("out_ord is not null").join(d.txs.select(F.col("tx_ord").alias("spender_tx"), "height"), "spender_tx")
    return {"txs": _below(d.txs, height), "outputs": _below(d.outputs, height), "spends": _below(spends, height)}


def _derived(d, height: int) -> dict[str, DataFrame]:
    fees = d.fees.join(d.txs.select("tx_ord", "height"), "tx_ord")
    return {"history": unspent_above(d.history, height), "fees": _below(fees, height)}


def first_spends(history: DataFrame, height: int) -> DataFrame:
    """(lock, spender_tx, height, out_ord): the first spender of each lock that is spent from up to a height; out_ord names the lock."""
    own = unspent_above(history, height)
    first = ledger.first_spend(own).join(own.groupBy("lock").agg(F.min("out_ord").alias("out_ord")), "lock")
    at = own.where("spender_tx is not null").select("lock", "spender_tx", F.col("spend_height").alias("height")).distinct()
    return first.join(at, ["lock", "spender_tx"]).select("lock", "spender_tx", "height", "out_ord")


def _firstspend(d, height: int) -> dict[str, DataFrame]:
    return {"firstspend": first_spends(d.history, height)}


@dataclass
class Kind:
    """A kind of store: its tag, the key of each table, its tables at a height, and how one of its own is cut back."""

    tag: str
    keys: dict[str, str]
    tables: Callable[[object, int], dict[str, DataFrame]]
    cut: Callable[[str, DataFrame, int], DataFrame]


KINDS = {
    "index": Kind("chainloom-index-v1", {"txs": "tx_ord", "outputs": "out_ord", "spends": "out_ord"}, _index, lambda name, df, h: _below(df, h)),
    "derived": Kind("chainloom-derived-v1", {"history": "out_ord", "fees": "tx_ord"}, _derived, lambda name, df, h: unspent_above(df, h) if name == "history" else _below(df, h)),
    # a first spend up to a height stays the first
    "firstspend": Kind("chainloom-firstspend-v1", {"firstspend": "out_ord"}, _firstspend, lambda name, df, h: _below(df, h)),
}


def opened(spark: SparkSession, kind: str, root: str, parent: str | None = None) -> Store:
    """A store, bound to the manifest of the index that it was built on where one is named."""
    own = KINDS[kind]
    manifest = opened(spark, "index", parent).manifest() if parent else None
    return Store(spark, root, own.tag, own.keys, manifest and {k: manifest[k] for k in ("format", "fingerprint", "coverage")})


def build(store: Store, kind: str, data, height: int | None = None) -> dict:
    """A new store, or the next generation of one, up to a height; the last block by default."""
    first, last = data.blocks.agg(F.min("height"), F.max("height")).first()
    if first is None:
        raise StoreError("there is no block")
    height = last if height is None else height
    if not first <= height <= last:
        raise StoreError(f"the blocks are those of {first} to {last}")
    return store.commit(KINDS[kind].tables(data, height), first, height)


def append(store: Store, kind: str, data, height: int | None = None) -> dict:
    """The store up to a later height. What it holds must be what the ingested tables hold, or it is another chain."""
    before = store.manifest()
    last = data.blocks.agg(F.max("height")).first()[0] if height is None else height
    if last > (data.blocks.agg(F.max("height")).first()[0] or 0):
        raise StoreError("the blocks end before that height")
    tables = KINDS[kind].tables(data, last)
    return store.append(tables, last, lambda name, old, new: _extends(name, old, KINDS[kind].cut(name, new, before["coverage"]["to"]), new))


def _extends(name: str, old: DataFrame, cut: DataFrame, new: DataFrame) -> DataFrame:
    columns = sorted(old.columns)
    if not old.select(columns).exceptAll(cut.select(columns)).isEmpty():
        raise StoreError(f"{name} holds rows that the ingested tables do not")
    return new


def rewind(store: Store, kind: str, height: int) -> dict:
    """The store as it was at a height."""
    return store.rewind(height, lambda name, df: KINDS[kind].cut(name, df, height))


def stats(store: Store) -> DataFrame:
    """(name, rows, sha256, from_height, to_height) of the tables of the current generation."""
    own = store.manifest()
    rows = [(f["name"], own["build"]["rows"][f["name"]], f["sha256"], own["coverage"]["from"], own["coverage"]["to"]) for f in own["files"]]
    return store.spark.createDataFrame(rows, "name string, rows long, sha256 string, from_height long, to_height long")
