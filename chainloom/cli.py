"""python -m chainloom GROUP VERB ...: the engine's questions from a shell.

DATA is a folder of tables that `ingest build` has written: parsed blocks, then
blocks, txs, outputs, inputs, spends, history, fees, firstspend, revelations and
nonces. Reports go to the screen, or to --csv as one file in a stated order.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.chain import coins
from chainloom.plans import audit, census, check, dist, ingest, ledger, lookups, nonces, reveal, series
from chainloom.session import session
from chainloom.sources import files
from chainloom.sources.nodes import Client, NodeSource, credentials
from chainloom.sources.snapshots import SnapshotSource


class Data:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


VERBS: dict[tuple[str, str], tuple[Callable, list]] = {}


def verb(group: str, name: str, *arguments):
    """Registers a function of (spark, options) that returns a table in order, text, or nothing."""

    def add(f):
        VERBS[group, name] = (f, list(arguments))
        return f

    return add


def opt(*names, **settings):
    return names, settings


DATA = opt("data")


@verb("ingest", "build", DATA, opt("--url"), opt("--raw"), opt("--from", dest="first", type=int, default=1), opt("--to", dest="last", type=int), opt("--rest", action="store_true"), opt("--cookie"))
def ingest_build(spark, o):
    """Blocks of a node, or of Parquet files of (height, block_hash, raw), to all tables."""
    d = Data(spark, o.data)
    if o.url:
        spark.dataSource.register(NodeSource)
        options = {"url": o.url, "from": str(o.first), "to": str(o.last), "transport": "rest" if o.rest else "rpc"} | ({"cookie": o.cookie} if o.cookie else {})
        raw = spark.read.format("ledger-node").options(**options).load()
    else:
        raw = spark.read.parquet(o.raw)
    t = ingest.tables(d.write("parsed", ingest.parsed(raw)))
    txs, outputs, spends = d.write("txs", t.txs), d.write("outputs", t.outputs), d.write("spends", t.spends)
    d.write("blocks", t.blocks)
    inputs = d.write("inputs", t.inputs)
    own = d.write("history", ledger.spend_heights(ledger.history(outputs, spends), txs))
    d.write("fees", ledger.fees(txs, outputs, spends))
    d.write("firstspend", ledger.first_spend(own))
    reveals = ingest.Tables(t.blocks, txs, outputs, inputs, spends).reveals()
    d.write("revelations", reveal.reduced(reveal.sightings(reveals)))
    found = nonces.extracted(reveals)
    d.write("nonces", nonces.census(found))
    d.write("witness", nonces.witness(found, d.nonces.groupBy("point").count().where("count > 1").select("point")))
    return f"{txs.count()} transactions\n"


def _snapshot(spark, path):
    spark.dataSource.register(SnapshotSource)
    return census.typed(spark.read.format("utxo-snapshot").load(path))


@verb("census", "run", opt("snapshot"))
def census_run(spark, o):
    return census.by_band(_snapshot(spark, o.snapshot)).orderBy("type", "height_from")


@verb("census", "epochs", opt("snapshot"))
def census_epochs(spark, o):
    return census.by_epoch(_snapshot(spark, o.snapshot)).orderBy("type")


@verb("reuse", "prepare", opt("snapshot"), opt("out"))
def reuse_prepare(spark, o):
    """Locks of a snapshot with what lies behind them; the lock of each type is the hash it shows."""
    rows = _snapshot(spark, o.snapshot).withColumn("lock", F.when(F.col("type").isin("p2pkh", "p2sh"), F.col("payload")).otherwise(F.substring("payload", 3, 32)))
    reveal.lock_totals(rows).write.mode("overwrite").parquet(o.out)
    return spark.read.parquet(o.out).groupBy("type").agg(F.count("*").alias("locks"), F.sum("sats").alias("sats")).orderBy("type")


def _burns(spark, o):
    return reveal.burned(spark.read.parquet(o.locks), reveal.opened(Data(spark, o.data).revelations, not o.no_faces, not o.no_cosigners))


PERIMETER = [DATA, opt("locks"), opt("--no-faces", action="store_true"), opt("--no-cosigners", action="store_true")]


@verb("archive", "derive", *PERIMETER)
def archive_derive(spark, o):
    burns = _burns(spark, o)
    print("fingerprint", reveal.bitmap_fingerprint(burns))
    return reveal.perimeter_table(burns).orderBy("type")


@verb("reuse", "stats", *PERIMETER)
def reuse_stats(spark, o):
    hit = dist.with_all(_burns(spark, o).where("burn_height is not null").select("type", "sats"), "type")
    return dist.order_stats(hit, ["type"], "sats").drop("gini_num").orderBy("type")


@verb("reuse", "curve", *PERIMETER, opt("--every", type=int, default=10_000))
def reuse_curve(spark, o):
    burns = _burns(spark, o).where("burn_height is not null").withColumnRenamed("burn_height", "height")
    last = Data(spark, o.data).blocks.agg(F.max("height")).first()[0]
    return series.cumulative(burns, reveal.LOCK_TYPES, "sats", o.every, last, kind="type").orderBy("height")


@verb("archive", "curve", DATA, opt("--every", type=int, default=10_000))
def archive_curve(spark, o):
    d = Data(spark, o.data)
    last = d.blocks.agg(F.max("height")).first()[0]
    return series.window_counts(d.revelations.withColumnRenamed("first_height", "height"), ["keys", "scripts20", "scripts32"], o.every, last, kind="category").orderBy("height")


def _said(pair):
    found, bad = pair
    for t in bad:
        print(f"left out: {t}", file=sys.stderr)
    return found


@verb("archive", "lookup", DATA, opt("digests", nargs="+"))
def archive_lookup(spark, o):
    return _said(lookups.digests(spark, o.digests, Data(spark, o.data).revelations)).orderBy("digest", "category")


@verb("archive", "verify", DATA)
def archive_verify(spark, o):
    d = Data(spark, o.data)
    return audit.revelation_faults(d.revelations, d.blocks.agg(F.max("height")).first()[0])


@verb("archive", "v1-digests", DATA)
def archive_projection(spark, o):
    return "".join(f"{k} {v}\n" for k, v in lookups.projection_digests(Data(spark, o.data).revelations).items())


@verb("nonces", "groups", DATA, opt("--min-count", type=int, default=2), opt("--limit", type=int, default=20))
def nonces_groups(spark, o):
    rows = nonces.groups(Data(spark, o.data).nonces, o.min_count)
    return rows.orderBy(F.desc("count"), "point").limit(o.limit)


@verb("nonces", "stats", DATA)
def nonces_stats(spark, o):
    return nonces.tallies(Data(spark, o.data).nonces)


@verb("nonces", "lookup", DATA, opt("points", nargs="+"))
def nonces_lookup(spark, o):
    return _said(lookups.points(spark, o.points, Data(spark, o.data).nonces)).orderBy("point")


@verb("nonces", "resolve", DATA)
def nonces_resolve(spark, o):
    return nonces.resolutions(Data(spark, o.data).witness).orderBy("resolution", "point")


@verb("nonces", "address", DATA, opt("address"))
def nonces_address(spark, o):
    d = Data(spark, o.data)
    own = lookups.lock_signatures(d.history, d.inputs, d.txs, _lock(o.address))
    return nonces.own_repeats(own, d.nonces).orderBy("r")


@verb("nonces", "verify", DATA)
def nonces_verify(spark, o):
    d = Data(spark, o.data)
    return audit.nonce_faults(d.nonces, d.blocks.agg(F.max("height")).first()[0])


@verb("headers", "stats", DATA)
def headers_stats(spark, o):
    return lookups.header_stats(Data(spark, o.data).blocks)


@verb("headers", "show", DATA, opt("height", type=int))
def headers_show(spark, o):
    return series.median_time_past(Data(spark, o.data).blocks.where(F.col("height").between(o.height - 10, o.height))).where(F.col("height") == o.height).drop("txs")


@verb("headers", "verify", DATA)
def headers_verify(spark, o):
    d = Data(spark, o.data)
    return audit.chain_breaks(d.blocks).withColumn("fault", F.lit("link")).unionByName(audit.merkle_mismatches(d.txs, d.blocks).withColumn("fault", F.lit("merkle root"))).orderBy("height")


@verb("graph", "digest", DATA, opt("--every", type=int, default=1000))
def graph_digest(spark, o):
    rows = Data(spark, o.data).txs.withColumn("txid", F.lower(F.hex("txid")))
    return audit.interval_digests(rows, ["tx_ord", "txid", "n_out"], "height", ["tx_ord"], o.every).orderBy("from_height")


@verb("index", "lookup", DATA, opt("outpoints", nargs="+"))
def index_lookup(spark, o):
    d = Data(spark, o.data)
    return _said(lookups.outputs(spark, o.outpoints, d.txs, d.outputs, d.spends)).orderBy("txid", "vout")


def _lock(address: str) -> bytes:
    """The lock of an address, or of a lock given as 40 hex digits."""
    from chainloom.functions.hashing import hash160_of
    from chainloom.functions.scripts import decode

    own, _ = lookups.hex_bytes([address], {20})
    if own:
        return own[0]
    kind, digest = decode(address)
    around = {"p2pkh": ("76a914", "88ac"), "p2sh": ("a914", "87"), "p2wpkh": ("0014", ""), "p2wsh": ("0020", ""), "p2tr": ("5120", "")}[kind]
    return hash160_of(bytes.fromhex(around[0]) + digest + bytes.fromhex(around[1]))


@verb("derived", "history", DATA, opt("address"), opt("--limit", type=int, default=50))
def derived_history(spark, o):
    own, more = lookups.history(Data(spark, o.data).history, _lock(o.address), o.limit)
    if more:
        print(f"{more} earlier events left out", file=sys.stderr)
    return own


@verb("derived", "balance", DATA, opt("address"), opt("--height", type=int, default=1 << 30))
def derived_balance(spark, o):
    rows = Data(spark, o.data).history.where(F.col("lock") == F.lit(bytearray(_lock(o.address))))
    return ledger.balance_at(rows, o.height).select("received", "spent", coins(F.col("unspent")).alias("unspent"))


@verb("derived", "fee", DATA, opt("txids", nargs="+"))
def derived_fee(spark, o):
    d = Data(spark, o.data)
    return _said(lookups.fee(spark, o.txids, d.txs, d.fees)).orderBy("txid")


@verb("derived", "cospends", DATA, opt("out_ord", type=int))
def derived_cospends(spark, o):
    from chainloom.plans.links import cospends

    d = Data(spark, o.data)
    print(check.CAVEAT, file=sys.stderr)
    return cospends(d.spends, d.outputs, d.outputs.where(F.col("out_ord") == o.out_ord)).orderBy("other_out")


@verb("derived", "supply", DATA, opt("--bucket", type=int, default=210_000))
def derived_supply(spark, o):
    d = Data(spark, o.data)
    heights = d.txs.join(d.fees, "tx_ord").groupBy("height").agg(F.sum("fee").alias("fees"), F.sum(F.when(F.col("coinbase"), F.col("value_out"))).alias("coinbase"))
    return ledger.supply_by_bucket(ledger.supply(heights), o.bucket).orderBy("bucket")


@verb("derived", "verify", DATA)
def derived_verify(spark, o):
    d = Data(spark, o.data)
    return audit.ledger_identities(d.outputs, d.history, d.spends, d.fees).orderBy("check_name")


@verb("firstspend", "between", DATA, opt("lo", type=int), opt("hi", type=int))
def firstspend_between(spark, o):
    d = Data(spark, o.data)
    return lookups.spent_between(d.firstspend, d.txs, o.lo, o.hi).orderBy("spender_tx", "lock")


def _stats(d: Data) -> DataFrame:
    return ledger.block_stats(d.blocks, d.txs, d.outputs, d.spends)


@verb("blockstats", "build", DATA)
def blockstats_build(spark, o):
    return _stats(Data(spark, o.data)).orderBy("height")


@verb("blockstats", "summary", DATA, opt("--bucket", type=int, default=210_000))
def blockstats_summary(spark, o):
    return ledger.stats_by_bucket(_stats(Data(spark, o.data)), o.bucket).orderBy("bucket")


SERIES = [opt("--series", action="append", required=True), opt("--stale", type=int, default=3 * 3600)]


def _series(spark, o):
    return [(files.price_series(spark, p), o.stale) for p in o.series]


@verb("price", "import", opt("path"), opt("--time", default="time"), opt("--price", default="price"), opt("--time-format", default="unix"), opt("--records", default=""), opt("--lists", action="store_true"))
def price_import(spark, o):
    return files.price_series(spark, o.path, o.time, o.price, o.time_format, o.records, o.lists)


@verb("price", "at", opt("times", type=int, nargs="+"), *SERIES)
def price_at(spark, o):
    return lookups.at_price(_series(spark, o), spark, o.times).orderBy("time")


@verb("price", "build", DATA, *SERIES)
def price_build(spark, o):
    return lookups.block_prices(Data(spark, o.data).blocks, _series(spark, o)).orderBy("height")


@verb("price", "daily", DATA, *SERIES, opt("--from", dest="first"), opt("--to", dest="last"))
def price_daily(spark, o):
    rows = lookups.block_prices(Data(spark, o.data).blocks, _series(spark, o)).withColumn("series", F.when(F.col("series") > 0, F.element_at(F.array(*map(F.lit, o.series)), F.greatest(F.col("series"), F.lit(1)))))
    out = series.daily(rows)
    return out.where(F.col("date").between(o.first or "", o.last or "9999")).orderBy("date")


@verb("price", "verify", opt("path"))
def price_verify(spark, o):
    return lookups.series_faults(files.price_series(spark, o.path))


@verb("curve", "deltas", opt("path"))
def curve_deltas(spark, o):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = [f"{k}_{x}" for k in reveal.LOCK_TYPES for x in ("hits", "satoshis")]
    schema = StructType([StructField("height", LongType()), *(StructField(n, LongType()) for n in names), StructField("fingerprint", StringType())])
    return series.deltas(series.last_line(files.numbered_csv(spark, o.path, schema)), names).orderBy("to_height")


@verb("curve", "dates", opt("heights", type=int, nargs="+"), opt("--url", required=True), opt("--cookie"))
def curve_dates(spark, o):
    from chainloom.functions.chain import utc_date

    times = Client(o.url, credentials(o.cookie)).times(o.heights)
    rows = spark.createDataFrame([(h, t) for h, (_, t) in zip(o.heights, times, strict=True)], "height long, time long")
    return rows.withColumn("date", utc_date(F.col("time"))).orderBy("height")


@verb("check", "run", opt("addresses", nargs="*"), opt("--data"), opt("--book"), opt("--url"), opt("--cookie"), opt("--depth", type=int, default=1, choices=(1, 2)), opt("--json", action="store_true"), opt("--out"))
def check_run(spark, o):
    """The report on addresses; into a file that its owner alone can read, unless it goes to the screen."""
    book = check.address_book(open(o.book).read()) if o.book else None
    addresses = [*o.addresses, *(book.group_of if book else ())]
    b = check.Backends()
    if o.data:
        d = Data(spark, o.data)
        b = check.Backends(d.revelations, True, d.history, d.outputs, d.txs, d.witness, watermark=d.blocks.agg(F.max("height")).first()[0])
    if o.url:
        from chainloom.functions.chain import script_pubkey
        from chainloom.functions.scripts import decode_address

        asked = spark.createDataFrame([(a,) for a in addresses], "a string").withColumn("d", decode_address("a")).where("d.error is null")
        scripts = [bytes(r[0]) for r in asked.select(script_pubkey(F.col("d.kind"), F.col("d.digest"))).distinct().collect()]
        b.balance_height, b.balances = Client(o.url, credentials(o.cookie)).balances(scripts)
    report = check.check(spark, addresses, b, book, o.depth)
    text = report.as_json() + "\n" if o.json else report.as_text()
    if o.out:
        files.write_text(o.out, text, private=True)
        return None
    return text


@verb("report", "run", opt("stores", nargs="+"))
def report_run(spark, o):
    import json

    from chainloom.plans.store import Files, report_page

    pages = []
    for root in o.stores:
        f = Files(spark, root)
        pages.append(json.loads(f.read(f"{f.read('CURRENT').strip()}/manifest.json")))
    return report_page(pages)


STORE, PARENT, TO = opt("store"), opt("--parent", help="the store of the index that this one is bound to"), opt("--to", type=int)


def _sealed(kind: str):
    """The verbs that every kind of store has."""
    from chainloom.plans import sealed

    def told(manifest: dict) -> str:
        return f"heights {manifest['coverage']['from']}-{manifest['coverage']['to']}, fingerprint {manifest['fingerprint']}\n"

    def store(spark, o):
        return sealed.opened(spark, kind, o.store, o.parent)

    @verb(kind, "build", DATA, STORE, PARENT, TO)
    def build(spark, o):
        """Seals the tables of ingested data up to a height."""
        return told(sealed.build(store(spark, o), kind, Data(spark, o.data), o.to))

    @verb(kind, "append", DATA, STORE, PARENT, TO)
    def append(spark, o):
        """Takes a store on to a later height."""
        return told(sealed.append(store(spark, o), kind, Data(spark, o.data), o.to))

    @verb(kind, "rewind", STORE, opt("height", type=int), PARENT)
    def rewind(spark, o):
        """Takes a store back to a height."""
        return told(sealed.rewind(store(spark, o), kind, o.height))

    @verb(kind, "stats", STORE, PARENT)
    def stats(spark, o):
        """Rows, digests and heights of a store's tables."""
        return sealed.stats(store(spark, o)).orderBy("name")

    @verb(kind, "check", STORE, PARENT, opt("--shallow", action="store_true"))
    def check_(spark, o):
        """What is wrong with a store, a line each."""
        return "".join(f"{x}\n" for x in store(spark, o).verify(not o.shallow)) or "sealed and whole\n"


for _kind in ("index", "derived", "firstspend"):
    _sealed(_kind)


@verb("graph", "stats", DATA)
def graph_stats(spark, o):
    """Rows of the ingested tables and the heights they cover."""
    d = Data(spark, o.data)
    parts = [getattr(d, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.min(h).alias("from_height"), F.max(h).alias("to_height")) for n, h in (("blocks", "height"), ("txs", "height"), ("outputs", "height"), ("inputs", "height"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).orderBy("name")


@verb("graph", "show", DATA, opt("height", type=int))
def graph_show(spark, o):
    """The transactions of a block."""
    return Data(spark, o.data).txs.where(F.col("height") == o.height).orderBy("tx_ord")


@verb("graph", "fingerprint", DATA)
def graph_fingerprint(spark, o):
    """Digests of the contents of transactions and outputs."""
    d = Data(spark, o.data)
    return "".join(f"{n} {audit.content_digest(t, sorted(t.columns), k)}\n" for n, t, k in (("txs", d.txs, "tx_ord"), ("outputs", d.outputs, "out_ord")))


@verb("headers", "fingerprint", DATA)
def headers_fingerprint(spark, o):
    """A digest of the headers in order of height."""
    own = Data(spark, o.data).blocks
    return f"headers {audit.content_digest(own, sorted(own.columns), 'height')}\n"


@verb("headers", "crosscheck", DATA)
def headers_crosscheck(spark, o):
    """Headers whose number of transactions is not that of the ingested ones."""
    d = Data(spark, o.data)
    own = d.txs.groupBy("height").agg(F.count("*").alias("found"))
    return d.blocks.select("height", "n_tx").join(own, "height", "full").where("n_tx is distinct from found").orderBy("height")


@verb("price", "stats", DATA, *SERIES)
def price_stats(spark, o):
    """Of the blocks' prices: how many, how many have none, by series."""
    rows = lookups.block_prices(Data(spark, o.data).blocks, _series(spark, o))
    return rows.groupBy("series").agg(F.count("*").alias("blocks"), F.min("height").alias("from_height"), F.max("height").alias("to_height"), F.count("price").alias("priced")).orderBy("series")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chainloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    groups = parser.add_subparsers(dest="group", required=True)
    verbs: dict[str, argparse._SubParsersAction] = {}
    for (group, name), (f, arguments) in VERBS.items():
        if group not in verbs:
            verbs[group] = groups.add_parser(group).add_subparsers(dest="verb", required=True)
        own = verbs[group].add_parser(name, help=f.__doc__)
        own.add_argument("--csv", help="write the table to this file")
        for names, settings in arguments:
            own.add_argument(*names, **settings)
    o = parser.parse_args(argv)
    spark = spark or session("chainloom")
    out = VERBS[o.group, o.verb][0](spark, o)
    if isinstance(out, str):
        print(out, end="")
    elif out is not None:
        shown = out.select(*(F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in out.dtypes))
        if o.csv:
            files.write_csv(shown, o.csv, [])
        else:
            print("\t".join(shown.columns))
            for row in shown.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in row))
    return 0
