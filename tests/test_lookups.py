import pytest
from chainwriter import COIN, A, B, Chain, coinbase, der, five_blocks, push, tx
from pyspark.sql import functions as F

from chainloom.functions.hashing import hash160_of
from chainloom.plans import ledger, lookups, nonces, reveal
from chainloom.plans.ingest import parsed, tables
from chainloom.session import written

RAW = "height int, block_hash binary, raw binary"


@pytest.fixture(scope="module")
def five(spark):
    return tables(written(parsed(spark.createDataFrame(five_blocks().rows(), RAW)), "five"))


def test_outpoints_and_fees(spark, five):
    ids = {r.tx_ord: bytes(r.txid)[::-1].hex() for r in five.txs.collect()}
    asked = [f"{ids[2]}:1", f"{ids[2]}:2", f"{ids[0]}:0", "00" * 32 + ":0", "zz", f"{ids[2]}"]
    out, bad = lookups.outputs(spark, asked, five.txs, five.outputs, five.spends)
    got = {(bytes(r.txid)[::-1].hex(), r.vout): (r.status, r.out_ord, r.value, r.spender_tx) for r in out.collect()}
    assert got == {(ids[2], 1): ("spent", 3, 3, 4), (ids[2], 2): ("no such output", None, None, None), (ids[0], 0): ("unspent", 6, COIN, None), ("00" * 32, 0): ("unknown transaction", None, None, None)}
    assert bad == ["zz", ids[2]]
    fees = ledger.fees(five.txs, five.outputs, five.spends)
    out, bad = lookups.fee(spark, [ids[8], ids[0], "11" * 32, "1"], five.txs, fees)
    assert {bytes(r.txid)[::-1].hex(): (r.status, r.fee) for r in out.collect()} == {ids[8]: ("ok", 3), ids[0]: ("coinbase", None), "11" * 32: ("unknown", None)} and bad == ["1"]


def test_history_and_first_spends(spark, five):
    full = ledger.spend_heights(ledger.history(five.outputs, five.spends), five.txs)
    own, more = lookups.history(full, hash160_of(B), 3)
    assert [(r.height, r.kind) for r in own.collect()] == [(4, "SPEND"), (4, "RECV"), (5, "SPEND")] and more == 1
    assert lookups.history(full, hash160_of(B))[0].count() == 4
    first = ledger.first_spend(full)
    assert sorted((r.spender_tx, r.height) for r in lookups.spent_between(first, five.txs, 3, 5).collect()) == [(4, 3), (6, 4)]
    assert lookups.spent_between(first, five.txs, 9, 12).count() == 0
    assert lookups.header_stats(five.blocks).first().blocks == 5


def test_digests_with_what_is_pending(spark):
    seen = spark.createDataFrame([("keys", b"a" * 20, 1, 5), ("scripts32", b"b" * 32, 2, 7)], "category string, digest binary, byte int, first_height long")
    new = spark.createDataFrame([("keys", b"a" * 20, 2, 3), ("keys", b"c" * 20, 4, 9)], "category string, digest binary, byte int, height long")
    texts = [(x * n).hex() for x, n in ((b"a", 20), (b"b", 32), (b"c", 20), (b"d", 20))] + ["abc", "61" * 21]
    out, bad = lookups.digests(spark, texts, seen, new)
    assert {bytes(r.digest)[:1]: (r.byte, r.first_height, r.status) for r in out.collect()} == {b"a": (3, 3, "pending"), b"b": (2, 7, "sealed"), b"c": (4, 9, "pending"), b"d": (None, None, "absent")}
    assert bad == texts[4:]
    old = lookups.projection_digests(seen)
    assert old == lookups.projection_digests(seen.withColumn("byte", F.when(F.col("category") == "keys", F.col("byte") + 16).otherwise(F.col("byte"))).withColumn("first_height", F.lit(1))) and len(set(old.values())) == 3


def test_points_and_the_signatures_of_a_lock(spark):
    c = Chain()
    key = b"\x02" + bytes(range(32))
    r = 77 << 200
    first, second = coinbase(b"\x01a", A), coinbase(b"\x01b", A)
    c.add(first)
    c.add(second, tx([(first[1], 0, push(der(r, 10)) + push(key))], [(1, B)]))
    c.add(coinbase(b"\x01c", B), tx([(second[1], 0, push(der(r, 20)) + push(key))], [(1, B)]))
    t = tables(written(parsed(spark.createDataFrame(c.rows(), RAW)), "sig"))
    full = ledger.spend_heights(ledger.history(t.outputs, t.spends), t.txs)
    own = lookups.lock_signatures(full, t.inputs, t.txs, hash160_of(A))
    census = nonces.census(nonces.extracted(t.reveals()))
    extra = census.unionByName(census.limit(1))
    got = nonces.own_repeats(own, extra).first()
    assert (got["count"], got.verdict, got.elsewhere) == (2, "key-follows", 1)
    out, bad = lookups.points(spark, [r.to_bytes(32, "big").hex(), "00" * 12, "0"], census)
    assert {bytes(x.point): x["count"] for x in out.collect()} == {r.to_bytes(32, "big")[:12]: 2, bytes(12): 0} and bad == ["0"]
    assert reveal.reduced(reveal.sightings(t.reveals())).where("category = 'keys'").first().first_height == 2


def test_block_prices(spark):
    blocks = spark.createDataFrame([(1, 100), (2, 200)], "height long, time long")
    prices = spark.createDataFrame([(90, "1.0000005"), (150, "2.5")], "ts long, price string")
    got = [(r.height, str(r.price), r.series) for r in lookups.block_prices(blocks, [(prices, 20)]).orderBy("height").collect()]
    assert got == [(1, "1.000000", 1), (2, "None", 0)]
    assert lookups.at_price([(prices, 1000)], spark, [149]).first().price == "1.0000005"
    assert lookups.series_faults(prices.unionByName(prices)).first() == (2, 0, 0)
