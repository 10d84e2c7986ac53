import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from chainwriter import Chain, A, B, coinbase, five_blocks, push, tx
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chainloom.functions.hashing import hash160_of
from chainloom.plans import audit, ledger, nonces, reveal
from chainloom.plans import check as K
from chainloom.plans import store as S
from chainloom.plans.ingest import parsed, tables
from chainloom.session import written
from chainloom.sources import files
from chainloom.sources.nodes import Client, NodeError, NodeSource
from chainloom.streaming import ingest as I

RAW = "height int, block_hash binary, raw binary"


# -- identities and stores ----------------------------------------------------


def test_identity_and_statement_bytes():
    identity = {"format": "demo-v2", "coverage": {"from": 1, "to": 4}, "files": [{"name": "alpha", "sha256": "11" * 32}, {"name": "beta", "sha256": "22" * 32}]}
    want = b"tag\0" + b"\0\7demo-v2" + b"\0\0\0\1\0\0\0\4\0\0\0\2" + b"\0\5alpha" + b"\x11" * 32 + b"\0\4beta" + b"\x22" * 32
    assert S.identity_bytes(identity, b"tag\0") == want
    swapped = identity | {"files": identity["files"][::-1]}
    assert S.fingerprint(swapped) != S.fingerprint(identity) == S.fingerprint(identity | {"build": {"parent": {"fingerprint": "00"}}})
    root = {"format": "demo-v2", "fingerprint": "ab" * 32, "build": {}}
    child = root | {"build": {"parent": {"format": "p-v1", "fingerprint": "cd" * 32}}}
    assert S.statement_bytes(root, b"t") == b"t\0\7demo-v2" + b"\xab" * 32 + b"\0"
    assert S.statement_bytes(child, b"t") == b"t\0\7demo-v2" + b"\xab" * 32 + b"\1\0\4p-v1" + b"\xcd" * 32
    for bad in ("../x", "/x", "a/b", "", ".hidden", "a..b"):
        with pytest.raises(S.StoreError):
            S.checked_name(bad)


def build(spark, last=None, first=1):
    chain = five_blocks()
    return tables(written(parsed(spark.createDataFrame([r for r in chain.rows(last) if r[0] >= first], RAW)), "store"))


def history(t):
    rows = ledger.spend_heights(ledger.history(t.outputs, t.spends), t.txs)
    return rows.select("out_ord", "lock", "height", "value", "spender_tx", "spend_height")


def test_append_rewind_and_rebuild_are_one(spark, tmp_path):
    keys = {"history": "out_ord"}
    new = lambda name, parent=None: S.Store(spark, str(tmp_path / name), "history-v1", keys, parent)
    whole, grown, back = new("whole"), new("grown"), new("back")
    full, short = history(build(spark)), history(build(spark, 3))
    sealed = whole.commit({"history": full}, 1, 5)
    grown.commit({"history": short}, 1, 3)

    def merge(name, old, fresh):  # rows of the new blocks, and old rows that they spend
        kept = old.join(fresh.select("out_ord"), "out_ord", "left_anti")
        return kept.unionByName(fresh)

    changed = full.exceptAll(short)
    appended = grown.append({"history": changed}, 5, merge)
    assert appended["fingerprint"] == sealed["fingerprint"] and appended["build"]["seconds"].keys() == {"build", "append"}
    back.commit({"history": full}, 1, 5)

    def cut(name, df):
        gone = F.col("spend_height") > 3
        return df.where("height <= 3").withColumns({c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)) for c in ("spender_tx",)}).withColumn("spend_height", F.when(~F.coalesce(gone, F.lit(False)), F.col("spend_height")))

    cut_back = back.rewind(3, cut)
    again = new("again")
    assert cut_back["fingerprint"] == again.commit({"history": short}, 1, 3)["fingerprint"]
    assert whole.verify() == [] and whole.manifest()["coverage"] == {"from": 1, "to": 5}
    with pytest.raises(S.StoreError):
        grown.append({"history": changed}, 5)
    with pytest.raises(S.StoreError):
        back.rewind(9, cut)
    with pytest.raises(S.StoreError, match="another parent"):
        new("whole", {"format": "x", "fingerprint": "00" * 32}).manifest()
    with pytest.raises(S.StoreError):
        S.Store(spark, str(tmp_path / "whole"), "history-v2", keys).manifest()
    with pytest.raises(S.StoreError):
        new("none").manifest()
    name = whole.current()
    (tmp_path / "whole" / "g9-crash").mkdir()
    assert whole.sweep() == ["g9-crash"] and whole.current() == name
    spark.read.parquet(str(tmp_path / "whole" / name / "history")).limit(3).write.mode("overwrite").parquet(str(tmp_path / "bad"))
    full.withColumn("value", F.col("value") + 1).write.mode("overwrite").parquet(str(tmp_path / "whole" / name / "history"))
    assert whole.verify() == ["history: the content is not that of the manifest"]
    assert S.total_cost([sealed | {"build": {"seconds": {"scan": 5, "merge": 1}}}, sealed | {"build": {"seconds": {"scan": 7, "merge": 2}}}], {"scan"}) == 10
    assert sealed["fingerprint"][:16] in S.report_page([sealed])


def test_content_digest_is_of_the_content(spark, tmp_path):
    df = history(build(spark))
    a = audit.content_digest(df, sorted(df.columns), "out_ord")
    assert a == audit.content_digest(df.repartition(7), sorted(df.columns), "out_ord")
    assert a != audit.content_digest(df.where("out_ord < 9"), sorted(df.columns), "out_ord")


# -- files --------------------------------------------------------------------


def test_price_files(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("time,PriceUSD\n20,3.50\n10,1\n20,9\n30,\n")
    assert [tuple(r) for r in files.price_series(spark, str(path), price="PriceUSD").collect()] == [(10, "1"), (20, "3.50")]
    path.write_text("time,price\n1,0\n")
    with pytest.raises(Exception, match="not a positive price"):
        files.price_series(spark, str(path)).collect()
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"data": {"rows": [["2024-01-02", 5.25], ["2024-01-01", 4]]}}))
    got = files.price_series(spark, str(path), "0", "1", "yyyy-MM-dd", "data.rows", True).collect()
    assert [tuple(r) for r in got] == [(1704067200, "4"), (1704153600, "5.25")]
    path.write_text(json.dumps([{"t": 1500, "p": "2"}, {"t": 2500, "p": None}]))
    assert [tuple(r) for r in files.price_series(spark, str(path), "t", "p", "unix_ms").collect()] == [(1, "2")]


def test_strict_csv_and_sinks(spark, tmp_path):
    schema = StructType([StructField("height", LongType()), StructField("n", LongType())])
    path = str(tmp_path / "c.csv")
    files.write_csv(spark.createDataFrame([(2, None), (1, 5)], schema), path, ["height"])
    assert open(path).read() == "height,n\n1,5\n2,\n"
    assert files.strict_csv(spark, path, schema).count() == 2
    assert [r.line for r in files.numbered_csv(spark, path, schema).orderBy("line").collect()] == [0, 1]
    (tmp_path / "d.csv").write_text("height,other\n1,2\n")
    with pytest.raises(Exception):
        files.strict_csv(spark, str(tmp_path / "d.csv"), schema).collect()
    (tmp_path / "e.csv").write_text("height,n\n1,x\n")
    with pytest.raises(Exception):
        files.strict_csv(spark, str(tmp_path / "e.csv"), schema).collect()
    files.write_json(str(tmp_path / "x.json"), {"b": 1, "a": 2}, private=True)
    assert json.load(open(tmp_path / "x.json")) == {"a": 2, "b": 1} and (tmp_path / "x.json").stat().st_mode & 0o777 == 0o600


# -- a node -------------------------------------------------------------------


class Node(BaseHTTPRequestHandler):
    chain: Chain = None
    fails = 0
    lies = False

    def log_message(self, *_):
        pass

    def _send(self, data: bytes, code: int = 200):
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        names = {b[::-1].hex(): (h, raw) for h, (b, raw) in self.chain.blocks.items()}
        out = []
        for c in body:
            m, p = c["method"], c["params"]
            if m == "getblockhash":
                r = self.chain.blocks[p[0]][0][::-1].hex()
            elif m == "getblock":
                r = names[p[0]][1].hex()
            elif m == "getblockheader":
                r = {"height": names[p[0]][0] + self.lies, "time": 1_700_000_000 + 600 * names[p[0]][0]}
            else:
                r = {"height": 5, "unspents": [{"scriptPubKey": A.hex(), "amount": 1.5}, {"scriptPubKey": "00", "amount": 9}, {"scriptPubKey": A.hex(), "amount": 0.00000001}]}
            out.append({"id": c["id"], "result": r, "error": None})
        self._send(json.dumps(out[::-1]).encode())

    def do_GET(self):
        if Node.fails:
            Node.fails -= 1
            return self._send(b"busy", 503)
        kind, name = self.path.split("/")[2:]
        if kind == "blockhashbyheight":
            return self._send(json.dumps({"blockhash": self.chain.blocks[int(name[:-5])][0][::-1].hex()}).encode())
        for b, raw in self.chain.blocks.values():
            if b[::-1].hex() == name[:-4]:
                return self._send(raw)
        self._send(b"", 404)


@pytest.fixture(scope="module")
def node():
    Node.chain = five_blocks()
    server = HTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_blocks_of_a_node(spark, node):
    spark.dataSource.register(NodeSource)
    want = sorted(five_blocks().rows())
    Node.fails = 2
    for transport in ("rest", "rpc"):
        df = spark.read.format("ledger-node").options(url=node, transport=transport, partition="2", batch="1", wait="0.01", **{"from": "1", "to": "5"}).load()
        assert sorted((r.height, bytes(r.block_hash), bytes(r.raw)) for r in df.collect()) == want
    heads = spark.read.format("ledger-node").options(url=node, kind="header", **{"from": "2", "to": "3"}).load()
    assert [(r.height, r.time) for r in heads.orderBy("height").collect()] == [(2, 1_700_001_200), (3, 1_700_001_800)]
    client = Client(node, "u:p", wait=0.01)
    assert client.balances([A, B]) == (5, {A: 150_000_001, B: 0})
    Node.lies = True
    with pytest.raises(NodeError, match="asked for height"):
        client.times([2])
    Node.lies = False
    with pytest.raises(NodeError):
        Client("http://127.0.0.1:9", tries=2, wait=0.01).call("getblockhash", 1)
    with pytest.raises(NodeError, match="HTTP 404"):
        client.get("/rest/block/00.bin")


# -- a stream -----------------------------------------------------------------


def test_batches_give_what_one_pass_gives(spark, tmp_path):
    chain = Chain()
    key = b"\x02" + bytes(range(32))
    for k in range(6):
        first = coinbase(bytes([1, k]), A)
        sig = b"\x30" + bytes(70)
        chain.add(first, tx([(bytes([k + 1]) * 32, 0, push(sig) + push(key[:-1] + bytes([k % 4])))], [(5, B)]))
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    land = lambda rows: spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
    watch = spark.createDataFrame([(hash160_of(B), "b")], "lock binary, label string")
    for part in (chain.rows()[:2], chain.rows()[2:5], chain.rows()[5:]):
        land(part)
        I.ingest(I.landed(spark, source, 1), out, mark).awaitTermination()
    own = tables(written(parsed(spark.createDataFrame(chain.rows(), RAW)), "one"), tolerate=True)
    whole = reveal.reduced(reveal.sightings(own.reveals()))
    assert audit.differences(I.revelations(spark, out).select(*whole.columns), whole).first() == (0, 0)
    assert spark.read.parquet(f"{out}/parsed").count() == 6
    assert spark.read.parquet(f"{out}/nonces").count() == nonces.census(nonces.extracted(own.reveals())).count()
    query = I.matched(I.landed(spark, source), watch).writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", mark + "2").start()
    query.awaitTermination()
    assert sorted((r.height, r.value, r.label) for r in spark.table("hits").collect()) == [(h, 5, "b") for h in range(1, 7)]


# -- the report ---------------------------------------------------------------

GOOD = {"format": "address-book-v2", "groups": [{"label": "a", "claim": "separate", "addresses": ["x", "x"]}, {"label": "b", "claim": "watching", "addresses": ["y"], "origin": {"method": "manual", "range": [0, 9], "gap_limit": 20}}]}


def test_address_books():
    book = K.address_book(json.dumps(GOOD))
    assert (book.repeats, book.separate, book.group_of) == (1, ["a"], {"x": "a", "y": "b"})
    change = lambda **g: json.dumps(GOOD | {"groups": [GOOD["groups"][0] | g, GOOD["groups"][1]]})
    for bad in ("[", "{}", json.dumps(GOOD | {"format": "v1"}), json.dumps(GOOD | {"x": 1}), change(claim="mine"), change(label="b"), change(addresses=["y"]), change(addresses="x"), change(extra=1), change(origin={"who": 1}), *(change(origin=o) for o in ({"method": "telepathy"}, {"chain": "recieve"}, {"range": [1]}, {"gap_limit": True}, {"derived_by": 3}))):
        with pytest.raises(K.BookError):
            K.address_book(bad)


def test_report(spark):
    from chainloom.functions.hashing import sha256d_of
    from chainloom.functions.scripts import BASE58

    def base58(version, digest):
        raw = bytes([version]) + digest
        n, out = int.from_bytes(raw + sha256d_of(raw)[:4], "big"), ""
        while n:
            n, k = divmod(n, 58)
            out = BASE58[k] + out
        return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out

    own = [base58(0, bytes([k]) * 20) for k in (1, 2, 3)]
    t = build(spark)
    full = ledger.spend_heights(ledger.history(t.outputs, t.spends), t.txs)
    seen = spark.createDataFrame([("keys", bytes([2]) * 20, 1, 4)], "category string, digest binary, byte int, first_height long")
    witness = spark.createDataFrame([(bytes([9]) * 32, bytes([2]) * 20, b"1", 1, 0), (bytes([9]) * 32, bytes([2]) * 20, b"2", 2, 0)], "r binary, key binary, s binary, height long, flags int")
    book = K.address_book(json.dumps({"format": "address-book-v2", "groups": [{"label": "p", "claim": "separate", "addresses": own[:1]}, {"label": "q", "claim": "separate", "addresses": own[1:2]}, {"label": "r", "claim": "separate", "addresses": own[2:]}]}))
    report = K.check(spark, [*own, "nonsense", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"], K.Backends(seen, True, full, t.outputs, t.txs, witness, watermark=5), book, depth=2)
    a, b, c, bad, tap = report.entries
    assert b.answers["exposure"].value == {"status": "exposed_by_reuse", "first_height": 4, "sealed": True, "note": "but empty"}
    assert a.answers["exposure"].value["status"] == "protected" and bad.error and tap.answers["exposure"].value["status"] == "exposed_by_construction"
    assert b.answers["nonces"].value == {"points": ["09" * 12]} and a.answers["nonces"].status == K.UNDETERMINED
    assert c.answers["history"].value["unspent"] == 5 and a.answers["co_inputs"].value["other_inputs"] == 1
    assert [(f["pos_a"], f["pos_b"], f["height"]) for f in report.links["common_input"]["findings"] if f["bridge"] is None] == [(0, 1, 5)]
    assert {(f["from_pos"], f["to_pos"]) for f in report.links["payment_arc"]["findings"]} >= {(0, 1), (2, 0), (1, 2)}
    assert [(s["group_a"], s["group_b"], s["held"]) for s in report.separations] == [("p", "q", False), ("p", "r", True), ("q", "r", True)]
    summary = report.summary()
    assert summary["exposure"] == {"protected": 2, "exposed_by_reuse": 1, "exposed_by_construction": 1} and summary["balance"] == 4 * 5_000_000_000 + 5
    assert json.loads(report.as_json())["entries"][3]["error"] and "but empty" in report.as_text() and report.as_csv().count("\n") == 6
    bare = K.check(spark, own[:1], K.Backends())
    assert bare.entries[0].answers["exposure"].status == K.UNDETERMINED and bare.entries[0].answers["balance"].status == K.UNSUPPORTED and "balance" not in bare.summary() and bare.crossing() is None
    scanned = K.check(spark, own[:1], K.Backends(seen, watermark=3, balances={A: 7}, balance_height=5))
    assert scanned.crossing() == {"exposure_height": 3, "balance_height": 5, "gap": 2, "behind": "exposure"} and scanned.entries[0].answers["balance"].value == {"sats": 7}
