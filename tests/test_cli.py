import pytest
from chainwriter import COIN, B, five_blocks, snapshot

from chainloom.cli import VERBS, main
from chainloom.functions.hashing import hash160_of

RAW = "height int, block_hash binary, raw binary"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    spark.createDataFrame(five_blocks().rows(), RAW).write.parquet(str(root / "raw"))
    assert main(["ingest", "build", str(root / "data"), "--raw", str(root / "raw")], spark) == 0
    (root / "p.csv").write_text("time,price\n1700000000,2\n1700001200,4\n")
    h = bytes(range(20))
    (root / "s.dat").write_bytes(snapshot([(b"\1" * 32, 0, 5, 1, COIN, 0, h), (b"\2" * 32, 0, 6, 0, 7, 28, b"\0\x14" + h)]))
    return root


def test_verbs(spark, data, capsys):
    d, s, p = str(data / "data"), str(data / "s.dat"), str(data / "p.csv")
    capsys.readouterr()

    def run(*argv):
        assert main(list(argv), spark) == 0
        return [line.split("\t") for line in capsys.readouterr().out.strip().split("\n")]

    assert run("derived", "history", d, hash160_of(B).hex())[1:][0][1:] == ["2", "2", "RECV", "7"]
    assert run("derived", "balance", d, hash160_of(B).hex(), "--height", "3")[1] == ["7", "0", "0.00000007"]
    assert ["5", "0"] not in run("derived", "supply", d, "--bucket", "2") and run("derived", "supply", d)[1][-1] == "0"
    assert all(r[1] == r[2] for r in run("derived", "verify", d)[1:])
    assert len(run("firstspend", "between", d, "1", "5")) == 4
    assert run("blockstats", "summary", d, "--bucket", "3")[1][:3] == ["0", "1", "2"]
    assert run("headers", "verify", d) == [["height", "fault"]] and run("headers", "stats", d)[1][0] == "5"
    assert run("headers", "show", d, "3")[1][-1] == "1700001200"
    assert len(run("graph", "digest", d, "--every", "2")) == 4
    assert run("archive", "verify", d)[1] == ["0"] * 4 and len(run("archive", "curve", d, "--every", "2")) == 4
    assert run("archive", "lookup", d, "11" * 20)[1][-1] == "absent"
    assert len(run("archive", "v1-digests", d)) == 3
    assert run("nonces", "stats", d)[1][3] == "0" and run("nonces", "groups", d)[0][0] == "point" and run("nonces", "verify", d)[1][0] == "0"
    assert run("nonces", "lookup", d, "00" * 12)[1][1] == "0" and run("nonces", "resolve", d)[0][0] == "point" and run("nonces", "address", d, hash160_of(B).hex())[0][0] == "r"
    assert run("index", "lookup", d, "00" * 32 + ":0")[1][2] == "unknown transaction"
    assert run("derived", "fee", d, "00" * 32)[1][1] == "unknown" and len(run("derived", "cospends", d, "5")) == 2
    assert run("price", "at", "1700000010", "--series", p)[1] == ["1700000010", "2", "1"]
    assert len(run("price", "build", d, "--series", p)) == 6 and run("price", "daily", d, "--series", p)[1][3] == "measured"
    assert run("price", "import", p)[1] == ["1700000000", "2"] and run("price", "verify", p)[1] == ["0", "0", "0"]
    assert run("census", "run", s)[1:] == [["p2pkh", "0", "1", str(COIN)], ["p2wpkh", "0", "1", "7"]] and run("census", "epochs", s)[0][0] == "type"
    assert run("reuse", "prepare", s, str(data / "locks"))[1:] == [["p2pkh", "1", str(COIN)], ["p2wpkh", "1", "7"]]
    assert run("archive", "derive", d, str(data / "locks"))[-1][0] == "p2wpkh"
    assert run("reuse", "stats", d, str(data / "locks"))[0][0] == "type" and len(run("reuse", "curve", d, str(data / "locks"), "--every", "2")) == 4
    assert "protected" in run("check", "run", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "--data", d)[0][0]
    (data / "c.csv").write_text("height,p2pkh_hits,p2pkh_satoshis,p2sh_hits,p2sh_satoshis,p2wpkh_hits,p2wpkh_satoshis,p2wsh_hits,p2wsh_satoshis,fingerprint\n10,2,1000,0,0,0,0,0,0,x\n20,5,7000,0,0,0,0,0,0,y\n")
    main(["curve", "deltas", str(data / "c.csv"), "--csv", str(data / "d.csv")], spark)
    assert (data / "d.csv").read_text().split("\n")[2].startswith("10,20,3,6000")
    assert len({g for g, _ in VERBS} - {"ingest"}) == 14
