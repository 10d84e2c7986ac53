import pytest
from chainwriter import five_blocks

from chainloom.cli import main
from chainloom.plans import sealed
from chainloom.plans.store import StoreError

RAW = "height int, block_hash binary, raw binary"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sealed")
    spark.createDataFrame(five_blocks().rows(), RAW).write.parquet(str(root / "raw"))
    assert main(["ingest", "build", str(root / "data"), "--raw", str(root / "raw")], spark) == 0
    return root


@pytest.mark.parametrize("kind", ["index", "derived", "firstspend"])
def test_append_and_rewind_equal_a_build(spark, root, capsys, kind):
    d, s, other = (str(root / x) for x in ("data", kind, f"{kind}-other"))

    def run(*argv):
        capsys.readouterr()
        assert main([kind, *argv], spark) == 0
        return capsys.readouterr().out

    early = run("build", d, s, "--to", "3")
    assert early.startswith("heights 1-3,")
    full = run("append", d, s)
    assert full == run("build", d, other) and full.startswith("heights 1-5,")
    with pytest.raises(StoreError):
        main([kind, "append", d, s], spark)
    before = sealed.opened(spark, kind, s).current()
    assert run("rewind", s, "3") == early
    assert before in sealed.opened(spark, kind, s).files.names()  # for who still reads it
    assert run("check", s) == "sealed and whole\n"
    told = [x.split("\t") for x in run("stats", s).strip().split("\n")][1:]
    assert [x[0] for x in told] == sorted(sealed.KINDS[kind].keys) and all(x[3:] == ["1", "3"] for x in told)


def test_a_store_is_bound_to_its_parent_and_its_rows_are_counted(spark, root, tmp_path):
    from chainloom.cli import Data

    d = Data(spark, str(root / "data"))
    index = sealed.opened(spark, "index", str(tmp_path / "index"))
    sealed.build(index, "index", d, 3)
    own = sealed.opened(spark, "derived", str(tmp_path / "derived"), index.root)
    sealed.build(own, "derived", d, 5)
    assert own.verify() == ["the coverage goes beyond that of the parent"]
    sealed.rewind(own, "derived", 3)
    assert own.verify() == []
    own.read("fees").limit(1).write.mode("append").parquet(f"{own.root}/{own.current()}/fees")
    assert "fees: the rows are not as many as in the manifest" in own.verify(deep=False)
    sealed.append(index, "index", d)
    with pytest.raises(StoreError):
        sealed.opened(spark, "derived", own.root, index.root).manifest()


def test_ingested_tables_can_be_asked_about(spark, root, capsys):
    d = str(root / "data")
    for argv, n in ((["graph", "stats", d], 5), (["headers", "crosscheck", d], 1), (["graph", "fingerprint", d], 2), (["headers", "fingerprint", d], 1)):
        capsys.readouterr()
        assert main(argv, spark) == 0
        assert len(capsys.readouterr().out.strip().split("\n")) == n
    capsys.readouterr()
    main(["graph", "show", d, "2"], spark)
    assert len(capsys.readouterr().out.strip().split("\n")) >= 2
