from pyspark.sql import functions as F

from chainloom.plans import links


def test_same_key_by_hand(spark):
    rows = [(p, ("p2pkh", "p2wpkh")[p % 3 == 0], "xyz"[p % 7 == 0]) for p in range(40)]
    rows += [(3, "p2pkh", "x"), (3, "p2wpkh", "x"), (1, "p2pkh", "x"), (None, "p2pkh", "x"), (None, "p2wpkh", "x"), (41, "p2pkh", None), (42, "p2wpkh", None), (43, "p2sh", "x"), (44, None, "x"), (45, "p2pkh", "z")]
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in a + b and a[2] == b[2] and a[0] < b[0] and a[1] != b[1] and "p2sh" not in (a[1], b[1]))
    own = spark.createDataFrame(rows, "pos int, kind string, digest string")
    for block in (1, 4, 1000):
        assert sorted(tuple(r) for r in links.same_key(own, block).collect()) == want
    assert links.same_key(own.limit(0)).collect() == []


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark):
    own = spark.range(0, 4000, 1, 1).select(F.col("id").alias("pos"), F.when(F.col("id") % 4 == 0, "p2pkh").otherwise("p2wpkh").alias("kind"), F.lit("x").alias("digest"))
    share = links.same_key(own).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in share) == 1000 * 3000
    assert len(share) > 1 and max(r["count"] for r in share) < 2_000_000
