import hashlib
import random
import re

from chainloom.llm.exactdedup import exact_dedup, exact_groups


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        flags = [True] + [False] * (len(ids) - 1)
        ordered = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, least, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()) for i, kept in zip(ordered, flags, strict=True)]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(4)
    texts = ["", " ", None, "a b", "a\t\nb", "a b ", "x" * 40 + "1", "x" * 40 + "2", "é  ü", "long " * 5000] + [f"t{i % 50}" for i in range(200)]
    rows = [(i, r.choice(texts)) for i in range(500)] + [(i, "hot text") for i in range(1000, 1300)] + [(7, "t1"), (7, "t1"), (None, "t1"), (None, "only null"), (None, "only null")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, head string, n int")
    want = brute(rows)
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(map(tuple, exact_groups(df).collect()), key=repr) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == sum(x[3] for x in want)
    assert exact_groups(df.limit(0)).collect() == [] and exact_dedup(df.limit(0)).collect() == []
