import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from chainloom.llm.simhash import TAU, fingerprints, links, near_dedup, near_groups, thresholds

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("root", T.StringType())])


def fingerprint(text):
    words = [w for w in _lower(text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= TAU:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_groups_against_brute_force(spark):
    r = random.Random(5)
    words = ["wort%d" % i for i in range(300)] + ["Ünï", "A", "B\tC"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(30)]
    texts = [None, "", "a", "a b", "A b"] + base
    for t in base:
        for _ in range(r.randint(0, 4)):
            parts = t.split(" ")
            parts[r.randrange(len(parts))] = r.choice(words)
            texts.append(" ".join(parts))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(7, texts[7], None, None), (None, "lonely text here", None, None)]
    out = {(x.doc_id, x.fingerprint): x.component_id for x in near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [fingerprint(t) for _, t, *_ in rows]
    group = classes(fps)
    for (i, *_), fp, g in zip(rows, fps, group, strict=True):
        ids = [x[0] for x, y in zip(rows, group, strict=True) if y == g and x[0] is not None]
        assert out[i, f"{fp:016x}"] == min(ids, default=None)


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {r.getrandbits(64) for _ in range(100)}
    for _ in range(400):
        x = centre
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=10).collect()
    want = classes(list(fps))
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= TAU and want[at[a]] == want[at[b]]
        root[find(at[a])] = find(at[b])
    assert len({find(i) for i in root}) == len(set(want))


def test_thresholds_satisfy_the_pigeonhole(spark):
    import numpy as np

    r = np.random.default_rng(1)
    for n in (10, 100_000, 10**9):
        bits = (r.random((2000, 64)) < 0.5).astype(float)
        plan = thresholds(n, bits.T @ bits / 2000 * n)
        assert sum(t + 1 for _, t in plan) == TAU + 1
        assert len({b for part, _ in plan for b in part}) == sum(len(part) for part, _ in plan)


def test_near_dedup_against_brute_force_with_nulls_and_repeats(spark):
    r = random.Random(6)
    words = ["wort%d" % i for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 90))) for _ in range(8)]
    a, b, c = base[:3]
    rows = [(1, a, "x", "y"), (1, a, "x", "z"), (None, a, None, None), (None, b, None, None), (2, c, None, None)]
    for t in base[3:]:
        for _ in range(r.randint(1, 5)):
            parts = t.split(" ")
            parts[r.randrange(len(parts))] = r.choice(words)
            rows.append((r.choice([None, *range(3, 9)]), " ".join(parts), None, None))
    group = classes([fingerprint(t) for _, t, *_ in rows])
    want = {}
    for (i, t, *_), g in zip(rows, group, strict=True):
        rank = (i is None, i or 0, hashlib.sha256(t.encode()).hexdigest())
        want[g] = min(want.get(g, (rank, i, t)), (rank, i, t), key=lambda x: x[0])
    schema = T.StructType(DOCS.fields[:2] + [T.StructField("key", T.StringType()), T.StructField("_key", T.StringType())])
    got = near_dedup(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "key", "_key"]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted(((i, t) for _, i, t in want.values()), key=repr)


def test_a_long_text_has_the_fingerprint_of_its_whole(spark):
    r = random.Random(2)
    text = " ".join(f"W{r.randrange(10**9)}" for _ in range(900000))
    assert len(text) > 8 << 20
    h = np.zeros(64, np.int64)
    words = text.lower().split(" ")
    own = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)), np.uint64)
    for b in range(64):
        h[b] = int(((own >> np.uint64(b)) & np.uint64(1)).sum())
    want = sum(1 << b for b in range(64) if 2 * h[b] > len(own))
    assert fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fp & (1 << 64) - 1 == want


def test_near_dedup_keeps_one_of_each_group_and_takes_an_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c d e", None, None), (1, "a b c d e", None, None), (2, "other words entirely different", None, None)], DOCS)
    assert sorted(x.doc_id for x in near_dedup(docs).collect()) == [1, 2]
    assert near_groups(docs.limit(0)).collect() == []
