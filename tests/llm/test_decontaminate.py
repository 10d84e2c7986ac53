import hashlib
import random
import re

from pyspark.sql import types as T

from chainloom.llm.decontaminate import Bitmap, contamination, decontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, size):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in own if i is not None}
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(2)
    words = ["the", "of", "Ä", "été", "x9", "naïve", "go", "to"] + [f"w{i}" for i in range(40)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, "; ".join(some(r.randint(10, 30)))) for i in range(25)] + [(90, "of the, TO"), (91, ""), (92, None), (None, " ".join(some(12))), (3, "go go")]
    docs = []
    for i in range(200):
        w = some(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            t = r.choice(items)[1] or ""
            w += WORD.findall(t)[r.randint(0, 3) :] + some(3)
        docs.append((i, " ".join(w).upper() if i % 3 else "-".join(w)))
    docs += [(500, None), (501, ""), (None, "of the to"), (5, docs[5][1])]
    d = spark.createDataFrame([(i, t, "clash", b"x") for i, t in docs], "doc_id long, text string, item_id string, __spans binary")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (10, 3):
        want = brute(docs, items, size)
        out = contamination(d, b, window=size)
        assert sorted((tuple(x) for x in out.drop("items", "spans").collect()), key=repr) == want
        assert out.where("n_hit != aggregate(spans, 0L, (a, x) -> a + x.end - x.begin) or n_items != size(items)").count() == 0
    want = brute(docs, items, 10)
    kept = decontaminated(d, b)
    assert kept.columns == d.columns and kept.where("__spans is null").count() == 0
    assert sorted(map(repr, (x.doc_id for x in kept.collect()))) == sorted(repr(x[0]) for x in want if not x[-1])
    assert decontaminated(d, b.limit(0)).count() == d.count()
    assert contamination(d.limit(0), b).count() == 0


def test_ids_of_any_type_long_texts_and_a_passage_in_many_documents(spark):
    r = random.Random(7)
    some = lambda n: " ".join(f"v{r.randrange(9000)}" for _ in range(n))
    items = [("i1", some(40)), ("i2", some(12)), ("i3", "lone pair")]
    parts = [some(400000), items[0][1], some(200000), items[1][1], some(800000), "Lone Pair", some(100000)]
    docs = [("long", " ".join(parts)), *((f"d{i}", f"{some(5)} {items[0][1]} {some(5)}") for i in range(300)), ("plain", some(50)), (None, None)]
    assert len(docs[0][1]) > 8 << 20
    d, b = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = contamination(d, b).drop("items", "spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, 10)
    assert {x.doc_id for x in decontaminated(d, b).collect()} == {"plain", None}


def test_the_bitmap_misses_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    own = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    bits = Bitmap.of(spark.createDataFrame([(int(x),) for x in own], "token long"), len(own))
    assert len(bits.may(own.view(np.uint64))) == len(own)
    assert len(bits.may(rng.integers(0, 1 << 64, 10000, dtype=np.uint64))) < 400
