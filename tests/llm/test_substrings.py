import hashlib
import random
import re
from collections import Counter

import pytest

from chainloom.llm import substrings
from chainloom.llm.substrings import kept_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(r):
    words = ["a", "the", "Äb", "é!", "x,y"] + [f"w{i}" for i in range(60)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    shared = [some(r.randint(20, 60)) for _ in range(5)]
    texts = [None, "", "one", "　\xa0 x", "a " * 400, "b\nb\tb " * 200]
    for i in range(150):
        w = some(r.randint(0, 80))
        if i % 2:
            w += shared[0] + some(10)
        if i % 5 == 0:
            w += r.choice(shared)
        texts.append(" \n".join(w))
    texts += [texts[20], texts[21], texts[21] + " end"]
    return [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (9, "other " * 50), (None, texts[12]), (None, "lone words here")]


@pytest.mark.parametrize("window,m,heavy", [(35, 4, substrings.HEAVY), (35, 4, 4000), (12, 3, 1500), (5, 1, 0)])
def test_against_brute_force(spark, window, m, heavy):
    rows = corpus(random.Random(window))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(5)
    assert sorted(map(tuple, kept_words(df, window, m, heavy=heavy).collect()), key=repr) == brute(rows, window)


def test_the_least_doc_id_is_no_null(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(-(1 << 63), text), (None, text)], "doc_id long, text string")
    assert [r.n_removed for r in kept_words(df).collect()] == [40, 40]


def test_a_frequent_minimiser_is_split_exactly(spark):
    """Of 256 documents all hold one run of words that wins every window it is in, amid words of their own."""
    r = random.Random(4)
    hot = "the very same four words of all"
    rows = [(i, " ".join([f"u{r.random()}" for _ in range(40)]) + f" {hot} " + " ".join([f"v{r.random()}" for _ in range(40)])) for i in range(256)]
    rows += [(256, rows[0][1]), (257, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    deal = substrings.dealt(df, 35, 4, heavy=20000)
    assert len(deal.heavy) and deal.spread >= 8
    assert sorted(map(tuple, kept_words(df, heavy=20000).collect()), key=repr) == brute(rows, 35)


def test_copies_are_merged_as_they_come_in():
    import numpy as np

    own = substrings.Bucket(heavy=12)
    assert own.add(np.array([(1, 1, 0, 1, 0)], substrings.HEADER), b"a b c") is None
    known = own.add(np.array([(2, 2, 7, 1, 0), (3, 3, 0, 1, 0)], substrings.HEADER), b"a b c\nx y z")
    assert known["id"].tolist() == [1, 2]
    assert own.bodies == [b"a b c\nx y z"] and own.heads[0]["flags"].tolist() == [1, 0]


def test_long_texts_are_read_in_sections(spark):
    r = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(50))
    long = " ".join([f"w{r.random()}" for _ in range(300000)]) + f" {shared} " + " ".join([f"w{r.random()}" for _ in range(200000)])
    assert len(long) > 8 << 20
    rows = [(1, long), (2, f"x {shared} y")]
    out = {r.doc_id: r for r in kept_words(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    want = {i: (n, gone, sha) for i, n, gone, _, sha in brute(rows, 35)}
    assert {i: tuple(r)[1:] for i, r in out.items()} == want


def test_empty_table(spark):
    assert kept_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(substrings, "rolling", lambda values, n: values * substrings.U(0))
    import numpy as np

    head = np.array([(1, 1, 0, 2, 0), (2, 2, 5, 1, 0), (3, 3, 0, 1, 1)], substrings.HEADER)
    out = substrings.repeated(head, [b"a b c d", b"b c d", b"x y z"], 3)
    assert [x.tolist() for x in out[:4]] == [[1, 2], [1, 2], [1, 5], [1, 1]]
