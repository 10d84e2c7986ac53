import random

import corpus_pipeline as P
from chainloom.llm.nearcopies import near_copies

DOCS = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(rows):
    """Ids that stay: brute force over all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min(g) for g in groups.values())


def edited(r, text, words, n):
    parts = text.split(" ")
    for _ in range(n):
        parts[r.randrange(len(parts))] = r.choice(words)
    return " ".join(parts)


def test_the_stage_finds_all_pairs_of_jaccard_four_fifths(spark):
    r = random.Random(8)
    words = ["wort%d" % i for i in range(400)]
    common = " ".join(r.choice(words) for _ in range(40))
    texts = ["", "a b", "A  b", "a b c"]
    for k in range(60):
        base = " ".join(r.choice(words) for _ in range(r.randint(6, 150)))
        texts += [base if k % 3 else base + " " + common, *(edited(r, base, words, r.randint(1, 5)) for _ in range(3))]
    texts += [common + f" {a} {b}" for a in words[:20] for b in ("x y z u v w", "q r s t o p")]
    hot = " ".join(r.choice(words) for _ in range(120))
    texts += [edited(r, hot, words, r.randint(0, 4)) for _ in range(150)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = P.near(spark, spark.createDataFrame(rows, DOCS), "").collect()
    want = kept(rows)
    assert len(want) < len(rows) - 100
    assert sorted(x.doc_id for x in got) == want


def test_an_empty_table_and_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (None, "alone here")], DOCS)
    assert sorted((x.doc_id is None, x.text) for x in near_copies(docs).collect()) == [(False, "A b c d e f"), (True, "alone here")]
    assert near_copies(docs.limit(0)).collect() == []
