import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from chainloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["hello", " ", "  ", "\n", "\t ", "é", "don't", "12", "<s>", "<unk>", "<0x41>", "字", "😀", "a" * 30, "▁", "ﬁ", "the", "ing"]


def texts():
    r = random.Random(1)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None, " ", " " * 300, "word " * 3000, "x" * 3000, "Ab9" * 500]


def test_ids_and_texts_equal_the_library(spark):
    own = texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [sp.encode(t or "") for t in own]
    rows = [(i, t, 5) for i, t in enumerate(own)] + [(None, "a b", 1), (0, own[0], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = P.encoded(df, PATH)
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and by[None][0].ids == sp.encode("a b") and len(by[0]) == 2
    for i, t in enumerate(own):
        assert by[i][0].ids == want[i] and by[i][0].n_pieces == len(want[i]) and by[i][0].round_trip
    back = {r.doc_id: r.text for r in P.decoded(out.where("doc_id > 0"), PATH).collect()}
    assert all(back[i] == sp.decode(want[i]) for i in range(1, len(own)))
    assert P.encoded(df.limit(0), PATH).collect() == []
    assert P.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text is None


def test_a_long_text_in_parts_has_the_ids_of_the_whole(spark):
    r = random.Random(3)
    text = "".join(r.choice([*BITS, "word ", "x; ", "die "]) for _ in range(300000))
    model, sp = P.Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for own, size in ((text[:40000], 500), (text[:3000], 1), (" a b  c", 2), ("", 5), ("字" * 900, 100)):
        cut = list(model.sections(pa.array([own]), size))
        assert b"".join(x[0].as_py() for x in cut).decode() == own
        assert [i for k, x in enumerate(cut) for i in model.encode(x, not k)[0].tolist()] == sp.encode(own)
    got = P.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert len(text.encode()) > P.BATCH / 2 and got.ids == sp.encode(text) and got.round_trip


def test_suffix_array_finds_every_occurrence():
    model = P.Model(vocabulary=[("a", 0), ("ab", 0), ("abababababab", 0), ("ababababababababababababab", 0), ("b▁", 0), ("▁a", 0)])
    data = np.frombuffer(b"ababababababababababababababab ab ba abababababab", np.uint8)
    key, piece = model.edges(data)
    text = data.tobytes()
    own = [p.encode().replace("▁".encode(), b" ") for p in ("a", "ab", "abababababab", "ababababababababababababab", "b▁", "▁a")]
    want = sorted((i * 512 + len(p), k) for k, p in enumerate(own) for i in range(len(text)) if text.startswith(p, i))
    assert list(zip(key.tolist(), piece.tolist(), strict=True)) == want and model.whole


def test_unigram_relaxation_finds_the_best_path():
    r = random.Random(2)
    pieces = {"a", "b", "c", "▁"} | {"".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(25)} | {"▁a", "▁bc"}
    vocabulary = [("<unk>", 0.0)] + [(p, -r.random() * 5 - len(p)) for p in sorted(pieces)]
    model = P.Model(vocabulary=vocabulary, bpe=False)
    scores = dict(vocabulary[1:])
    for _ in range(60):
        text = "".join(r.choice("abcd ") for _ in range(r.randint(1, 25)))
        ids, _ = model.encode(pa.array([text]))
        marked = ("▁" + text).replace(" ", "▁")
        floor = min(s for _, s in vocabulary) - 10
        best = [0.0] + [-1e18] * len(marked)
        for i in range(len(marked)):
            for j in range(i + 1, len(marked) + 1):
                s = scores.get(marked[i:j], floor if j == i + 1 else None)
                if s is not None:
                    best[j] = max(best[j], best[i] + s)
        total = sum(vocabulary[i][1] if i else floor for i in ids)
        assert abs(total - best[-1]) < 1e-6
