import hashlib
import random

from chainloom.llm.chat import END, START, digests, formatted, parsed
from pyspark.sql import functions as F

BITS = ["<|im_end|>", "<|im_start|>", "\n", "<|im_end|>\n", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>", "<|", "|>", "\\", "a", "é😀", " ", "$1", "<|n|>"]


def test_every_text_comes_back_and_the_mask_holds_the_assistant_texts(spark):
    r = random.Random(6)
    some = lambda: r.choice([None, "", "".join(r.choice(BITS) for _ in range(r.randint(0, 7)))])
    rows = []
    for c in [*range(40), None, -1]:
        for turn in range(r.randint(1, 6)):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "assistant", "system", "assistant", "", None, "a\nb", "<|n|>", "x<|im_end|>\n"]), some(), "clash"))
    rows += [rows[3], rows[3], (77, 0, "user", "long " * 20000 + "<|im_end|>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, out string")
    chats = formatted(df)
    want = {}
    key = lambda x: tuple((v is not None, v if v is not None else 0) if i == 0 else v for i, v in enumerate(x))
    for c, turn, role, text, _ in rows:
        want.setdefault(c, []).append((turn, role or "", text or ""))
    got = {x.conv_id: x for x in chats.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort(key=key)
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for _, role, text in turns]
        text = got[c].formatted
        for t in got[c].turns:
            assert START not in t.body and END not in t.body
        mask = [text[s.start : s.start + s.n] for s in got[c].loss]
        assert mask == [t.body for t in got[c].turns if t.role == "assistant"]
    for x in digests(chats).collect():
        turns = want[x.conv_id]
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert x.formatted_chars == len(got[x.conv_id].formatted)
    assert formatted(df.limit(0)).collect() == []


def test_plain_texts_are_not_changed_and_bad_strings_are_not_parsed(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <| b"), (1, 1, "assistant", "c")], "conv_id long, turn int, role string, text string")
    assert formatted(df).first().formatted == f"{START}user\na <| b{END}\n{START}assistant\nc{END}\n"
    bad = ["x", f"{START}user{END}\n", f"{START}user\n{START}{END}\n", f"{START}user\na{END}", f"user\na{END}\n"]
    out = spark.createDataFrame([(b,) for b in bad], "f string").select(parsed(F.col("f")).alias("t")).collect()
    assert [x.t for x in out] == [None] * len(bad)


def test_what_is_learnt_lies_where_the_mask_says(spark):
    df = spark.createDataFrame([(1, 0, "user", "a question, long enough"), (1, 1, "assistant", "yes <|im_end|> it is"), (1, 2, "assistant", "")], "conv_id long, turn int, role string, text string")
    chats = formatted(df)
    moved = chats.withColumn("loss", F.transform("loss", lambda s: s.withField("start", s["start"] - 3)))
    a, b = digests(chats).first(), digests(moved).first()
    assert a.loss_sha256 == hashlib.sha256(b"yes <|im_end|> it is").hexdigest() and b.loss_sha256 != a.loss_sha256
