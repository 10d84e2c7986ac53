import random

import public_tokenizers
from tokenizers import Tokenizer

from chainloom.llm.tokencount import counter, may_cut, parts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library_on_whole_texts(spark):
    r = random.Random(1)
    bits = ["hello", " ", "  ", "\n", "\t ", "é", "don't", "12", "<|endoftext|>", "<|endof", "字", "😀", "a" * 30, " 'll"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["", None, "word " * 40000, "x" * 70000, ("a  b <|endoftext|> c\n d" * 9000)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 2), (0, texts[0], 3)]
    t = Tokenizer.from_file(PATH)
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for i, x, _ in rows), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, token_counts(df, PATH).collect()), key=repr) == want
    assert token_counts(df.limit(0), PATH).collect() == []


def test_parts_are_cut_where_pretokens_start():
    t = Tokenizer.from_file(PATH)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice([" ", "\n", "a", "é", "'s", "1", "!", "　"]) for _ in range(200))
        cut = parts(text, 20)
        assert "".join(cut) == text
        assert [x for p in cut for x in t.encode(p).ids] == t.encode(text).ids


def test_a_tokenizer_of_another_kind_takes_texts_whole():
    other = public_tokenizers.path("word_bpe_49k.json")
    assert may_cut(PATH) and not may_cut(other)
    text = "Don't  stop é12 " * 9000
    assert counter(other)([text]).tolist() == [len(Tokenizer.from_file(other).encode(text, add_special_tokens=False))]
