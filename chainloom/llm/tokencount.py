"""Token counts: batches of an Arrow function, balanced by bytes, that give lengths only.

A long text is cut before a space that stands between two characters other
than white space. The byte-level pattern starts a new pretoken there, whatever
follows, and no special string holds a space, so the counts of the parts add
up to the count of the text. A tokenizer of another kind takes texts whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.text import bounded, pieces, raw

#: Bytes of a part of a long text, and of a batch that is encoded at once.
PART, BATCH = 1 << 16, 1 << 19


def length(text: str) -> int:
    """Bytes of a text."""
    return len(text) if text.isascii() else len(text.encode())


def parts(text: str, size: int = PART) -> list[str]:
    """text, cut into parts of about size bytes at safe boundaries."""
    total = length(text)
    if total <= size:
        return [text]
    step = max(1, size * len(text) // total)
    safe, out, at = re.compile(r"(?<=\S) (?=\S)"), [], 0
    while len(text) - at > step:
        cut = safe.search(text, at + step)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def may_cut(tokenizer_path: str) -> bool:
    """Whether a tokenizer starts anew at such a space: byte-level by its own pattern, texts unchanged, no space in a special string."""
    with open(tokenizer_path, encoding="utf-8") as f:
        own = json.load(f)
    before = own.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    return bool(plain and not own.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in own.get("added_tokens", [])))


def counter(tokenizer_path: str):
    """A function from an iterator of texts to the list of their token counts."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    cut = parts if may_cut(tokenizer_path) else lambda text: [text]

    def count(texts: list[str]) -> np.ndarray:
        totals, batch, owners, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            for owner, e in zip(owners, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                totals[owner] += len(e)
            batch.clear(), owners.clear()

        for i, text in enumerate(texts):
            for part in cut(text):
                n = length(part)
                if batch and size + n > BATCH:
                    flush()
                    size = 0
                batch.append(part)
                owners.append(i)
                size += n
        if batch:
            flush()
        return totals

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    A null or empty text has no bytes and no tokens; a null doc_id stays null;
    repeated rows stay repeated; an empty table gives an empty table; other
    columns are not looked at, whatever their names. tokenizer_path must exist
    on every executor.
    """

    def count(batches):
        of = counter(tokenizer_path)
        for batch in pieces(batches, "text", 4 << 20):
            n = of([t or "" for t in batch.column("text").to_pylist()])
            size = np.diff(raw(batch.column("text"))[1])
            yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
