"""Bounded samples of rows for fitting, and names that clash with no column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thinned(df: DataFrame, key: Column, want: int, count: int) -> DataFrame:
    """About four times want of count rows, chosen by a hash of key; all rows where there are no more.

    What is put in order and cut to want afterwards then comes to a few rows a
    task, however many tasks there are.
    """
    share = 4 * want / max(count, 1)
    if share >= 1:
        return df
    scale = 1 << 40
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < max(1, int(share * scale)))


def chosen(rows: DataFrame, names: list[Column], sample: int, size: int, count: int) -> list[int]:
    """Hashes of at most sample rows of rows(text, ...), of at most size bytes of text together.

    rows are told apart by names and text. They are taken whole, in order of
    their hash; a text that is too long for what is left of size is passed
    over. count is the number of rows.
    """
    h = F.xxhash64(*names, "text")
    few = thinned(rows, h, sample, count).select(h.alias("h"), F.octet_length("text").alias("n")).distinct().orderBy("h").limit(sample).collect()
    out, left = [], size
    for r in few:
        if (r.n or 0) <= left:
            out.append(r.h)
            left -= r.n or 0
    return out


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
