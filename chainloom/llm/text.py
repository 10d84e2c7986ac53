"""Words of whole texts, found in a batch of documents at once with numpy.

A batch is handled in pieces of a bounded number of bytes; a single text that
is longer makes a piece of its own, which is read in sections.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
#: Odd multiplier of the polynomial hashes, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


#: Bytes of a record batch that Spark hands over, if the session has Spark's own default.
HANDED, DEFAULT = "8m", "67108864b"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose record batches are small enough for long texts; a setting of the user's own stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, DEFAULT) == DEFAULT:
        conf.set(key, HANDED)
    return df


def pieces(batches, column: str, limit: int):
    """Slices of the record batches with at most limit bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes unchanged."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


class Words:
    """The words of a piece.

    text: their bytes, each word followed by one space; start and end: where
    word i lies in it; first: of document d, words first[d] to first[d + 1];
    begin: where word i began in the piece.
    """

    def __init__(self, array: pa.Array | None, table: np.ndarray, lower: bool = False, data: np.ndarray | None = None):
        """Of an array of texts, or of the bytes of one text."""
        data, offsets = raw(array) if data is None else (data, np.array([0, len(data)]))
        if lower:
            data = lowered(data)
        n = len(data)
        word = table[data]
        breaks = np.zeros(n + 1, bool)
        breaks[offsets] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, word
        starts = np.flatnonzero(word & (~before[:-1] | breaks[:-1]))
        after = np.zeros(n + 1, bool)
        after[:-1] = word
        ends = np.flatnonzero(word & (~after[1:] | breaks[1:])) + 1
        sizes = ends - starts
        self.begin = starts
        self.count = len(starts)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.text = np.full(int(self.end[-1]) + 1 if self.count else 0, 0x20, np.uint8)
        gaps = np.ones(len(self.text), bool)
        gaps[self.end] = False
        self.text[gaps] = data[word]
        self.first = np.searchsorted(starts, offsets)
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        return mixed(spans(self.text, self.start, self.end))


#: Bytes of a text from which it is read in sections, and of a section.
LONG, SECTION = 8 << 20, 4 << 20


def is_long(batch: pa.RecordBatch, column: str = "text") -> bool:
    """Whether a piece is one text that has to be read in sections."""
    return batch.num_rows == 1 and (pc.binary_length(batch.column(column))[0].as_py() or 0) > LONG


def sections(array: pa.Array, table: np.ndarray, lower: bool = False, overlap: int = 0, size: int = SECTION):
    """The words of an array of one text in sections: (number of the first word, words that the section before held too, Words).

    A section starts overlap words before the end of the one before, so every
    run of overlap + 1 words lies in one of them; each but the last has more
    words than overlap. No word is cut.
    """
    data, _ = raw(array)
    begin = end = base = held = 0
    while True:
        while True:
            end = min(end + size, len(data))
            while end < len(data):  # on to the end of the word
                gap = np.flatnonzero(~table[data[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, len(data))
            w = Words(None, table, lower, data[begin:end])
            if w.count > overlap or end == len(data):
                break
        yield base, held, w
        if end == len(data):
            return
        held = overlap
        base += w.count - held
        begin = begin + int(w.begin[w.count - held]) if held else end


#: Values whose sums are taken at once.
RUN = 1 << 16


def _powers(base: int) -> np.ndarray:
    p = np.full(RUN, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(BASE), _powers(INVERSE)


def _scaled(low: np.ndarray, places: np.ndarray, base: int) -> np.ndarray:
    """base**place of each place, low being the powers below RUN."""
    high = np.full(int(places.max(initial=0)) // RUN + 1, pow(base, RUN, 1 << 64), U)
    high[0] = 1
    return low[places % RUN] * np.multiply.accumulate(high)[places // RUN]


def _sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of (value + 1) * BASE**i over i < place, for places in order; of bounded memory but for the result."""
    out, carry, scale, step = np.zeros(len(places), U), U(0), 1, pow(BASE, RUN, 1 << 64)
    for at in range(0, len(values), RUN):
        part = values[at : at + RUN].astype(U)
        part += U(1)
        part *= _UP[: len(part)]
        np.cumsum(part, out=part)
        part *= U(scale)
        lo, hi = np.searchsorted(places, (at + 1, at + RUN + 1))
        out[lo:hi] = part[places[lo:hi] - at - 1] + carry
        carry += part[-1]
        scale = scale * step % (1 << 64)
    return out


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, wherever it lies; starts and ends must be in order."""
    with np.errstate(over="ignore"):
        return (_sums(values, end) - _sums(values, start)) * _scaled(_DOWN, start, INVERSE)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of h affect all bits of the result."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h
