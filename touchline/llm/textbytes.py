"""Vectorised scans over the UTF-8 bytes of many texts at once.

A ``Slice`` lays the texts of a few rows end to end, each followed by one newline, and answers
questions about words, lines and byte windows with numpy, whatever the number of rows.  Hashes are
64-bit polynomials over random byte values, finished with an avalanche step; two different strings
of one run agree by chance with probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Values of the 256 bytes, from a fixed seed.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return and blank.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial of the first i values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def per_row(flags_at: np.ndarray, row_start: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall into each row's range."""
    return np.searchsorted(flags_at, row_end) - np.searchsorted(flags_at, row_start)


def later(keys: np.ndarray) -> np.ndarray:
    """True for all but one of each group of equal keys."""
    order = np.argsort(keys)
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Slice:
    """A few rows' texts: ``buf`` holds them, row i at [start[i], end[i]), a newline at end[i]."""

    def __init__(self, texts: pa.Array, first: int):
        self.first, self.n = first, len(texts)
        raw, offsets = text_buffers(texts)
        self.buf = np.insert(raw, offsets[1:], 10) if self.n else raw
        self.start = offsets[:-1] + np.arange(self.n)
        self.end = offsets[1:] + np.arange(self.n)

    def words(self, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are no ASCII white space."""
        dark = np.zeros(len(self.buf) + 1, np.int8)
        dark[1:] = ~IS_SPACE[self.buf]
        edge = np.diff(dark)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row that holds each position."""
        return np.searchsorted(self.start, at, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines of all rows, in order."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.empty_like(ends)
        if len(ends):
            starts[0], starts[1:] = 0, ends[:-1] + 1
        return starts, ends


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null counts as empty."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if off is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(texts: pa.Array, most_bytes: int = 1 << 19) -> Iterator[Slice]:
    """Cut a column into runs of rows of about ``most_bytes``; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        floor = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, floor + most_bytes, side="right")))
        yield Slice(texts.slice(at, to - at), at)
        at = to


def scan_texts(df: DataFrame, text: str, measure: Callable[[Slice], dict[str, pa.Array]], schema: str, keep: bool = False) -> DataFrame:
    """``df`` with what ``measure`` finds for each row of a slice, and without the column ``text`` unless it is to be kept.

    ``schema`` lists the new columns; ``measure`` gives one Arrow array for each, a value for each row.
    """
    added = T._parse_datatype_string(schema)
    carried = [f for f in df.schema.fields if keep or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(column(batch, text)):
                found = measure(s)
                arrays = [column(batch, f.name).slice(s.first, s.n) for f in carried]
                yield pa.RecordBatch.from_arrays([*arrays, *(found[f.name] for f in added.fields)], names=[f.name for f in [*carried, *added.fields]])

    return df.mapInArrow(run, T.StructType([*carried, *added.fields]))
