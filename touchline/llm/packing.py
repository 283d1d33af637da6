"""Packing token sequences into windows by non-negative least squares (operator 7).

A document is tokenised, ended with one id, and cut into whole windows and a rest.  The rests' lengths
make a histogram of at most ``window - 1`` counts, which is all that reaches the driver.  There, sets of
two or three lengths that fill a window exactly are enumerated, their repeat counts are solved against
the histogram by non-negative least squares and rounded, and what is left over is packed greedily, length by
length.  The plan (patterns of lengths and how often each occurs) goes back to the tasks, which place
every piece from its rank among the pieces of its length.

Nulls: a null text is empty and gives one piece, the end id; null and repeated ids each keep their own
pieces.  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .store import settle

WINDOW = 1024
END_ID = 0
RANK_BUCKETS = 64
#: Texts with a run of so many white-space characters are encoded from the JSON file of the vocabulary: the same ids, slower.
LONG_BLANK = 100_000
_BLANK = re.compile(r"\s+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    # the JSON file of the same vocabulary names the added tokens, which are cut out of a text before all else
    added = json.loads(Path(path).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})


@lru_cache(maxsize=2)
def _plain_encoding(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(str(Path(path).with_suffix(".json")))
    own.no_truncation()
    own.no_padding()
    return own


def long_blank(text: str, least: int = LONG_BLANK) -> bool:
    """Whether a text has a run of white space that is too long for the faster encoder's pattern, which looks back over it."""
    return len(text) >= least and any(m.end() - m.start() >= least for m in _BLANK.finditer(text))


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
    if not text:
        ids = np.zeros(0, np.uint32)
    elif long_blank(text):
        ids = np.array(_plain_encoding(path).encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = _encoding(path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


def _cut(path: str, window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(tb.column(batch, "text").to_pylist()):
                all_ids = token_ids(text, path)
                for at in range(0, len(all_ids), window):
                    piece = all_ids[at : at + window]
                    of.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(all_ids))
                    ids.append(piece.astype(np.int32) if keep_ids else None)
            columns = [tb.column(batch, c).take(pa.array(of, pa.int64())) for c in ("row", "id")]
            columns += [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    return run


# ---- the plan, from the histogram alone -------------------------------------------------------


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs of present lengths that fill a window, and for each length some triples with it."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [(window - a, a) for a in range(1, window // 2 + 1) if there[a] and there[window - a]]
    seen = set(out)
    for a in lengths.tolist():
        rest = window - a
        for b in sorted({rest // 2, rest // 3, rest // 4, rest // 5, 2 * rest // 5} - {0}):
            for b in (b, b + 1, b - 1):
                c = rest - b
                triple = tuple(sorted((a, b, c), reverse=True))
                if b > 0 and c > 0 and there[b] and there[c] and triple not in seen:
                    seen.add(triple)
                    out.append(triple)
                    break
    return out


def repeat_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often each combination should occur."""
    left = histogram.astype(float).copy()
    x = np.zeros(len(combos))
    parts = [np.unique(c, return_counts=True) for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, n) in enumerate(parts):
            step = max(float(left[at] @ n) / float(n @ n), -x[j])
            if abs(step) > 1e-6:
                x[j] += step
                left[at] -= step * n
                moved += abs(step)
        if moved < 0.5:
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, how many such sequences), using up the histogram exactly."""
    left = histogram.copy()
    combos = combinations(np.flatnonzero(left), window)
    x = np.rint(repeat_counts(combos, left)).astype(np.int64)
    out = []
    for j in np.argsort(-x, kind="stable"):
        at, n = np.unique(combos[j], return_counts=True)
        times = int(min(x[j], (left[at] // n).min()))
        if times > 0:
            left[at] -= n * times
            out.append((combos[j], times))
    while left.any():
        pattern, space, use = [], window, np.zeros_like(left)
        while True:
            fits = np.flatnonzero(left[: space + 1] > use[: space + 1])
            if not len(fits):
                break
            exact = _exact_pair(left - use, space) if len(pattern) else None
            for length in exact or (int(fits[-1]),):
                pattern.append(length)
                use[length] += 1
                space -= length
        at = np.flatnonzero(use)
        times = int((left[at] // use[at]).min())
        left[at] -= use[at] * times
        out.append((tuple(pattern), times))
    return out


def _exact_pair(left: np.ndarray, space: int) -> tuple[int, ...] | None:
    """One or two lengths at hand that fill the space exactly."""
    if space < len(left) and left[space] > 0:
        return (space,)
    a = np.arange(1, space // 2 + 1)
    good = (left[a] > 0) & (left[space - a] > 0) & ((2 * a != space) | (left[a] > 1))
    found = np.flatnonzero(good)
    return (int(space - a[found[0]]), int(a[found[0]])) if len(found) else None


def slots(patterns: list[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """For each length its slots in order of rank: first rank, first sequence and offset."""
    rows, used, sequence = [], np.zeros(window + 1, np.int64), 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _place(found: dict[str, np.ndarray]):
    wide = np.int64(1) << 40
    key = found["length"] * wide + found["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = tb.column(batch, "length").to_numpy(), tb.column(batch, "rank").to_numpy()
            at = np.searchsorted(key, length * wide + rank, side="right") - 1
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(2 * (found["sequence"][at] + rank - found["rank"][at]) + 1))
            yield out.append_column("offset", pa.array(found["offset"][at]))

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``keep_ids``, its ids.  Sequence ids are even for pieces that fill a window alone, else odd."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = "row long, id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    schema = T._parse_datatype_string(kind)
    schema["id"].dataType = docs.schema[doc_id].dataType
    pieces = settle(rows.mapInArrow(_cut(path, window, keep_ids), schema), "pieces")
    rest = pieces.filter(F.col("length") < window).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(RANK_BUCKETS)))
    counts = rest.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length below the window
        histogram[r["length"]] = r["n"]
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "start"))
    # at most (window - 1) * RANK_BUCKETS rows of three numbers
    ranked = rest.withColumn("number", number).join(F.broadcast(before), ["length", "bucket"])
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    ranked = ranked.select(*columns, (F.col("before") + F.col("number") - 1).alias("rank"))
    shape = T.StructType([*(pieces.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.mapInArrow(_place(slots(plan(histogram, window), window)), shape)
    full = pieces.filter(F.col("length") == window).select(*columns, (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed).withColumnRenamed("id", doc_id)
