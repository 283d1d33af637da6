"""Removal of repeated byte strings with a suffix array sorted in two stages (operator 6).

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller id, or in the same document before.  No shuffle ever holds all suffixes:

1.  Every string of ``length`` bytes contains an anchor, the smallest hash of its ``GRAM``-byte
    grams, at the same place wherever it occurs.  Anchors meet by hash; one that stands alone takes
    part in no repeat.  Where an anchor's whole surroundings also stand earlier, all its strings do.
2.  The surroundings that are left, one for each different content, go to tasks by anchor, and each
    task builds the suffix array of what it has: suffixes smaller than their successors are sorted
    directly, the others follow by scans over the first-byte buckets, and adjacent common prefixes
    give the strings that are equal.  An anchor with more than ``LONG_GROUP`` different surroundings
    is dealt by longer pieces of them instead, which again every string of the piece shares.
3.  The spans found are merged for each document and cut out.

Nulls: a null text is empty; a null id comes after all others; repeated ids are told apart by the
order of the rows.  A ``docs`` that isn't a plain scan of files is written to the shared folder first, so
that its rows are numbered once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import fixed

GRAM = 32
#: Starts of strings that one finer piece serves.
STEP = 12
LONG_GROUP = 10_000
#: Bytes that one suffix array is built for, unless a single anchor's surroundings are more.
ARRAY_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max


# ---- the suffix array -------------------------------------------------------------------------


def words_at(text: np.ndarray, extra: int) -> np.ndarray:
    """For each position the next eight bytes as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(extra + 8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)


def sort_directly(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes."""
    key = word[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
    for k in range(8, depth, 8):
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(fresh)[where]
        sub = at[where]
        key = word[sub + k]
        order = np.lexsort((key, group))
        at[where] = sub[order]
        key = key[order]
        fresh[where[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return at


def suffix_array(text: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes, in the order of their first ``depth`` bytes at least, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    turn = np.full(n, n - 1)
    turn[:-1] = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = (turn < n - 1) & (text[turn] < text[np.minimum(turn + 1, n - 1)])  # smaller than its successor
    direct = sort_directly(np.flatnonzero(small), word, depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(text):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~small[before]]
        bucket.append(direct[cut[c] : cut[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        for piece, b in zip(np.split(before, edges[1:]) if len(first) else [], first[edges] if len(first) else [], strict=True):
            waiting[b].append(piece)
    return np.concatenate(out)


def adjacent_prefixes(order: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, ``depth`` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = word[order[live] + k] ^ word[order[live - 1] + k]
        ends = differ != 0
        stop, differ = live[ends], differ[ends]
        for b in range(7):
            out[stop] += (differ >> np.uint64(56 - 8 * b)) == 0
        live = live[~ends]
        out[live] += 8
    return np.minimum(out, depth)


def later_strings(text: np.ndarray, valid: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Valid starts whose string of ``length`` bytes also starts at a valid place of a smaller rank."""
    word = words_at(text, length + 8)
    order = suffix_array(text, word, length)
    run = np.cumsum(adjacent_prefixes(order, word, length) < length)
    keep = valid[order]
    order, run = order[keep], run[keep]
    by = np.lexsort((rank[order], run))
    order, run = order[by], run[by]
    first = np.searchsorted(run, run)
    return order[rank[order] > rank[order[first]]]


# ---- step 1: anchors --------------------------------------------------------------------------


def _nearest_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least value, the first of equals."""
    place = np.arange(len(h))
    done = 1
    while done < width:
        step = min(done, width - done)
        right = h[step:] < h[: len(h) - step]
        h = np.where(right, h[step:], h[: len(h) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        done += step
    return place


def anchors(s: tb.Slice, length: int) -> tuple[np.ndarray, ...]:
    """For each anchor of a slice: row, hash, hash of its surroundings, and offsets in its document of
    the first and the last string that it is the anchor of and of itself."""
    prefix = tb.prefix_hash(tb.BYTE_VALUE[s.buf])
    size = s.end - s.start
    many = np.maximum(size - length + 1, 0)  # strings of each document
    if not many.any():
        return tuple(np.zeros(0, np.uint64 if k in (1, 2) else np.int64) for k in range(6))
    at = np.arange(len(s.buf) - GRAM + 1)
    place = _nearest_least(tb.span_hash(prefix, at, at + GRAM), length - GRAM + 1)
    row = np.repeat(np.arange(s.n), many)
    start = s.start[row] + np.arange(many.sum()) - (np.cumsum(many) - many)[row]
    a = place[start]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(a)]]) - 1
    row, a, first, last = row[first], a[first], start[first], start[last]
    around = tb.mix(tb.span_hash(prefix, first, last + length) + (a - first).astype(np.uint64))
    base = s.start[row]
    return row, tb.span_hash(prefix, a, a + GRAM), around, first - base, last - base, a - base


def _find_anchors(length: int) -> Callable:
    """(row, doc, text) -> anchors.  Those whose surroundings stand earlier in the same slice are
    settled already (again) and only dealt evenly, so that common content doesn't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tb.column(batch, "row").to_numpy()
            docs = tb.column(batch, "doc").to_numpy()
            for s in tb.slices(tb.column(batch, "text")):
                found = anchors(s, length)
                order = np.lexsort((found[3], ids[s.first + found[0]], docs[s.first + found[0]], found[2], found[1]))
                row, h, around, first, last, a = (x[order] for x in found)
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (around[1:] == around[:-1])
                code = (first << 16) | ((last - first) << 8) | (a - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(again, tb.mix(ids[s.first + row].astype(np.uint64) * np.uint64(tb.BASE) + code.astype(np.uint64)), h).view(np.int64)),
                        pa.array(around.view(np.int64)),
                        pa.array(docs[s.first + row]),
                        pa.array(ids[s.first + row]),
                        pa.array(code),
                        pa.array(again),
                    ],
                    names=["h", "around", "doc", "row", "code", "again"],
                )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (h, around, doc, row, code) -> later anchors of equal surroundings (n = 0), and the
    first of each different surroundings where an anchor has several (n: how many)."""

    def groups(x: list[np.ndarray]) -> pa.RecordBatch:
        h, around, row, code, again = x
        known_row, known_code = row[again], code[again]
        h, around, row, code = (v[~again] for v in (h, around, row, code))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new = new_h.copy()
        new[1:] |= around[1:] != around[:-1]
        of = np.cumsum(new_h) - 1
        n = np.where(new, np.bincount(of[new])[of] if len(of) else 0, 0)
        keep = n != 1
        row, code, n = np.concatenate([row[keep], known_row]), np.concatenate([code[keep], known_code]), np.concatenate([n[keep], np.zeros(len(known_row), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(code), pa.array(n.astype(np.int32))], names=["row", "code", "n"])

    rest: list | None = None
    for batch in batches:
        now = [tb.column(batch, c).to_numpy(zero_copy_only=False) for c in ("h", "around", "row", "code", "again")]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if whole:
            yield groups([x[:whole] for x in now])
        rest = [x[whole:] for x in now]
    if rest is not None and len(rest[0]):
        yield groups(rest)


# ---- step 2: surroundings and their suffix arrays ---------------------------------------------


def pack_text(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + (pa.compress(text, codec="zstd", asbytes=True) if text else b"")


def unpack_text(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], n, codec="zstd", asbytes=True) if n else b""


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack_text(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in tb.column(batch, "text").cast(pa.binary())]
        yield batch.drop_columns(["text"]).append_column("packed", pa.array(packed, pa.binary()))


def _gather(data: np.ndarray, b: np.ndarray, e: np.ndarray) -> pa.Array:
    """data[b:e] for each span, as a binary column."""
    size = e - b
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(b)), size)
    joined = data[b[of] + np.arange(len(of)) - (ends - size)[of]] if len(of) else data[:0]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.tobytes())])


def _surroundings(length: int, long_group: int) -> Callable:
    """Documents and their anchors -> surroundings to compare, and spans already known to go (no piece)."""

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [unpack_text(x) for x in tb.column(batch, "packed").to_pylist()]
        data = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0, *map(len, texts)])
        found = tb.column(batch, "found")
        of = np.repeat(np.arange(len(batch)), pc.list_value_length(found).to_numpy())
        code, n = (found.flatten().field(k).to_numpy() for k in (0, 1))
        b = code >> 16
        last, anchor = b + ((code >> 8) & 255), b + (code & 255)
        ids, docs = tb.column(batch, "row").to_numpy(), tb.column(batch, "doc").to_numpy()
        prefix = tb.prefix_hash(tb.BYTE_VALUE[data])

        def out(key: np.ndarray, of: np.ndarray, b: np.ndarray, e: np.ndarray, anchor: np.ndarray, with_bytes: bool) -> pa.RecordBatch:
            piece = _gather(data, base[of] + b, base[of] + e) if with_bytes else pa.nulls(len(of), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(docs[of]), pa.array(ids[of]), *(pa.array(x.astype(np.int32)) for x in (b, e, anchor)), piece],
                names=["key", "doc", "row", "b", "e", "anchor", "piece"],
            )

        k = np.flatnonzero(n == 0)
        order = k[np.lexsort((b[k], of[k]))]
        gone, to, whose = b[order], last[order] + length, of[order]
        if len(order):
            new = np.concatenate([[True], (whose[1:] != whose[:-1]) | (gone[1:] > to[:-1])])
            ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(order) - 1]])
            key = tb.mix(ids[whose[new]].astype(np.uint64) * np.uint64(tb.BASE) + gone[new].astype(np.uint64))
            yield out(key, whose[new], gone[new], to[ends], gone[new], False)
        k = np.flatnonzero((n > 0) & (n <= long_group))
        if len(k):
            at = base[of[k]] + anchor[k]
            yield out(tb.span_hash(prefix, at, at + GRAM), of[k], b[k], last[k] + length, anchor[k], True)
        k = np.flatnonzero(n > long_group)
        for c in range(0, length - GRAM + 1, STEP):  # finer: strings that start c to c + STEP - 1 bytes before the anchor
            lo, hi = np.maximum(b[k], anchor[k] - c - STEP + 1), np.minimum(last[k], anchor[k] - c)
            has = lo <= hi
            j, lo, hi = k[has], lo[has], hi[has]
            if len(j):
                core = base[of[j]] + anchor[j] - c
                yield out(tb.span_hash(prefix, core, core - STEP + 1 + length), of[j], lo, hi + length, anchor[j], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield from pieces(batch.slice(at, 256))

    return run


def merge(b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not len(b):
        return b, e
    order = np.argsort(b, kind="stable")
    b, e = b[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], b[1:] > e[:-1]])
    return b[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]


def _promising(text: np.ndarray, cut: np.ndarray, size: np.ndarray, anchor: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Pieces that share with another of their key what any of their strings would have to share."""
    prefix = tb.prefix_hash(tb.BYTE_VALUE[text])
    keep = np.zeros(len(cut), bool)
    for c in range(0, length - GRAM + 1, STEP):
        lo, hi = np.maximum(0, anchor - c - STEP + 1), np.minimum(size - length, anchor - c)
        has = np.flatnonzero(lo <= hi)
        core = cut[has] + anchor[has] - c
        h = tb.span_hash(prefix, core, core - STEP + 1 + length)
        keep[has[tb.repeated(h ^ tb.mix(key[has].view(np.uint64)))]] = True
    return keep


def _compare(length: int, array_bytes: int) -> Callable:
    """Pieces sorted by key -> spans of strings that also start earlier; known spans pass."""

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bare = pc.is_null(table.column("piece"))
        yield from table.filter(bare).select(["row", "b", "e"]).to_batches()
        table = table.filter(pc.invert(bare))
        if len(table):
            yield compare(parts(table))

    def compare(x: list) -> pa.RecordBatch:
        key, doc, row, b, anchor, piece = x
        data, off = tb.text_buffers(piece)
        cut, size = off[:-1], np.diff(off)
        kept = np.flatnonzero(_promising(data, cut, size, anchor - b, key, length))
        data, off = tb.text_buffers(piece.take(pa.array(kept)))
        key, doc, row, b = key[kept], doc[kept], row[kept], b[kept]
        cut, size = off[:-1], np.diff(off)
        of = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(data)) - cut[of]
        place = b[of] + inside
        valid = inside + length <= size[of]
        # the same place can lie in the pieces of two anchors: it has one rank
        v = np.flatnonzero(valid)
        v = v[np.lexsort((place[v], row[of[v]], doc[of[v]]))]
        rank = np.zeros(len(data), np.int64)
        rank[v[1:]] = np.cumsum((place[v[1:]] != place[v[:-1]]) | (row[of[v[1:]]] != row[of[v[:-1]]]))
        gone = later_strings(data, valid, rank, length)
        gone = gone[np.lexsort((place[gone], row[of[gone]]))]
        r, p = row[of[gone]], place[gone]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] > p[:-1] + length)]) if len(r) else np.zeros(0, bool)
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(r) - 1]]) if len(r) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(r[new]), pa.array(p[new].astype(np.int32)), pa.array((p[last] + length).astype(np.int32))], names=["row", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= array_bytes:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield from spans(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held) if whole else 0
        if held:
            yield from spans(pa.Table.from_batches(held))

    def parts(table: pa.Table) -> list:
        piece = table.column("piece").combine_chunks()
        return [*(table.column(c).to_numpy() for c in ("key", "doc", "row")), *(table.column(c).to_numpy().astype(np.int64) for c in ("b", "anchor")), piece.chunk(0) if isinstance(piece, pa.ChunkedArray) else piece]

    return run


# ---- step 3: cut out --------------------------------------------------------------------------


def cut_out(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the maximal runs removed."""
    if not spans:
        return text, 0, 0
    b, e = merge(*np.array(spans, np.int64).reshape(-1, 2).T)
    parts, at = [], 0
    for x, y in zip(b.tolist(), e.tolist(), strict=True):
        parts.append(text[at:x])
        at = y
    return b"".join([*parts, text[at:]]), int((e - b).sum()), len(b)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, spans = tb.column(batch, "packed").to_pylist(), tb.column(batch, "spans").to_pylist()
        full = [unpack_text(x) for x in packed]
        left = [cut_out(x, [(y["b"], y["e"]) for y in s or []]) for x, s in zip(full, spans, strict=True)]
        out = batch.drop_columns(["packed", "spans"])
        for name, kind, values in (
            ("n_bytes", pa.int64(), [len(x) for x in full]),
            ("n_removed", pa.int64(), [x[1] for x in left]),
            ("n_spans", pa.int64(), [x[2] for x in left]),
            ("kept_sha256", pa.string(), [hashlib.sha256(x[0]).hexdigest() for x in left]),
            ("kept", pa.binary(), [x[0] for x in left]),
        ):
            out = out.append_column(name, pa.array(values, kind))
        yield out


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 100, long_group: int = LONG_GROUP, array_bytes: int = ARRAY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(row, doc, text) of ``docs`` and the spans (row, b, e) of bytes to remove; spans may overlap."""
    docs = fixed(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("doc"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(_find_anchors(length), "h long, around long, doc long, row long, code long, again boolean")
    met = found.repartition("h").sortWithinPartitions("h", "around", "doc", "row", "code").mapInArrow(_meet, "row long, code long, n int")
    by_row = met.groupBy("row").agg(F.collect_list(F.struct("code", "n")).alias("found"))
    packed = rows.mapInArrow(_pack, "row long, doc long, packed binary")
    pieces = packed.join(by_row, "row").mapInArrow(_surroundings(length, long_group), "key long, doc long, row long, b int, e int, anchor int, piece binary")
    spans = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length, array_bytes), "row long, b int, e int")
    return packed, spans


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 100, long_group: int = LONG_GROUP, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """One row for each row of ``docs``: its id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left)."""
    packed, spans = repeated_spans(docs, text, doc_id, length, long_group, array_bytes)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("b", "e")).alias("spans"))
    cut = packed.join(by_row, "row", "left").select("doc", "packed", "spans").mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
