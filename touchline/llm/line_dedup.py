"""Line dedup with a segment-partition edit join (operator 2).

Lines of at least ``min_chars`` characters that differ by at most ``edits`` insertions, deletions or
substitutions are one class, and so is whatever such links connect; the first line of each class (by
id of the document, then place) stays and the others go.  A line is split into ``edits + 1`` segments,
one of which survives whole in any line that near.  Each different line posts its segments under its length,
and probes, for its own and each shorter length that is near enough, the few substrings that a
surviving segment could be.  Lines that meet and whose character counts allow it are verified with
a banded bit-parallel edit distance, many pairs at a time.  Lines of a key with more than ``FEW`` of them bring
their texts, are dealt out in blocks of at most about ``block`` lines that meet two by two, and leave a forest
of confirmed links, fewer than the lines that met: no task holds all lines of one key, and none emits its pairs.

Shorter lines stay.  A document all of whose lines go keeps an empty text; ``drop_empty`` drops it.
Nulls: a null text stays null; a null id comes after all others; repeated rows are later copies.
A ``docs`` that isn't a plain scan of files is written to the shared folder first, so that its rows are numbered once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .components import components
from .store import fixed, forget, settle

EDITS = 2
MIN_CHARS = 24
#: Kinds of characters that are counted, modulo 8, to rule out pairs before they are compared.
BAG = 9
#: The lowest bit of a note above the counts; from here on it tells the side of a line whose key is of two blocks.
SIDE = 2 + 3 * BAG
#: Lines of a key that give pairs; those of a key with more are connected by links that are confirmed where they meet.
FEW = 64
#: Lines of a key that are compared in one task, about, and their bytes; a key with more is cut into blocks.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
_LAST = np.iinfo(np.int64).max
_U = np.uint64


# ---- edit distance ----------------------------------------------------------------------------


def near(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    """Which pairs of code point arrays are within ``edits`` of each other."""
    out = np.zeros(len(pairs), bool)
    todo = []
    for k, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > edits:
            continue
        n = len(b)
        same = np.flatnonzero(a[:n] != b)
        lead = int(same[0]) if len(same) else n
        a, b = a[lead:], b[lead:]
        n = len(b)
        same = np.flatnonzero(a[len(a) - n :][::-1] != b[::-1])
        trail = int(same[0]) if len(same) else n
        a, b = a[: len(a) - trail], b[: n - trail]
        if len(b) <= edits:
            out[k] = _small(a, b) <= edits
        else:
            todo.append((k, a, b))
    todo.sort(key=lambda x: len(x[2]))
    for at in range(0, len(todo), 512):
        part = todo[at : at + 512]
        out[[k for k, _, _ in part]] = _banded([a for _, a, _ in part], [b for _, _, b in part], edits)
    return out


def _small(a: np.ndarray, b: np.ndarray) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def _banded(longer: list[np.ndarray], shorter: list[np.ndarray], edits: int) -> np.ndarray:
    """Bit-parallel columns of a band of ``2 * edits + 1`` cells; bit 63 is the band's lowest cell."""
    m, n = (np.array([len(x) for x in side]) for side in (longer, shorter))
    width = int(m.max()) + 2 * edits + 1
    a = np.full((len(m), width), -1, np.int64)
    b = np.full((len(n), int(n.max())), -2, np.int64)
    for k, (x, y) in enumerate(zip(longer, shorter, strict=True)):
        a[k, edits : edits + len(x)] = x
        b[k, : len(y)] = y
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    top = _U(1) << _U(63)
    up = np.full(len(m), ~_U(0) << _U(63 - edits), _U)
    down = np.zeros(len(m), _U)
    score = np.full(len(m), edits, np.int64)
    for j in range(len(b)):
        match = np.zeros(len(m), _U)
        for d in range(2 * edits + 1):
            match |= (a[min(j + d, width - 1)] == b[j]).astype(_U) << _U(63 - 2 * edits + d)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(diagonal | up), diagonal & up
        live = j < n
        slant = j < m - edits  # the lowest cell still goes down the diagonal, later along the last row
        bit = np.where(slant, 0, np.clip(62 - (j - np.maximum(m - edits, 0)), 0, 63)).astype(_U)
        step = np.where(slant, ((diagonal & top) == 0).astype(np.int64), ((right >> bit) & _U(1)).astype(np.int64) - ((left >> bit) & _U(1)).astype(np.int64))
        score += np.where(live, step, 0)
        moved = diagonal >> _U(1)
        up, down = left | ~(moved | right), moved & right
    return score <= edits


# ---- scans ------------------------------------------------------------------------------------


class Lines:
    """The long enough lines of a slice, as spans of code points."""

    def __init__(self, s: tb.Slice, min_chars: int):
        self.points = np.frombuffer(s.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(self.points == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        row = s.row_of(s.lines()[0])
        number = np.arange(len(row)) - np.searchsorted(row, row)
        keep = ends - starts >= min_chars
        self.start, self.end, self.row, self.number = starts[keep], ends[keep], row[keep], number[keep]
        self.size = self.end - self.start
        self.prefix = tb.prefix_hash(tb.mix(self.points.astype(_U) + _U(1)) | _U(1))
        self.hash = tb.span_hash(self.prefix, self.start, self.end) if len(self.start) else np.zeros(0, _U)


def _occurrences(min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tb.slices(tb.column(batch, "text")):
                x = Lines(s, min_chars)
                of = pa.array(s.first + x.row)
                yield pa.RecordBatch.from_arrays([tb.column(batch, "row").take(of), tb.column(batch, "doc").take(of), pa.array(x.number.astype(np.int32)), pa.array(x.hash.view(np.int64))], names=["row", "doc", "number", "line"])

    return run


def segments(size: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of given sizes; the last ones are the longer."""
    base, more = size // (edits + 1), size % (edits + 1)
    short = edits + 1 - more
    return i * base + np.maximum(i - short, 0), base + (i >= short)


def posts(x: Lines, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line index, key, role): role 1 posts a segment, 2 probes, 3 does both."""
    out = []
    for less in range(edits + 1):
        size = x.size - less
        for i in range(edits + 1):
            start, length = segments(size, edits, i)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = start + shift
                k = np.flatnonzero((at >= 0) & (at + length <= x.size))
                h = tb.span_hash(x.prefix, x.start[k] + at[k], x.start[k] + at[k] + length[k])
                key = tb.mix(h + (size[k] * (edits + 1) + i).astype(_U) * _U(tb.BASE))
                out.append((k, key, np.full(len(k), 3 if less == shift == 0 else 2)))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _post(min_chars: int, edits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tb.slices(tb.column(batch, "text")):
                x = Lines(s, min_chars)
                first = np.flatnonzero(~tb.later(x.hash))
                x.start, x.end, x.size, x.hash = x.start[first], x.end[first], x.size[first], x.hash[first]
                bag = np.zeros(len(first), np.int64)
                kind = x.points % BAG
                for c in range(BAG):
                    count = np.concatenate([[0], np.cumsum(kind == c)])
                    bag |= ((count[x.end] - count[x.start]) & 7) << (3 * c)
                k, key, role = posts(x, edits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x.hash[k].view(np.int64)), pa.array((bag[k] << 2 | role).astype(np.int32))], names=["key", "line", "note"])

    return run


def _allowed(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """Which notes allow a link: one side posts what the other probes, and no count of characters rules it out."""
    ok = ((x & 1) & (y >> 1 & 1)) | ((y & 1) & (x >> 1 & 1))
    apart = np.zeros(np.broadcast(x, y).shape, np.int64)
    for c in range(BAG):
        d = ((x >> (2 + 3 * c)) - (y >> (2 + 3 * c))) & 7
        apart += np.minimum(d, 8 - d)
    met = (x >> SIDE != y >> SIDE) | (x >> SIDE == 0)
    return (ok == 1) & met & (apart <= 2 * edits)


def _meet(edits: int, block: int) -> Callable:
    """Posts sorted by key, line -> pairs of different lines whose counts of characters allow a link; key is null there.

    The posts of a key with more than ``block`` lines pass through as (line, line, key, note) instead.
    """

    def once(key: np.ndarray, line: np.ndarray, note: np.ndarray) -> list[np.ndarray]:
        # a line may come from many tasks, and may probe and post at one key
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])]))
        return [key[at], line[at], np.bitwise_or.reduceat(note, at)]

    def pairs(key: np.ndarray, line: np.ndarray, note: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([cut, [len(key)]]))
        each = np.repeat(size, size)
        left, right = [], []
        for d in range(1, min(32, int(size.max()))):
            i = np.flatnonzero((each[:-d] <= 32) & (key[:-d] == key[d:]))
            i = i[_allowed(note[i], note[i + d], edits)]
            left.append(i)
            right.append(i + d)
        for c, n in zip(cut[size > 32], size[size > 32], strict=True):
            for i in range(c, c + n - 1):
                j = i + 1 + np.flatnonzero(_allowed(note[i], note[i + 1 : c + n], edits))
                left.append(np.full(len(j), i))
                right.append(j)
        a, b = (line[np.concatenate(x)] if x else line[:0] for x in (left, right))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int64()), pa.nulls(both.shape[1], pa.int32())], names=["a", "b", "key", "note"])

    def posts_of(key: np.ndarray, line: np.ndarray, note: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(line), pa.array(line), pa.array(key), pa.array(note)], names=["a", "b", "key", "note"])

    def split(now: list[np.ndarray], passing: bool) -> Iterator[pa.RecordBatch]:
        """Whole keys; the first one only passes through where its earlier posts did."""
        key = now[0]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([cut, [len(key)]]))
        long = size > block
        long[0] |= passing
        long = np.repeat(long, size)
        for take, give in ((~long, pairs), (long, posts_of)):
            if take.any():
                yield give(*(x[take] for x in now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passing = None, None  # passing: the key whose posts pass through
        for batch in batches:
            now = [tb.column(batch, c).to_numpy() for c in ("key", "line", "note")]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            now = once(*now)
            last = now[0][-1]
            whole = int(np.searchsorted(now[0], last))
            if whole:
                yield from split([x[:whole] for x in now], now[0][0] == passing)
            rest = [x[whole:] for x in now]
            if len(rest[0]) > block or last == passing:
                yield posts_of(*rest)
                rest, passing = [x[:0] for x in rest], last
        if rest is not None and len(rest[0]):
            yield from split(rest, rest[0][0] == passing)

    return run


_POSTS = "a long, b long, key long, note int"


def _sorted_out(posted: DataFrame, edits: int, few: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) that meet at keys of up to ``few`` lines, the posts (key, line, note) of other keys, and the table of both."""
    found = settle(posted.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_meet(edits, few), _POSTS), "line-meetings")
    long = found.filter("key IS NOT NULL").groupBy("key", F.col("a").alias("line")).agg(F.bit_or("note").alias("note"))
    return found.filter("key IS NULL").select("a", "b"), long, found


def _dealt(long: DataFrame, block: int) -> DataFrame:
    """``long`` with a new key for each two blocks of an old one: lines in the same block meet there, or those of two."""
    # blocks of half the size, so that two of them fit in one comparison; the key of two blocks is a hash of their numbers
    room = F.count("*") / (block // 2)
    if "text" in long.columns:
        room = F.greatest(room, F.sum(F.octet_length("text")) / (BLOCK_BYTES // 2))
    blocks = long.groupBy("key").agg(F.ceil(room).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("line"), F.col("blocks"))
    dealt = long.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0)  # two blocks: only lines of different sides
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(key.alias("key"), "line", F.col("note").bitwiseOR(F.shiftleft(side, SIDE)).alias("note"), *(c for c in long.columns if c == "text"))


def _met(posted: DataFrame, edits: int, block: int) -> DataFrame:
    """Pairs (a, b) of lines that meet at a key, each once; ``dedup_lines`` confirms those of long keys where they meet."""
    pairs, long, _ = _sorted_out(posted, edits, block)
    between = _dealt(long, block).repartition("key").sortWithinPartitions("key", "line").mapInArrow(_meet(edits, _LAST), _POSTS).select("a", "b")
    return settle(pairs.unionByName(between).distinct(), "line-pairs")


def forest(note: np.ndarray, points: list[np.ndarray], edits: int) -> list[tuple[int, int]]:
    """Links that connect whatever links connect among these lines: less of them than lines, all confirmed."""
    label = np.arange(len(note))
    out: list[tuple[int, int]] = []

    def confirm(left: list[np.ndarray], right: list[np.ndarray]) -> None:
        i, j = np.concatenate(left), np.concatenate(right)
        for at in range(0, len(i), 1024):  # pairs that came to be connected meanwhile aren't compared
            x, y = i[at : at + 1024], j[at : at + 1024]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            for k in np.flatnonzero(near([(points[p], points[q]) for p, q in zip(x, y, strict=True)], edits)):
                p, q = label[x[k]], label[y[k]]
                if p != q:
                    label[label == max(p, q)] = min(p, q)
                    out.append((int(x[k]), int(y[k])))

    left, right, waiting = [], [], 0
    for i in range(len(note) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[_allowed(note[i], note[j], edits)]
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j)
            waiting += len(j)
        if waiting >= 4096:
            confirm(left, right)
            left, right, waiting = [], [], 0
    if waiting:
        confirm(left, right)
    return out


def _connect(edits: int) -> Callable:
    """Posts with texts, sorted by key, line -> a forest of links of each key."""

    def links(line: list[np.ndarray], note: list[np.ndarray], text: list[str]) -> pa.RecordBatch:
        lines = np.concatenate(line)
        found = np.array(forest(np.concatenate(note), [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in text], edits), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(lines[found[:, 0]]), pa.array(lines[found[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, note, text = None, [], [], []
        for batch in batches:
            key = tb.column(batch, "key").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                if start == end:
                    continue
                if key[start] != now:
                    if line:
                        yield links(line, note, text)
                    now, line, note, text = key[start], [], [], []
                part = batch.slice(start, end - start)
                line.append(tb.column(part, "line").to_numpy())
                note.append(tb.column(part, "note").to_numpy())
                text += tb.column(part, "text").to_pylist()
        if line:
            yield links(line, note, text)

    return run


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        line, text = [], []
        for x, wanted in zip(tb.column(batch, "text").to_pylist(), tb.column(batch, "wanted").to_pylist(), strict=True):
            lines = x.split("\n")
            line += [w["line"] for w in wanted]
            text += [lines[w["number"]] for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(text, pa.string())], names=["line", "text"])


def _verify(edits: int) -> Callable:
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                found = near([(points(x), points(y)) for x, y in zip(tb.column(part, "x").to_pylist(), tb.column(part, "y").to_pylist(), strict=True)], edits)
                yield part.select(["a", "b"]).filter(pa.array(found))

    return run


def _without(carried: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = [], []
            for x, gone in zip(tb.column(batch, "text").to_pylist(), tb.column(batch, "gone").to_pylist(), strict=True):
                n.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    x = "\n".join(y for i, y in enumerate(x.split("\n")) if i not in out)
                text.append(x)
            kept = [tb.column(batch, c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(n, pa.int64())], names=[*carried, "text", "n_removed_lines"])

    return run


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, drop_empty: bool = False, block: int = BLOCK) -> DataFrame:
    """``docs`` with its repeated lines removed, and n_removed_lines."""
    docs = fixed(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("doc"), F.col(f"`{text}`").alias("text"))
    occurrences = settle(rows.mapInArrow(_occurrences(min_chars), "row long, doc long, number int, line long"), "occurrences")
    posted = rows.select("text").mapInArrow(_post(min_chars, edits), "key long, line long, note int")
    pairs, long, met = _sorted_out(posted, edits, FEW)
    pairs = settle(pairs.distinct(), "line-pairs")

    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(long.select("line")).distinct()
    # a line of very many documents is reduced to one place before it is dealt out
    places = occurrences.groupBy("line").agg(F.min(F.struct("row", "number")).alias("p")).join(wanted, "line", "left_semi").select("line", "p.row", "p.number")
    by_row = places.groupBy("row").agg(F.collect_list(F.struct("line", "number")).alias("wanted"))
    # texts are always shuffled, so that the plan and its disk don't change with the number of lines
    texts = settle(rows.select("row", "text").join(by_row.hint("merge"), "row").mapInArrow(_lines_of, "line long, text string"), "line-texts")
    side = lambda c, name: texts.select(F.col("line").alias(c), F.col("text").alias(name))
    confirmed = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(_verify(edits), "a long, b long")
    connected = _dealt(long.join(texts, "line"), block).repartition("key").sortWithinPartitions("key", "line").mapInArrow(_connect(edits), "a long, b long")
    links = settle(confirmed.unionByName(connected), "line-links")
    for done in (met, pairs, texts):
        forget(done)

    classes = components(links).withColumnsRenamed({"node": "line", "component": "class"})
    placed = occurrences.join(classes, "line", "left").withColumn("class", F.coalesce("class", "line"))
    # the first line of each class that stands in several places; a table, so that Spark can split a large class in the join
    first = settle(placed.groupBy("class").agg(F.min(F.struct("doc", "row", "number")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-lines")
    gone = placed.join(first, "class").filter("NOT (row = first.row AND number = first.number)").groupBy("row").agg(F.collect_list("number").alias("gone"))
    gone = settle(gone, "gone-lines")

    carried = [c for c in docs.columns if c not in (text, "n_removed_lines")]
    named = docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)), F.col(f"`{text}`").alias("text"))
    columns = [f"c{i}" for i in range(len(carried))]
    shape = T.StructType([*(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carried)), T.StructField("text", T.StringType()), T.StructField("n_removed_lines", T.LongType())])
    out = named.join(gone.hint("merge"), "row", "left").mapInArrow(_without(columns), shape)
    if drop_empty:
        out = out.filter("n_removed_lines = 0 OR text != ''")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carried)}).withColumnRenamed("text", text)
