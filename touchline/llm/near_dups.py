"""MinHash near-duplicates by a signature-coordinate inverted join (operator 10).

Every document posts under each of the first ``COORDS - m + 1`` of its coordinate-value pairs, in an order that
is the same for all: pairs that are frequent in a sample come last.  Two documents that agree on m of
``COORDS`` coordinates share one of these posts at least, whatever the order, so the rest of a
signature is never posted, only compared where documents meet (one byte for each coordinate).  A
post list longer than ``LONG_LIST`` is split by a second coordinate: a pair that agrees often enough
shares two of the first ``COORDS - m + 2`` coordinates.  From each list leaves a maximum spanning forest
of the pairs that pass, never all pairs.  A list that is long even then (near copies agree on nearly
everything) is cut into blocks by a hash, which all hold the list's pivots, about ``PIVOTS`` of its rows;
there each row meets the pivots and only what passes with none of them meets its block.

Links are then confirmed on the full shingle sets: each document with its best partner, then all other
candidates between what is still apart.  Where that leaves a candidate component, or a list cut into
blocks, in pieces, all pieces but the largest meet the whole of it, block against block, and each pair of blocks gives
a forest of the links between pieces.  So every link between different sets is accounted for.

Identical shingle sets are one class and enter once.  Documents without words link with nothing.
Null ids are nodes like others; repeated rows are copies; a component takes its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .store import fixed, forget, settle

COORDS = 64
LONG_LIST = 4096
PIVOTS = 64
#: One row in so many is looked at for frequent pairs; at most so many pairs are known as frequent.  Both only order the posts.
SAMPLE, MOST_FREQUENT = 16, 65_536
#: Bytes of shingle sets in a block, on average.
BLOCK_BYTES = 1 << 21
_RNG = np.random.default_rng(7)
_FLIP = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "n_shingles long, set_a long, set_b long, posts array<long>, sketch binary"


def match_threshold(percent: int) -> int:
    """Coordinates that must agree: at the similarity itself fewer do with a chance of 1 in 10,000."""
    p = percent / 100
    return max(1, int(COORDS * p - 3.9 * (COORDS * p * (1 - p)) ** 0.5))


def shingle_sets(s: tb.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's rows, row by row, and how many each row has."""
    w0, w1 = s.words()
    row = s.row_of(w0)
    by_word = tb.prefix_hash(tb.span_hash(tb.prefix_hash(tb.BYTE_VALUE[tb.LOWER[s.buf]]), w0, w1))
    n = tb.per_row(w0, s.start, s.end)
    first = np.cumsum(n) - n
    at = np.arange(max(0, len(w0) - size + 1))
    at = at[row[at] == row[at + size - 1]]
    few = np.flatnonzero((n > 0) & (n < size))
    start, end = np.concatenate([at, first[few]]), np.concatenate([at + size, first[few] + n[few]])
    owner = np.concatenate([row[at], few])
    order = np.argsort(owner, kind="stable")
    start, end, owner = start[order], end[order], owner[order]
    h = tb.span_hash(by_word, start, end)
    once = ~tb.later(h + tb.mix(owner.astype(np.uint64) + np.uint64(1)))
    return h[once], np.bincount(owner[once], minlength=s.n)


def _sign(size: int):
    """Signatures: the coordinate-value pairs as numbers, and one byte of each."""

    def measure(s: tb.Slice) -> dict[str, pa.Array]:
        h, n = shingle_sets(s, size)
        full = np.flatnonzero(n)
        cut = (np.cumsum(n) - n)[full]
        low = np.zeros((s.n, COORDS), np.uint64)
        ids = np.zeros((2, s.n), np.uint64)
        if len(full):
            for k in range(COORDS):
                x = (h ^ _FLIP[k]) * _ODD[k]
                x ^= x >> np.uint64(32)
                low[full, k] = np.minimum.reduceat(x, cut)
            ids[0, full], ids[1, full] = np.add.reduceat(h, cut), np.add.reduceat(tb.mix(h + np.uint64(1)), cut)
        posts = tb.mix(low + _FLIP)
        sketch = (tb.mix(low) & np.uint64(255)).astype(np.uint8)
        return {
            "n_shingles": pa.array(n.astype(np.int64)),
            "set_a": pa.array(ids[0].view(np.int64)),
            "set_b": pa.array(ids[1].view(np.int64)),
            "posts": pa.FixedSizeListArray.from_arrays(pa.array(posts.view(np.int64).ravel()), COORDS).cast(pa.list_(pa.int64())),
            "sketch": pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDS), s.n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary()),
        }

    return measure


def _set_of(size: int):
    def measure(s: tb.Slice) -> dict[str, pa.Array]:
        h, n = shingle_sets(s, size)
        ends = np.cumsum(n)
        return {"members": pa.array([np.sort(h[e - k : e]).tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())}

    return measure


def spanning_forest(sketch: np.ndarray, at_least: int) -> list[tuple[int, int, int]]:
    """Maximum spanning forest of the pairs of rows that agree on ``at_least`` coordinates."""
    n = len(sketch)
    best, parent, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    edges, i = [], 0
    for _ in range(n - 1):
        out[i] = True
        m = np.count_nonzero(sketch == sketch[i], axis=1)
        closer = m > best
        best[closer], parent[closer] = m[closer], i
        best[out] = -1
        i = int(np.argmax(best))
        if best[i] >= at_least:
            edges.append((int(parent[i]), i, int(best[i])))
    return edges


def pivot_edges(sketch: np.ndarray, pivots: int, at_least: int) -> list[tuple[int, int, int]]:
    """Each row's best pivot, the pivots being the first rows; a forest of the rows that pass with none."""
    edges = spanning_forest(sketch[:pivots], at_least)
    best, which = np.zeros(len(sketch), np.int64), np.zeros(len(sketch), np.int64)
    for k in range(pivots):
        m = np.count_nonzero(sketch == sketch[k], axis=1)
        closer = m > best
        best[closer], which[closer] = m[closer], k
    met = np.flatnonzero(best >= at_least)
    met = met[met >= pivots]
    edges += list(zip(which[met].tolist(), met.tolist(), best[met].tolist(), strict=True))
    alone = np.flatnonzero(best < at_least)
    return edges + [(int(alone[i]), int(alone[j]), m) for i, j, m in spanning_forest(sketch[alone], at_least)]


def _forests(at_least: int):
    """Batches sorted by key, pivots first -> candidate edges of each key's rows."""

    def edges_of(key: np.ndarray, row: np.ndarray, pivot: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([cut, [len(key)]]))
        left, right, many = [], [], []
        each = np.repeat(size, size)
        for d in range(1, min(8, size.max(initial=1))):
            i = np.flatnonzero((each[:-d] <= 8) & (key[:-d] == key[d:]))
            m = np.count_nonzero(sketch[i] == sketch[i + d], axis=1)
            keep = m >= at_least
            left.append(i[keep])
            right.append(i[keep] + d)
            many.append(m[keep])
        for c, n in zip(cut[size > 8], size[size > 8], strict=True):
            pivots = int(np.count_nonzero(pivot[c : c + n]))
            found = pivot_edges(sketch[c : c + n], pivots, at_least) if pivots else spanning_forest(sketch[c : c + n], at_least)
            found = np.array(found, np.int64).reshape(-1, 3)
            left.append(found[:, 0] + c)
            right.append(found[:, 1] + c)
            many.append(found[:, 2])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        a, b = row[join(left)], row[join(right)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(join(many).astype(np.int64))], names=["a", "b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, COORDS), np.uint8)]
        for batch in batches:
            data, _ = tb.text_buffers(tb.column(batch, "sketch"))
            now = [*(tb.column(batch, c).to_numpy() for c in ("key", "row", "pivot")), data.reshape(-1, COORDS)]
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if whole:
                yield edges_of(*(x[:whole] for x in now))
            rest = [x[whole:] for x in now]
        if len(rest[0]):
            yield edges_of(*rest)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(tb.column(batch, "x"), tb.column(batch, "y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int, matches: int):
    """Pairs of blocks -> links that join pieces: a forest over the pieces of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, y = (tb.column(batch, c)[i].as_py() for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in links_between(x, y, percent, matches)], names=["a", "b"])

    return run


def links_between(left: list[dict], right: list[dict], percent: int, matches: int) -> tuple[list[int], list[int]]:
    """A forest, over pieces, of the links between rows whose sketches agree on ``matches`` coordinates."""
    sets = [np.frombuffer(r["members"], np.uint64) for r in right]
    size = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum(size) - size
    sketch = np.frombuffer(b"".join(bytes(r["sketch"]) for r in right), np.uint8).reshape(-1, COORDS)
    names, piece = np.unique([r["piece"] for r in [*right, *left]], return_inverse=True)
    tree = np.arange(len(names))  # the piece that each piece has been joined to
    mark = np.zeros(len(values), np.int8)
    a, b = [], []
    for r, own in zip(left, piece[len(right) :], strict=True):
        near = np.count_nonzero(sketch == np.frombuffer(bytes(r["sketch"]), np.uint8), axis=1) >= matches
        j = np.flatnonzero(near & (tree[piece[: len(right)]] != tree[own]))
        if not len(j):
            continue
        mine = np.frombuffer(r["members"], np.uint64)
        at = np.searchsorted(values, mine)
        at[at == len(values)] = 0
        at = at[values[at] == mine]
        mark[at] = 1
        if 8 * len(j) > len(right):
            both = np.add.reduceat(mark[place], cut, dtype=np.int64)[j]
        else:
            both = np.array([int(mark[place[cut[k] : cut[k] + size[k]]].sum(dtype=np.int64)) for k in j])
        mark[at] = 0
        for k in j[100 * both >= percent * (len(mine) + size[j] - both)]:
            if tree[piece[k]] != tree[own]:
                tree[tree == tree[piece[k]]] = tree[own]
                a.append(r["row"])
                b.append(right[k]["row"])
    return a, b


def _first_posts(frequent: np.ndarray, posted: int):
    """(row, posts) -> the first ``posted`` pairs, frequent ones last, else by coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts = tb.column(batch, "posts").flatten().to_numpy().reshape(-1, COORDS)
            order = np.argsort(np.isin(posts, frequent), axis=1, kind="stable")[:, :posted]
            first = np.take_along_axis(posts, order, axis=1)
            yield pa.RecordBatch.from_arrays([tb.column(batch, "row"), pa.FixedSizeListArray.from_arrays(pa.array(first.ravel()), posted).cast(pa.list_(pa.int64()))], names=["row", "posts"])

    return run


def ordered_posts(members: DataFrame, posted: int, long_list: int) -> DataFrame:
    """(row, posts) with the posts of each row in the common order."""
    sample = members.filter(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(SAMPLE)) == 0).select(F.explode("posts").alias("key"))
    busy = sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > long_list / 2 / SAMPLE)
    frequent = np.array([r["key"] for r in busy.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()], np.int64)
    return members.select("row", "posts").mapInArrow(_first_posts(frequent, posted), "row long, posts array<long>")


def candidate_edges(members: DataFrame, matches: int, long_list: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, m): forests of all post lists over rows (row, posts, sketch); (key, row): the lists that were cut into blocks."""
    prefix = COORDS - matches + 1
    ordered = ordered_posts(members, min(COORDS, prefix + 1), long_list)
    posts = ordered.select("row", F.posexplode(F.slice("posts", 1, prefix)).alias("c", "key"))
    busy = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = settle(posts.join(busy, "key"), "met")
    short = met.filter(F.col("n") <= long_list).select("key", "row", F.lit(0).alias("pivot"))
    finer = (
        met.filter(F.col("n") > long_list).join(ordered, "row")
        .select("row", "key", F.explode(F.expr(f"slice(posts, c + 2, {prefix})")).alias("second"))
        .select(F.xxhash64("key", "second").alias("key"), "row")
    )
    again = finer.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    finer = settle(finer.join(again, "key"), "met-twice")
    short = short.unionByName(finer.filter(F.col("n") <= long_list).select("key", "row", F.lit(0).alias("pivot")))
    # blocks by a power of two and by rows alone, so that lists of nearly the same rows have the same blocks and pivots
    huge = finer.filter(F.col("n") > long_list).select("key", "row", F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / (long_list / 2)))).cast("long").alias("blocks"))
    own = huge.select(F.xxhash64("key", F.pmod(F.xxhash64("row"), F.col("blocks"))).alias("key"), "row", F.lit(0).alias("pivot"))
    chosen = huge.filter(F.pmod(F.xxhash64("row", F.lit(1)), F.expr(f"greatest(1, blocks * {long_list // 2} div {PIVOTS})")) == 0)
    shared = chosen.select("key", "row", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block")).select(F.xxhash64("key", "block").alias("key"), "row", F.lit(1).alias("pivot"))
    lists = short.unionByName(own).unionByName(shared).join(members.select("row", "sketch"), "row")
    edges = lists.repartition("key").sortWithinPartitions("key", F.desc("pivot"), "row").mapInArrow(_forests(matches), "a long, b long, m long").filter("a != b")
    out = settle(edges.groupBy("a", "b").agg(F.max("m").alias("m")), "candidates")
    forget(met)
    return out, huge.select("key", "row")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 5,
    percent: int = 80,
    matches: int | None = None,
    long_list: int = LONG_LIST,
) -> DataFrame:
    """One row for each row of ``docs``: its columns but the text, n_shingles, component_id and kept.

    ``percent`` is the similarity in hundredths, ``matches`` the coordinates of a signature that a
    pair must share to be looked at.  kept is true where the id is its component's smallest; first_row is true for one row of each
    component, also where ids are null or repeat; row is the row's number in the order of ``docs``, which
    must be the same whenever it is read (a table of files does that).
    """
    matches = matches or match_threshold(percent)
    added = {"n_shingles", "component_id", "kept", "first_row", "row"}
    carried = [c for c in docs.columns if c != text and c not in added]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_key"),
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried))).alias("side"),
        F.col(f"`{text}`").alias("text"),
    )
    signed = settle(tb.scan_texts(numbered, "text", _sign(shingle), _SIGNED), "signed")
    own = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("node"))
    members = signed.join(own.select(F.col("node").alias("row")), "row", "left_semi").select("row", "id", "text_key", "posts", "sketch")
    edges, huge = candidate_edges(members, matches, long_list)

    nodes = edges.select(F.col("a").alias("row")).union(edges.select("b")).union(huge.select("row")).distinct()
    wanted = members.join(nodes, "row", "left_semi").select("row", "id", "text_key", "sketch")
    texts = (
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("id2"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key2"), F.col(f"`{text}`").alias("text"))
        .join(wanted, (F.col("text_key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2"))).select("row", "sketch", "text")
    )
    sets = settle(tb.scan_texts(texts, "text", _set_of(shingle), "members binary").dropDuplicates(["row"]), "sets")
    side = lambda c, name: sets.select(F.col("row").alias(c), F.col("members").alias(name))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")

    def pieces_by(links: DataFrame) -> DataFrame:
        return settle(with_component(sets.select("row"), components(links)), "pieces")

    def crossing(pieces: DataFrame) -> DataFrame:
        piece = lambda c: pieces.select(F.col("row").alias(c), F.col("component").alias(f"{c}_piece"))
        return edges.join(piece("a"), "a").join(piece("b"), "b").filter("a_piece != b_piece")

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "m"))
    best = both.groupBy("a").agg(F.max(F.struct("m", (-F.col("b")).alias("nb"))).alias("x")).select("a", (-F.col("x.nb")).alias("b"))
    links = settle(confirmed(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "links")
    pieces = pieces_by(links)
    more = settle(confirmed(crossing(pieces).select("a", "b")), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        pieces = pieces_by(links)
    apart = crossing(pieces).select("a_piece", "b_piece").union(_apart_in(huge, pieces))
    apart = settle(apart.select(F.least("a_piece", "b_piece").alias("a_piece"), F.greatest("a_piece", "b_piece").alias("b_piece")).distinct(), "apart")
    if not apart.isEmpty():
        links = links.unionByName(settle(_rest_of_links(sets, pieces, apart, percent, matches), "links"))
    by_set = signed.filter("n_shingles > 0").select("row", "set_a", "set_b").join(own, ["set_a", "set_b"]).select("row", "node")
    labelled = with_component(by_set.withColumnRenamed("row", "member").withColumnRenamed("node", "row"), components(links)).select(F.col("member").alias("row"), F.col("component").alias("group"))
    placed = signed.select("row", "id", "n_shingles", "side").join(labelled, "row", "left").withColumn("group", F.coalesce("group", "row"))
    # ids in order, nulls last
    least = placed.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return placed.join(least, "group").select(
        *(F.col(f"side.c{i}").alias(c) for i, c in enumerate(carried)),
        "n_shingles",
        F.col("first.id").alias("component_id"),
        F.coalesce(F.col("id") == F.col("first.id"), F.lit(True)).alias("kept"),
        (F.col("row") == F.col("first.row")).alias("first_row"),
        "row",
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id."""
    docs = fixed(docs)
    found = near_duplicates(docs, **options).filter("first_row").select(F.col("row").alias("_row"))
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(found, "_row", "left_semi").drop("_row")


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))


def _apart_in(huge: DataFrame, pieces: DataFrame) -> DataFrame:
    """In each list that was cut into blocks, the other pieces with the largest one."""
    sizes = huge.join(pieces, "row").groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("x")).select("key", F.col("x.component").alias("b_piece"))
    return sizes.join(largest, "key").filter("component != b_piece").select(F.col("component").alias("a_piece"), "b_piece")


def _rest_of_links(sets: DataFrame, pieces: DataFrame, apart: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links between the pieces of a candidate component: all but its largest piece against all of it."""
    held = pieces.select("row", F.col("component").alias("piece"))
    touched = apart.select(F.col("a_piece").alias("row")).union(apart.select("b_piece")).distinct()
    whole = with_component(touched, components(apart)).select(F.col("row").alias("piece"), F.col("component").alias("whole"))
    placed = settle(held.join(whole, "piece").join(sets.select("row", F.length("members").alias("bytes")), "row"), "placed")
    sizes = placed.groupBy("whole", "piece").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    total = sizes.groupBy("whole").agg(F.ceil((F.sum("bytes") + 1) / BLOCK_BYTES).cast("int").alias("blocks"), F.max(F.struct("n", "piece")).alias("x")).select("whole", "blocks", F.col("x.piece").alias("largest"))
    cut = placed.join(total, "whole").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).join(sets, "row")
    entry = F.collect_list(F.struct("row", "piece", "sketch", "members"))
    right = cut.groupBy("whole", "block").agg(entry.alias("y"))
    left = cut.filter("piece != largest").groupBy("whole", "block", "blocks").agg(entry.alias("x"))
    left = left.select("whole", "x", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"))
    return left.join(right, ["whole", "block"]).select("x", "y").mapInArrow(_block_links(percent, matches), "a long, b long")
