"""Embedding near-duplicates with an inverted multi-index (operator 1).

Two codebooks, one for each half of the vectors, form a grid of cells; every vector is posted to its
own cell.  A vector visits the cells whose vectors can be near enough: a cell lies, against each other
code, on one side of a plane, and the farthest of these planes, summed over the halves, bounds the
distance from below.  No pair at the threshold is farther apart than ``2 - 2 * threshold``, so every link
is met, whatever the data.  Of two cells only the lower one's vectors visit the higher one, so that
each pair of vectors meets once.  All pairs that meet are verified in double precision, block against
block; a task gives each vector's number of links and a star for each group of linked vectors, never
the pairs.

Identical vectors of a label enter once, with their number.  A cell of more than ``BLOCK`` vectors is
cut into blocks that meet one another.

Vectors link only with those of their own length; each length has its own index.

Nulls: a vector that is null, zero, or holds a null or non-finite component, and one without a label,
links with nothing.  Rows are told apart by position, so null and repeated ids are rows of their own; a
component takes its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .store import settle

#: Vectors, at most about, that codebooks are fitted on; all vectors are indexed.
SAMPLE_ROWS = 8192
#: Vectors of a label in a cell, on average, where the label is the largest.
VECTORS_PER_CELL = 512
BLOCK = 1024
#: Lengths of vectors, the commonest, that get codebooks; the vectors of any other length share one cell.
MOST_LENGTHS = 64
#: Rows that a scan gives at once, and bounds that it holds.
POST_ROWS, POST_BOUNDS = 8192, 1 << 18
#: Sampled vectors, at least, for each code: this alone bounds the number of codes.
SAMPLES_PER_CODE = 8


@dataclass
class Index:
    """Codebooks of the two halves and the bound at which a traversal stops."""

    books: tuple[np.ndarray, np.ndarray]
    stop: float

    @property
    def size(self) -> int:
        return len(self.books[0])

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, a lower bound of each vector's squared distance to each code's region."""
        out, half = [], x.shape[1] // 2
        for part, book in zip((x[:, :half], x[:, half:]), self.books, strict=True):
            d = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None]
            apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))
            np.fill_diagonal(apart, np.inf)
            far = np.zeros_like(d)
            for k in range(len(book)):
                np.maximum(far, (d - d[:, k : k + 1]) / (2 * apart[k]), out=far)
            out.append(far * far)
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (s.argmin(1) for s in self.bounds(x))
        return a * self.size + b

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) for each cell that a vector reaches before the stop, nearest cells first.

        Both halves' codes are gone through in the order of their bounds; the second half's run for a code of the first ends
        where the sum passes the stop, so only cells that are reached take memory.
        """
        at, cells = [], []
        for v, (a, b) in enumerate(zip(*self.bounds(x), strict=True)):
            first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            near = np.searchsorted(b[second], self.stop - a[first], side="right")
            near = near[: int(np.count_nonzero(near))]
            i = np.repeat(first[: len(near)], near)
            j = second[np.arange(len(i)) - np.repeat(np.cumsum(near) - near, near)]
            order = np.argsort(a[i] + b[j], kind="stable")
            at.append(np.full(len(i), v))
            cells.append((i * self.size + j)[order])
        return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(cells or [np.zeros(0, np.int64)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, whose square could be beyond a double or below it."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        own = (-2 * x @ book.T + (book * book).sum(1)[None]).argmin(1)
        for c in range(len(book)):
            if (own == c).any():
                book[c] = x[own == c].mean(0)
    return np.unique(book, axis=0)


def fit(sample: np.ndarray, codes: int, threshold: float) -> Index:
    """Codebooks by k-means, from unit vectors, and the stop that no pair at the threshold exceeds."""
    rng = np.random.default_rng(11)
    half = sample.shape[1] // 2
    books = [_codebook(sample[:, :half], codes, rng), _codebook(sample[:, half:], codes, rng)]
    n = min(map(len, books))
    return Index((books[0][:n], books[1][:n]), farthest(threshold))


def one_cell(dim: int, threshold: float) -> Index:
    half = dim // 2
    return Index((np.zeros((1, half)), np.zeros((1, dim - half))), farthest(threshold))


def farthest(threshold: float) -> float:
    """Squared distance of unit vectors at the threshold, with room for rounding."""
    return 2 - 2 * threshold + 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _post(indexes: dict[int, Index], threshold: float):
    """(label, vector, node, many) -> the row with (own, cell, role 0) for its own cell and role 1 for each higher one visited."""

    def of_length(batch: pa.RecordBatch, index: Index) -> Iterator[pa.RecordBatch]:
        x = unit(_matrix(tb.column(batch, "vector")))
        step = int(np.clip(POST_BOUNDS // index.size, 1, 1024))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            own = index.cells(part)
            who, cell = index.visits(part)
            higher = cell > own[who]
            row = np.concatenate([np.arange(len(part)), who[higher]])
            cell = np.concatenate([own, cell[higher]])
            role = np.repeat([0, 1], [len(part), int(higher.sum())]).astype(np.int32)
            for s in range(0, len(row), POST_ROWS):
                take = row[s : s + POST_ROWS]
                rows = batch.slice(at, len(part)).take(pa.array(take))
                yield rows.append_column("own", pa.array(own[take])).append_column("cell", pa.array(cell[s : s + POST_ROWS])).append_column("role", pa.array(role[s : s + POST_ROWS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = tb.column(batch, "vector").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(length).tolist():
                yield from of_length(batch.filter(pa.array(length == dim)), indexes.get(dim) or one_cell(dim, threshold))

    return run


def stars(hit: np.ndarray, member: np.ndarray, row: np.ndarray) -> tuple[list[int], list[int]]:
    """Star edges of the groups linked by ``hit`` (rows against members, members being the first rows)."""
    a, b = [], []
    m = hit.shape[1]
    open_ = hit.any(0)
    while open_.any():
        inside = np.zeros(m, bool)
        inside[np.argmax(open_)] = True
        size = 0
        while size < inside.sum():
            size = int(inside.sum())
            rows = hit[:, inside].any(1)
            inside |= hit[rows].any(0)
            inside |= rows[:m]
        group = np.unique(np.concatenate([member[inside], row[hit[:, inside].any(1)]]))
        a += [int(group[0])] * (len(group) - 1)
        b += group[1:].tolist()
        open_ &= ~inside
    return a, b


def _verify(threshold: float):
    """Rows sorted by (label, cell, block, role) -> (node, other, n): links counted, and star edges (n = 0)."""

    def block(member: tuple, probe: tuple, within: bool) -> pa.RecordBatch | None:
        node, many, x = (np.concatenate([p, q]) if within else q for p, q in zip(member, probe, strict=True))
        hit = x @ member[2].T >= threshold
        if within:
            np.fill_diagonal(hit[: len(member[0])], False)
        if not hit.any():
            return None
        n = hit @ member[1]
        if within:
            n[: len(member[0])] += probe[1] @ hit[len(member[0]) :]
            extra = (np.zeros(0, np.int64),) * 2
        else:
            extra = (member[0], probe[1] @ hit)
            hit = np.concatenate([np.zeros((len(member[0]),) * 2, bool), hit])
            node = np.concatenate([member[0], node])
        nodes, counts = (np.concatenate([node[-len(n) :], extra[0]]), np.concatenate([n, extra[1]]))
        a, b = stars(hit, member[0], node)
        keep = counts > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([nodes[keep], a]).astype(np.int64)), pa.array(np.concatenate([nodes[keep], b]).astype(np.int64)), pa.array(np.concatenate([counts[keep], np.zeros(len(a))]).astype(np.int64))],
            names=["node", "other", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, member, fresh = None, None, False
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([tb.column(batch, c).to_numpy() for c in ("label", "cell", "block")], axis=1)
            role = tb.column(batch, "role").to_numpy()
            node, many, vector = (tb.column(batch, c) for c in ("node", "many", "vector"))
            node, many = node.to_numpy(), many.to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                members = int((role[s:e] == 0).sum())
                data = (node[s:e], many[s:e], unit(_matrix(vector.slice(s, e - s))))  # of one length
                part, probes = tuple(v[:members] for v in data), tuple(v[members:] for v in data)
                if group is None or (key[s] != group).any():
                    group, member = key[s], part
                    out = block(part, probes, True)
                    if out is not None:
                        yield out
                    continue
                # the group goes on from the batch before: more members meet those held, then probes meet all
                for piece, within in ((part, False), (probes, False)):
                    if len(piece[0]):
                        out = block(member, piece, within)
                        if out is not None:
                            yield out
                    if piece is part and len(part[0]):
                        out = block(part, tuple(v[:0] for v in data), True)
                        if out is not None:
                            yield out
                        member = tuple(np.concatenate(v) for v in zip(member, part, strict=True))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", recall: float = 1.0, sample_rows: int = SAMPLE_ROWS, vectors_per_cell: int = VECTORS_PER_CELL, block: int = BLOCK) -> DataFrame:
    """One row for each vector: its id, n_links, component_id, kept and first_row.

    All links are found, so any ``recall`` that a caller asks for is reached.
    """
    v = F.col(f"`{vector}`")
    known = F.forall(v, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y.cast("double")) < float("inf")), F.lit(False)))
    finite = F.coalesce(known & F.exists(v, lambda y: y != 0), F.lit(False))
    base = settle(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{vec_id}`").cast("long").alias("id"),
            F.xxhash64(F.col(f"`{label}`"), F.size(v)).alias("label"),
            (finite & F.col(f"`{label}`").isNotNull()).alias("valid"),
            v.alias("vector"),
        ),
        "vectors",
    )
    usable = base.filter("valid")
    classes = settle(usable.groupBy("label", "vector").agg(F.min("row").alias("node"), F.count("*").alias("many")), "classes")

    labels = classes.groupBy("label", F.size("vector").alias("dim")).count()
    lengths = labels.groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()
    part = min(1.0, sample_rows / max(1, classes.count()))
    sample = classes.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < max(1, int(part * 1_000_000))).select("vector").collect()
    indexes = {}
    for r in lengths:
        some = [v.vector for v in sample if len(v.vector) == r["dim"]]
        codes = int(np.clip(np.sqrt(r["most"] / vectors_per_cell), 1, max(1, len(some) // SAMPLES_PER_CODE)))
        if some and codes > 1 and r["dim"] > 1:
            indexes[r["dim"]] = fit(unit(np.array(some)), codes, threshold)

    kind = classes.schema["vector"].dataType.simpleString()
    posted = classes.mapInArrow(_post(indexes, threshold), f"label long, vector {kind}, node long, many long, own long, cell long, role int")
    fine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    sizes = posted.filter("role = 0").groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    met = posted.join(sizes, ["label", "cell"])
    own = met.filter("role = 0").withColumn("block", fine)
    columns = ["label", "cell", "block", "role", "node", "many", "vector"]
    spread = lambda df, first: df.withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1))).withColumn("role", F.lit(1))
    across = spread(met.filter("role = 1"), F.lit(0)).select(*columns)
    between = spread(own.withColumn("next", (F.col("block") + 1).cast("int")).filter("next < blocks").drop("block"), F.col("next")).select(*columns)
    rows = own.select(*columns).unionByName(across.withColumn("block", F.col("block").cast("long"))).unionByName(between.withColumn("block", F.col("block").cast("long")))
    found = settle(
        rows.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role").mapInArrow(_verify(threshold), "node long, other long, n long"),
        "found",
    )
    links = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.filter("n = 0").select("node", "other"))
    placed = (
        classes.join(links, "node", "left").join(groups, "node", "left")
        .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    )
    rows = usable.select("row", "label", "vector").join(placed, ["label", "vector"]).select("row", "n_links", "group")
    whole = base.select("row", "id").join(rows, "row", "left").withColumn("group", F.coalesce("group", "row"))
    least = whole.groupBy("group").agg(F.min("id").alias("component_id"))
    return whole.join(least, "group").select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        (F.col("row") == F.col("group")).alias("first_row"),
    )
