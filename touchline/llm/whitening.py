"""Embedding whitening from upper-triangle column aggregates (operator 11).

Each entry of a vector becomes a whole number on a grid.  The distinct grid vectors are the list that the
transform is fitted on, so copies, however many, weigh once.  One aggregation gives the sums of all
dimensions, a second one the sums of the centred products of all pairs of dimensions, as SQL expressions
generated for the upper triangle.  The dimensions are cut into ranges of ``TILE``; each pair of ranges is a
group of the same aggregation, which keeps its code small enough to be compiled and lets vectors have any
width.  The covariance, whose size the rows don't change, is decomposed with LAPACK on the driver, and
every row is projected where it lies.

Vectors of each length are fitted and projected among themselves.

Nulls: rows whose vector is null or holds null or non-finite entries are dropped; null and repeated ids
each keep their own rows.  An empty vector has no components and gives no rows, as does an empty table.
A component without variance (fewer distinct vectors than dimensions, or a constant dimension) has
``whitened`` and ``explained`` 0 and doesn't count in ``identity_error``.  Entries whose grid number passes
``MOST`` in size are held there.  Other columns are not looked at and not returned.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .store import fixed, forget, settle

COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Grid numbers are held within this, so that sums of any number of rows fit a decimal of 38 digits.
MOST = 1 << 60
#: Dimensions of a range; a pair of ranges has TILE * TILE sums.
TILE = 8
#: Rows that are projected at once.
ROWS = 4096
#: Eigenvalues below this part of the largest are rounding.
NO_VARIANCE = 1e-13


@dataclass
class Whitening:
    """The transform of one length: n vectors, their sums, and the leading components."""

    n: int
    sums: list[int]
    components: np.ndarray  # one row for each component
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of grid numbers -> their whitened components."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s - int(w) * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        out = ((x - whole).astype(np.float64) - part) @ self.components.T
        alive = self.variances > 0
        return np.where(alive, out / np.sqrt(np.where(alive, self.variances, 1.0)), 0.0)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - sum) squared."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * max(1, x.shape[1]) < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def _grid(v: Column) -> Column:
    held = lambda c: F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-float(MOST))), F.lit(float(MOST)))
    return F.transform(v, lambda c: F.floor(held(c)).cast("long") + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """True for a vector of finite entries."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def covariance_sums(rows: DataFrame, values: str, dim: int, tile: int = TILE) -> np.ndarray:
    """The sums over all rows of the products of each pair of entries of the array ``values``, in one aggregation."""
    ranges = [(a, min(a + tile, dim)) for a in range(0, dim, tile)]
    cells = [(p, q) for p in range(len(ranges)) for q in range(p, len(ranges))]
    width = range(min(tile, dim))
    pieces = ", ".join(f"struct({k} as cell, slice({values}, {p * tile + 1}, {tile}) as a, slice({values}, {q * tile + 1}, {tile}) as b)" for k, (p, q) in enumerate(cells))
    flat = rows.selectExpr(f"explode(array({pieces})) as r").selectExpr("r.cell", *(f"get(r.{x}, {i}) as {x}{i}" for x in "ab" for i in width))
    sums = ", ".join(f"coalesce(sum(a{i} * b{j}), 0d)" for i in width for j in width)
    out = np.zeros((len(ranges) * tile,) * 2)
    for r in flat.groupBy("cell").agg(F.expr(f"array({sums})").alias("s")).collect():  # a row for each pair of ranges: dim * dim / 2 numbers in all
        p, q = (at * tile for at in cells[r["cell"]])
        block = np.array(r["s"]).reshape(len(width), -1)
        out[p : p + len(width), q : q + len(width)] = block
        out[q : q + len(width), p : p + len(width)] = block.T
    return out[:dim, :dim]


def fit(grid: DataFrame, dim: int, components: int = COMPONENTS, tile: int = TILE) -> Whitening:
    """The transform of distinct grid vectors of one length (column ``x``)."""
    exact = [F.sum(F.get("x", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    row = grid.agg(F.count("*").alias("n"), *exact).first()
    n, sums = row["n"], [int(row[f"s{i}"]) for i in range(dim)]
    whole = [s // n for s in sums]
    part = [(s - w * n) / n for s, w in zip(sums, whole, strict=True)]
    centre = F.array(*((F.get("x", i) - F.lit(w)).cast("double") - F.lit(p) for i, (w, p) in enumerate(zip(whole, part, strict=True))))
    v = covariance_sums(grid.select(centre.alias("c")), "c", dim, tile) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values = values[order]
    values[values <= NO_VARIANCE * max(values.max(initial=0.0), 0.0)] = 0.0
    trace = float(np.trace(v))
    own = Whitening(n, sums, vectors[:, order].T.copy(), values, values / trace if trace > 0 else np.zeros(len(values)))
    own.identity_error = _identity_error(grid, own, tile)
    return own


def _identity_error(grid: DataFrame, own: Whitening, tile: int) -> float:
    alive = np.flatnonzero(own.variances > 0)
    if not len(alive):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = own.project(_matrix(tb.column(batch, "x")))[:, alive] if len(batch) else np.zeros((0, len(alive)))
            yield pa.RecordBatch.from_arrays([_lists(w)], names=["w"])

    whitened = grid.select("x").mapInArrow(run, "w array<double>")
    mean = [F.sum(F.get("w", i)).alias(f"m{i}") for i in range(len(alive))]
    at = np.array([r or 0.0 for r in whitened.agg(*mean).first()]) / own.n
    centre = F.array(*(F.get("w", i) - F.lit(float(m)) for i, m in enumerate(at)))
    v = covariance_sums(whitened.select(centre.alias("c")), "c", len(alive), tile) / own.n
    return float(np.abs(v - np.eye(len(alive))).max())


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def whiten(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark: SparkSession = vectors.sparkSession
    v = F.col(f"`{vector}`")
    base = fixed(vectors).filter(usable(v)).select(F.col(f"`{vec_id}`").alias("id"), _grid(v).alias("x"))
    grid = settle(base.select("x").distinct(), "grid")
    fits: dict[int, Whitening] = {}
    # one fit for each length of vectors: tables of embeddings have one
    for r in grid.groupBy(F.size("x").alias("dim")).count().orderBy("dim").toLocalIterator():
        if r["dim"] > 0:
            fits[r["dim"]] = fit(grid.filter(F.size("x") == r["dim"]), r["dim"], components, tile)
    forget(grid)
    ids = base.schema["id"].dataType
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(ids: pa.Array, x: np.ndarray, own: Whitening) -> pa.RecordBatch:
        k, m = len(own.variances), len(x)
        deviation = pa.array([decimal.Decimal(d) for d in own.deviation(x)], pa.decimal128(38, 0))
        who = pa.array(np.repeat(np.arange(m), k))
        return pa.RecordBatch.from_arrays(
            [
                ids.take(who), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n, np.int64)), deviation.take(who),
                pa.array(own.project(x).ravel()), pa.array(np.tile(own.explained, m)), pa.array(np.full(m * k, own.identity_error)),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                size = tb.column(part, "x").value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(size[size > 0]).tolist():
                    some = part.filter(pa.array(size == dim))
                    yield rows(tb.column(some, "id"), _matrix(tb.column(some, "x")), fits[dim])

    kind = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    shape = T.StructType([T.StructField("id", ids), *T._parse_datatype_string(kind).fields])
    return base.mapInArrow(run, shape).withColumnRenamed("id", vec_id)


def digest(whitened: DataFrame) -> DataFrame:
    """``deviation`` as a long, null where it doesn't fit one."""
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))
