"""Hard-negative mining over k-means inverted lists with stored radii (operator 12).

Every vector lies in the list of its nearest centroid, and each list keeps its radius, the farthest that a
member lies from the centroid.  By Cauchy and Schwarz a member's inner product with an anchor differs from
the centroid's by at most the anchor's length times the radius, which bounds each list from above and below.
An anchor visits lists by falling upper bound: the first ``FIRST`` of them, then, once their k-th best score is
known, only the lists whose upper bound isn't strictly below it.  For negatives, lists outside the window
of scores are skipped as well.  Scores are exact integers, so the result is that of a full search.

Each visit is one row that goes to the list; a list of more than ``block`` members is cut into blocks, each a
group of its own.  A task holds one block and streams the visits past it, and gives at most k rows for
each visit.  An anchor that visits a list costs a row, whatever the list's size: lists grow to a block of
about ``BLOCK_BYTES`` before there are more of them, so the visits of a large table are few for each anchor.

Nulls: a row with a null label or vector, or a null or non-finite component, takes no part.  An empty
vector takes no part either.  A row with a null id is no anchor; as a candidate it comes after all others of its score.  Rows are told apart by
position, so rows of one id are candidates and anchors of their own.  Only vectors of the anchor's length are
its candidates.  Components whose grid number passes sqrt(2**55 / length) in size are held there, so that
windows of scores fit a long.  Empty tables, and anchors without a positive or without a negative in the window,
give no rows.  Other columns are not looked at and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .store import forget, settle

#: A component x becomes floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window of negative scores, in percent of the positive's score.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Lists that an anchor visits before its k-th score is known.
FIRST = 4
#: Lists of a length, where it has rows enough for FEWEST_ROWS in each.
LISTS, FEWEST_ROWS = 64, 256
#: Bytes of a block of members, as doubles; more rows make more lists.
BLOCK_BYTES = 32 << 20
#: Vectors that centroids are fitted on, for each list and in bytes at most; all vectors are listed.
SAMPLES_PER_LIST, SAMPLE_BYTES = 16, 32 << 20
#: Lengths of vectors, the commonest, that get centroids; the vectors of another length share one list.
MOST_LENGTHS = 64
#: Scores that a task holds at once.
SCORES = 1 << 22


@dataclass
class Lists:
    """Centroids of one length and the radii of their lists."""

    centroids: np.ndarray
    radii: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of each vector with each list, with room for rounding."""
        middle = x @ self.centroids.T
        size = np.sqrt((x * x).sum(1))[:, None]
        far = size * self.radii[None]
        slack = 1e-9 * (size * (np.sqrt((self.centroids**2).sum(1)) + self.radii)[None] + 1)
        return middle - far - slack, middle + far + slack


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's list and its distance to the centroid."""
    own = ((centroids**2).sum(1)[None] - 2 * x @ centroids.T).argmin(1)
    return own, np.sqrt(((x - centroids[own]) ** 2).sum(1))


def kmeans(x: np.ndarray, k: int, passes: int = 8) -> np.ndarray:
    """Centroids of the sample; identical ones are kept once."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(17).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(passes):
        own, _ = nearest(x, centroids)
        many = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centroids)
    return np.unique(centroids, axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = tb.column(batch, "x").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        yield dim, batch.filter(pa.array(size == dim))


def _grid(v: Column) -> Column:
    most = F.floor(F.sqrt(F.lit(float(1 << 55)) / F.greatest(F.size(v), F.lit(1))))
    return F.transform(v, lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), -most), most)).cast("int"))


def _usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def _append(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return batch


# ---- the lists ---------------------------------------------------------------------------------


def _fit(base: DataFrame, lists: int, fewest_rows: int, block_bytes: int) -> dict[int, np.ndarray]:
    """Centroids for each of the commonest lengths, from a bounded sample."""
    out = {}
    for r in base.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect():
        dim, n = r["dim"], r["count"]
        k = max(min(lists, n // fewest_rows), -(-n * 8 * dim // block_bytes))
        most = SAMPLE_BYTES // (8 * dim)
        k = min(k, max(1, most // SAMPLES_PER_LIST))
        if k > 1:
            part = min(1.0, k * SAMPLES_PER_LIST / n)
            some = base.filter((F.col("dim") == dim) & (F.xxhash64("row", F.lit(3)) / F.lit(2.0**64) + F.lit(0.5) < part))
            sample = _matrix(some.select("x").limit(most).toArrow().column("x").combine_chunks()).astype(np.float64)
            if len(sample):
                out[dim] = kmeans(sample, k)
    return out


def _assign(centroids: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _dims(batch):
                x = _matrix(tb.column(part, "x")).astype(np.float64)
                cell, far = nearest(x, centroids.get(dim, np.zeros((1, dim))))
                yield _append(part, cell=cell.astype(np.int32), far=far)

    return run


# ---- the visits --------------------------------------------------------------------------------


def _visits(index: dict[int, Lists], first: int, again: bool):
    """Anchors (anchor, id, label, x, low, high: a window for each search) -> a row for each list that is visited.

    The first round takes the first lists by upper bound; the second one those of the rest that can still hold
    a score of some window, whose lower end is then the k-th best score found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _dims(batch):
                own = index.get(dim)
                if own is None:
                    continue
                for at in range(0, len(part), max(1, SCORES // 16 // len(own.radii))):
                    some = part.slice(at, max(1, SCORES // 16 // len(own.radii)))
                    least, most = own.bounds(_matrix(tb.column(some, "x")).astype(np.float64))
                    windows = tb.column(some, "low").value_lengths().to_numpy()
                    who = np.repeat(np.arange(len(some)), windows)
                    low, high, begin = (tb.column(some, c).flatten().to_numpy(zero_copy_only=False) for c in ("low", "high", "begin"))
                    # by the window as it was at first, the first lists are the same in both rounds
                    meets = (most[who] >= begin[:, None]) & (least[who] <= high[:, None])
                    can = np.zeros(most.shape, bool)
                    np.logical_or.at(can, who, meets)
                    bound = np.where(can, most, -np.inf)
                    place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable")
                    wanted = can & (place < first)
                    if again:
                        still = np.zeros(most.shape, bool)
                        np.logical_or.at(still, who, meets & (most[who] >= low[:, None]))
                        wanted = still & (place >= first)
                    row, cell = np.nonzero(wanted)
                    if len(row):
                        yield _append(some.take(pa.array(row)).drop_columns(["begin"]), cell=cell.astype(np.int32))

    return run


def _exact(x: np.ndarray) -> bool:
    """Whether scores of such vectors are exact in doubles."""
    return float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 53


def _search(k: int, same_label: bool):
    """Rows by (dim, cell, block), members (role 0) before visits (role 1) -> (anchor, search, id, row, score): the k best of each block."""

    def meet(visits: pa.RecordBatch, member: dict) -> pa.RecordBatch | None:
        anchor, label = (tb.column(visits, c).to_numpy() for c in ("anchor", "label"))
        q = _matrix(tb.column(visits, "x"))
        windows = tb.column(visits, "low").value_lengths().to_numpy()
        low, high = (tb.column(visits, c).flatten().to_numpy() for c in ("low", "high"))
        begin = np.cumsum(windows) - windows
        out: list[tuple] = []
        step = max(1, SCORES // len(member["row"]))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            if member["exact"] and _exact(part):
                scores = (part.astype(np.float64) @ member["float"].T).astype(np.int64)
            else:
                scores = part.astype(np.int64) @ member["x"].astype(np.int64).T
            for i, s in enumerate(scores, at):
                fine = (member["label"] == label[i]) == same_label
                if same_label:
                    fine &= member["row"] != anchor[i]
                for w in range(windows[i]):
                    j = begin[i] + w
                    here = np.flatnonzero(fine & (s >= low[j]) & (s <= high[j]))
                    if len(here) > k:
                        cut = np.partition(s[here], len(here) - k)[len(here) - k]
                        over = here[s[here] > cut]
                        here = np.concatenate([over, here[s[here] == cut][: k - len(over)]])  # members come by id
                    out.append((np.full(len(here), anchor[i]), np.full(len(here), w, np.int32), here, s[here]))
        at = np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int64)
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), member["id"].take(pa.array(at)), pa.array(member["row"][at]), pa.array(np.concatenate([o[3] for o in out]))],
            names=["anchor", "search", "id", "row", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, member = None, [], None
        for batch in batches:
            key = np.stack([tb.column(batch, c).to_numpy() for c in ("dim", "cell", "block", "role")], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]])) if len(batch) else [0]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if group is None or (key[s, :3] != group).any():
                    group, held, member = key[s, :3], [], None
                part = batch.slice(s, e - s)
                if key[s, 3] == 0:
                    held.append(part.select(["id", "anchor", "label", "x"]))
                    continue
                if member is None and held:
                    all_ = pa.Table.from_batches(held).combine_chunks()
                    x = _matrix(all_.column("x").combine_chunks())
                    member = {"id": all_.column("id").combine_chunks(), "row": all_.column("anchor").to_numpy(), "label": all_.column("label").to_numpy(), "x": x, "exact": _exact(x)}
                    member["float"] = x.astype(np.float64) if member["exact"] else None
                    held = []
                if member is not None:
                    found = meet(part, member)
                    if found is not None:
                        yield found

    return run


class Mine:
    """The written lists of a table and the searches over them."""

    def __init__(self, base: DataFrame, lists: int, fewest_rows: int, block_bytes: int, first: int):
        self.first = first
        centroids = _fit(base, lists, fewest_rows, block_bytes)
        shape = T.StructType([*base.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
        self.listed = settle(base.mapInArrow(_assign(centroids), shape), "lists")
        #: at most MOST_LENGTHS times the lists of a length, and one list for each other length
        found = self.listed.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
        self.index, most = {}, {}
        for r in found:
            own = self.index.setdefault(r["dim"], Lists(centroids.get(r["dim"], np.zeros((1, r["dim"]))), np.full(len(centroids.get(r["dim"], [0])), -np.inf)))
            own.radii[r["cell"]] = r["far"]
            most[r["dim"]] = most.get(r["dim"], 0) + r["n"]
        for own in self.index.values():  # centroids without members aren't visited
            there = np.isfinite(own.radii)
            own.radii = np.where(there, own.radii, 0.0)
            own.centroids = np.where(there[:, None], own.centroids, 0.0)
        sizes = {d: max(1, min(block_bytes // (8 * max(1, d)), 2 * -(-n // len(self.index[d].radii)))) for d, n in most.items()}
        self.blocks = {(r["dim"], r["cell"]): -(-r["n"] // sizes[r["dim"]]) for r in found}

    def best(self, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(anchor, search, rank, id, score): the k best rows of each window of each anchor, with or without its label.

        ``anchors``: anchor, label, x, dim and the arrays low and high.
        """
        asked = anchors.withColumn("begin", F.col("low"))
        met = settle(self._round(asked, k, same_label, False), "met")
        order = [F.desc("score"), F.asc_nulls_last("id"), "row"]
        rank = F.row_number().over(Window.partitionBy("anchor", "search").orderBy(*order))
        top = met.withColumn("rank", rank).filter(F.col("rank") <= k)
        kth = top.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("kth"))
        floor = F.transform("low", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w), low)))
        rest = asked.join(kth, "anchor", "left").withColumn("low", floor).drop("kth")
        every = met.unionByName(self._round(rest, k, same_label, True))
        out = settle(every.withColumn("rank", rank).filter(F.col("rank") <= k).select("anchor", "search", "rank", "id", "score"), "best")
        forget(met)
        return out

    def _round(self, anchors: DataFrame, k: int, same_label: bool, again: bool) -> DataFrame:
        anchors = anchors.select("anchor", "label", "x", "dim", "low", "high", "begin")
        fields = [f for f in anchors.schema.fields if f.name != "begin"]
        visits = anchors.mapInArrow(_visits(self.index, self.first, again), T.StructType([*fields, T.StructField("cell", T.IntegerType())]))
        spark = anchors.sparkSession
        blocks = F.broadcast(spark.createDataFrame([(d, c, b) for (d, c), b in self.blocks.items()], "dim int, cell int, blocks int"))  # a row for each list
        none = F.lit(None).cast("array<long>")
        members = self.listed.join(blocks, ["dim", "cell"]).select(
            "dim", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"),
            "id", F.col("row").alias("anchor"), "label", "x", none.alias("low"), none.alias("high"),
        )
        guests = visits.join(blocks, ["dim", "cell"]).select(
            "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"),
            F.lit(None).cast(members.schema["id"].dataType).alias("id"), "anchor", "label", "x", "low", "high",
        )
        rows = members.unionByName(guests).repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "role", F.asc_nulls_last("id"), "anchor")
        kind = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("search", T.IntegerType()), members.schema["id"], T.StructField("row", T.LongType()), T.StructField("score", T.LongType())])
        return rows.mapInArrow(_search(k, same_label), kind)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, vector: str = "embedding", vec_id: str = "vec_id", positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT), lists: int = LISTS, fewest_rows: int = FEWEST_ROWS, block_bytes: int = BLOCK_BYTES, first: int = FIRST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row where ``anchors`` holds.

    ``label`` is the label's expression over the table (its column ``label`` if not given).
    """
    v = F.col(f"`{vector}`")
    base = settle(
        vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
            F.coalesce(anchors, F.lit(False)).alias("asks"), _grid(v).alias("x"), F.size(v).alias("dim"), _usable(v).alias("usable"),
        ).filter("usable and dim > 0 and label is not null").drop("usable"),
        "grid",
    )
    own = Mine(base, lists, fewest_rows, block_bytes, first)
    forget(base)
    asks = own.listed.filter("asks")
    everything = F.lit(1 << 62).cast("long")
    queries = asks.select(F.col("row").alias("anchor"), "label", "x", "dim", F.array(-everything).alias("low"), F.array(everything).alias("high"))
    good = own.best(queries, positives, True)
    by_rank = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))  # at most ``positives`` for each
    windows = by_rank.select("anchor", F.transform("found", lambda f: f["score"]).alias("scores"))
    least, most = (f"({sign}s * {p}L - pmod({sign}s * {p}L, 100L)) div 100L" for sign, p in zip(("-", ""), percent, strict=True))
    low, high = F.expr(f"transform(scores, s -> -({least}))"), F.expr(f"transform(scores, s -> {most})")
    asked = queries.drop("low", "high").join(windows.select("anchor", low.alias("low"), high.alias("high")), "anchor")
    bad = own.best(asked, negatives, False)
    names = asks.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = good.select("anchor", (F.col("rank") - 1).alias("search"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(pairs, ["anchor", "search"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
