"""Mixing sources to target weights by hierarchical budgeting (operator 3).

The token budget runs down a tree of domain, language and source.  At each node the children share by
their weights; what a child can't use (its tokens times the epochs allowed) goes to its siblings, and
only what they can't use either goes back to the node's own siblings.  A leaf's budget is spent on
whole epochs and then on the documents that come first in the order of a seeded hash, as many as fit:
the leaf's token-prefix of its next epoch.  That prefix is found through sums over ranges of the hash, and
over ranges of the range where it ends, so that no leaf has to be sorted in one task; it is one threshold
for each leaf.  Budgets are tables of their own, a row for each node: any number of leaves will do.

Tokens are words here (runs of bytes that are no ASCII white space); another count can be passed as a
column.  Nulls: a null text has no tokens, and a leaf without tokens is not selected; null languages
or sources are values of their own.  Repeated rows stand at the same place of the order and are taken
together or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import settle

SEED = 20240229
#: Bits of the hash that tell ranges apart, and the ranges within one of them: 16.8 million for each leaf.
RANGE_BITS = (12, 24)
LEVELS = ("domain", "lang", "source")


@dataclass
class Weights:
    """Weights of children by level and name; a name that isn't listed gets ``other``."""

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0

    def of(self, level: int, name: str | None) -> float:
        return (self.domain, self.lang, self.source)[level].get(name, self.other)

    def column(self, level: int) -> Column:
        """The weight of the child that the level's column names."""
        named, at = (self.domain, self.lang, self.source)[level], F.col(LEVELS[level])
        pairs = [F.lit(x) for name, w in named.items() if name is not None for x in (name, float(w))]
        listed = F.element_at(F.create_map(*pairs), at) if pairs else F.lit(None).cast("double")
        return F.when(at.isNull(), F.lit(float(self.of(level, None)))).otherwise(F.coalesce(listed, F.lit(float(self.other))))


def domain_of(source: Column) -> Column:
    """The default domain of a source: one of four, by the number at the end of its name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("domain"), F.pmod(F.when(number != "", number.cast("int")).otherwise(0), F.lit(4)).cast("string"))


def share_out(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its room; what one can't take goes to the others."""
    given = [0.0] * len(room)
    open_ = [i for i in range(len(room)) if room[i] > 0 and weights[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] - given[i] <= left * weights[i] / total]
        if not full:
            for i in open_:
                given[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - given[i]
            given[i] = room[i]
        open_ = [i for i in open_ if i not in full]
    return given


def leaf_budgets(leaves: list[tuple[tuple, int]], weights: Weights, budget: float, max_epochs: int) -> dict[tuple, float]:
    """Budget of each leaf of a tree that fits in memory; ``leaves`` are ((domain, lang, source), tokens)."""

    def room(items: list[tuple[tuple, int]], level: int) -> float:
        if level == len(LEVELS):
            return sum(t for _, t in items) * max_epochs
        return sum(room(part, level + 1) for name, part in children(items, level) if weights.of(level, name) > 0)

    def children(items: list[tuple[tuple, int]], level: int) -> list[tuple[str | None, list]]:
        out: dict = {}
        for item in items:
            out.setdefault(item[0][level], []).append(item)
        return sorted(out.items(), key=lambda x: (x[0] is not None, x[0] or ""))

    def down(items: list[tuple[tuple, int]], level: int, budget: float) -> dict[tuple, float]:
        if level == len(LEVELS):
            return {items[0][0]: budget}
        parts = children(items, level)
        given = share_out(budget, [weights.of(level, name) for name, _ in parts], [room(part, level + 1) for _, part in parts])
        return {k: v for (_, part), g in zip(parts, given, strict=True) for k, v in down(part, level + 1, g).items()}

    return down(leaves, 0, budget) if leaves else {}


def _count_words(s: tb.Slice) -> dict[str, pa.Array]:
    return {"n_tokens": pa.array(tb.per_row(s.words()[0], s.start, s.end).astype(np.int64))}


def _keyed(docs: DataFrame, text: str, doc_id: str, lang: str, source: str, domain: Column | None) -> DataFrame:
    d = (domain_of(F.col(f"`{source}`")) if domain is None else domain).cast("string")
    return docs.withColumns(
        {
            "_domain": d,
            "_leaf": F.concat_ws("\x1f", *(F.coalesce(x.cast("string"), F.lit("\x1e")) for x in (d, F.col(f"`{lang}`"), F.col(f"`{source}`")))),
            "_key": F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        }
    )


def _place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("_epochs"), F.col("_key"))


def _shared(children: DataFrame, parent: str) -> DataFrame:
    """``children`` (w, room, and budget, the parent's) with the budget that each takes.

    By rising room for each unit of weight, a child's level is what is left by those before it over the weights from
    it on; the greatest level of all is the one at which the siblings without a shortage share.
    """
    siblings = Window.partitionBy(parent)
    open_ = (F.col("w") > 0) & (F.col("room") > 0)
    before = siblings.orderBy(F.when(open_, F.col("room") / F.col("w")).asc_nulls_last(), "w", "room", "_node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.when(open_, F.col("w")).otherwise(0.0)
    room = F.when(open_, F.col("room")).otherwise(0)
    at = children.withColumns({"_w": F.sum(share).over(siblings) - F.sum(share).over(before) + share, "_r": F.sum(room).over(before) - room, "_all": F.sum(room).over(siblings)})
    level = F.max(F.when(open_, (F.least("budget", F.col("_all").cast("double")) - F.col("_r")) / F.col("_w"))).over(siblings)
    taken = F.when(open_, F.least(F.col("room").cast("double"), F.greatest(F.lit(0.0), level * F.col("w")))).otherwise(0.0)
    return at.withColumn("budget", taken).drop("_w", "_r", "_all")


def budgets(stats: DataFrame, weights: Weights, share: float, max_epochs: int) -> DataFrame:
    """Budget of each leaf: ``stats`` (_leaf, domain, lang, source, tokens) with budget."""
    up = lambda n: F.substring_index("_node", "\x1f", n)
    leaf = stats.withColumns({"_node": F.col("_leaf"), "w": weights.column(2), "room": F.col("tokens") * max_epochs})
    inner = lambda below, n, level, *names: (
        below.groupBy(up(n).alias("_node"), *names).agg(F.sum(F.when(F.col("w") > 0, F.col("room")).otherwise(0)).alias("room")).withColumn("w", weights.column(level))
    )
    lang = inner(leaf, 2, 1, "domain", "lang")
    domain = inner(lang, 1, 0, "domain")
    total = stats.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(share))).alias("budget"))  # one row
    top = _shared(domain.crossJoin(F.broadcast(total)).withColumn("_top", F.lit(0)), "_top")
    for below, n in ((lang, 1), (leaf, 2)):
        given = top.select(F.col("_node").alias("_parent"), "budget")
        top = _shared(below.withColumn("_parent", up(n)).join(given, "_parent"), "_parent")
    return top.select("_leaf", "tokens", "budget")


def plan(docs: DataFrame, weights: Weights, share: float, max_epochs: int, seed: int, text: str, doc_id: str, lang: str, source: str, domain: Column | None) -> tuple[DataFrame, DataFrame]:
    """The rows' keys and tokens (no texts), and for each leaf its whole epochs and the end of its prefix.

    Joins with the leaves have no hint: Spark broadcasts them by their size, and splits a large leaf where it doesn't.
    """
    keyed = _keyed(docs, text, doc_id, lang, source, domain)
    side = keyed.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("_domain").alias("domain"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), "_leaf", "_key", F.col(f"`{text}`").alias("text"))
    rows = settle(tb.scan_texts(side, "text", _count_words, "n_tokens long"), "mix-rows")
    stats = settle(rows.groupBy("_leaf", *LEVELS).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"), "mix-tokens")
    whole = budgets(stats, weights, share, max_epochs).withColumn("_b", F.floor(F.col("budget") + 1e-6))
    leaves = settle(whole.select("_leaf", F.expr("_b div tokens").alias("_epochs"), F.expr("_b % tokens").alias("_rest")), "mix-budgets")

    edge = leaves.select("_leaf", "_epochs", "_rest", F.lit(0).cast("long").alias("_range"), F.lit(0).cast("long").alias("_before"))
    bits = 0
    for finer in RANGE_BITS:
        # the range of each leaf where its prefix ends, within the range found before
        placed = rows.join(edge, "_leaf").withColumn("_at", _place(seed)).filter(F.shiftright("_at", 64 - bits) == F.col("_range") if bits else F.lit(True))
        sums = placed.groupBy("_leaf", "_epochs", "_rest", "_before", F.shiftright("_at", 64 - finer).alias("_range")).agg(F.sum("n_tokens").alias("n"))
        upto = F.col("_before") + F.sum("n").over(Window.partitionBy("_leaf").orderBy("_range"))
        edge = sums.withColumn("_upto", upto).filter("_upto - n <= _rest AND _upto > _rest").select("_leaf", "_epochs", "_rest", "_range", (F.col("_upto") - F.col("n")).alias("_before"))
        edge, bits = settle(edge, "mix-edges"), finer
    # all ranges below the edge are in; within it, those that still fit
    placed = rows.join(edge, "_leaf").withColumn("_at", _place(seed)).filter(F.shiftright("_at", 64 - bits) == F.col("_range"))
    inside = placed.withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(Window.partitionBy("_leaf").orderBy("_at")))
    ends = inside.groupBy("_leaf").agg(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_at"))).alias("_last"), F.min("_range").alias("_edge"))
    floor = F.shiftleft(F.col("_edge"), 64 - bits) - 1  # just below the edge range
    cut = leaves.join(ends, "_leaf", "left").select("_leaf", "_epochs", F.when(F.col("_edge").isNull(), F.lit(None)).otherwise(F.coalesce("_last", F.when(F.col("_edge") > -(1 << (bits - 1)), floor))).alias("_cut"))
    return rows, settle(cut, "mix-leaves")


def _selected(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Rows repeated for each epoch (column epoch) that takes them."""
    met = rows.join(leaves, "_leaf")
    last = F.when(_place(seed) <= F.col("_cut"), F.col("_epochs")).otherwise(F.col("_epochs") - 1)
    return met.withColumn("_to", last).filter("_to >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_to"))))


def mix(docs: DataFrame, weights: Weights | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", domain: Column | None = None) -> DataFrame:
    """``docs`` with a column epoch, a row for each time that a document is taken.

    ``share`` is the budget as a share of all tokens; a leaf is repeated ``max_epochs`` times at most.
    """
    _, leaves = plan(docs, weights or Weights(), share, max_epochs, seed, text, doc_id, lang, source, domain)
    carried = [F.col(f"`{c}`") for c in docs.columns if c != "epoch"]
    return _selected(_keyed(docs, text, doc_id, lang, source, domain), leaves, seed).select(*carried, "epoch")


def mix_ids(docs: DataFrame, weights: Weights | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", domain: Column | None = None) -> DataFrame:
    """The same selection without texts: doc_id, domain, lang, source, n_tokens, epoch."""
    rows, leaves = plan(docs, weights or Weights(), share, max_epochs, seed, text, doc_id, lang, source, domain)
    return _selected(rows, leaves, seed).select("doc_id", *LEVELS, "n_tokens", "epoch")
