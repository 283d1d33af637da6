"""Connected components by alternating large-star and small-star passes.

Each pass is two aggregations and two joins; its result is written to the shared folder, so no
pass depends on executors that computed an earlier one, and nothing but a count and a checksum
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that is not the smallest of its component.

    ``edges`` has two long columns; direction, repeats, loops and nulls don't matter.  A node that
    the result doesn't list is the smallest of its component, or has no edge.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
