"""Keyed writes without MERGE: each gives the new table as a DataFrame; writing is a separate call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], preserve: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Old rows replaced by new ones of the same key, others added; ``preserve`` keeps old values on update.

    Keys compare with null equal to null; of several new rows of a key the one with the largest ``order`` is
    taken, or any one where no order is given.
    """
    new = (new.dropDuplicates(list(keys)) if order is None else latest(new, keys, order)).select(*old.columns)
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("n__there"))
    same = _same(keys)
    both = old.withColumn("o__there", F.lit(True)).join(n, same, "full_outer")
    pick = lambda c: F.when(F.col("n__there").isNull() | (F.col("o__there") & F.lit(c in preserve)), F.col(c)).otherwise(F.col(f"n_{c}"))
    return both.select(*(pick(c).alias(c) for c in old.columns))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``; by aggregation, so that no key's rows are sorted in one task."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_r"))
    return best.select("_r.*")


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    return out


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new``, one for each key, whose key ``old`` doesn't have; key columns in ``scope`` take an empty text for null."""
    key = lambda c: F.coalesce(F.col(c), F.lit("")) if c in scope else F.col(c)
    o = old.select(*(key(k).alias(f"n_{k}") for k in keys)).distinct()
    marked = new.withColumns({f"_k_{k}": key(k) for k in keys}).dropDuplicates([f"_k_{k}" for k in keys])
    return marked.join(o, reduce(lambda a, b: a & b, (F.col(f"_k_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys)), "left_anti").select(*new.columns)


def upsert_counted(old: DataFrame, new: DataFrame, keys: Sequence[str], scope: Sequence[str], order: str, at: str, count: str = "usage_count", seen: str = "last_seen_at", updated: str = "updated_at", row_id: str = "id") -> DataFrame:
    """Old rows with the values of the last new row of their key and ``count`` raised by one for each new row; others added.

    Key columns in ``scope`` take an empty text for null.  Where several old rows have one key, the one with the
    smallest ``row_id`` is updated and the others stay.  ``new`` needs the old table's columns but those that are
    set here; added rows have their times at ``at``, a null ``row_id``, and their number of rows as the count.
    """
    own = {count, seen, updated, row_id}
    values = [c for c in old.columns if c not in own and c not in keys]
    flat = lambda c: F.coalesce(F.col(c), F.lit("")) if c in scope else F.col(c)
    fresh = new.groupBy(*(flat(k).alias(f"_n_{k}") for k in keys)).agg(F.max_by(F.struct(*keys, *values), F.col(order)).alias("_new"), F.count("*").alias("_n"))
    have = old.withColumns({f"_k_{k}": flat(k) for k in keys})
    first = have.groupBy(*(F.col(f"_k_{k}").alias(f"_f_{k}") for k in keys)).agg(F.min(row_id).alias("_first"))  # the row of a key that takes the update
    alike = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys))
    marked = have.join(first, alike("_k_", "_f_")).withColumn("_takes", F.col(row_id).eqNullSafe(F.col("_first")))
    on = F.col("_takes") & alike("_k_", "_n_")
    both = marked.join(fresh, on, "full_outer")
    now, n = F.lit(at).cast("timestamp_ntz"), F.col("_n")
    is_old, hit = F.col("_takes").isNotNull(), n.isNotNull()

    def pick(c: str) -> Column:
        kind = old.schema[c].dataType
        if c == count:
            return F.when(hit, F.when(is_old, F.coalesce(F.col(c), F.lit(0))).otherwise(0) + n).otherwise(F.col(c)).cast(kind)
        if c in (seen, updated):
            return F.when(hit, now).otherwise(F.col(c)).cast(kind)
        if c == row_id:
            return F.col(c)
        if c in keys:
            return F.when(is_old, F.col(c)).otherwise(F.col(f"_new.{c}"))
        return F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))

    return both.select(*(pick(c).alias(c) for c in old.columns))


def patch(old: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str, updated: str = "updated_at", order: str | None = None) -> DataFrame:
    """Old rows with ``columns`` set where ``changes`` has their key, and ``updated`` set to ``at`` on those rows.

    A null in ``changes`` is written like any value; keys that ``old`` doesn't have are not added.  Of several
    changes of a key the one with the largest ``order`` counts.
    """
    last = changes.dropDuplicates(list(keys)) if order is None else latest(changes, keys, order)
    c = last.select(*(F.col(k).alias(f"n_{k}") for k in keys), *(F.col(v).alias(f"n_{v}") for v in columns), F.lit(True).alias("n__there"))
    hit = F.col("n__there").isNotNull()
    both = old.join(c, _same(keys), "left")
    new = {v: F.when(hit, F.col(f"n_{v}").cast(old.schema[v].dataType)).otherwise(F.col(v)) for v in columns}
    new[updated] = F.when(hit, F.lit(at).cast("timestamp_ntz").cast(old.schema[updated].dataType)).otherwise(F.col(updated))
    return both.withColumns(new).select(*old.columns)


def patch_partitions(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str, partition: str, updated: str = "updated_at", order: str | None = None) -> list:
    """Patch a partitioned Parquet table in place, reading and writing only the partitions that have a changed key.

    ``changes`` names the partition of each key.  The values of the partitions touched, which number as
    the table's folders, go through the driver; the rows don't.  Gives those values.  A partition without a matching
    key keeps its files.
    """
    table = spark.read.parquet(path)
    kind = table.schema[partition].dataType
    named = changes.select(F.col(partition).cast(kind).alias(partition), *keys).distinct()
    there = table.filter(F.col(partition).isin([r[0] for r in named.select(partition).distinct().collect()]))
    hit = there.join(named, [partition, *keys], "left_semi").select(partition).distinct()
    touched = sorted(r[0] for r in hit.collect())
    if touched:
        part = patch(table.filter(F.col(partition).isin(touched)), changes.filter(F.col(partition).isin(touched)), keys, columns, at, updated, order)
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        spark.catalog.refreshByPath(path)
    return touched


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, at the place of the key's first."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(order))), "_first": F.min(order).over(w)})
    return numbered.filter("_n = 1").drop("_n").withColumnRenamed("_first", "first_" + order)


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key is in ``old`` with some other value; null equals null, and an empty list too in ``lists``."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in [*keys, *values]))
    differs = F.lit(False)
    for v in values:
        a, b = F.col(v), F.col(f"n_{v}")
        if v in lists:
            empty = F.array().cast(old.schema[v].dataType)
            a, b = F.coalesce(a, empty), F.coalesce(b, empty)
        differs = differs | ~a.eqNullSafe(b)
    joined = old.join(n, [F.col(k) == F.col(f"n_{k}") for k in keys]).filter(differs)
    return joined.select(*(F.col(f"n_{c}").alias(c) for c in [*keys, *values]))


def violations(results: DataFrame) -> DataFrame:
    """How many rows break each rule of the results table."""
    n = lambda c: F.count(F.when(c, 1))
    return results.agg(
        n(~F.col("points").isin(0, 2, 4)).alias("bad_points"),
        n(~F.col("outcome_label").isin("exact", "goal_diff", "tendency", "wrong")).alias("bad_label"),
        n(~F.col("predicted_1x2").isin("H", "D", "A")).alias("bad_predicted"),
        n(~F.col("actual_1x2").isin("H", "D", "A")).alias("bad_actual"),
    )


def forbid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` if it has none of the columns, else an error."""
    found = sorted(set(df.columns) & set(columns))
    if found:
        raise ValueError(f"columns that this writer may not set: {found}")
    return df
