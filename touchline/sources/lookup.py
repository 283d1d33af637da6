"""Tables dealt into buckets by a key when they are written, so that joins and groups by it don't shuffle.

A lookup by one key reads one bucket's files; two tables of as many buckets meet bucket by bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least buckets of a table, and the most rows that a bucket should hold; a bucket is read, sorted and joined by one task.
BUCKETS, BUCKET_ROWS = 16, 1_000_000


def buckets_for(rows: int) -> int:
    """Buckets for a table of so many rows: a power of two, so that tables of different numbers can still meet."""
    n = BUCKETS
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def write(df: DataFrame, key: str, path: str, buckets: int | None = None, name: str | None = None) -> str:
    """The name of a new table at ``path``, bucketed and sorted by ``key``, into as many buckets as its rows need unless they are given.

    Rows are dealt out before they are written, so each bucket is one file, not one for each task.
    """
    name = name or f"touchline_{uuid.uuid4().hex}"
    buckets = buckets_for(df.count()) if buckets is None else buckets
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def of(spark: SparkSession, name: str, **values: object) -> DataFrame:
    """Rows whose columns have the given values; a value of the bucketed column reads one bucket."""
    out = spark.table(name)
    for column, value in values.items():
        out = out.filter(F.col(column) == F.lit(value))
    return out


def for_model(spark: SparkSession, name: str, model: str) -> DataFrame:
    return of(spark, name, model_key=model)


def for_match(spark: SparkSession, name: str, match_id: int) -> DataFrame:
    return of(spark, name, match_id=match_id)


def for_league(spark: SparkSession, name: str, code: str) -> DataFrame:
    return of(spark, name, competition_code=code)


def external_mappings(mappings: DataFrame, source: str, order: str = "updated_at") -> DataFrame:
    """A source's mappings, active or not, one for each external code: the last by ``order``."""
    mine = mappings.filter(F.col("source_system") == source)
    best = mine.groupBy("external_code").agg(F.max_by(F.struct("competition_code", "is_active"), order).alias("m"))
    return best.select("external_code", "m.competition_code", "m.is_active")
