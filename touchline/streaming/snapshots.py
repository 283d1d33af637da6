"""Odds snapshots and alias events as streams: appended once, and one consensus for each match kept fresh.

Every batch writes under its own number and is written again alike when it is run again, so a restart neither
loses nor repeats rows.  Tables are dealt into buckets by a hash of their key: a batch reads and rewrites only
the buckets that it touches, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..operators.odds import consensus

SCHEMA = "match_id long, bookmaker_id long, snapshot_ts timestamp, seq int, home_odds double, draw_odds double, away_odds double"
ALIAS_EVENTS = "source_system string, competition_code string, raw_name string, raw_name_normalized string, home_or_away string, context string, status string"
EVENT_KEY = ("source_system", "competition_code", "raw_name_normalized", "home_or_away")
#: Buckets of a table; a bucket of a batch should hold some ten megabytes or more.  A task writes about so many rows.
BUCKETS, TASK_ROWS = 32, 500_000


def read(spark: SparkSession, folder: str, files_per_batch: int = 100, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def bucket(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _dealt(df: DataFrame, rows: int, buckets: int, keys: tuple[str, ...]) -> DataFrame:
    """Rows with a bucket, dealt to tasks by it and, where buckets are large, by parts of it: a task sorts what it writes."""
    parts = max(1, -(-rows // (TASK_ROWS * buckets)))
    part = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(parts))
    return df.repartition(max(buckets * parts, 1), F.col("bucket"), part)


def _batch(df: DataFrame, path: str, number: int) -> None:
    """The batch's rows below its own number, in place of what an earlier try of it left."""
    df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")


def _read(spark: SparkSession, path: str, schema: str, *more: str) -> DataFrame:
    kind = T.StructType([*T._parse_datatype_string(schema).fields, *(T.StructField(c, T.IntegerType()) for c in ("bucket", *more))])
    try:
        return spark.read.schema(kind).option("basePath", path).parquet(path)
    except Exception as error:  # noqa: BLE001  nothing was written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], kind)


def _touched(df: DataFrame) -> list[int]:
    """The buckets of a batch: as many numbers as there are buckets at most."""
    return [r[0] for r in df.select("bucket").distinct().collect()]


def append_snapshots(df: DataFrame, log: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """The batch's snapshots, appended to the log once; gives what the log then holds of the matches touched."""
    spark = df.sparkSession
    rows = df.withColumn("bucket", bucket(("match_id",), buckets))
    _batch(_dealt(rows, df.count(), buckets, ("match_id",)), log, number)
    own = _read(spark, f"{log}/batch={number}", SCHEMA)
    touched = own.select("match_id").distinct()
    return _read(spark, log, SCHEMA, "batch").filter(F.col("bucket").isin(_touched(own))).join(touched, "match_id", "left_semi").drop("batch")


def refresh(fresh: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS, most: int = 0) -> None:
    """The table with the rows of ``fresh``, ``most`` at most, in place of those of their keys; only the buckets touched are written."""
    spark = fresh.sparkSession
    new = fresh.withColumn("bucket", bucket(tuple(keys), buckets))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
    touched = _touched(new)
    if not touched:
        return
    old = _read(spark, table, schema).filter(F.col("bucket").isin(touched))
    merged = _dealt(merge.upsert(old, new, ["bucket", *keys]), old.count() + most, buckets, tuple(keys))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    spark.catalog.refreshByPath(table)


def consensus_table(spark: SparkSession, table: str) -> DataFrame:
    """One row for each match: the consensus over all snapshots so far."""
    return _read(spark, table, "match_id long, median_home_odds double, median_draw_odds double, median_away_odds double, bookmaker_count long").drop("bucket")


def refresh_consensus(snapshots: DataFrame, log: str, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append each batch to ``log`` and set the consensus of the matches that it touches in ``table``."""

    def batch(df: DataFrame, number: int) -> None:
        refresh(consensus(append_snapshots(df, log, number, buckets)), table, ["match_id"], buckets, df.count())

    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(df: DataFrame, table: str, number: int, buckets: int = BUCKETS) -> None:
    """The batch's alias events whose key no earlier batch has, one for each key: of several the last by context."""
    spark = df.sparkSession
    parts = -(-df.count() // TASK_ROWS)
    if parts > 1:  # a task sorts its rows to find the last of each key
        df = df.repartition(parts, F.xxhash64(*df.columns))
    new = merge.latest(df, EVENT_KEY, "context").withColumn("bucket", bucket(EVENT_KEY, buckets))
    earlier = _read(spark, table, ALIAS_EVENTS, "batch").filter(F.col("bucket").isin(_touched(new)) & (F.col("batch") < number))
    have = earlier.select(*(F.col(c).alias(f"n_{c}") for c in EVENT_KEY))
    same = F.lit(True)
    for c in EVENT_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    _batch(new.join(have, same, "left_anti"), table, number)


def alias_events(spark: SparkSession, table: str) -> DataFrame:
    return _read(spark, table, ALIAS_EVENTS, "batch").drop("bucket", "batch")


def collect_events(events: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append alias events as they come, each key once."""
    return events.writeStream.foreachBatch(lambda df, n: append_events(df, table, n, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
