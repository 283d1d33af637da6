"""Pages of a sorted table, by key instead of by offset.

The table is written once in order, each file holding one range of the order, with a small index of each
file's first key and its rows.  A page starts after a key that the caller saw last: the index names the files
that can follow, and only as many are read as the page needs.  Reading page one thousand costs what page one
does, and nothing is sorted but the rows of those files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, about, and the most files: each is a task and a row of the index, which come to the driver.
FILE_ROWS, MOST_FILES = 1_000_000, 1000


@dataclass(frozen=True)
class Order:
    """Columns of a total order and whether each falls; nulls come last."""

    columns: tuple[str, ...]
    falling: tuple[bool, ...]

    def sort(self) -> list[Column]:
        return [F.desc_nulls_last(c) if f else F.asc_nulls_last(c) for c, f in zip(self.columns, self.falling, strict=True)]

    def after(self, key: Sequence) -> Column:
        """Rows that come after a key, compared column by column."""
        out, same = F.lit(False), F.lit(True)
        for c, f, v in zip(self.columns, self.falling, key, strict=True):
            if v is not None:  # nothing comes after a null but by a later column
                col, value = F.col(c), F.lit(v)
                out = out | (same & (col.isNull() | (col < value if f else col > value)))
            same = same & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        return F.coalesce(out, F.lit(False))


def write(df: DataFrame, path: str, order: Order, file_rows: int = FILE_ROWS, rows: int | None = None) -> None:
    """The table at ``path``/rows and its index at ``path``/index; ``rows`` saves a count where the caller knows it.

    Files hold about ``file_rows`` rows, more where there would be more than ``MOST_FILES`` of them.
    """
    n = df.count() if rows is None else rows
    files = min(MOST_FILES, max(1, -(-n // file_rows)))
    ranged = df.repartitionByRange(files, *order.sort()) if files > 1 else df.coalesce(1)
    ranged.sortWithinPartitions(*order.sort()).write.parquet(f"{path}/rows")
    spark = df.sparkSession
    place = F.col("_metadata.row_index")
    listed = spark.read.schema(df.schema).parquet(f"{path}/rows").select(*order.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"), place.alias("_at"))
    listed.groupBy("_file", "_path").agg(F.count("*").alias("n"), F.max_by(F.struct(*order.columns), "_at").alias("last")).coalesce(1).write.parquet(f"{path}/index")


@dataclass
class Pages:
    """A sorted table and its index."""

    spark: SparkSession
    path: str
    order: Order

    def files(self, after: Sequence | None = None) -> list[str]:
        """The files that can hold rows after the key, in order: the index has a row for each file."""
        index = self.spark.read.parquet(f"{self.path}/index")
        if after is not None:
            last = index.select("_file", "_path", "last.*")
            index = last.filter(self.order.after(after))
        return [r["_path"] for r in index.orderBy("_file").select("_path").collect()]

    def page(self, size: int, after: Sequence | None = None, where: Column | None = None) -> DataFrame:
        """The next ``size`` rows after the key (from the start without one) among those that ``where`` holds for.

        Reads one file, then twice as many, until the page is full.
        """
        files = self.files(after)
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        rows, take = self.spark.createDataFrame([], schema), 1
        while take <= 2 * len(files):
            rows = self.spark.read.schema(schema).parquet(*files[:take])
            if after is not None:
                rows = rows.filter(self.order.after(after))
            if where is not None:
                rows = rows.filter(where)
            rows = rows.orderBy(*self.order.sort()).limit(size)
            if take >= len(files) or rows.count() >= size:
                break
            take *= 2
        return rows

    def key(self, page: DataFrame) -> tuple | None:
        """The key to go on from: that of a page's last row; a page has few rows."""
        rows = page.select(*self.order.columns).collect()
        return tuple(rows[-1]) if rows else None


#: How the dashboard reads: predictions of two days ahead, days of history, one day, and results of models.
LIVE_DAYS, LIVE_ROWS, HISTORY_DAYS, DAY_ROWS, RESULT_ROWS = 2, 500, 365, 50, 2000


def live_window(rows: DataFrame, now: str, days: int = LIVE_DAYS, most: int = LIVE_ROWS) -> DataFrame:
    """Rows from the start of today to the start of the day ``days`` later, by kickoff; the first ``most``."""
    start = F.date_trunc("day", F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    inside = (F.col("kickoff_at") >= start) & (F.col("kickoff_at") < start + F.make_dt_interval(days=F.lit(days)))
    return rows.filter(inside).orderBy("kickoff_at", "match_id").limit(most)


def newest_days(days: DataFrame, most: int = HISTORY_DAYS) -> DataFrame:
    """The last ``most`` days, newest first."""
    return days.orderBy(F.desc("match_date")).limit(most)


def one_day(rows: DataFrame, day: str, most: int = DAY_ROWS) -> DataFrame:
    """A day's rows by kickoff, the first ``most``."""
    return rows.filter(F.col("match_date") == F.lit(day).cast("date")).orderBy("kickoff_at", "match_id").limit(most)


def newest_results(results: DataFrame, model: str | None = None, code: str | None = None, since: str | None = None, most: int = RESULT_ROWS) -> DataFrame:
    """Results newest first, of a model, a competition or from a time on where one is named; the first ``most``."""
    for column, value in (("model_key", model), ("competition_code", code)):
        if value is not None:
            results = results.filter(F.col(column) == value)
    if since is not None:
        results = results.filter(F.col("kickoff_at") >= F.lit(since).cast(results.schema["kickoff_at"].dataType))
    return results.orderBy(F.desc("kickoff_at"), "match_id", "model_key").limit(most)
