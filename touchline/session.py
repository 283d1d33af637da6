"""A session with the settings that the library assumes, and the folder that its tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytecode beyond this isn't compiled by the JVM's own compiler; Spark then splits the expressions of such a stage.
HUGE_METHOD, _HUGE = "8000", "spark.sql.codegen.hugeMethodLimit"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def session(name: str = "touchline", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """UTC, ANSI mode and adaptive execution; the master, partition count and checkpoint folder only where given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    b = b.config(_HUGE, HUGE_METHOD)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        b = b.config(CHECKPOINT_DIR, checkpoint_dir)
    return b.getOrCreate()


def compiled(spark: SparkSession) -> None:
    """Lower a larger setting of the session to HUGE_METHOD: beyond it generated code is interpreted, however many rows there are."""
    if int(spark.conf.get(_HUGE)) > int(HUGE_METHOD):
        spark.conf.set(_HUGE, HUGE_METHOD)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where the setting is missing, a session of one process takes a local folder; a cluster's session is refused.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set(CHECKPOINT_DIR, named)
    return f"{named.rstrip('/')}/touchline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows neither plans nor works it out again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
