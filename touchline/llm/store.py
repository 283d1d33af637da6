"""Reading inputs and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: Rows of whole texts that a Python worker holds at once, at most; a larger session setting is lowered to it.
BATCH_ROWS = 4096
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application, and bound their batches."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        base = Path(tempfile.mkdtemp()) / _PACKAGE.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", _PACKAGE.parent, _PACKAGE.name))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where none is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/touchline-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs restart from files, not from lineage."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a settled table that no later step reads."""
    spark = df.sparkSession
    for path in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        if "/touchline-" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fixed(df: DataFrame) -> DataFrame:
    """``df`` where it only reads files, so that rows are numbered alike whenever it is read; else it is written first."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return df if node.nodeName() in ("LogicalRelation", "Relation") else settle(df, "input")
