"""A log of job runs and releases: append-only events, folded into one row for each run when read.

A run's rows are counted by an observation of the job's own plan, so the log starts no job over the data.
Whatever goes wrong with the log itself is logged and never raised; what goes wrong in the job is noted and
raised again.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

EVENTS = "run_id string, job_name string, system_version string, git_commit_sha string, status string, at timestamp, metadata map<string,string>"
RELEASES = "system_version string, git_commit_sha string, git_branch string, notes string, at timestamp"
RUNNING, SUCCESS, FAILED = "running", "success", "failed"


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def iso_utc(at: datetime) -> str:
    """ISO text in UTC; a time without a zone is taken as UTC."""
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()


@dataclass
class Run:
    """A run that is under way: what it counted and noted so far."""

    run_id: str
    metadata: dict[str, str] = field(default_factory=dict)
    observed: list[Observation] = field(default_factory=list)

    def counted(self, df: DataFrame, **more: Column) -> DataFrame:
        """``df``, whose rows (n_rows) and further aggregates the next action on it counts on the way."""
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        self.observed.append(seen)
        return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in more.items()))

    def figures(self) -> dict[str, str]:
        """What all observations counted; the same name counted twice adds up.  Call after the job's actions."""
        out: dict[str, object] = {}
        for seen in self.observed:
            for name, value in seen.get.items():
                out[name] = value if out.get(name) is None else out[name] if value is None else out[name] + value
        return {k: str(v) for k, v in out.items() if v is not None}


class RunLog:
    """Runs and releases in two folders of Parquet files below ``path``."""

    def __init__(self, spark: SparkSession, path: str, version: str = "dev", commit: str = "", branch: str = "", clock: Callable[[], datetime] = utc_now):
        self.spark, self.path, self.version, self.commit, self.branch, self.clock = spark, path.rstrip("/"), version, commit, branch, clock

    def _append(self, folder: str, schema: str, row: tuple) -> None:
        try:
            self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{folder}")
        except Exception:  # noqa: BLE001  a job doesn't end for its log
            log.exception("the run log can't be written: %s", self.path)

    def _event(self, run_id: str, job: str | None, status: str, metadata: dict[str, str] | None) -> None:
        self._append("events", EVENTS, (run_id, job, self.version if job else None, self.commit if job else None, status, self.clock(), metadata or None))

    def start(self, job: str, run_id: str | None = None, metadata: dict[str, str] | None = None) -> str:
        """The id of the new run, also where the log can't be written."""
        run_id = run_id or str(uuid.uuid4())
        self._event(run_id, job, RUNNING, metadata)
        return run_id

    def finish(self, run_id: str, status: str = SUCCESS, metadata: dict[str, str] | None = None) -> None:
        """``status`` is any text: success, failed, partial.  Metadata given here replaces that of the start."""
        if not run_id:
            log.warning("a run without an id can't be finished")
            return
        self._event(run_id, None, status, metadata)

    def release(self, notes: str = "") -> None:
        """Note the version; of a version noted twice the first stays (see ``releases``)."""
        self._append("releases", RELEASES, (self.version, self.commit, self.branch, notes, self.clock()))

    @contextmanager
    def run(self, job: str, metadata: dict[str, str] | None = None) -> Iterator[Run]:
        """A run from start to finish: ``with log.run("job") as run: run.counted(df).write...``."""
        now = Run(self.start(job, metadata=metadata), dict(metadata or {}))
        try:
            yield now
        except BaseException as error:
            self.finish(now.run_id, FAILED, now.metadata | {"error": f"{type(error).__name__}: {error}"[:2000]})
            raise
        try:
            figures = now.figures()
        except Exception:  # noqa: BLE001
            log.exception("the rows of %s weren't counted", job)
            figures = {}
        self.finish(now.run_id, SUCCESS, now.metadata | figures)

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except Exception:  # noqa: BLE001  nothing was logged yet
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """A row for each run: its job, version, last status, times and last metadata."""
        at = F.struct((F.col("status") != RUNNING).alias("over"), "at")
        first = lambda c: F.min_by(c, at)
        return self._read("events", EVENTS).groupBy("run_id").agg(
            *(first(c).alias(c) for c in ("job_name", "system_version", "git_commit_sha")),
            F.max_by("status", at).alias("status"),
            F.min(F.when(F.col("status") == RUNNING, F.col("at"))).alias("started_at"),
            F.max(F.when(F.col("status") != RUNNING, F.col("at"))).alias("finished_at"),
            F.max_by("metadata", F.when(F.col("metadata").isNotNull(), at)).alias("metadata"),
        )

    def releases(self) -> DataFrame:
        """A row for each version, as first noted."""
        rest = ("git_commit_sha", "git_branch", "notes", "at")
        return self._read("releases", RELEASES).groupBy("system_version").agg(*(F.min_by(c, "at").alias(c) for c in rest))
