"""Session settings, staged tables and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have before it stops being sent to every executor.
BROADCAST_ROWS = 200_000
#: Write options of tables with very long values. A reader takes thousands of rows of a row group at once, so the row
#: groups are kept small, and their size is looked at after every row.
LONG_VALUES = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}

_STAGE_ROOTS: dict[str, str] = {}
_SCRATCH = threading.local()


def build_session(app: str = "corridor_spark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` where it is set.

    A local session without that setting gets a temporary folder; a cluster
    session without it is refused, since its executors share no local disk.
    """
    app = spark.sparkContext.applicationId
    if app not in _STAGE_ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="corridor-stage-")
        _STAGE_ROOTS[app] = f"{base.rstrip('/')}/corridor_spark/{app}"
    return _STAGE_ROOTS[app]


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table that several branches read, and return the written table.

    The lineage ends at the files, so a lost executor costs a re-read and not a
    recompute, and every branch reads only the columns it needs. ``options`` are the writer's (``LONG_VALUES``).
    """
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if getattr(_SCRATCH, "paths", None) is not None:
        _SCRATCH.paths.append(path)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables from the shared folder."""
    root = _STAGE_ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        _delete(spark, root)


def _at(spark: SparkSession, folder: str) -> tuple:
    """File system of a folder and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, folder: str) -> None:
    system, path = _at(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _at(spark, folder)
    return system.exists(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What this thread stages inside goes on leaving: for a micro-batch that has written its result by then.

    Gives a ``stage`` whose tables outlive the block, for the result that the others lead to.
    """
    before, _SCRATCH.paths = getattr(_SCRATCH, "paths", None), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside, _SCRATCH.paths = _SCRATCH.paths, before
        try:
            return stage(df, name)
        finally:
            _SCRATCH.paths = inside

    try:
        yield keep
    finally:
        done, _SCRATCH.paths = _SCRATCH.paths, before
        for folder in done:
            _delete(spark, folder)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast if a count proves it small, else leave it to a shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df
