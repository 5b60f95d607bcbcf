"""Session factory used by tests, the bench and interactive work; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "quillforge", **conf: str) -> SparkSession:
    """A local session with AQE on, UTC time and shuffle partitions that match the cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where a session on one machine names none (tests), a temporary folder is made once per application; on a cluster that
    is an error, as executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quillforge-")
        base = "file://" + _OWN[app]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
