"""Session helper for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "rivalry", memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session whose master is local may leave it unset; it then gets a temporary
    folder of its own. A cluster without the setting gets an error that names it, because
    executors would write to their own disks. The session's settings are not changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="rivalry-"))
    return _LOCAL_ROOT[0]


_RUNS: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared root; nothing is created yet."""
    path = f"{shared_root(spark)}/rivalry-{uuid.uuid4().hex}"
    if _RUNS:
        _RUNS[-1].append(path)
    return path


@contextmanager
def run_scope(spark: SparkSession):
    """Deletes every folder stored inside the scope when it ends; write or collect results before that."""
    _RUNS.append([])
    try:
        yield
    finally:
        for path in _RUNS.pop():
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a run's folder once its results are no longer read; only names this library made."""
    if not re.search(r"/rivalry-[0-9a-f]{32}(/|$)", path):
        raise ValueError(f"not a folder of this library: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def persist_table(df, path: str | None = None):
    """Writes a DataFrame once and reads it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    target = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
