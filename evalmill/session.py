"""Session settings and the shared folder that staged tables are written to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_REPO = str(Path(__file__).resolve().parent.parent)
_local: dict[str, str] = {}
#: The setting by which Spark deletes the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evalmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.executorEnv.PYTHONPATH", _REPO)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only where that is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="evalmill-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_local[app])
    return "file://" + _local[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The copy survives the loss of any executor, and both sides of a later join
    are plain scans, so that adaptive execution can split a skewed key. Once it
    is written, Spark drops the shuffle files that it was made from.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalmill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for df in staged:
        delete_path(df.sparkSession, df.staged_at)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't start in its folder."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(os.path.realpath(p or ".") == _REPO for p in known):
        return
    if _REPO not in _local:
        folder = tempfile.mkdtemp(prefix="evalmill-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[_REPO] = shutil.make_archive(f"{folder}/evalmill", "zip", _REPO, "evalmill")
    spark.sparkContext.addPyFile(_local[_REPO])
