"""What a session needs besides its data."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parents[1]
    # The driver serves this one file as long as the application runs.
    folder = str(Path(tempfile.mkdtemp(prefix="package")).resolve())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder) / "tree" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", copy.parent))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: the cluster's own setting.

    Only where none is set and driver and executors are one process (as in
    tests) a temporary one is made, and removed at the end; elsewhere it is an error.
    """
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder for tables that are written and read again; the driver's JVM removes it when it ends.

    It lies in the shared folder, so any executor can read it, also after others are lost.
    """
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path
