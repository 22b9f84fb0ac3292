"""What a session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, local mode (tests) gets a
    temporary one; on a cluster that would lose data, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jdir.get() if jdir.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        at = "file://" + tempfile.mkdtemp(prefix="loomstone-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomstone/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, among those of this application."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has in the shared folder: indexes, states and cut lineages. Results that weren't
    written elsewhere by then can't be read any more, as they are computed from these tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package, for clusters on which it isn't installed. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomstone_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        at = os.path.join(tempfile.mkdtemp(prefix="loomstone-ship-"), "loomstone_ship.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for d, dirs, files in os.walk(top):
                dirs[:] = [x for x in dirs if x != "__pycache__"]
                for f in files:
                    if f.endswith(".py"):
                        p = os.path.join(d, f)
                        z.write(p, os.path.relpath(p, os.path.dirname(top)))
        sc.addPyFile(at)
    sc._loomstone_shipped = True
