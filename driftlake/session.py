"""A session with the defaults that the engine is tuned for."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their Python path has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "") + os.pathsep + spark.conf.get("spark.executorEnv.PYTHONPATH", "")
    if app in _shipped or root in paths.split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="driftlake-")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "driftlake"), "zip", root, "driftlake"))
    _shipped.add(app)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder named in spark.checkpoint.dir; where it is unset, a local master's session gets a folder of its own.

    On a cluster executors don't share local folders, so the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="driftlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: computed once, and safe when executors are lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on. On a cluster leave ``shuffle_partitions`` to its configuration; AQE merges small ones."""
    b = SparkSession.builder.appName("driftlake").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
