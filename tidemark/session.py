"""Session set-up and staging of intermediate tables in shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators rely on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return ship_package(use_utc(spark))


def use_utc(spark: SparkSession) -> SparkSession:
    """Panels are zone-free; a fixed session zone keeps hour arithmetic free of clock changes."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever they were started; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        source = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, files in os.walk(source):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(source)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


_private: dict[str, str] = {}  # folders of local sessions without the setting


def staging_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Only a local session may lack one: it gets a private folder, removed at exit."""
    application = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _private.get(application)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _private[application] = folder
    return folder


_staged: dict[str, list[str]] = {}


def drop_staged(spark: SparkSession) -> int:
    """Delete all tables this application has staged, once nothing that reads them is needed any more; how many."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several later steps read the same expensive result. Unlike a cached plan it survives the
    loss of executors, and unlike an RDD checkpoint it keeps column pruning and size statistics. ``drop_staged`` deletes
    the copies.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)
