"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stowage")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Scratch folder of each local application that was started without a shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one named in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="stowage-")
        base = _LOCAL[application]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system Spark finds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that is used several times to the shared folder and read it back.

    Lost executors then cost the re-reading of files, not the work behind them,
    and the planner knows the size from the files.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="stowage-"), "stowage")
        archive = shutil.make_archive(
            target, "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
