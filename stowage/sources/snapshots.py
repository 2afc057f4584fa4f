"""Usage snapshots, usage history and audit events as append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.audit import latest_status
from ..operators.scale import broadcast_if_small
from ..operators.usage import (
    COMPLETED_MARKER,
    RUN_SLACK,
    drive_totals,
    last_completed,
)
from ..session import folder_exists, materialize

USAGE_SCHEMA = "path string, bytes bigint, created timestamp, drive_id int, run bigint"
HISTORY_SCHEMA = "drive_id int, created timestamp, bytes bigint, path string"
ROLLUP_SCHEMA = "folder string, bytes bigint, files bigint, as_of bigint, drive_id int, part int"
#: Parts of a drive's stored totals; a table keeps the number it was begun with.
ROLLUP_PARTS = 16


def _rows(items: DataFrame, run_ts: str) -> DataFrame:
    created = F.lit(run_ts).cast("timestamp")
    return items.select(
        "path",
        F.col("file_size").alias("bytes"),
        created.alias("created"),
        F.col("drive_id").cast("int").alias("drive_id"),
        F.unix_micros(created).alias("run"),
    )


def append_snapshot(items: DataFrame, drives: DataFrame, run_ts: str, path: str) -> None:
    """Append one run: all files first, then one marker row per drive.

    The marker is its own append after the data has been committed, so readers
    that go through the last closed run never see half a run. Partitions are
    (drive_id, run), the run as microseconds since 1970 so that sessions in any time
    zone agree, which lets retention drop whole folders; a large drive is
    spread over several writers, and paths are sorted within a file so that a
    folder's rows lie together and other row groups are skipped.
    """
    writer = {"mode": "append", "partitionBy": ["drive_id", "run"]}
    rows = _rows(items, run_ts).hint("rebalance", "drive_id")
    rows.sortWithinPartitions("drive_id", "run", "path").write.parquet(path, **writer)
    markers = drives.select(
        "drive_id",
        F.lit(COMPLETED_MARKER).alias("path"),
        F.lit(0).cast("bigint").alias("file_size"),
    )
    _rows(markers, run_ts).coalesce(1).write.parquet(path, **writer)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_SCHEMA).parquet(path)


def fold_rollup(changes: DataFrame, run_ts: str, path: str, parts: int = ROLLUP_PARTS) -> None:
    """Fold the changes of one run (`usage_rollup` kept by `rollup_changes`) into stored folder totals.

    The table is partitioned by (drive_id, part), the part from a hash of the folder. Only the parts with a change
    are read and written; every row of a part says up to which run it is folded, so a call that was cut short
    is repeated and leaves the parts alone that it had finished. Runs have to come in order, and a run's changes
    are taken against the run folded before it. Folders that lost their last file stay as rows of 0 files, which
    `read_rollup` leaves out. An empty table of changes writes nothing.
    """
    spark = changes.sparkSession
    run = F.unix_micros(F.lit(run_ts).cast("timestamp"))
    key = ["drive_id", "part"]
    placed = materialize(
        changes.select(
            "folder", "bytes", "files", F.col("drive_id").cast("int").alias("drive_id"),
            F.pmod(F.xxhash64("folder"), F.lit(parts)).cast("int").alias("part"),
        ),
        "rollup-changes",
    )
    touched = broadcast_if_small(placed.select(*key).distinct())
    if folder_exists(spark, path):
        stored = spark.read.schema(ROLLUP_SCHEMA).parquet(path).join(touched, key, "left_semi")
        # written apart, since the files read here are replaced below
        stored = materialize(stored, "rollup-parts")
        done = stored.where(F.col("as_of") >= run).select(*key).distinct()
        placed = placed.join(done, key, "left_anti")
        stored = stored.join(done, key, "left_anti").drop("as_of")
        placed = stored.unionByName(placed)
    folded = placed.groupBy(*key, "folder").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    folded.select("folder", "bytes", "files", run.alias("as_of"), *key).sortWithinPartitions(
        *key, "folder"
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)


def read_rollup(spark: SparkSession, path: str, under: str = "/") -> DataFrame:
    """Stored totals (drive_id, folder, bytes, files) of the folders at or below `under`."""
    totals = spark.read.schema(ROLLUP_SCHEMA).parquet(path).where("files > 0")
    if under not in ("", "/"):
        totals = totals.where(F.col("folder").startswith(under.strip("/") + "/"))
    return totals.select("drive_id", "folder", "bytes", "files")


def append_history(snapshot: DataFrame, drives: DataFrame, run_ts: str, path: str) -> None:
    """Append the total of each drive at the run time; a drive without files gets 0."""
    totals = drives.select("drive_id").join(drive_totals(snapshot), "drive_id", "left")
    totals.select(
        F.col("drive_id").cast("int"),
        F.lit(run_ts).cast("timestamp").alias("created"),
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
        F.lit("/").alias("path"),
    ).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def expired_runs(usage: DataFrame) -> DataFrame:
    """The (drive_id, run) partitions that lie wholly before the visible run."""
    cutoffs = last_completed(usage).select(
        "drive_id", (F.col("last_completed") - F.expr(RUN_SLACK)).alias("cutoff")
    )
    runs = usage.select("drive_id", "run").distinct()
    return runs.join(cutoffs, "drive_id").where(F.col("run") < F.unix_micros("cutoff")).select(
        "drive_id", "run"
    )


def purge_snapshots(spark: SparkSession, path: str) -> int:
    """Drop the partitions of expired runs; nothing is rewritten. Returns how many went.

    Only the names of the expired partitions, not rows, come to the driver, one
    at a time.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = 0
    for row in expired_runs(read_usage(spark, path)).toLocalIterator():
        folder = f"{path}/drive_id={row['drive_id']}/run={row['run']}"
        dropped += files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
    return dropped


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit events; a status change is one more event of the same action."""
    events.write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Current state of every action."""
    return latest_status(spark.read.parquet(path))

