"""Listing a store into catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths
from ..session import folder_exists
from .stores import LISTING_ROWS, list_tree

STORED_SCHEMA = (
    "drive_id int, path string, file_size bigint, modified_date timestamp,"
    " directory boolean, error string"
)


def _scheme_free(uri: Column) -> Column:
    """A URI without its scheme, so that file:/x, file:///x and /x agree."""
    return F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^/+", "/")


def normalize_items(raw: DataFrame, drive_id: int, root: str) -> DataFrame:
    """Listing rows (path, modificationTime, length) as catalog rows below `root`.

    Extra columns `storage_class`, `is_restoring` and `error` of a listing are kept.
    """
    base = _scheme_free(F.lit(root.rstrip("/")))
    path = paths.to_unix(paths.relative_path(base, _scheme_free(F.col("path"))))
    kept = [c for c in ("storage_class", "is_restoring", "error") if c in raw.columns]
    return raw.select(
        F.lit(drive_id).cast("int").alias("drive_id"),
        path.alias("path"),
        F.col("length").cast("bigint").alias("file_size"),
        F.col("modificationTime").alias("modified_date"),
        paths.is_directory(path).alias("directory"),
        *kept,
    )


def scan_catalog(
    spark: SparkSession, root: str, drive_id: int, start: str = "", batch_rows: int = LISTING_ROWS
) -> DataFrame:
    """Every file and folder below a root, empty and hidden ones included.

    `start` narrows the listing to one folder below the root. A folder that cannot be
    listed has one more row with the `error`; the others have none.
    """
    base = root.rstrip("/")
    whole = list_tree(spark, root, start, batch_rows)
    return normalize_items(whole.withColumn("path", F.concat(F.lit(f"{base}/"), "path")), drive_id, root)


def record_new_files(spark: SparkSession, root: str, drive_id: int, table: str) -> None:
    """Append the files below `root` that `table` does not hold yet in this version.

    A version is a path with its size and time. An append that was cut short is made up
    by the next call, which looks at what the table holds.
    """
    found = scan_catalog(spark, root, drive_id).where(~F.col("directory"))
    if folder_exists(spark, table):
        known = spark.read.schema(STORED_SCHEMA).parquet(table)
        version = ["drive_id", "path", "file_size", "modified_date"]
        found = found.join(known.select(version), version, "left_anti")
    found.write.mode("append").parquet(table)


def stream_catalog(spark: SparkSession, root: str, drive_id: int, table: str) -> DataFrame:
    """Files as they appear below `root`, as a stream of catalog rows.

    The store is listed and compared with `table`, which keeps what was found before; the
    stream reads that table. While it runs, `record_new_files` brings in what came since.
    """
    record_new_files(spark, root, drive_id, table)
    return spark.readStream.schema(STORED_SCHEMA).parquet(table).drop("error")
