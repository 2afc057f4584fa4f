"""Storage-class changes and restores of archived files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..operators.drives import storage_classes
from ..operators.scale import fits_broadcast
from .requests import expand, hint, reason, with_access

# Drive types that know storage classes, and those that can restore.
CLOUD_TYPES = ("Blob", "GCS", "S3")
RESTORABLE_TYPES = ("Blob", "S3")


def _with_type(requests: DataFrame, drives: DataFrame) -> DataFrame:
    kinds = drives.select("drive_id", "drive_type")
    return requests.join(hint(kinds, fits_broadcast(kinds)), "drive_id", "left")


def storage_class_plan(
    requests: DataFrame,
    items: DataFrame,
    drives: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str] = (),
) -> DataFrame:
    """Old and new class per requested item; needs Archive and a cloud drive.

    The new class has to be one the drive's type knows.
    """
    held = with_access(
        _with_type(requests, drives), rules, user, roles, "drive_id", "path", ["A"], "may"
    )
    classes = F.broadcast(  # a fixed list
        storage_classes(items.sparkSession).select(
            "drive_type", F.col("storage_class").alias("new_class"), F.lit(True).alias("known")
        )
    )
    current = items.select("drive_id", "path", F.col("storage_class").alias("old_class"))
    wanted = held.join(classes, ["drive_type", "new_class"], "left")
    small = fits_broadcast(requests)
    present = current.join(
        hint(wanted.select("request_id", "drive_id", "path"), small), ["drive_id", "path"]
    ).select("request_id", "old_class", F.lit(True).alias("present"))
    found = wanted.join(hint(present, small), "request_id", "left")
    why = reason(
        (F.col("drive_type").isNull(), "no drive"),
        (~F.col("may_A"), "no permission"),
        (~F.col("drive_type").isin(*CLOUD_TYPES), "not a cloud drive"),
        (F.col("known").isNull(), "unknown storage class"),
        (F.col("present").isNull(), "not found"),
    )
    return found.select(
        "request_id", "drive_id", "path", "old_class", "new_class", why.alias("reason")
    ).withColumn("decision", F.when(F.col("reason").isNull(), "change").otherwise("reject"))


def restore_plan(
    requests: DataFrame,
    items: DataFrame,
    drives: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str] = (),
) -> DataFrame:
    """Files to restore per request, one row per refused request.

    Needs Restore and a drive that can restore. A folder yields the files whose
    class needs restoring and that are not being restored; a file named exactly
    is always asked for.
    """
    small = fits_broadcast(requests)
    held = with_access(
        _with_type(requests, drives), rules, user, roles, "drive_id", "path", ["U"], "may"
    )
    checked = held.withColumn(
        "reason",
        reason(
            (F.col("drive_type").isNull(), "no drive"),
            (~F.col("may_U"), "no permission"),
            (~F.col("drive_type").isin(*RESTORABLE_TYPES), "not a restorable drive"),
        ),
    ).drop("may_U")
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    classes = F.broadcast(
        storage_classes(items.sparkSession).select(
            "drive_type", F.col("storage_class").alias("item_storage_class"), "restore_required"
        )
    )
    covered = expand(valid, items, small=small).where(
        ~F.col("is_self") & ~paths.is_directory(F.col("item_path"))
    )
    restoring = (
        F.coalesce("item_is_restoring", F.lit(False))
        if "is_restoring" in items.columns
        else F.lit(False)
    )
    needed = F.coalesce("restore_required", F.lit(False)) & ~restoring
    chosen = covered.join(classes, ["drive_type", "item_storage_class"], "left").where(
        ~F.col("in_folder") | needed
    )
    granted = chosen.select(
        "request_id",
        "drive_id",
        F.col("item_path").alias("path"),
        F.lit("restore").alias("decision"),
        F.lit(None).cast("string").alias("reason"),
    )
    refused = checked.where(F.col("reason").isNotNull()).select(
        "request_id", "drive_id", "path", F.lit("reject").alias("decision"), "reason"
    )
    return granted.unionByName(refused)
