"""Delete plans: permission, expansion and a safe order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..operators.scale import fits_broadcast, running_position
from ..session import materialize
from .requests import expand, hint, with_access


def delete_plan(
    requests: DataFrame,
    items: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str] = (),
) -> DataFrame:
    """Every item to delete with its place in the order, one row per refused request.

    Files come first by path, folders follow from the deepest up. A folder never
    takes siblings along that merely share its name as a prefix, such as
    ``dir.zip`` next to ``dir/``. An item that several requests cover is deleted by the
    first of them; for the others it is ``covered`` and has no place.
    """
    held = materialize(
        with_access(requests, rules, user, roles, "drive_id", "path", ["D"], "may"),
        "delete-requests",
    )
    allowed = held.where("may_D").drop("may_D")
    small = fits_broadcast(allowed)
    covered = materialize(
        expand(allowed, items, small=small).select(
            "request_id",
            "drive_id",
            F.col("item_path").alias("path"),
            (F.col("item_directory") | paths.is_directory(F.col("item_path"))).alias("is_folder"),
        ),
        "delete-items",
    )
    owners = covered.groupBy("drive_id", "path").agg(F.min("request_id").alias("_owner"))
    marked = materialize(covered.join(owners, ["drive_id", "path"]), "delete-owners")
    own = marked.where(F.col("request_id") == F.col("_owner")).drop("_owner")
    placed = running_position(own, ["request_id", "is_folder"], ["path"], "_place", "_count")
    files = own.where(~F.col("is_folder")).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_files")
    )
    from_below = F.coalesce("_files", F.lit(0)) + F.col("_count") - F.col("_place") + 1
    ordered = placed.join(hint(files, small), "request_id", "left").select(
        "request_id",
        "drive_id",
        "path",
        F.when(F.col("is_folder"), from_below).otherwise(F.col("_place")).alias("ordinal"),
        F.lit("delete").alias("decision"),
        F.lit(None).cast("string").alias("reason"),
    )
    elsewhere = marked.where(F.col("request_id") != F.col("_owner")).select(
        "request_id",
        "drive_id",
        "path",
        F.lit(None).cast("bigint").alias("ordinal"),
        F.lit("covered").alias("decision"),
        F.lit(None).cast("string").alias("reason"),
    )
    missing = allowed.join(
        hint(covered.select("request_id").distinct(), small), "request_id", "left_anti"
    ).withColumn("reason", F.lit("not found"))
    denied = held.where(~F.col("may_D")).drop("may_D").withColumn("reason", F.lit("no permission"))
    refused = denied.unionByName(missing).select(
        "request_id",
        "drive_id",
        "path",
        F.lit(None).cast("bigint").alias("ordinal"),
        F.lit("reject").alias("decision"),
        "reason",
    )
    return ordered.unionByName(elsewhere).unionByName(refused)
