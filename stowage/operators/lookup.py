"""Set-wise lookups of requested paths in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from .query import ancestor_closure
from .scale import broadcast_if_small


def items_and_folders(items: DataFrame) -> DataFrame:
    """(drive, path) of every item and of every folder that exists because of one."""
    return items.select("drive_id", "path").unionByName(ancestor_closure(items))


def _hits(items: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted keys that occur among the items."""
    return items.join(broadcast_if_small(wanted.distinct()), keys, "left_semi").distinct()


def any_exists(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: does any of its paths name an existing child of its parent folder?

    Names compare without case. A request may have many paths.
    """
    keys = ["drive_id", "parent", "name"]
    columns = [
        "drive_id",
        paths.parent_folder_path(F.col("path")).alias("parent"),
        F.lower(paths.file_name(F.col("path"))).alias("name"),
    ]
    wanted = requests.select("request_id", *columns)
    known = items_and_folders(items).select(*columns)
    found = _hits(known, wanted.select(*keys), keys).withColumn("found", F.lit(True))
    return (
        wanted.join(found, keys, "left")
        .groupBy("request_id")
        .agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("any_exists"))
    )


def path_exists(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: is the path an item, or a folder with something below it?"""
    keys = ["drive_id", "key"]
    bare = paths.remove_first_slash(F.col("path"))
    forms = F.array_distinct(F.array(bare, paths.add_last_slash(bare)))
    wanted = requests.select("request_id", "drive_id", "path", F.explode(forms).alias("key"))
    known = items_and_folders(items).select("drive_id", bare.alias("key"))
    found = _hits(known, wanted.select(*keys), keys).withColumn("found", F.lit(True))
    return (
        wanted.join(found, keys, "left")
        .groupBy("request_id", "drive_id", "path")
        .agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("exists"))
    )


def get_items(items: DataFrame, requests: DataFrame) -> DataFrame:
    """The item each request names, by parent folder and file name.

    A request without a match gives no row; a file comes before a folder of the
    same name.
    """
    keys = ["drive_id", "_parent", "_name"]
    parts = [
        paths.parent_folder_path(F.col("path")).alias("_parent"),
        paths.file_name(F.col("path")).alias("_name"),
    ]
    wanted = requests.select("request_id", "drive_id", *parts)
    rest = [c for c in items.columns if c not in ("drive_id", "path")]
    matches = items.select("*", *parts).join(broadcast_if_small(wanted), keys)
    first = F.min(F.struct("path", *rest)).alias("_item")
    return (
        matches.groupBy("request_id", "drive_id")
        .agg(first)
        .select("request_id", "drive_id", "_item.*")
    )


def existing_keys(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (drive_id, key) pairs that exist as a file or a folder.

    Keys are paths without outer slashes.
    """
    bare = paths.remove_both_slashes(F.col("path"))
    known = items_and_folders(items).select("drive_id", bare.alias("key"))
    return _hits(known, wanted, ["drive_id", "key"])
