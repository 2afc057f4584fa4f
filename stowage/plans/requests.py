"""Parts shared by the plans: access of requested paths and expansion into items."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators.access import with_held
from ..operators.scale import broadcast_if_small
from ..session import materialize


def with_access(
    requests: DataFrame,
    rules: DataFrame,
    user: str,
    roles: Iterable[str],
    drive: str,
    path: str,
    levels: list[str],
    prefix: str,
) -> DataFrame:
    """Requests with a boolean `<prefix>_<level>` for each level on (drive, path)."""
    # the access operator works on columns drive_id and path
    renamed = requests.select(
        F.struct(*requests.columns).alias("_request"),
        F.col(drive).alias("drive_id"),
        F.col(path).alias("path"),
    )
    held = with_held(renamed, rules, user, list(roles), levels)
    return held.select(
        "_request.*", *[F.col(f"_held_{level}").alias(f"{prefix}_{level}") for level in levels]
    )


def request_keys(path: Column) -> Column:
    """The keys a requested path stands for: a file of that name, or the folder."""
    bare = paths.remove_first_slash(path)
    folder = paths.folder_key(path)
    return F.when(paths.is_directory(path) | paths.is_root(path), F.array(folder)).otherwise(
        F.array(bare, folder)
    )


def _folders_below(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Wanted rows with every folder at or below theirs that holds items directly.

    Only the distinct parent folders are exploded into their ancestors, so the
    prefix test becomes an equality join over folders and not over items.
    """
    parents = items.select(
        F.col("drive_id").alias("_drive"),
        paths.parent_folder_path(F.col("path")).alias("_parent"),
    ).distinct()
    chains = parents.select(
        "*", F.explode(paths.self_and_ancestors_of_folder(F.col("_parent"))).alias("_key")
    )
    return chains.join(wanted, ["_drive", "_key"])


def expand(
    requests: DataFrame,
    items: DataFrame,
    drive: str = "drive_id",
    path: str = "path",
    small: bool = False,
) -> DataFrame:
    """Each request with the items it covers, in columns prefixed `item_`.

    A request is joined to the folders it covers first and to the items by
    (drive, parent folder) and by exact path then. Where requests and folders
    are few, both are broadcast and the items stay in place; otherwise the
    joins are on those keys, and Spark splits a skewed one.
    `in_folder` tells descendants from an item named exactly; `is_self` marks the
    stored row of a requested folder.
    """
    wanted = requests.select(
        "*", F.col(drive).alias("_drive"), F.explode(request_keys(F.col(path))).alias("_key")
    )
    bare = paths.remove_first_slash(F.col("path"))
    keyed = items.select(
        F.col("drive_id").alias("_drive"),
        *[F.col(c).alias(f"item_{c}") for c in items.columns],
        bare.alias("_key"),
        paths.parent_folder_path(F.col("path")).alias("_parent"),
    )
    columns = [*requests.columns, *[f"item_{c}" for c in items.columns]]
    below = materialize(
        _folders_below(hint(wanted, small), items).drop("_key"), "request-folders"
    )
    inside = keyed.join(broadcast_if_small(below), ["_drive", "_parent"]).select(
        *columns, F.lit(True).alias("in_folder"), F.lit(False).alias("is_self")
    )
    exact = keyed.join(hint(wanted, small), ["_drive", "_key"]).select(
        *columns,
        F.lit(False).alias("in_folder"),
        paths.is_directory(F.col("_key")).alias("is_self"),
    )
    return inside.unionByName(exact)


def hint(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side with at most one row per request when the requests are few."""
    return F.broadcast(df) if small else df


def reason(*cases: tuple[Column, str]) -> Column:
    """The first reason whose test holds, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for test, text in cases:
        out = out.when(F.coalesce(test, F.lit(False)), F.lit(text))
    return out
