"""The catalog query, one-level listing, and set operations on items."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

# Default name of the marker file that keeps an otherwise empty cloud folder alive.
PLACEHOLDER_NAME = ".placeholder"


def full_match(pattern: str) -> str:
    """A pattern for ``rlike`` that has to cover the whole text."""
    return rf"\A(?:{pattern})\z"


def _start(start: str | None) -> str:
    """The start path with both outer slashes."""
    inner = (start or "/").removesuffix("/").removeprefix("/")
    return f"/{inner}/" if inner else "/"


def not_root() -> Column:
    return ~paths.is_root(F.col("path"))


def at_level(start: str | None) -> Column:
    parent = paths.add_both_slashes(paths.parent_folder_path(F.col("path")))
    return parent == _start(start)


def not_self(start: str | None) -> Column:
    return ~paths.matches_path(F.col("path"), F.lit(_start(start)))


def not_placeholder(placeholder_name: str = PLACEHOLDER_NAME) -> Column:
    return paths.file_name(F.col("path")) != placeholder_name


def inside(start: str | None) -> Column:
    """Below the start folder, with or without a leading slash.

    Plain prefix tests, so that they reach the scan.
    """
    key = _start(start)
    if key == "/":
        return F.lit(True)
    return F.col("path").startswith(key.removeprefix("/")) | F.col("path").startswith(key)


def path_matches(pattern: str) -> Column:
    return F.col("path").rlike(full_match(pattern))


def name_matches(pattern: str) -> Column:
    name = paths.file_name(F.col("path"))
    return (name == pattern) | name.rlike(full_match(pattern))


def query_items(
    items: DataFrame,
    start: str | None = None,
    recursive: bool = False,
    pattern: str | None = None,
    placeholder: bool = False,
    on: str = "path",
    placeholder_name: str = PLACEHOLDER_NAME,
) -> DataFrame:
    """Items below `start` (direct children unless `recursive`) that match `pattern`.

    The pattern has to cover the whole path, or the whole file name when `on`
    is ``"name"``. Placeholder files stay hidden unless asked for.
    """
    rooted = _start(start) == "/"
    tests = [not_root()] if rooted else [inside(start), not_self(start)]
    if not recursive:
        tests.append(at_level(start))
    if not placeholder:
        tests.append(not_placeholder(placeholder_name))
    if pattern:
        tests.append(name_matches(pattern) if on == "name" else path_matches(pattern))
    return items.where(reduce(and_, tests))


def prefix_folders(items: DataFrame, start: str | None = None) -> DataFrame:
    """The folders directly below `start` that exist because something lies in them."""
    prefix = _start(start).removeprefix("/")
    bare = paths.remove_first_slash(F.col("path"))
    rest = F.substring(bare, len(prefix) + 1, 2147483647)
    folder = F.concat(F.lit(prefix), F.substring_index(rest, "/", 1), F.lit("/"))
    below = inside(start) & (F.instr(rest, "/") > 0)
    return items.where(below).select("drive_id", folder.alias("path")).distinct()


def with_prefix_folders(items: DataFrame, start: str | None = None) -> DataFrame:
    """Items below `start`, plus one folder row per common prefix at that level."""
    folders = prefix_folders(items, start).select(
        "*", F.lit(True).alias("directory"), F.lit(0).cast("bigint").alias("file_size")
    )
    return items.where(inside(start)).unionByName(folders, allowMissingColumns=True)


def list_one_level(
    items: DataFrame, start: str | None = None, placeholder_name: str = PLACEHOLDER_NAME
) -> DataFrame:
    """Immediate children of `start`: files, and folders whether stored or implied."""
    files = query_items(items, start, placeholder_name=placeholder_name).where(
        ~paths.is_directory(F.col("path"))
    )
    folders = prefix_folders(items, start).select(
        "*", F.lit(True).alias("directory"), F.lit(0).cast("bigint").alias("file_size")
    )
    return files.unionByName(folders, allowMissingColumns=True)


def distinct_items(items: DataFrame, newest: str = "modified_date") -> DataFrame:
    """One row per (drive, path): the newest, ties broken by the remaining columns."""
    rest = [c for c in items.columns if c not in ("drive_id", "path", newest)]
    best = items.groupBy("drive_id", "path").agg(F.max(F.struct(newest, *rest)).alias("_best"))
    return best.select("drive_id", "path", "_best.*").select(*items.columns)


def ancestor_closure(items: DataFrame, with_root: bool = False) -> DataFrame:
    """Every folder above the items, once per drive.

    The parent folders are made distinct before they are exploded, so the
    explode sees folders and not files.
    """
    parents = items.select("drive_id", paths.parent_folder_path(F.col("path")).alias("folder"))
    chain = paths.self_and_ancestors_of_folder(F.col("folder"))
    folders = parents.distinct().select("drive_id", F.explode(chain).alias("path")).distinct()
    return folders if with_root else folders.where(F.col("path") != "/")


def path_profile(items: DataFrame) -> DataFrame:
    """Every derived path column over a whole catalog, in one narrow pass."""
    path = F.col("path")
    name = paths.file_name(path)
    return items.select(
        "drive_id",
        "path",
        name.alias("file_name"),
        paths.extension(name).alias("extension"),
        paths.is_directory(path).alias("is_directory"),
        paths.parent_folder(path).alias("parent_folder"),
        paths.parent_folder_path(path).alias("parent_folder_path"),
        paths.add_first_slash(path).alias("add_first_slash"),
        paths.add_last_slash(path).alias("add_last_slash"),
        paths.add_both_slashes(path).alias("add_both_slashes"),
        paths.remove_first_slash(path).alias("remove_first_slash"),
        paths.remove_last_slash(path).alias("remove_last_slash"),
        paths.remove_both_slashes(path).alias("remove_both_slashes"),
        paths.to_unix(path).alias("to_unix"),
        paths.to_windows(path).alias("to_windows"),
        paths.has_drive_letter(path).alias("has_drive_letter"),
        paths.remove_drive_letter(path).alias("remove_drive_letter"),
        paths.is_root(path).alias("is_root"),
        paths.avsc_location(path).alias("avsc_location"),
    )
