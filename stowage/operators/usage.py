"""Usage snapshots: the visible run, folder totals, top files and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from .query import inside
from .scale import broadcast_if_small, running_position

# The path of the row that closes a run, and how far before that
# row's time the rows of the run may lie.
COMPLETED_MARKER = "///COMPLETED///"
RUN_SLACK = "INTERVAL 60 SECONDS"


def is_marker() -> Column:
    return F.col("path") == COMPLETED_MARKER


def last_completed(usage: DataFrame) -> DataFrame:
    """Time of the latest closed run per drive."""
    return (
        usage.where(is_marker())
        .groupBy("drive_id")
        .agg(F.max("created").alias("last_completed"))
    )


def _with_cutoff(usage: DataFrame, how: str) -> DataFrame:
    """Rows with the time that separates the visible run of their drive from older ones."""
    cutoffs = last_completed(usage).select(
        "drive_id", (F.col("last_completed") - F.expr(RUN_SLACK)).alias("_cutoff")
    )
    return usage.join(broadcast_if_small(cutoffs), "drive_id", how)


def _runs_since(usage: DataFrame, cutoff: Column) -> DataFrame:
    """Where the table is partitioned by run, skip the folders of runs before a time."""
    if "run" not in usage.columns:
        return usage
    return usage.where(F.col("run") >= F.unix_micros(cutoff))


def current_usage(usage: DataFrame) -> DataFrame:
    """Files of the visible run of every drive; drives without a closed run have none.

    Rows of a newer run that is still open are visible as well.
    """
    visible = ~is_marker() & (F.col("created") > F.col("_cutoff"))
    if "run" in usage.columns:
        oldest = last_completed(usage).agg(
            (F.min("last_completed") - F.expr(RUN_SLACK)).alias("oldest")
        )
        usage = _runs_since(usage, oldest.scalar())
    return _with_cutoff(usage, "inner").where(visible).drop("_cutoff")


def _run_of_drive(usage: DataFrame, drive_id: int) -> DataFrame:
    """The visible run of one drive; its cutoff is one scalar, not a join."""
    mine = usage.where(F.col("drive_id") == drive_id)
    cutoff = (
        mine.where(is_marker())
        .agg((F.max("created") - F.expr(RUN_SLACK)).alias("cutoff"))
        .scalar()
    )
    return _runs_since(mine, cutoff).where(~is_marker() & (F.col("created") > cutoff))


def below(path: str) -> Column:
    """Plain prefix test, without wildcards; the root covers everything."""
    if path in ("", "/"):
        return F.lit(True)
    return F.col("path").startswith(path)


def folder_usage_total(usage: DataFrame, drive_id: int, path: str) -> DataFrame:
    """Bytes below a folder in the visible run; null when no run was ever closed."""
    return _run_of_drive(usage, drive_id).where(below(path)).agg(F.sum("bytes").alias("bytes"))


def subfolder_usage(usage: DataFrame, drive_id: int, start: str) -> DataFrame:
    """One total per immediate subfolder of `start`, in one pass over the run."""
    prefix = "" if start in ("", "/") else start.removeprefix("/").removesuffix("/") + "/"
    bare = paths.remove_first_slash(F.col("path"))
    rest = F.substring(bare, len(prefix) + 1, 2147483647)
    folder = F.concat(F.lit(prefix), F.substring_index(rest, "/", 1), F.lit("/"))
    return (
        _run_of_drive(usage, drive_id)
        .where(inside(start) & (F.instr(rest, "/") > 0))
        .groupBy(folder.alias("path"))
        .agg(F.sum("bytes").alias("bytes"))
    )


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Bytes and files below every folder of every drive, the root included.

    Files are summed per parent folder first, so only folders are exploded into
    their ancestors.
    """
    per_folder = (
        current_usage(usage)
        .groupBy("drive_id", paths.parent_folder_path(F.col("path")).alias("_parent"))
        .agg(F.sum("bytes").alias("_bytes"), F.count(F.lit(1)).alias("_files"))
    )
    chain = paths.self_and_ancestors_of_folder(F.col("_parent"))
    return (
        per_folder.select("drive_id", F.explode(chain).alias("folder"), "_bytes", "_files")
        .groupBy("drive_id", "folder")
        .agg(F.sum("_bytes").alias("bytes"), F.sum("_files").alias("files"))
    )


def rollup_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed bytes and files per folder, the root included, by which run `after` differs from `before`.

    Both hold the files of one run (drive_id, path, bytes); marker rows are left out and null bytes count 0. Files
    are never matched with each other: every file counts for its parent folder, with its sign, and only folders
    whose sums changed are exploded into their ancestors. Folders without a change have no row.
    """
    signed = [
        run.where(~is_marker()).select(
            "drive_id",
            paths.parent_folder_path(F.col("path")).alias("_parent"),
            (F.coalesce("bytes", F.lit(0)) * sign).alias("_bytes"),
            F.lit(sign).alias("_files"),
        )
        for run, sign in ((before, -1), (after, 1))
    ]
    sums = [F.sum("_bytes").cast("bigint").alias("_bytes"), F.sum("_files").cast("bigint").alias("_files")]
    changed = F.expr("_bytes <> 0 OR _files <> 0")
    parents = signed[0].unionByName(signed[1]).groupBy("drive_id", "_parent").agg(*sums).where(changed)
    chain = paths.self_and_ancestors_of_folder(F.col("_parent"))
    return (
        parents.select("drive_id", F.explode(chain).alias("folder"), "_bytes", "_files")
        .groupBy("drive_id", "folder").agg(*sums).where(changed)
        .withColumnsRenamed({"_bytes": "bytes", "_files": "files"})
    )


def drive_totals(snapshot: DataFrame) -> DataFrame:
    """Bytes per drive over the rows given, marker rows left out."""
    return (
        snapshot.where(~is_marker()).groupBy("drive_id").agg(F.sum("bytes").alias("bytes"))
    )


def biggest_files(usage: DataFrame, drive_id: int, path: str = "/", k: int = 50) -> DataFrame:
    """The k largest files below a folder in the visible run."""
    return (
        _run_of_drive(usage, drive_id)
        .where(below(path))
        .orderBy(F.col("bytes").desc_nulls_first(), "path")
        .limit(k)
    )


def history_range(history: DataFrame, start=None, end=None) -> DataFrame:
    """Points between two times, both included.

    An open end, or one at the epoch that does not lie after the start, means now.
    """
    first = F.lit("1970-01-01 00:00:00" if start is None else start).cast("timestamp")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    if end is None:
        last = F.current_timestamp()
    else:
        asked = F.lit(end).cast("timestamp")
        last = F.when((asked == epoch) & (first >= asked), F.current_timestamp()).otherwise(asked)
    kind = dict(history.dtypes)["created"]
    bounds = [bound.cast(kind) for bound in (first, last)]
    return history.where(F.col("created").between(*bounds))


def usage_history(history: DataFrame, start=None, end=None, k: int = 0) -> DataFrame:
    """At most k points per drive: the first, then evenly spaced ones back from the last.

    k <= 0 keeps every point.
    """
    points = history_range(history, start, end).distinct()
    if k <= 0:
        return points
    placed = running_position(points, ["drive_id"], ["created"], "_place", "_count")
    place = F.col("_place") - 1
    stride = F.floor(F.col("_count") / k)
    first = (F.col("_count") - 1) - (k - 1) * stride
    picked = (place == 0) | ((place > first) & ((place - first) % stride == 0))
    return placed.where((F.col("_count") <= k) | picked).select(*history.columns)


def retention_flags(usage: DataFrame) -> DataFrame:
    """Each row with `expired`: older than its drive's last closed run allows.

    A row exactly at the cutoff is neither visible nor expired.
    """
    flagged = _with_cutoff(usage, "left")
    expired = F.coalesce(F.col("created") < F.col("_cutoff"), F.lit(False))
    return flagged.withColumn("expired", expired).drop("_cutoff")


def expire_snapshots(usage: DataFrame) -> DataFrame:
    """The rows that stay after retention."""
    return retention_flags(usage).where(~F.col("expired")).drop("expired")
