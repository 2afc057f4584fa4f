"""Audit events: statistics, current state, recent actions and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scale import broadcast_if_small, running_position

TASK_PATH = "task"
PENDING = "P"
RECENT = 50

MATCH_KEYS = ["username", "action", "path", "drive_id", "dest_path", "dest_drive_id", "status"]


def audit_statistics(audit: DataFrame, status: str, since: str) -> DataFrame:
    """Count per action with this status since a time, ordered by action."""
    kind = dict(audit.dtypes)["created"]
    after = F.col("created") > F.lit(since).cast("timestamp").cast(kind)
    return (
        audit.where((F.col("status") == status) & after)
        .groupBy("action")
        .agg(F.count("action").alias("actions"))
        .orderBy("action")
    )


def mask_audit(audit: DataFrame) -> DataFrame:
    """Hide stack traces always and messages unless a row allows them."""
    shown = F.when(F.col("use_message"), F.col("message"))
    masked = audit.withColumn("message", shown)
    if "stack_trace" in audit.columns:
        masked = masked.withColumn("stack_trace", F.lit(None).cast("string"))
    return masked


def _newest(audit: DataFrame, k: int) -> DataFrame:
    order = [F.col("created").desc_nulls_first(), F.col("action_audit_id").desc()]
    return mask_audit(audit.orderBy(*order).limit(k))


def recent_actions(audit: DataFrame, user: str, k: int = RECENT) -> DataFrame:
    return _newest(audit.where(F.col("username") == user), k)


def in_progress(audit: DataFrame, user: str, k: int = RECENT) -> DataFrame:
    """Newest batch tasks of a user that have not ended."""
    open_tasks = (F.col("status") == PENDING) & (F.col("path") == TASK_PATH)
    return _newest(audit.where((F.col("username") == user) & open_tasks), k)


def audit_with_drive(audit: DataFrame, drives: DataFrame) -> DataFrame:
    """Each action with its drive's name and type, null when the drive is gone."""
    return audit.join(
        broadcast_if_small(drives.select("drive_id", "display_name", "drive_type")),
        "drive_id",
        "left",
    )


def latest_matching(audit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest event for each combination of `keys`; nulls group together.

    One max per group merges map-side, so a hot key costs one row per task.
    """
    keys = keys or [k for k in MATCH_KEYS if k in audit.columns]
    rest = [c for c in audit.columns if c not in (*keys, "created", "action_audit_id")]
    newest = F.max(F.struct("created", "action_audit_id", *rest)).alias("_newest")
    return audit.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*audit.columns)


def latest_status(events: DataFrame, key: str = "action_audit_id", updated: str = "updated") -> DataFrame:
    """Current state of an append-only audit: the last event of each action."""
    rest = [c for c in events.columns if c not in (key, updated)]
    last = events.groupBy(key).agg(F.max(F.struct(updated, *rest)).alias("_last"))
    return last.select(key, "_last.*").select(*events.columns)


def transfer_progress(done: DataFrame, batch: str = "batch_id", item: str = "path") -> DataFrame:
    """Items done so far, items in total and rounded percent, in item order per batch."""
    placed = running_position(done, [batch], [item], "done", "total")
    percent = F.floor(F.col("done") / F.col("total") * 100 + 0.5).cast("int")
    return placed.withColumn("percent_complete", percent)


def duration_ms(created: Column, updated: Column) -> Column:
    return F.unix_millis(updated.cast("timestamp")) - F.unix_millis(created.cast("timestamp"))


def with_duration(audit: DataFrame) -> DataFrame:
    return audit.withColumn("duration_ms", duration_ms(F.col("created"), F.col("updated")))
