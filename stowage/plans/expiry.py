"""Which temporary files to drop to win space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators.scale import broadcast_if_small

# Ages in hours after which temporary files may go, oldest first.
CUTOFF_HOURS = (24, 12, 6, 3, 1)


def has_prefix(prefix: str) -> Column:
    """File names that start with the prefix in all upper or all lower case."""
    name = paths.file_name(F.col("path"))
    return name.startswith(prefix.lower()) | name.startswith(prefix.upper())


def _moment(now: str, kind: str) -> Column:
    return F.lit(now).cast("timestamp").cast(kind)


def temp_space(
    items: DataFrame, prefix: str, now: str | None = None, older_than_minutes: int | None = None
) -> DataFrame:
    """Bytes of temporary files per drive, optionally only those old enough."""
    chosen = items.where(has_prefix(prefix))
    if older_than_minutes is not None:
        kind = dict(items.dtypes)["modified_date"]
        limit = _moment(now, kind) - F.expr(f"INTERVAL {int(older_than_minutes)} MINUTES")
        chosen = chosen.where(F.col("modified_date") <= limit)
    return chosen.groupBy("drive_id").agg(
        F.sum("file_size").alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def expiry_plan(items: DataFrame, need: DataFrame, now: str, prefix: str) -> DataFrame:
    """Temporary files to drop per drive so that `need_bytes` fit.

    `need` holds (drive_id, free_bytes, need_bytes). The oldest cutoff that
    wins enough is used; when even all temporary files would not be enough
    nothing is dropped, and when no cutoff suffices everything past the last
    cutoff goes. `sufficient` tells whether the need is met.
    """
    kind = dict(items.dtypes)["modified_date"]
    temp = items.where(has_prefix(prefix))

    def older(hours: int | Column) -> Column:
        limit = _moment(now, kind) - F.expr(f"INTERVAL {hours} HOURS")
        return F.col("modified_date") <= limit

    won = [
        F.coalesce(F.sum(F.when(older(h), F.col("file_size"))), F.lit(0)).alias(f"_won_{h}")
        for h in CUTOFF_HOURS
    ]
    totals = temp.groupBy("drive_id").agg(F.sum("file_size").alias("_all"), *won)
    free, wanted = F.col("free_bytes"), F.col("need_bytes")
    choices = [(free + F.col(f"_won_{h}") >= wanted, F.lit(h)) for h in CUTOFF_HOURS]
    cutoff = reduce(
        lambda chain, choice: chain.when(*choice),
        choices,
        F.when((free >= wanted) | (free + F.col("_all") < wanted), F.lit(None).cast("int")),
    ).otherwise(F.lit(CUTOFF_HOURS[-1]))
    enough = F.lit(False)
    for h in CUTOFF_HOURS:
        enough = enough | (free + F.col(f"_won_{h}") >= wanted)
    chosen = (
        need.join(totals, "drive_id")
        .select("drive_id", cutoff.alias("cutoff_hours"), enough.alias("sufficient"))
        .where(F.col("cutoff_hours").isNotNull())
    )
    past = F.lit(False)
    for h in CUTOFF_HOURS:
        past = past | ((F.col("cutoff_hours") == h) & older(h))
    return (
        temp.join(broadcast_if_small(chosen), "drive_id")
        .where(past)
        .select("drive_id", "path", "file_size", "cutoff_hours", "sufficient")
    )
