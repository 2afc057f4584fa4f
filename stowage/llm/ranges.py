"""Ranges and running sums that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def range_of(key: Column, splits: list) -> Column:
    """How many of the sorted values `splits` are at most `key`, by binary search; 0 for a null key."""
    if not splits:
        return F.lit(0)
    values, steps, step = F.array(*map(F.lit, splits)), [], 1
    while step <= len(splits):
        steps.insert(0, step)
        step *= 2

    def advance(found: Column, step: Column) -> Column:
        ahead = found + step
        reached = (ahead <= len(splits)) & (F.get(values, ahead - 1) <= key)
        return F.when(reached, ahead).otherwise(found)

    return F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), advance), F.lit(0))


def running_sum(
    df: DataFrame, group: str, slot: str, order: list, value: Column, name: str, total: str | None = None
) -> DataFrame:
    """Running sum of `value` in each group by (slot, order), the row itself left out.

    `slot` is a number that rises with the order and cuts a group into parts that fit a task. The
    parts are summed first; the row window runs inside one part. Group and slot must not be null.
    """
    keys = [group, slot]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(
        *keys,
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_sum").over(of_group).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(parts, keys)
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_before")
    )
