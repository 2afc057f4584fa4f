"""The audit grid: filters, sort, page and total."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .scale import broadcast_if_small

DRIVE_FIELD = "drive.driveId"
CREATED_FIELD = "created"


@dataclass(frozen=True)
class GridFilter:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class GridSpec:
    sort_field: str
    sort_dir: str | None = None
    start_row: int = 0
    end_row: int = 50
    filters: list[GridFilter] = field(default_factory=list)


def _like(column: Column, pattern: str) -> Column:
    """`%` and `_` of the value are wildcards, backslashes are themselves."""
    return column.cast("string").like(pattern.replace("\\", "\\\\"))


def condition(column: Column, operator: str, value: Any, data_type: str = "string") -> Column:
    """One grid operator over one column; nulls drop out as in SQL."""
    typed = F.lit(value) if data_type == "string" else F.lit(value).try_cast(data_type)
    conditions = {
        "contains": lambda: _like(column, f"%{value}%"),
        "doesnotcontain": lambda: ~_like(column, f"%{value}%"),
        "startswith": lambda: _like(column, f"{value}%"),
        "endswith": lambda: _like(column, f"%{value}"),
        "eq": lambda: column == typed,
        "neq": lambda: column != typed,
        "isnull": column.isNull,
        "isnotnull": column.isNotNull,
        "isempty": lambda: column.cast("string") == "",
        "isnotempty": lambda: column.cast("string") != "",
    }
    if operator not in conditions:
        raise ValueError(f"unknown grid operator: {operator}")
    return conditions[operator]()


def created_on(day: str) -> Column:
    """The whole of one day, whatever operator the grid sent; a time after the date is ignored."""
    first = dt.date.fromisoformat(day.strip()[:10])
    created = F.col(CREATED_FIELD)
    return (created >= F.lit(first)) & (created < F.lit(first + dt.timedelta(days=1)))


def grid_filter(df: DataFrame, filters: list[GridFilter], drives: DataFrame | None = None) -> DataFrame:
    """All filters joined by AND; the drive filter is a semi join with `drives`."""
    types = dict(df.dtypes)
    tests = []
    for item in filters:
        if item.field == DRIVE_FIELD:
            if drives is None:
                raise ValueError("the drive filter needs the drive table")
            value = "" if item.value is None else str(item.value)
            wanted = drives.where(
                condition(F.col("drive_id").cast("string"), item.operator, value)
            ).select("drive_id")
            df = df.join(broadcast_if_small(wanted), "drive_id", "left_semi")
        elif item.field == CREATED_FIELD:
            tests.append(created_on(str(item.value)))
        else:
            tests.append(
                condition(F.col(item.field), item.operator, item.value, types[item.field])
            )
    return df.where(reduce(and_, tests)) if tests else df


def grid_sort(df: DataFrame, spec: GridSpec, tie: str) -> DataFrame:
    """Nulls last going up and first going down; `tie` makes pages repeatable."""
    name = "drive_id" if spec.sort_field == DRIVE_FIELD else spec.sort_field
    upward = spec.sort_dir in (None, "asc")
    key = F.col(name).asc_nulls_last() if upward else F.col(name).desc_nulls_first()
    return df.orderBy(key, F.col(tie).asc())


def grid(
    df: DataFrame,
    spec: GridSpec,
    drives: DataFrame | None = None,
    tie: str = "action_audit_id",
) -> DataFrame:
    """One page of the filtered and sorted rows."""
    rows = grid_sort(grid_filter(df, spec.filters, drives), spec, tie)
    return rows.offset(spec.start_row).limit(spec.end_row - spec.start_row)


def grid_total(df: DataFrame, spec: GridSpec, drives: DataFrame | None = None) -> DataFrame:
    """Row count under the same filters."""
    return grid_filter(df, spec.filters, drives).agg(F.count(F.lit(1)).alias("total"))
