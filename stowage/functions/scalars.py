"""Small value functions: sizes, truncation, names and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Transfer part size and how many parts one file may have.
DEFAULT_PART_BYTES = 10 * 1_048_576
MAX_PARTS = 10_000
MAX_PART_BYTES = 2**31 - 1

# Column widths of the audit and usage records.
TEXT_WIDTH = 255
STACK_TRACE_WIDTH = 2048


def chunk_size(file_size: Column) -> Column:
    """Part size in bytes: grows in 10 MiB steps so that 10 000 parts suffice."""
    span = F.lit(DEFAULT_PART_BYTES * MAX_PARTS)
    steps = F.call_function("div", file_size - F.lit(1), span)
    return F.least(
        (steps + F.lit(1)) * F.lit(DEFAULT_PART_BYTES), F.lit(MAX_PART_BYTES)
    ).cast("bigint")


def safe_value(text: Column, width: int = TEXT_WIDTH) -> Column:
    return F.substring(text, 1, width)


def users_list(users: Column) -> Column:
    """Names of a ``;`` list; null or empty gives an empty array."""
    return F.filter(F.split(F.coalesce(users, F.lit("")), ";"), lambda name: name != "")


def timestamp_name(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def restore_expiry(is_restoring: Column, expires: Column, zone: str = "UTC") -> Column:
    """When a finished restore ends; null while restoring or when not restored."""
    text = F.concat(F.date_format(expires, "MM/dd/yyyy hh:mm"), F.lit(f" {zone}"))
    return F.when(~F.coalesce(is_restoring, F.lit(False)) & expires.isNotNull(), text)


def is_empty(file_size: Column) -> Column:
    return file_size == 0
