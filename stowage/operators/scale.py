"""Building blocks that keep large or skewed groups distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
SAMPLE_PER_BUCKET = 16


def _row_bytes(df: DataFrame) -> Column:
    """Rough width of a row: text and lists of text by their bytes, everything else at 16."""
    width = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            width = width + F.coalesce(F.octet_length(F.array_join(column, "")), F.lit(0)) + F.size(column) * 16
        elif isinstance(kind, StringType):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        else:
            width = width + F.lit(16)
    return width


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a supposedly small side; reads at most `max_rows` + 1 rows of it."""
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose size was measured; beyond the bound Spark shuffles both sides."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def _bucket_of(row_key: Column, splits: Column, buckets: int) -> Column:
    """How many of the sorted `splits` are <= `row_key`, by binary search."""
    steps = []
    step = 1
    while step <= buckets:
        steps.insert(0, step)
        step *= 2

    def advance(found: Column, step: Column) -> Column:
        ahead = found + step
        passes = (ahead <= F.size(splits)) & (F.get(splits, ahead - 1) <= row_key)
        return F.when(passes, ahead).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def running_total(
    df: DataFrame,
    groups: list[str],
    key: list[str],
    value: Column,
    name: str,
    total_name: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Running sum of `value` per group in ascending `key` order, this row included.

    A plain window would put a whole group in one task. Here the rows are cut
    into ranges of (groups, key) at split points taken from the keys with the
    smallest hashes, a sample of fixed size that depends on the data only. Each
    range is summed first; the row window then runs inside one range of one
    group and adds the sums of the ranges before it. (groups, key) has to be
    unique; null groups and keys are values like any other.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row_key = F.struct(*groups, *key)
    sample = (
        df.select(row_key.alias("k"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(buckets * SAMPLE_PER_BUCKET)
    )
    splits = sample.agg(F.sort_array(F.collect_list("k")).alias("ks")).select(
        F.filter("ks", lambda _, i: (i % SAMPLE_PER_BUCKET) == SAMPLE_PER_BUCKET - 1)
    )
    cut = (
        df.withColumn("_value", value)
        .withColumn("_splits", splits.scalar())
        .withColumn("_bucket", F.coalesce(_bucket_of(row_key, F.col("_splits"), buckets), F.lit(0)))
        .drop("_splits")
    )
    by_range = [*groups, "_bucket"]
    sums = cut.groupBy(*by_range).agg(F.sum("_value").alias("_sum"))
    of_group = Window.partitionBy(*groups)
    before = of_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by_range,
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(of_group).alias("_total"),
    )
    inside = (
        Window.partitionBy(*by_range).orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    )
    renamed = offsets.withColumnsRenamed({c: f"_of_{c}" for c in by_range})
    same = [cut[c].eqNullSafe(renamed[f"_of_{c}"]) for c in by_range]
    out = (
        cut.join(renamed, same).drop(*renamed.columns[: len(by_range)])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .withColumn(total_name or "_total", F.col("_total"))
    )
    helpers = ["_value", "_bucket", "_sum", "_before", "_total"]
    return out.drop(*helpers).select(
        *df.columns, name, *([total_name] if total_name else [])
    )


def running_position(
    df: DataFrame,
    groups: list[str],
    key: list[str],
    name: str = "ordinal",
    total_name: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group, and optionally the group's size."""
    return running_total(df, groups, key, F.lit(1).cast("bigint"), name, total_name)
