"""Opening and listing stores on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

LISTED = (
    "path string, modificationTime timestamp, length bigint, directory boolean, error string"
)
LISTING_ROWS = 10_000


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style URI; a bare path is local."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri.removeprefix("s3a://")
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_input(uri: str) -> pa.NativeFile:
    system, path = resolve(uri)
    return system.open_input_file(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A bare path with the scheme of the session's default file system."""
    if "://" in path or path.startswith("file:"):
        return path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return place.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session shuffles with."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _entries(system: fs.FileSystem, base: str, folder: str) -> Iterator[tuple]:
    """Rows of the children of one folder; a base that is a file is its own only row."""
    place = f"{base}/{folder}".rstrip("/") or "/"
    if not folder:
        itself = system.get_file_info(place)
        if itself.is_file:
            yield "", itself.mtime_ns, itself.size, False, None
            return
    try:
        children = system.get_file_info(fs.FileSelector(place))
    except OSError as problem:
        if not folder:
            raise
        yield folder, None, None, True, str(problem)
        return
    for entry in children:
        is_folder = entry.type == fs.FileType.Directory
        name = f"{folder}{entry.base_name}{'/' if is_folder else ''}"
        yield name, entry.mtime_ns, 0 if is_folder else entry.size, is_folder, None


def _children_of(root: str, batch_rows: int):
    """A lister for batches of folders below `root`, given relative to it."""
    columns = ["path", "modificationTime", "length", "directory", "error"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        listed = pd.DataFrame(rows, columns=columns)
        micros = [None if ns is None else ns // 1000 for ns in listed["modificationTime"]]
        listed["modificationTime"] = pd.to_datetime(micros, unit="us", utc=True)
        return listed.astype({"length": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = resolve(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch["folder"]:
                rows: list[tuple] = []
                for row in _entries(system, base, folder):
                    rows.append(row)
                    if len(rows) == batch_rows:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return read


def list_tree(
    spark: SparkSession, root: str, start: str = "", batch_rows: int = LISTING_ROWS
) -> DataFrame:
    """Everything below a root by its path relative to it, empty and hidden files included.

    The tree is listed level by level: the folders found on one level are spread
    over the cluster and listed by the executors, so the number of rounds is the
    depth of the tree. A folder that cannot be listed gives one more row, with `error`.
    """
    first = f"{start.strip('/')}/" if start.strip("/") else ""
    frontier = spark.createDataFrame([(first,)], "folder string")
    levels: list[DataFrame] = []
    while not levels or not frontier.isEmpty():
        listed = spread(frontier, "folder").mapInPandas(_children_of(root, batch_rows), LISTED)
        levels.append(materialize(listed, "listing"))
        found = levels[-1].where(F.col("directory") & F.col("error").isNull())
        frontier = found.select(F.col("path").alias("folder"))
    return reduce(DataFrame.unionByName, levels)


def path_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of every file below the given paths, empty and hidden ones included.

    A path may be a file itself. A folder that cannot be listed fails the job, since its
    files would be missing without anybody noticing.
    """
    tables = []
    for given in [path] if isinstance(path, str) else path:
        root = qualified(spark, given).rstrip("/")
        below = F.when(F.col("path") == "", F.lit(root)).otherwise(
            F.concat(F.lit(f"{root}/"), "path")
        )
        name = F.when(F.col("error").isNotNull(), F.raise_error("error").cast("string"))
        listed = list_tree(spark, root).where(~F.col("directory") | F.col("error").isNotNull())
        tables.append(listed.select(name.otherwise(below).alias("path"), "length"))
    return spread(reduce(DataFrame.unionByName, tables))
