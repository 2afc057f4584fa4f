"""Files as rows of bytes: ranges, archive entries and copies, read on the executors."""

from __future__ import annotations

import gzip
import tarfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from .lzw import open_lzw
from .stores import open_input, resolve, spread

BLOCK_BYTES = 4 * 1024 * 1024

# How often a copy is tried and how long it rests in between.
COPY_ATTEMPTS = 20
COPY_PAUSE_SECONDS = 1.0

# Archive extensions; only Z is told apart by case, gz in any case.
ZIP_EXTENSIONS = ("ear", "jar", "war", "zip", "ZIP")
ARCHIVE_MESSAGE = "left alone, its ending names no kind of archive"


def byte_range(files: DataFrame, start: int, n: int, block: int = BLOCK_BYTES) -> DataFrame:
    """Bytes [start, start + n) of each file as (path, start_byte, data) blocks.

    `files` has path and length. A range that ends past the file comes back
    short; one that begins past it gives no row. Each block is its own row and
    is read by itself, so a wide range of one file is read by many tasks.
    """
    end, step = F.least(F.col("length"), F.lit(start + n)), F.lit(block).cast("bigint")
    starts = F.sequence(F.lit(start).cast("bigint"), end - 1, step)
    blocks = files.where((F.col("length") > start) & F.lit(n > 0)).select(
        "path", end.alias("_end"), F.explode(starts).alias("start_byte")
    )
    size = F.least(step, F.col("_end") - F.col("start_byte"))
    wanted = blocks.select("path", "start_byte", size.alias("_size"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, offset, size in batch.itertuples(index=False):
                with open_input(path) as source:
                    source.seek(int(offset))
                    data = source.read(int(size))
                yield pd.DataFrame({"path": [path], "start_byte": [offset], "data": [data]})

    schema = "path string, start_byte bigint, data binary"
    return spread(wanted, "path", "start_byte").mapInPandas(read, schema)


# --- archives ---------------------------------------------------------------

EXTRACTED = (
    "archive string, entry string, target string, start_byte bigint, data binary, error string"
)


def _archive_kind(path: Column) -> Column:
    ending = paths.extension(paths.file_name(path))
    return (
        F.when(ending == "Z", "Z")
        .when(F.lower(ending) == "gz", "gz")
        .when(ending == "tar", "tar")
        .when(ending.isin(*ZIP_EXTENSIONS), "zip")
        .otherwise("other")
    )


def _blocks(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """A stream in blocks with their offsets; an empty stream is one empty block."""
    offset = 0
    while True:
        data = stream.read(BLOCK_BYTES)
        if data or offset == 0:
            yield offset, data
        if len(data) == 0:
            return
        offset += len(data)


def _read_unit(path: str, kind: str, entry: str | None) -> Iterator[tuple[str | None, int, bytes]]:
    """(entry, offset, bytes) of one zip entry, or of everything in another archive."""
    with open_input(path) as source:
        if kind == "zip":
            with zipfile.ZipFile(source) as archive, archive.open(entry) as stream:
                for offset, data in _blocks(stream):
                    yield entry, offset, data
        elif kind == "tar":
            with tarfile.open(fileobj=source, mode="r|") as archive:
                for member in archive:
                    if member.isfile():
                        for offset, data in _blocks(archive.extractfile(member)):
                            yield member.name, offset, data
        else:
            opener = gzip.GzipFile(fileobj=source) if kind == "gz" else open_lzw(source)
            with opener as stream:
                for offset, data in _blocks(stream):
                    yield None, offset, data


def _list_zip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, kind in batch.itertuples(index=False):
            try:
                with open_input(path) as source, zipfile.ZipFile(source) as archive:
                    names = [i.filename for i in archive.infolist() if not i.is_dir()]
                error = None
            except (OSError, ValueError, zipfile.BadZipFile) as problem:
                names, error = [None], str(problem)
            yield pd.DataFrame(
                {"path": path, "kind": kind, "entry": names, "error": error}, dtype="object"
            )


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "entry", "target", "start_byte", "data", "error"]
    for batch in batches:
        for path, kind, entry, error, target in batch.itertuples(index=False):
            if error is not None:
                yield pd.DataFrame([(path, entry, None, None, None, error)], columns=columns)
                continue
            try:
                for name, offset, data in _read_unit(path, kind, entry):
                    place = target if name is None else f"{target}/{name}"
                    yield pd.DataFrame([(path, name, place, offset, data, None)], columns=columns)
            except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError) as problem:
                yield pd.DataFrame([(path, entry, None, None, None, str(problem))], columns=columns)


def extract_archives(files: DataFrame) -> DataFrame:
    """The contents of zip, jar, ear, war, tar, gz and Z files as blocks of bytes.

    Entries go below the archive's path without its extension. Zip archives are
    listed first and each entry is its own unit of work; the other formats can
    only be read from the front, one task per archive. Entries longer than a
    block come as several rows, ordered by `start_byte`. An archive that cannot
    be read, or of another kind, gives a row with `error`.
    """
    archives = files.select("path", _archive_kind(F.col("path")).alias("kind"))
    zipped = archives.where(F.col("kind") == "zip").mapInPandas(
        _list_zip, "path string, kind string, entry string, error string"
    )
    ending = paths.extension(paths.file_name(F.col("path")))
    refused = F.concat(F.lit(f"{ARCHIVE_MESSAGE}: "), ending)
    others = archives.where(F.col("kind") != "zip").select(
        "path",
        "kind",
        F.lit(None).cast("string").alias("entry"),
        F.when(F.col("kind") == "other", refused).alias("error"),
    )
    parent = paths.add_last_slash(paths.parent_folder(F.col("path")))
    target = F.concat(parent, paths.base_name(F.col("path")))
    units = zipped.unionByName(others).withColumn("target", target)
    return spread(units, "path", "entry").mapInPandas(_extract, EXTRACTED)


# --- copies -----------------------------------------------------------------

COPIED = (
    "source string, target string, bytes_transferred bigint, status string,"
    " message string, attempts int"
)


def _copy_one(source: str, target: str, move: bool) -> int:
    """Copy one file through a temporary name, so that a lost task leaves no half file."""
    source_system, source_path = resolve(source)
    target_system, target_path = resolve(target)
    info = source_system.get_file_info(source_path)
    there = target_system.get_file_info(target_path)
    if move and info.type == fs.FileType.NotFound and there.type == fs.FileType.File:
        return there.size  # an earlier attempt of this task got this far
    target_system.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
    partial = f"{target_path}._copying-{uuid.uuid4().hex}"
    copied = 0
    with source_system.open_input_stream(source_path) as reading:
        with target_system.open_output_stream(partial) as writing:
            while data := reading.read(BLOCK_BYTES):
                writing.write(data)
                copied += len(data)
    target_system.move(partial, target_path)
    if move:
        source_system.delete_file(source_path)
    return copied


def _copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source, target, move in batch.itertuples(index=False):
            size, status, message, attempt = 0, "E", None, 0
            while status == "E" and attempt < COPY_ATTEMPTS:
                attempt += 1
                try:
                    size, status, message = _copy_one(source, target, bool(move)), "S", None
                except FileNotFoundError as problem:
                    message = str(problem)
                    break
                except OSError as problem:
                    message = str(problem)
                    time.sleep(COPY_PAUSE_SECONDS)
            rows.append((source, target, size, status, message, attempt))
        yield pd.DataFrame(
            rows,
            columns=["source", "target", "bytes_transferred", "status", "message", "attempts"],
        )


def bulk_copy(plan: DataFrame, audit_path: str) -> DataFrame:
    """Carry out a plan of (source, target, remove_source) and return the audit rows.

    The audit is written to `audit_path` and read back, so that looking at it
    twice does not copy twice.
    """
    chosen = plan.select("source", "target", F.col("remove_source").alias("move"))
    spread(chosen, "source", "target").mapInPandas(_copy, COPIED).write.mode("append").parquet(
        audit_path
    )
    return plan.sparkSession.read.schema(COPIED).parquet(audit_path)
