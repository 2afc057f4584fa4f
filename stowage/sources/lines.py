"""Lines of files, read on the executors in ranges of bytes.

Lines end at ``\\r\\n``, ``\\n`` or ``\\r``. Bytes that are no UTF-8 become replacement
characters; a byte order mark in front is left out. Files with the extension of a
compression are decompressed, which only works from the front.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .files import BLOCK_BYTES
from .stores import open_input, resolve, spread

BREAK = re.compile(rb"\r\n|\n|\r")
MARK = b"\xef\xbb\xbf"
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
CHUNK_BYTES = 64 * 1024
BATCH_LINES = 10_000


def split_lines(chunks: Iterable[bytes], offset: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of every line; a break at the very end opens no other line."""
    begin, parts, held = offset, [], b""
    for chunk in chunks:
        data = held + chunk
        # a \r at the end may be the first half of a break
        held = b"\r" if data.endswith(b"\r") else b""
        data = data[: len(data) - len(held)]
        at = 0
        for found in BREAK.finditer(data):
            parts.append(data[at : found.start()])
            yield begin, b"".join(parts)
            parts, at = [], found.end()
            begin = offset + at
        parts.append(data[at:])
        offset += len(data)
    if held or any(parts):
        yield begin, b"".join(parts)


def _chunks(path: str, start: int = 0, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    if path.endswith(COMPRESSED):
        system, place = resolve(path)
        source = system.open_input_stream(place, compression="detect")
    else:
        source = open_input(path)
        source.seek(start)
    with source:
        while chunk := source.read(size):
            yield chunk


def _lines_within(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in [start, end), looking one byte back for the break before."""
    back = max(start - 1, 0)
    for offset, line in split_lines(_chunks(path, back), back):
        if end is not None and offset >= end:
            return
        if offset >= start:
            yield offset, line


def _last_lines(path: str, length: int, n: int) -> list[tuple[int, bytes]]:
    """The last n lines, from a window at the end that grows until it holds them."""
    if path.endswith(COMPRESSED):
        return list(deque(split_lines(_chunks(path)), maxlen=n))
    width = CHUNK_BYTES
    while True:
        start = max(length - width, 0)
        found = deque(_lines_within(path, start, None), maxlen=n)
        if len(found) == n or start == 0:
            return list(found)
        width *= 4


def _text(offset: int, line: bytes) -> str:
    return (line.removeprefix(MARK) if offset == 0 else line).decode("utf-8", "replace")


def file_lines(files: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Every line of every file of (path, length) as (path, line_no, line, line_count).

    Files are read in blocks. A line belongs to the block it begins in; its number is its
    place there plus the lines of the file's earlier blocks. Blocks are counted first and
    read again with the number of their first line, so one large file is read and numbered
    by many tasks, and only counts are shuffled and joined, never lines: Spark cannot know
    how large these are and would broadcast them.
    """
    packed = F.col("path").rlike(r"\.(gz|bz2|zst|lz4)\z")
    starts = F.when(packed, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))
    )
    end = F.when(~packed, F.col("_start") + block)
    units = files.where("length > 0").select("path", F.explode(starts).alias("_start"), "length")
    units = units.select("path", "_start", end.alias("_end"))

    def within(path: str, start: int, end: float) -> Iterator[tuple[int, bytes]]:
        return _lines_within(path, int(start), None if pd.isna(end) else int(end))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = [sum(1 for _ in within(*unit)) for unit in batch.itertuples(index=False)]
            yield batch[["path", "_start"]].assign(_n=counted)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, end, before, total in batch.itertuples(index=False):
                numbered = enumerate(within(path, start, end), int(before))
                while some := list(islice(numbered, BATCH_LINES)):
                    yield pd.DataFrame({
                        "path": path, "line_no": [i for i, _ in some],
                        "line": [_text(*found) for _, found in some], "line_count": total,
                    })

    counted = spread(units, "path", "_start").mapInPandas(count, "path string, _start bigint, _n bigint")
    counts = counted.groupBy("path", "_start").agg(F.sum("_n").alias("_n"))
    of_file = Window.partitionBy("path")
    earlier = of_file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "path", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(of_file).alias("line_count"),
    )
    numbered = units.join(offsets.hint("merge"), ["path", "_start"])
    return spread(numbered, "path", "_start").mapInPandas(
        read, "path string, line_no bigint, line string, line_count bigint"
    )


def _per_file(files: DataFrame, read, schema: str) -> DataFrame:
    """One small frame per file from `read(path, length)`; contents are not shuffled."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in batch.itertuples(index=False):
                frame = read(path, int(length))
                if len(frame):
                    yield frame

    return files.select("path", "length").mapInPandas(each, schema)


def file_top_lines(files: DataFrame, n: int) -> DataFrame:
    """The first n lines of each file as (path, line_no, line); only its beginning is read."""

    def read(path: str, length: int) -> pd.DataFrame:
        found = [_text(*line) for line in islice(split_lines(_chunks(path)), n)]
        return pd.DataFrame({"path": path, "line_no": range(len(found)), "line": found})

    return _per_file(files, read, "path string, line_no bigint, line string")


def file_preview(files: DataFrame, top: int, bottom: int) -> DataFrame:
    """First `top` and last `bottom` lines of each file, each once, as (path, start_byte, line).

    Only the two ends of a file are read. `start_byte` is where the line begins in the
    (decompressed) file, so it gives the order; numbers would take a pass over the whole file.
    """

    def read(path: str, length: int) -> pd.DataFrame:
        found = dict(islice(split_lines(_chunks(path)), top))
        found.update(_last_lines(path, length, bottom) if bottom else [])
        return pd.DataFrame({
            "path": path, "start_byte": list(found), "line": [_text(*line) for line in found.items()]
        })

    return _per_file(files, read, "path string, start_byte bigint, line string")
