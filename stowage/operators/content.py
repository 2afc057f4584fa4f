"""Content as data: lines of texts, part lists and chunk assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from ..functions import scalars
from ..session import materialize
from .scale import running_total

LINE_BREAK = r"\r\n|\n|\r"
SEGMENT_BYTES = 16 * 1024 * 1024


def _lines(text: Column, limit: int = -1) -> Column:
    """Lines of a text; a break at the very end does not open another line.

    With a limit, everything past it stays in one last element.
    """
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK, limit)
    )


def top_lines(texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The first n lines of each text as (key, line_no, line)."""
    head = F.slice(_lines(F.col(text), n + 1), 1, n) if n > 0 else F.array().cast("array<string>")
    return texts.select(key, F.posexplode(head).alias("line_no", "line"))


def first_line(texts: DataFrame, key: str, text: str) -> DataFrame:
    """First line of each text, empty when the text is empty."""
    line = F.coalesce(F.get(_lines(F.col(text), 2), F.lit(0)), F.lit(""))
    return texts.select(key, line.alias("line"))


def preview(texts: DataFrame, key: str, text: str, top: int, bottom: int) -> DataFrame:
    """First `top` and last `bottom` lines of each text, all lines when those overlap."""
    split = texts.select(key, _lines(F.col(text)).alias("_lines"))
    count = F.size("_lines")
    numbered = F.transform("_lines", lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    shown = F.filter(
        numbered, lambda entry: (entry["line_no"] < top) | (entry["line_no"] >= count - bottom)
    )
    return split.select(key, F.inline(shown))


def chunk_manifest(items: DataFrame) -> DataFrame:
    """The parts of each file as (part_number, start_byte, part_bytes); an empty file has one."""
    size, part = F.col("file_size"), F.col("_part")
    last = F.greatest(size - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), last, part)
    return (
        items.select("drive_id", "path", "file_size", scalars.chunk_size(size).alias("_part"))
        .select("drive_id", "path", "file_size", "_part", F.posexplode(starts).alias("_ix", "start_byte"))
        .select(
            "drive_id",
            "path",
            (F.col("_ix") + 1).alias("part_number"),
            "start_byte",
            F.least(part, size - F.col("start_byte")).alias("part_bytes"),
        )
    )


def upload_status(chunks: DataFrame) -> DataFrame:
    """Per upload: chunks present, chunks announced, and whether all of them are there.

    Chunks that were sent again count once.
    """
    present = chunks.groupBy("file_uid", "chunk_index").agg(
        F.max("total_chunks").alias("total_chunks")
    )
    expected = F.max("total_chunks")
    inside = F.count(F.when(F.col("chunk_index") >= 0, 1))
    whole = (inside == expected) & (F.max("chunk_index") == expected - 1)
    return present.groupBy("file_uid").agg(
        inside.alias("chunks_present"), expected.alias("total_chunks"), whole.alias("complete")
    )


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of complete uploads with their byte offset in the assembled file.

    Offsets are summed over (upload, index, size) rows; the data itself is
    shuffled once, by (upload, index). Of copies that differ the longest counts.
    """
    key = ["file_uid", "chunk_index"]
    size = F.octet_length("data").cast("bigint")
    done = upload_status(chunks).where("complete").select("file_uid")
    whole = chunks.join(done, "file_uid", "left_semi")
    sizes = materialize(whole.groupBy(*key).agg(F.max(size).alias("_size")), "chunk-sizes")
    placed = running_total(sizes, key[:1], key[1:], F.col("_size"), "_end", "file_bytes")
    once = whole.groupBy(*key).agg(F.max(F.struct(size.alias("size"), "data")).alias("_chunk"))
    return once.join(placed, key).select(
        *key, (F.col("_end") - F.col("_size")).alias("start_byte"), "_chunk.data", "file_bytes"
    )


def assemble_chunks(chunks: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Complete uploads, concatenated in chunk order, cut into segments.

    A segment holds the chunks that start within its `segment_bytes` of the
    file, so a file up to that size is one row and a larger one is several rows
    in order; no row and no group grows with the file. The content has the type of `data`.
    """
    placed = placed_chunks(chunks).withColumn(
        "segment", F.floor(F.col("start_byte") / segment_bytes)
    )
    # empty chunks add nothing to the content; an empty file keeps its first one
    kept = placed.where((F.octet_length("data") > 0) | (F.col("chunk_index") == 0))
    in_order = F.sort_array(F.collect_list(F.struct("chunk_index", "data")))
    if isinstance(chunks.schema["data"].dataType, BinaryType):
        content = F.unhex(F.array_join(F.transform(in_order, lambda c: F.hex(c["data"])), ""))
    else:
        content = F.array_join(F.transform(in_order, lambda c: c["data"]), "")
    return kept.groupBy("file_uid", "segment", "file_bytes").agg(
        F.min("start_byte").alias("start_byte"),
        content.alias("content"),
    )
