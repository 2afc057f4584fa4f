"""WARC archives through a chunked record table.

A payload travels as rows of (record, chunk number, bytes), in order, on its way into an
archive and out of it again, so Python holds one chunk of a record at a time. Digests grow chunk
by chunk. Archives are gzip files with one member per record, written under names that no other
attempt of the task uses; the list of archives names those of the attempts that succeeded, so a
lost executor leaves at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from stowage.session import shared_folder

CHUNK_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 20
#: A revisit needs a payload of at least this many bytes.
LEAST_REVISIT = 100
#: Copies of a payload are spread over this many tasks.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"

CHUNKS = (
    "id bigint, url string, bytes bigint, digest string, refers_to bigint, revisit boolean, "
    "chunk int, chunks int, data binary"
)
ARCHIVES = pa.schema([("path", pa.string()), ("records", pa.int64())])
READ = (
    "id bigint, url string, record_type string, refers_to bigint, declared_bytes bigint, "
    "declared_digest string, chunk int, last boolean, bytes_so_far bigint, digest_so_far string, data binary"
)
READ_ARROW = pa.schema([
    ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk", pa.int32()),
    ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
    ("data", pa.binary()),
])


def payload_chunks(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
    payload_column: str = "html", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The chunked record table of the pages; rows of one record are neighbours, in chunk order.

    Of equal payloads of at least `LEAST_REVISIT` bytes the one with the smallest id is the response
    and the others refer to it; rows that repeat its id are responses too. Null payloads
    are empty; null ids come after all others. An empty payload is one empty chunk.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(url_column).alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("bytes"),
        F.sha2(payload, 256).alias("digest"),
        F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int").alias("salt"),
    )
    # Only payloads that occur more than once are looked up, each of them once per salt.
    firsts = (
        rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    )
    known = rows.join(firsts, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    chunks = F.when(revisit, 1).otherwise(
        F.greatest(F.ceil(F.col("bytes") / chunk_bytes), F.lit(1)).cast("int")
    )
    cut = known.select(
        "id", "url", "payload", "bytes", "digest",
        F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"),
        chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
    )
    data = F.when(
        ~F.col("revisit"), F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    )
    return cut.select(
        "id", "url", "bytes", "digest", "refers_to", "revisit", "chunk", "chunks", data.alias("data")
    )


def record_name(number: int | None) -> str:
    return f"<{RECORD}{'' if number is None else number}>"


def record_number(name: str | None) -> int | None:
    digits = (name or "").strip("<>").removeprefix(RECORD)
    return int(digits) if digits else None


def record_header(row: dict, date: str) -> bytes:
    """WARC header and HTTP header of a record; the payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n"
    body = 0 if row["revisit"] else row["bytes"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
        f"WARC-Record-ID: {record_name(row['id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((row['url'] or '').split())}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
    ]
    if row["revisit"]:
        lines += [f"WARC-Refers-To: {record_name(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    lines += [
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + body}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(chunks: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the chunked record table below `folder`; returns the stored list of archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        out = path = member = None
        records = size = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if out is not None and size > ARCHIVE_BYTES:
                        out.close()
                        done.append((path, records))
                        out, records, size = None, 0, 0
                    if out is None:
                        store.create_dir(root, recursive=True)
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(path, compression=None)
                    member = zlib.compressobj(1, wbits=31)
                    out.write(member.compress(record_header(row, date)))
                    records += 1
                if row["data"]:
                    size += len(row["data"])
                    out.write(member.compress(row["data"]))
                if row["chunk"] == row["chunks"] - 1:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            done.append((path, records))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done), ARCHIVES)], schema=ARCHIVES
            )

    listing = f"{folder}/archives"
    chunks.mapInArrow(write, "path string, records bigint").write.parquet(listing)
    return chunks.sparkSession.read.parquet(listing)


class Unzipped:
    """Bytes of a gzip file of many members, a bounded block at a time."""

    def __init__(self, source):
        self.source, self.inflate, self.data = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        pending = self.inflate.unconsumed_tail or self.inflate.unused_data
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        block = pending or self.source.read(READ_BYTES)
        if not block:
            return False
        self.data += self.inflate.decompress(block, READ_BYTES)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.data.find(mark)) < 0:
            if not self.more():
                return None
        found, self.data = self.data[:at], self.data[at + len(mark) :]
        return found

    def blocks(self, size: int, most: int) -> Iterator[bytes]:
        """The next `size` bytes in blocks of `most`, the last one shorter."""
        while size:
            want = min(size, most)
            while len(self.data) < want:
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            block, self.data = self.data[:want], self.data[want:]
            size -= want
            yield block


def fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def archive_rows(source, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Rows of READ for each chunk of each record of an open archive."""
    stream = Unzipped(source)
    while (header := stream.until(b"\r\n\r\n")) is not None:
        warc = fields(header)
        http_header = stream.until(b"\r\n\r\n")
        if http_header is None:
            raise ValueError("the archive ends inside a record")
        left = int(warc["content-length"]) - len(http_header) - 4
        fixed = (
            record_number(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"],
            record_number(warc.get("warc-refers-to")), int(fields(http_header)["content-length"]),
            warc["warc-payload-digest"].removeprefix("sha256:"),
        )
        running, so_far, number = hashlib.sha256(), 0, 0
        for block in stream.blocks(left, chunk_bytes) if left else [b""]:
            running.update(block)
            so_far += len(block)
            yield (
                *fixed, number, so_far == left, so_far, running.copy().hexdigest(),
                block if with_data else None,
            )
            number += 1
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError("a record is longer than its header says")


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives in the column `path`: place, bytes and digest so far, data.

    A record of n bytes has max(1, ceil(n / chunk_bytes)) rows; `last` marks the one whose
    digest and bytes are those of the whole payload. Raises for an archive that is cut short.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as source:
                    rows, held = [], 0
                    for row in archive_rows(source, chunk_bytes, with_data):
                        rows.append(row)
                        held += 200 + (len(row[-1]) if row[-1] else 0)
                        if held > 1 << 23:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return archives.select("path").mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), READ_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=READ_ARROW)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per page, read the archives back, and report each record.

    Sizes and digests of responses are those of the bytes read back. Those of a revisit, which has
    no payload, are the ones its headers declare. Repeated rows are records of their own.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    archives = write_archives(payload_chunks(pages), base)
    # One task per archive; their paths are unique and of about equal size.
    paths = archives.select("path").repartitionByRange(max(1, archives.count()), "path")
    records = read_archives(paths, with_data=False).where("last")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        F.col("id").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), facts AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM facts
"""
