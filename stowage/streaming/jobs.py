"""Streams over audit events, upload chunks and new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import stream_catalog
from ..sources.snapshots import HISTORY_SCHEMA
from ..session import folder_exists, shared_folder

__all__ = [
    "drain_to_table", "read_uploads", "stream_audit_statistics", "stream_catalog",
    "stream_upload_status", "stream_uploads", "stream_usage_history",
]


def stream_audit_statistics(
    audit: DataFrame, window: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Counts per action and status in tumbling windows of event time."""
    timed = audit.withColumn("created", F.col("created").cast("timestamp"))
    return (
        timed.withWatermark("created", delay)
        .groupBy(F.window("created", window), "action", "status")
        .agg(F.count(F.lit(1)).alias("actions"))
        .select("window.start", "window.end", "action", "status", "actions")
    )


def stream_upload_status(
    chunks: DataFrame, timeout: str = "1 hour", arrival: str = "arrived"
) -> DataFrame:
    """Progress per upload while chunks arrive; complete when every index was seen.

    State per upload is a few numbers, not its bytes: the chunks themselves stay
    in their table, and `assemble_chunks` reads those of complete uploads. A
    chunk that is sent again within the timeout counts once, one with a negative
    index not at all. An upload that stays silent for the timeout is closed: it leaves the
    state, later chunks start a new row, and the old one, still incomplete, is an abandoned
    upload.
    """
    once = _sent_once(chunks, timeout, arrival)
    inside = F.col("chunk_index") >= 0
    sessions = once.groupBy("file_uid", F.session_window(arrival, timeout)).agg(
        F.count(F.when(inside, 1)).alias("chunks_present"),
        F.max("total_chunks").alias("total_chunks"),
        F.max("chunk_index").alias("last_index"),
        F.sum(F.when(inside, F.octet_length("data").cast("bigint"))).alias("bytes"),
    )
    return _progress(sessions.withColumn("started", F.col("session_window.start")))


def _sent_once(chunks: DataFrame, timeout: str, arrival: str) -> DataFrame:
    timed = chunks.withColumn(arrival, F.col(arrival).cast("timestamp"))
    return timed.withWatermark(arrival, timeout).dropDuplicatesWithinWatermark(
        ["file_uid", "chunk_index"]
    )


def _progress(sessions: DataFrame) -> DataFrame:
    whole = (F.col("chunks_present") == F.col("total_chunks")) & (
        F.col("last_index") == F.col("total_chunks") - 1
    )
    return sessions.select(
        "file_uid", "started", "chunks_present", "total_chunks", "bytes", whole.alias("complete")
    )


def stream_uploads(
    chunks: DataFrame, path: str, checkpoint: str, timeout: str = "1 hour",
    arrival: str = "arrived", once: bool = True,
) -> StreamingQuery:
    """Keep a table of all uploads, open ones too, up to date with each micro-batch of chunks.

    Rows are those of `stream_upload_status`, by (file_uid, started). Each batch merges its chunks
    into the open uploads and writes them to the one of two folders that the batch before did not
    write; uploads the watermark has closed move to a folder of their own and are not read
    again. A repeated batch replaces what it wrote. `read_uploads` reads the table.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        inside = F.col("chunk_index") >= 0
        rows = batch.select(
            "file_uid",
            F.col(arrival).alias("started"),
            F.lit(timeout).alias("gap"),
            inside.cast("bigint").alias("chunks_present"),
            "total_chunks",
            F.col("chunk_index").alias("last_index"),
            F.when(inside, F.octet_length("data").cast("bigint")).alias("bytes"),
        )
        mark = None
        if batch_id:
            before = batch.sparkSession.read.parquet(f"{path}/open/{(batch_id - 1) % 2}")
            # The last chunk so far ended an hour (or what the timeout is) before its upload does;
            # later batches may still hold chunks that the watermark of the batch before let in.
            pause = F.lit(timeout).cast("interval")
            mark, some = before.agg(
                F.unix_micros(F.max("ended") - pause - pause), F.max("closed")
            ).first()
            if some:
                before.where("closed").drop("batch").write.mode("overwrite").parquet(
                    f"{path}/closed/batch={batch_id - 1}"
                )
            length = F.unix_micros("ended") - F.unix_micros("started")
            still = before.where(~F.col("closed"))
            still = still.withColumn("gap", F.concat(length.cast("string"), F.lit(" microseconds")))
            rows = rows.unionByName(still.select(rows.columns))
        merged = rows.groupBy("file_uid", F.session_window("started", F.col("gap"))).agg(
            F.coalesce(F.sum("chunks_present"), F.lit(0)).alias("chunks_present"),
            F.max("total_chunks").alias("total_chunks"),
            F.max("last_index").alias("last_index"),
            F.sum("bytes").alias("bytes"),
        )
        merged.select(
            "file_uid",
            F.col("session_window.start").alias("started"),
            F.col("session_window.end").alias("ended"),
            "chunks_present", "total_chunks", "last_index", "bytes",
            F.coalesce(F.unix_micros("session_window.end") <= F.lit(mark).cast("bigint"), F.lit(False))
            .alias("closed"),
            F.lit(batch_id).cast("bigint").alias("batch"),
        ).write.mode("overwrite").parquet(f"{path}/open/{batch_id % 2}")

    writer = _sent_once(chunks, timeout, arrival).writeStream.outputMode("update")
    writer = writer.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """The uploads as the last whole batch of `stream_uploads` left them."""
    versions = [f"{path}/open/{i}" for i in (0, 1) if folder_exists(spark, f"{path}/open/{i}/_SUCCESS")]
    rows = spark.read.parquet(*versions)
    last = rows.agg(F.max("batch")).first()[0]
    rows = rows.where(F.col("batch") == F.lit(last).cast("bigint"))
    if last and folder_exists(spark, f"{path}/closed"):
        schema = rows.schema
        closed = spark.read.schema(schema).parquet(f"{path}/closed")
        rows = rows.unionByName(closed.where(F.col("batch") < last))
    return _progress(rows)


def stream_usage_history(
    catalog: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append the bytes per drive of each micro-batch of catalog rows to a history table.

    Each batch writes its own folder and replaces it when the batch is repeated,
    so a restarted stream does not count anything twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        totals = batch.groupBy("drive_id").agg(F.sum("file_size").alias("bytes"))
        totals.select(
            F.col("drive_id").cast("int"),
            F.current_timestamp().alias("created"),
            F.col("bytes").cast("bigint"),
            F.lit("/").alias("path"),
        ).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = catalog.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_stream_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{HISTORY_SCHEMA}, batch bigint").parquet(path)


def drain_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and return the rows it has closed.

    Append mode: a window or an upload is written once, when the watermark has passed it,
    and its state is dropped then. What is still open at the end stays in the checkpoint
    for the next run and is not among the rows.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    result = f"{folder}/result"
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(result)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(result)
