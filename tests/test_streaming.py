import os

import pytest
from pyspark.sql import functions as F

from stowage.operators.content import upload_status
from stowage.streaming import jobs


def test_statistics_match_batch(spark, folder):
    rows = [(f"2024-01-0{d} 0{h}:15:00", a, s) for d in (1, 2) for h in range(5) for a in "xy" for s in "SE"]
    batch = spark.createDataFrame(rows, "created string, action string, status string")
    batch = batch.withColumn("created", F.col("created").cast("timestamp_ntz"))
    batch.repartition(3).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/events")
    final = jobs.drain_to_table(jobs.stream_audit_statistics(stream, "1 hour"), "test-statistics")
    got = {(str(r.start)[:13], r.action, r.status): r.actions for r in final.collect()}
    closed = [(d, h) for d in (1, 2) for h in range(5) if (d, h) != (2, 4)]  # the last hour is open
    assert got == {(f"2024-01-0{d} 0{h}", a, s): 1 for d, h in closed for a in "xy" for s in "SE"}


def test_state_shrinks(spark, folder):
    schema = "created string, action string, status string"

    def run(hour):
        rows = [(f"2024-01-01 {hour}:{m:02}:00", f"a{m}", "S") for m in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/events")
        query = jobs.stream_audit_statistics(stream).writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", f"{folder}/checkpoint"
        ).trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]

    assert [run(hour) for hour in ("01", "05", "09", "13")] == [60] * 4


def test_uploads(spark, folder):
    rows = [("whole", i, 3, "ab", "2024-01-01 00:00:00") for i in range(3)]
    rows += [("again", i, 2, "x", "2024-01-01 00:00:00") for i in (0, 0, 1, -1)]
    rows += [("left", 0, 3, "x", "2024-01-01 00:00:00"), ("open", 0, 1, "x", "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "file_uid string, chunk_index bigint, total_chunks bigint, data string, arrived string")
    df.repartition(2).write.parquet(f"{folder}/chunks")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/chunks")
    final = jobs.drain_to_table(jobs.stream_upload_status(stream), "test-uploads").collect()
    got = {r.file_uid: (r.chunks_present, r.complete, r.bytes) for r in final}
    assert got == {"whole": (3, True, 6), "again": (2, True, 2), "left": (1, False, 1)}
    batch = {r.file_uid: (r.chunks_present, r.complete) for r in upload_status(df.drop("arrived")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v for k, v in batch.items() if k != "open"}


def test_abandoned_uploads_are_closed(spark, folder):
    schema = "file_uid string, chunk_index bigint, total_chunks bigint, data string, arrived string"

    def arrive(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/chunks")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/chunks")
        jobs.stream_upload_status(stream, "10 minutes").writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", f"{folder}/checkpoint"
        ).trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        if not os.path.exists(f"{folder}/out/_spark_metadata"):
            return {}
        return {r.file_uid: r.complete for r in spark.read.parquet(f"{folder}/out").collect()}

    arrive("1", ("left", 0, 2, "x", "2024-01-01 00:00:00"), ("done", 0, 1, "x", "2024-01-01 00:00:00"))
    run()
    arrive("2", ("later", 0, 2, "x", "2024-01-01 02:00:00"))
    run()
    arrive("3", ("more", 0, 2, "x", "2024-01-01 04:00:00"))
    got = run()
    assert got["left"] is False and got["done"] is True and "more" not in got


def test_open_and_closed_uploads_are_rows(spark, folder):
    schema = "file_uid string, chunk_index bigint, total_chunks bigint, data string, arrived string"

    def run(*rows):
        rows = [(u, i, n, "ab", f"2024-01-01 {at}") for u, i, n, at in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/chunks")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/chunks")
        jobs.stream_uploads(stream, f"{folder}/out", f"{folder}/checkpoint", "10 minutes").awaitTermination()
        got = jobs.read_uploads(spark, f"{folder}/out").collect()
        assert len({(r.file_uid, r.started) for r in got}) == len(got)
        return sorted((r.file_uid, str(r.started)[11:16], r.chunks_present, r["bytes"], r.complete) for r in got)

    first = run(("done", 0, 1, "00:00:00"), ("left", 0, 2, "00:00:00"), ("slow", 1, 2, "00:05:00"))
    assert first == [("done", "00:00", 1, 2, True), ("left", "00:00", 1, 2, False), ("slow", "00:05", 1, 2, False)]
    # an earlier chunk of another batch joins its upload, one sent again counts once
    second = run(("slow", 0, 2, "00:01:00"), ("slow", 1, 2, "00:06:00"), ("next", 0, 2, "00:08:00"))
    assert ("slow", "00:01", 2, 4, True) in second and len(second) == 4
    third = run(("left", 1, 2, "03:00:00"))
    assert third == sorted([*second, ("left", "03:00", 1, 2, False)])
    fourth = run(("more", 0, 1, "05:00:00"))
    fifth = run(("more", -1, 1, "05:00:01"))
    assert fourth == fifth == sorted([*third, ("more", "05:00", 1, 2, True)])
    # closed uploads have left the table that the batches merge into
    last = max(spark.read.parquet(f"{folder}/out/open/{i}").agg(F.max("batch")).first()[0] for i in (0, 1))
    left = {r.file_uid for r in spark.read.parquet(f"{folder}/out/open/{last % 2}").where("not closed").collect()}
    assert left == {"more"}


def test_registered_uploads_are_all_there(spark):
    from stowage.datasets import Tables
    from stowage import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    chunks = Tables(spark, folder).upload_chunk()
    rests = (F.col("file_uid") % 5 == 0) & (F.col("chunk_index") >= 1)
    want = chunks.groupBy("file_uid", rests.alias("rests")).agg(F.count(F.lit(1)).alias("n"), F.max("total_chunks").alias("total"))
    got = queries.registered()["stream_assemble_chunks"](spark, folder)
    assert sorted((r.file_uid, r.chunks_present, r.total_chunks) for r in got.collect()) == sorted(
        (r.file_uid, r.n, r.total) for r in want.collect()
    )


def test_catalog_stream_and_history(spark, folder):
    os.makedirs(f"{folder}/store/a")
    for name, size in (("_x", 3), ("a/y", 4), ("a/.none", 0)):
        with open(f"{folder}/store/{name}", "wb") as out:
            out.write(b"." * size)

    def run():
        stream = jobs.stream_catalog(spark, f"{folder}/store", 5, f"{folder}/listed")
        jobs.stream_usage_history(stream, f"{folder}/history", f"{folder}/checkpoint").awaitTermination()
        rows = jobs.read_stream_history(spark, f"{folder}/history").collect()
        return sorted((r.batch, r.drive_id, r["bytes"], r.path) for r in rows)

    assert run() == [(0, 5, 7, "/")]
    with open(f"{folder}/store/a/z", "wb") as out:
        out.write(b"." * 10)
    assert run() == [(0, 5, 7, "/"), (1, 5, 10, "/")]
    listed = spark.read.parquet(f"{folder}/listed")
    assert sorted(r.path for r in listed.collect()) == ["_x", "a/.none", "a/y", "a/z"]
