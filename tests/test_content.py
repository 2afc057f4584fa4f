import gzip
import re

import pytest
from pyspark.sql import functions as F

from stowage.operators import content as C
from stowage.sources import lines as L
from stowage.sources.stores import path_table


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def lines(df):
    return [(r.line_no, r.line) for r in df.orderBy("line_no").collect()]


def test_top_lines_of_five(spark):
    df = texts(spark, "1\r\n2\n3\r\r\n5")  # a blank line in fourth place
    whole = [(0, "1"), (1, "2"), (2, "3"), (3, ""), (4, "5")]
    assert lines(C.top_lines(df, "id", "text", 1000)) == whole
    assert lines(C.top_lines(df, "id", "text", 0)) == []
    assert lines(C.top_lines(df, "id", "text", 1)) == whole[:1]
    assert lines(C.top_lines(df, "id", "text", 4)) == whole[:4]
    assert C.first_line(df, "id", "text").first()["line"] == "1"


@pytest.mark.parametrize("text,count", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("\n", 1), ("a\r\nb\r\n", 2)])
def test_line_counts(spark, text, count):
    assert C.top_lines(texts(spark, text), "id", "text", 100).count() == count
    assert C.preview(texts(spark, text), "id", "text", 100, 100).count() == count


def test_preview(spark):
    df = texts(spark, "\n".join(str(i) for i in range(10)))
    assert [n for n, _ in lines(C.preview(df, "id", "text", 2, 3))] == [0, 1, 7, 8, 9]
    assert [n for n, _ in lines(C.preview(df, "id", "text", 6, 6))] == list(range(10))
    assert [n for n, _ in lines(C.preview(df, "id", "text", 0, 1))] == [9]


BODIES = {
    "a.txt": "\r\n".join(f"line {i} " + "x" * (i % 50) for i in range(3000)).encode(),
    "b.txt": b"\xef\xbb\xbf1\n2\n3", "c.txt": b"", "_d": b"\r\r\n\n\r", ".e": b"no break \xff",
    "f": b"\n" * 50, "g": b"x" * 200_000 + b"\r\nlast\r",
}


def lines_of(body):
    text = body.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    parts = re.split(r"\r\n|\n|\r", text)
    return parts[:-1] if parts[-1] == "" else parts


@pytest.fixture
def stored(spark, folder):
    for name, body in BODIES.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(body)
    with gzip.open(f"{folder}/h.gz", "wb") as out:
        out.write(BODIES["a.txt"])
    return path_table(spark, folder), {**BODIES, "h.gz": BODIES["a.txt"]}


@pytest.mark.parametrize("block", [1, 7, 5000, 1 << 22])
def test_lines_of_files_read_in_blocks(stored, block):
    table, bodies = stored
    if block < 100:
        small = [n for n, b in bodies.items() if len(b) < 100]
        table = table.where(F.element_at(F.split("path", "/"), -1).isin(small))
        bodies = {n: bodies[n] for n in small}
    got = {}
    for r in L.file_lines(table, block).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], {})[r.line_no] = (r.line, r.line_count)
    for name, body in bodies.items():
        want = lines_of(body)
        assert got.get(name, {}) == {i: (line, len(want)) for i, line in enumerate(want)}


def test_lines_are_not_joined(stored):
    """Lines leave the scan and go nowhere else: a join could collect them all in the driver."""
    plan = L.file_lines(stored[0])._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInPandas")]
    assert "Join" not in above and "Aggregate" not in above


@pytest.mark.parametrize("top,bottom", [(3, 2), (0, 1), (40, 40), (1, 0), (0, 2999)])
def test_ends_of_files(stored, top, bottom):
    table, bodies = stored
    heads, ends = {}, {}
    for r in L.file_top_lines(table, top).collect():
        heads.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    for r in L.file_preview(table, top, bottom).collect():
        ends.setdefault(r.path.rsplit("/", 1)[1], []).append((r.start_byte, r.line))
    for name, body in bodies.items():
        whole = lines_of(body)
        assert sorted(heads.get(name, [])) == list(enumerate(whole[:top]))
        want = [line for i, line in enumerate(whole) if i < top or i >= len(whole) - bottom]
        assert [line for _, line in sorted(ends.get(name, []))] == want


def test_manifest(spark):
    part = 10 * 1024 * 1024
    df = spark.createDataFrame(
        [(1, "empty", 0), (1, "one", part), (1, "two", part + 1)], "drive_id int, path string, file_size bigint"
    )
    got = [(r.path, r.part_number, r.start_byte, r.part_bytes) for r in C.chunk_manifest(df).collect()]
    assert sorted(got) == [
        ("empty", 1, 0, 0), ("one", 1, 0, part), ("two", 1, 0, part), ("two", 2, part, 1),
    ]


CHUNK = "file_uid string, chunk_index bigint, total_chunks bigint, data string"


def test_assembly(spark):
    rows = [("a", i, 12, f"<{i}>") for i in range(12)] + [("a", 3, 12, "<3>")]
    rows += [("gap", 0, 3, "x"), ("gap", 2, 3, "y"), ("none", 0, 1, ""), ("e", 0, 3, "p"), ("e", 1, 3, ""), ("e", 2, 3, "q")]
    df = spark.createDataFrame(rows, CHUNK)
    status = {r.file_uid: (r.chunks_present, r.complete) for r in C.upload_status(df).collect()}
    assert status == {"a": (12, True), "gap": (2, False), "none": (1, True), "e": (3, True)}
    whole = {r.file_uid: (r.content, r.file_bytes) for r in C.assemble_chunks(df).collect()}
    text = "".join(f"<{i}>" for i in range(12))
    assert whole == {"a": (text, len(text)), "none": ("", 0), "e": ("pq", 2)}
    parts = C.assemble_chunks(df.where("file_uid = 'a'"), segment_bytes=8).orderBy("segment").collect()
    assert len(parts) > 3 and "".join(p.content for p in parts) == text
    assert all(len(p.content) <= 8 + 4 for p in parts)
    assert [p.start_byte for p in parts] == [sum(len(q.content) for q in parts[:i]) for i in range(len(parts))]


def test_binary_chunks_stay_binary(spark):
    data = bytes(range(256)) * 3
    rows = [("f", i, 3, bytearray(data[i * 256 : i * 256 + 256])) for i in (2, 0, 1)]
    chunks = spark.createDataFrame(rows, "file_uid string, chunk_index int, total_chunks int, data binary")
    whole = C.assemble_chunks(chunks)
    assert dict(whole.dtypes)["content"] == "binary"
    assert bytes(whole.first()["content"]) == data
