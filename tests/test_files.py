import gzip
import io
import os
import random
import shutil
import subprocess
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stowage.sources import catalog, files, stores
from stowage.sources.lzw import open_lzw


def compress_z(data, max_bits=16):
    """What ``compress`` writes: LZW codes in groups of eight, widths from 9 bits up."""
    out = bytearray(b"\x1f\x9d" + bytes([0x80 | max_bits]))
    table = {bytes([i]): i for i in range(256)}
    table_size, bits, group = 257, 9, []

    def flush(pad):
        packed = sum(code << (i * bits) for i, code in enumerate(group))
        size = bits if pad else (len(group) * bits + 7) // 8
        out.extend(packed.to_bytes(size, "little"))
        group.clear()

    word = b""
    for i in range(len(data)):
        longer = word + data[i:i + 1]
        if longer in table:
            word = longer
            continue
        group.append(table[word])
        if len(group) == 8:
            flush(True)
        # the reader's table is one entry behind the writer's
        if table_size < 1 << max_bits:
            table[longer] = table_size
            table_size += 1
            if table_size == (1 << bits) + 1 and bits < max_bits:
                if group:
                    flush(True)
                bits += 1
        word = data[i:i + 1]
    if word:
        group.append(table[word])
    if group:
        flush(False)
    return bytes(out)


def sample(size, seed=1):
    chance = random.Random(seed)
    words = [bytes(chance.choices(range(256), k=chance.randint(1, 9))) for _ in range(300)]
    out = bytearray()
    while len(out) < size:
        out += chance.choice(words)
    return bytes(out[:size])


@pytest.mark.parametrize("size,bits", [(0, 16), (1, 16), (300, 16), (20_000, 16), (400_000, 16), (50_000, 12)])
def test_lzw(size, bits):
    data = sample(size)
    packed = compress_z(data, bits)
    tool = shutil.which("gzip")
    if tool and size:
        assert subprocess.run([tool, "-dc"], input=packed, capture_output=True).stdout == data
    assert open_lzw(io.BytesIO(packed)).read() == data


def test_lzw_repeats_and_damage():
    assert open_lzw(io.BytesIO(compress_z(b"a" * 10_000))).read() == b"a" * 10_000
    with pytest.raises(ValueError):
        open_lzw(io.BytesIO(b"PK\x03\x04"))


@pytest.fixture
def archives(folder):
    data = {"one.txt": b"first", "deep/two.bin": sample(9_000_000), "empty": b""}
    with zipfile.ZipFile(f"{folder}/z.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in data.items():
            out.writestr(name, content)
        out.writestr("folder/", b"")
    shutil.copy(f"{folder}/z.zip", f"{folder}/j.jar")
    with tarfile.open(f"{folder}/t.tar", "w") as out:
        for name, content in data.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            out.addfile(info, io.BytesIO(content))
    with gzip.open(f"{folder}/g.txt.gz", "wb") as out:
        out.write(b"zipped")
    with open(f"{folder}/c.txt.Z", "wb") as out:
        out.write(compress_z(b"compressed"))
    with open(f"{folder}/x.rar", "wb") as out:
        out.write(b"nothing")
    with open(f"{folder}/bad.zip", "wb") as out:
        out.write(b"no archive")
    return folder, data


def test_extract(spark, archives):
    folder, data = archives
    rows = files.extract_archives(stores.path_table(spark, folder)).collect()
    content, errors = {}, {}
    for r in sorted(rows, key=lambda r: (r.archive, r.entry or "", r.start_byte or 0)):
        name = r.archive.rsplit("/", 1)[1]
        if r.error:
            errors[name] = r.error
            continue
        held = content.setdefault(r.target.removeprefix(f"file:{folder}/"), b"")
        assert len(held) == r.start_byte and len(r.data) <= files.BLOCK_BYTES
        content[r.target.removeprefix(f"file:{folder}/")] = held + bytes(r.data)
    want = {f"{base}/{name}": body for base in "zjt" for name, body in data.items()}
    want |= {"g.txt": b"zipped", "c.txt": b"compressed"}
    assert content == want
    assert set(errors) == {"x.rar", "bad.zip"}
    assert errors["x.rar"] == f"{files.ARCHIVE_MESSAGE}: rar"


def test_byte_ranges(spark, folder):
    data = sample(100_000)
    for name, size in (("a", 100_000), ("_b", 10), (".c", 0)):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(data[:size])
    table = stores.path_table(spark, folder)
    for start, n in ((0, 5), (3, 7), (8, 50_000), (10, 1), (99_999, 100), (0, 0), (0, 200_000)):
        got = {}
        for r in files.byte_range(table, start, n, block=7_000).orderBy("path", "start_byte").collect():
            held = got.setdefault(r.path.rsplit("/", 1)[1], bytearray())
            assert r.start_byte == start + len(held)
            held += r.data
        want = {"a": data[start:start + n], "_b": data[:10][start:start + n], ".c": b""}
        assert {k: bytes(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_path_table_sees_every_file(spark, folder):
    os.makedirs(f"{folder}/a/.b")
    for name, size in (("_x", 3), ("a/empty", 0), ("a/.b/z", 7)):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(b"." * size)
    got = {(r.path, r.length) for r in stores.path_table(spark, folder).collect()}
    assert got == {(f"file:{folder}/{n}", s) for n, s in (("_x", 3), ("a/empty", 0), ("a/.b/z", 7))}
    one = stores.path_table(spark, [f"file:{folder}/_x", f"{folder}/a/.b/"]).collect()
    assert {r.path for r in one} == {f"file:{folder}/_x", f"file:{folder}/a/.b/z"}


def test_a_wide_folder_is_listed_in_batches(spark, folder):
    os.makedirs(f"{folder}/wide")
    for i in range(20_000):
        open(f"{folder}/wide/f{i}", "w").close()
    listed = catalog.scan_catalog(spark, folder, 1, batch_rows=1000)
    assert listed.count() == 20_001 and listed.select("path").distinct().count() == 20_001
    frames = stores._children_of(folder, 1000)(iter([pd.DataFrame({"folder": ["wide/"]})]))
    assert {len(frame) for frame in frames} == {1000}


def test_a_folder_that_cannot_be_listed(spark, folder):
    rows = list(stores._children_of(folder, 10)(iter([pd.DataFrame({"folder": ["gone/"]})])))
    assert rows[0]["path"].tolist() == ["gone/"] and "gone" in rows[0]["error"][0]


def test_copy_and_move(spark, folder):
    os.makedirs(f"{folder}/in/deep")
    for name in ("a", "b", "deep/c"):
        with open(f"{folder}/in/{name}", "wb") as out:
            out.write(name.encode() * 1000)
    rows = [(f"file:{folder}/in/{n}", f"{folder}/out/{n}", n == "b") for n in ("a", "b", "deep/c", "lost")]
    plan = spark.createDataFrame(rows, "source string, target string, remove_source boolean")
    audit = files.bulk_copy(plan, f"{folder}/audit")
    got = {r.source.rsplit("/", 1)[1]: (r.status, r.bytes_transferred) for r in audit.collect()}
    assert got == {"a": ("S", 1000), "b": ("S", 1000), "c": ("S", 6000), "lost": ("E", 0)}
    assert sorted(os.listdir(f"{folder}/in")) == ["a", "deep"]
    assert sorted(os.listdir(f"{folder}/out")) == ["a", "b", "deep"]
    with open(f"{folder}/out/deep/c", "rb") as copied:
        assert copied.read() == b"deep/c" * 1000
    # a task that runs again finds its work done
    files.bulk_copy(plan, f"{folder}/audit2")
    again = spark.read.parquet(f"{folder}/audit2")
    assert {r.status for r in again.where("source like '%/b'").collect()} == {"S"}


def test_scan(spark, folder):
    os.makedirs(f"{folder}/store/a/b")
    os.makedirs(f"{folder}/store/none")
    for name, size in (("x.txt", 3), ("a/y.bin", 0), ("a/b/z", 7), ("a/.hidden", 1), ("a/_under", 2)):
        with open(f"{folder}/store/{name}", "wb") as out:
            out.write(b"." * size)
    df = catalog.scan_catalog(spark, f"{folder}/store", 4)
    got = {r.path: (r.drive_id, r.file_size, r.directory) for r in df.collect()}
    below_a = {
        "a/y.bin": (4, 0, False), "a/b/": (4, 0, True), "a/b/z": (4, 7, False),
        "a/.hidden": (4, 1, False), "a/_under": (4, 2, False),
    }
    assert got == {"x.txt": (4, 3, False), "a/": (4, 0, True), "none/": (4, 0, True), **below_a}
    changed = df.where("path = 'x.txt'").select(F.unix_seconds("modified_date")).first()[0]
    assert changed == int(os.path.getmtime(f"{folder}/store/x.txt"))
    assert {r.path for r in catalog.scan_catalog(spark, f"file://{folder}/store/", 4, "/a").collect()} == set(below_a)
    assert catalog.scan_catalog(spark, f"{folder}/store", 4, "none").count() == 0


def test_normalize(spark):
    raw = spark.createDataFrame(
        [("s3a://store/root/a/b.txt", 5), ("s3a://store/root/a/", 0)], "path string, length bigint"
    ).withColumns({"modificationTime": F.current_timestamp(), "storage_class": F.lit("GLACIER")})
    got = catalog.normalize_items(raw, 2, "s3a://store/root/").orderBy("path").collect()
    assert [(r.path, r.directory, r.storage_class) for r in got] == [
        ("a/", True, "GLACIER"), ("a/b.txt", False, "GLACIER"),
    ]
