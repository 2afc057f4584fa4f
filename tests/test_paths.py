import pytest
from pyspark.sql import functions as F

from stowage.functions import levels, paths as P, scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


CASES = [
    (P.file_name, [(None, None), ("", ""), ("file.txt", "file.txt"), ("folder1/folder2/", "folder2"),
                   ("/d1/d2/file.txt", "file.txt")]),
    (P.extension, [(None, None), ("file", ""), ("file.txt", "txt"), ("some.file.txt", "txt"), ("a.", "")]),
    (P.parent_folder, [(None, "/"), ("", "/"), ("file.txt", "/"), ("/d1/d2/file.txt", "/d1/d2"),
                       ("C:/d1/d2/file.txt", "C:/d1/d2"), ("/f", ""), ("a/b/", "a/b")]),
    (P.parent_folder_path, [(None, "/"), ("/", "/"), ("test/", "/"), ("/test", "/"), ("/test/", "/"),
                            ("test/sub", "test/"), ("/test/sub", "test/"), ("/test/sub/", "test/"),
                            ("a/b/c.d", "a/b/")]),
    (P.add_first_slash, [(None, None), ("", "/"), ("/", "/"), ("test", "/test"), ("/test", "/test"),
                         ("test/", "/test/"), ("/test/", "/test/")]),
    (P.add_last_slash, [(None, None), ("", "/"), ("/", "/"), ("test", "test/"), ("/test", "/test/"),
                        ("test/", "test/"), ("/test/", "/test/")]),
    (P.add_both_slashes, [("", "/"), ("/", "/"), ("a", "/a/"), ("/a/", "/a/"), ("a/b", "/a/b/")]),
    (P.remove_first_slash, [("", ""), ("/", ""), ("test", "test"), ("/test", "test"), ("//a", "/a"),
                            ("test/", "test/"), ("/test/", "test/")]),
    (P.remove_last_slash, [("", ""), ("/", ""), ("test", "test"), ("/test", "/test"), ("a//", "a/"),
                           ("test/", "test"), ("/test/", "/test")]),
    (P.remove_both_slashes, [("", ""), ("/", ""), ("//", ""), ("/a/b/", "a/b"), ("a", "a")]),
    (P.to_unix, [("\\folder\\subFolder\\", "/folder/subFolder/"), ("/folder/subFolder/", "/folder/subFolder/")]),
    (P.to_windows, [("/folder/subFolder/", "\\folder\\subFolder\\")]),
    (P.has_drive_letter, [(None, False), ("C:/x", True), ("d:\\x", True), ("/C:/x", False), ("CD:/", False)]),
    (P.remove_drive_letter, [("C:/x/y", "x/y"), ("x/y", "x/y")]),
    (P.is_root, [(None, True), ("", True), ("/", True), ("a", False)]),
    (P.avsc_location, [("dir1/dir2/base.avro", "dir1/base.avsc"), ("a/dir1/dir2/b.c.avro", "a/dir1/b.c.avsc")]),
    (P.folder_key, [("/", "/"), ("", "/"), ("a", "a/"), ("/a/b/", "a/b/")]),
    (P.ancestors, [("f", []), ("/f", []), ("a/f", ["a/"]), ("/a/b/f", ["a/", "a/b/"]), ("a/b/", ["a/"])]),
    (P.self_and_ancestors_of_folder, [("/", ["/"]), ("a/b/", ["/", "a/", "a/b/"])]),
]


@pytest.mark.parametrize("function,cases", CASES, ids=[c[0].__name__ for c in CASES])
def test_path_function(spark, function, cases):
    rows = [(i, text) for i, (text, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, p string").select("i", function(F.col("p")).alias("v"))
    assert {r["i"]: r["v"] for r in got.collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_same_source_and_destination(spark):
    for args, want in [
        ((1, "a", 1, "a"), True), ((1, "a/", 1, "a"), True), ((1, "a/", 1, "a/"), True),
        ((1, "a", 1, "b"), False), ((1, "a", 2, "a"), False), ((1, "a/", 1, "a/b"), False),
        ((1, "a", 1, "a/"), False),
    ]:
        assert value(spark, P.same_source_dest(*[F.lit(a) for a in args])) is want


def test_relative_rebase_and_move(spark):
    assert value(spark, P.relative_path(F.lit("/a/b"), F.lit("/a/b/c/d"))) == "c/d"
    assert value(spark, P.relative_path(F.lit("/x"), F.lit("/a/b"))) == "a/b"
    # only the leading occurrence is swapped
    assert value(spark, P.rebase_path(F.lit("a/x/a/y"), F.lit("a/"), F.lit("z/"))) == "z/x/a/y"
    assert value(spark, P.rebase_path(F.lit("b/a/y"), F.lit("a/"), F.lit("z/"))) == "b/a/y"
    assert value(spark, P.move_below(F.lit("/a/b/c"), F.lit("a"), F.lit("/z/"))) == "z/b/c"
    assert value(spark, P.move_below(F.lit("a/b"), F.lit("/"), F.lit("z"))) == "z/a/b"
    assert value(spark, P.move_below(F.lit("a/b"), F.lit("a/"), F.lit("/"))) == "b"


def test_chunk_sizes(spark):
    part, most = 10 * 1024 * 1024, 10_000 * 10 * 1024 * 1024
    sizes = [(0, part), (1, part), (most, part), (most + 1, 2 * part), (2 * most, 2 * part),
             (400 * most, 2**31 - 1)]
    for size, want in sizes:
        assert value(spark, S.chunk_size(F.lit(size).cast("bigint"))) == want


def test_small_values(spark):
    assert len(value(spark, S.safe_value(F.lit("x" * 5000), S.STACK_TRACE_WIDTH))) == 2048
    assert value(spark, S.users_list(F.lit("ann;bob"))) == ["ann", "bob"]
    assert value(spark, S.users_list(F.lit("ann"))) == ["ann"]
    assert value(spark, S.users_list(F.lit(""))) == []
    assert value(spark, S.users_list(F.lit(None).cast("string"))) == []
    moment = F.lit("2024-03-04 15:06:07").cast("timestamp")
    assert value(spark, S.timestamp_name(moment)) == "20240304_150607"
    assert value(spark, S.restore_expiry(F.lit(False), moment)) == "03/04/2024 03:06 UTC"
    assert value(spark, S.restore_expiry(F.lit(True), moment)) is None


def test_access_lattice(spark):
    granted = {
        "N": "", "D": "DMCR", "M": "MCR", "C": "CR", "R": "R", "A": "A", "U": "U", "?": "", "d": "DMCR",
    }
    for held, want in granted.items():
        for asserted in "DMCRAU":
            assert value(spark, levels.grants(F.lit(held), asserted)) is (asserted in want)
    assert value(spark, levels.access_name(F.lit("u"))) == "Restore"
    assert value(spark, levels.access_name(F.lit(None).cast("string"))) == "None"
