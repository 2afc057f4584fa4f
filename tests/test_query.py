from stowage.operators import query as Q

ITEMS_13 = [
    "/folder1/subFolder1/fileA.png", "/folder1/subFolder1/fileB.docx", "/folder1/fileC.txt",
    "/folder1/fileD.java", "/folder2/fileE.pdf", "/folder2/fileF.yaml", "fileG.tmnt", None,
    "/fileH.tla", "/fileI.exe", "/folder1/", "/folder2/", "/folder1/subFolder1/",
]


def items(spark, paths, drive=1):
    rows = [(drive, p, 10, bool(p and p.endswith("/"))) for p in paths]
    return spark.createDataFrame(rows, "drive_id int, path string, file_size bigint, directory boolean")


def found(df):
    return sorted(r["path"] for r in df.collect())


def test_levels_of_thirteen_items(spark):
    df = items(spark, ITEMS_13)
    assert len(found(Q.query_items(df))) == 5
    assert len(found(Q.query_items(df, "/folder1"))) == 3
    assert len(found(Q.query_items(df, "/folder2"))) == 2
    assert found(Q.query_items(df, "folder1/")) == found(Q.query_items(df, "/folder1"))


def test_folder_inside_folder_of_same_name(spark):
    df = items(spark, [
        "/same/same/fileA.png", "/same/same/fileB.docx", "/same/fileC.txt", "/same/same/", "/same/",
    ])
    assert found(Q.query_items(df, "/same")) == ["/same/fileC.txt", "/same/same/"]
    assert found(Q.query_items(df, "/same/same/")) == ["/same/same/fileA.png", "/same/same/fileB.docx"]


def test_start_path_and_recursion(spark):
    df = items(spark, ["/hello/world/document.docx"])
    for start, recursive, count in [
        ("hello/world/", False, 1), ("hello/", False, 0), ("hello/", True, 1), ("/hello/world", False, 1),
        ("/hello", False, 0), ("/hello", True, 1), ("hell", True, 0), (None, True, 1), (None, False, 0),
    ]:
        assert Q.query_items(df, start, recursive).count() == count


def test_patterns_cover_the_whole_text(spark):
    df = items(spark, ["a/one.csv", "a/one.csv.bak", "b/one.csv"])
    assert found(Q.query_items(df, None, True, r".*\.csv")) == ["a/one.csv", "b/one.csv"]
    assert found(Q.query_items(df, None, True, "a|b/one.csv")) == ["b/one.csv"]
    assert found(Q.query_items(df, None, True, "one.csv", on="name")) == ["a/one.csv", "b/one.csv"]
    assert found(Q.query_items(df, "a", True, "o.*", on="name")) == ["a/one.csv", "a/one.csv.bak"]


def test_placeholder(spark):
    df = items(spark, ["a/.placeholder", "a/x"])
    assert found(Q.query_items(df, "a")) == ["a/x"]
    assert found(Q.query_items(df, "a", placeholder=True)) == ["a/.placeholder", "a/x"]


def test_one_level_with_implied_folders(spark):
    df = items(spark, ["a/b/c/1", "a/b/2", "a/3", "a/empty/", "4"])
    assert found(Q.list_one_level(df)) == ["4", "a/"]
    assert found(Q.list_one_level(df, "a")) == ["a/3", "a/b/", "a/empty/"]
    assert found(Q.list_one_level(df, "/a/b/")) == ["a/b/2", "a/b/c/"]
    assert found(Q.ancestor_closure(df)) == ["a/", "a/b/", "a/b/c/"]


def test_distinct_items_keeps_the_newest(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, "2024-01-01"), (1, "a", 2, "2024-01-03"), (1, "a", 9, "2024-01-02"), (2, "a", 5, None)],
        "drive_id int, path string, file_size bigint, modified_date string",
    )
    got = {(r.drive_id, r.path): r.file_size for r in Q.distinct_items(df).collect()}
    assert got == {(1, "a"): 2, (2, "a"): 5}


def test_query_reaches_the_scan(spark, folder):
    items(spark, ["a/b/1"]).write.parquet(f"{folder}/items")
    df = Q.query_items(spark.read.parquet(f"{folder}/items"), "a/b").select("path")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
    assert "Exchange" not in plan
    assert "Or(StringStartsWith(path,a/b/),StringStartsWith(path,/a/b/))" in plan
