"""Slash functions against the patterns that define them."""

import itertools
import re

from pyspark.sql import functions as F

from stowage.functions import paths


def test_slash_functions_match_their_patterns(spark):
    texts = ["".join(t) for n in range(6) for t in itertools.product("/ä\n", repeat=n)]
    path = F.col("path")
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "path string").select(
        "path", paths.remove_first_slash(path).alias("first"), paths.remove_both_slashes(path).alias("both"),
        paths.parent_folder_path(path).alias("parent"),
    ).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.path is None:
            assert (r.first, r.both, r.parent) == (None, None, "/")
            continue
        both = re.sub(r"\A/|/\Z", "", r.path)
        assert (r.first, r.both) == (re.sub(r"\A/", "", r.path), both)
        assert r.parent == (re.match(r"(?s)(.*/)", both) or re.match("(/)", "/"))[1]


def test_slashes_of_items_need_no_pattern(spark):
    path = F.col("path")
    df = spark.createDataFrame([("a/b",)], "path string").select(
        paths.remove_first_slash(path), paths.folder_key(path), paths.parent_folder_path(path)
    )
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
