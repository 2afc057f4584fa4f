"""The filter audit against recounting everything at the end."""

import re
from collections import Counter
from itertools import permutations

import pytest

from stowage.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def plain_fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def plain_audit(rows, labels):
    smallest, judged = {}, {}
    for number, text, _ in rows:
        if number is not None:
            smallest[text or ""] = min(number, smallest.get(text or "", number))
    for number, quality, toxic in labels:
        good, bad = judged.get(number, (False, False))
        judged[number] = good or quality == 1, bad or toxic == 1
    docs = []
    for number, text, lang in rows:
        fails = plain_fails(text or "")
        fails["E"] = number is not None and smallest[text or ""] < number
        docs.append((lang or "", {k for k, v in fails.items() if v}, *judged.get(number, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley, lines = Counter(), {}
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                here = [d for d in own if letter in d[1] and not d[1] & before]
                shapley[letter] += len(here)
                lines["".join(order), step + 1] = [
                    sum(not d[1] & (before | {letter}) for d in own), len(here),
                    sum(letter in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {letter} for d in own),
                    sum(d[2] for d in here), sum(d[3] for d in here),
                ]
        for (order, step), values in lines.items():
            out[part, order, step] = (*values, shapley[order[step - 1]])
    return out


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in df.collect()}


PLENTY = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (9, PLENTY, "en"), (7, PLENTY, "en"), (8, PLENTY, None), (7, PLENTY, "de"), (None, PLENTY, "en"), (3, None, "en"),
    (2, "", ""), (1, " \t", "en"), (6, "A" * 50 + " b", "en"), (5, "x " * 200, "de"), (4, PLENTY + " 5%", "de"),
    (10, "é|" * 40_000, "fr"), (11, "É" * 200, "fr"), (12, "É" * 200, "en"), (0, "x " * 200, "en"), (7, "x " * 200, "de"),
]
JUDGED = [(9, 1, 0), (7, 1, 1), (7, 0, 0), (5, 0, 1), (0, None, 1), (99, 1, 1), (None, 1, 1)]


def write(spark, rows, folder, files):
    for number in range(files):
        some = spark.createDataFrame(rows[number::files], "doc_id long, text string, lang string")
        some.selectExpr("*", "1 AS key", "2 AS part", "3 AS id").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("batches", [1, 2, 8])
def test_against_a_recount(spark, folder, batches):
    write(spark, ROWS, f"{folder}/docs", 8)
    labels = spark.createDataFrame(JUDGED, LABELS)
    assert got(fa.audit_filters(spark, f"{folder}/docs", labels, batches, 4)) == plain_audit(ROWS, JUDGED)


def test_one_file_and_none(spark, folder):
    write(spark, ROWS, f"{folder}/docs", 1)
    labels = spark.createDataFrame(JUDGED, LABELS)
    single = next(f for f in spark.read.parquet(f"{folder}/docs").inputFiles())
    assert got(fa.audit_filters(spark, single, labels)) == plain_audit(ROWS, JUDGED)
    spark.read.parquet(f"{folder}/docs").limit(0).write.parquet(f"{folder}/none")
    assert fa.audit_filters(spark, f"{folder}/none", labels.limit(0)).count() == 0


def test_later_files_take_earlier_counts_back(spark, folder):
    """A restarted stream goes on from its state: a smaller id in a new file turns the first holder into a copy."""
    labels = spark.createDataFrame([], LABELS)
    seen = []
    for number in (5, 4, 6):
        rows = [(number, PLENTY, "en")]
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.mode("append").parquet(f"{folder}/docs")
        table = spark.read.parquet(f"{folder}/docs")
        stream = spark.readStream.schema(table.schema).parquet(f"{folder}/docs")
        fa.audit_stream(stream, labels, f"{folder}/changes", f"{folder}/checkpoint", 2)
        found = fa.counters(spark, f"{folder}/changes").collect()
        seen.append({r["flags"]: r["n"] for r in found})
    assert seen == [{0: 1}, {0: 1, fa.COPY: 1}, {0: 1, fa.COPY: 2}]


def test_retraction():
    known, changes = {}, Counter()
    fa.retract(known, [(b"d", "en", 3, 8, 2, 3)], changes)
    assert changes == {("en", 3): 2, ("en", 3 | fa.COPY): 1}
    changes.clear()
    fa.retract(known, [(b"d", "de", 3, 5, 1, 1), (b"d", "en", 3, None, 0, 4), (b"d", "en", 3, 8, 1, 1)], changes)
    assert changes == {("en", 3): -2 + 4, ("en", 3 | fa.COPY): 2 + 1, ("de", 3): 1}
    assert known == {b"d": (5, {("de", 3): 1})}
