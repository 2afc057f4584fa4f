"""Positions, coverage and redaction of secrets against plain versions, and texts with very many of them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stowage.llm import secret_scan as ss


#: The known shapes as they are asked for: pattern, measured group, least length.
ASKED = [
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
]


def plain_base(text):
    return sorted(
        (m.start(), kind, m.end()) for kind, (pattern, group, least) in enumerate(ASKED)
        for m in re.finditer(pattern, text) if len(m.group(group)) >= least
    )


def spans_of(rng, many):
    found = [(s, s + rng.randint(1, 12)) for s in (rng.randint(0, 60) for _ in range(many))]
    return sorted(found)


def plain_merged(spans):
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


@pytest.mark.parametrize("block", [2, 256])
def test_merging_and_covering(spark, monkeypatch, block):
    monkeypatch.setattr(ss, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for i in range(200):
        spans, at, runs = spans_of(rng, rng.randint(0, 8)), 0, []
        while at < 60 and len(runs) < rng.randint(0, 9):
            at += rng.randint(0, 9)
            runs.append((at, at + rng.randint(1, 9)))
            at = runs[-1][1]
        rows.append((i, spans, runs))
    pairs = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, spans {pairs}, runs {pairs}")
    for row in df.select("*", ss.merged_spans(F.col("spans")).alias("m"), ss.uncovered(F.col("runs"), F.col("spans")).alias("u")).collect():
        merged = plain_merged(rows[row["i"]][1])
        assert [tuple(s) for s in row["m"]] == merged
        assert [tuple(r) for r in row["u"]] == [
            r for r in rows[row["i"]][2] if not any(a <= r[0] and r[1] <= b for a, b in merged)
        ]


@pytest.mark.parametrize("slice_,block", [(7, 3), (4096, 256)])
def test_scan_and_redaction(spark, monkeypatch, slice_, block):
    monkeypatch.setattr(ss, "SLICE", slice_)
    monkeypatch.setattr(ss, "BLOCK", block)
    rng = random.Random(3)
    parts = ["0a" * 13, "secret=abcdef0123", "AKIA" + "Q" * 20, "plain", "é🙂", "\n", "token: '" + "f0" * 14, "=", " ", "x" * 9]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ss.secret_spans(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in ss.redact_secrets(docs).collect()}
    for i, text in enumerate(texts):
        base = plain_base(text)
        found = [tuple(s) for s in rows[i]["secrets"]]
        assert [s for s in found if s[1] < len(ss.SHAPES)] == base
        out, at = "", 0
        for a, b in plain_merged([(s[0], s[2]) for s in found]):
            out, at = out + text[at:a] + "[SECRET]", b
        assert clean[i] == out + text[at:]


def test_runs_around_the_least_length(spark):
    rng = random.Random(5)
    parts = ["AKIA", "A", "KIA", "AKIAKIA", "Z9" * 5, "Q" * 16, "a", "0f" * 11, "0f" * 12, "passwd=", "token:", "abcde", " ", "g", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1_000)]
    texts += ["AKIA" + "B" * n for n in (0, 15, 16, 17)] + ["e" * n for n in (23, 24, 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in ss.secret_spans(docs).collect():
        assert [tuple(s) for s in row["secrets"] if s[1] < len(ASKED)] == plain_base(row["text"])


def test_very_many_secrets_in_one_text(spark):
    """The work grows with the number of secrets, not with its square."""
    rng = random.Random(4)
    runs = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")
    begin = time.perf_counter()
    row = ss.scan_secrets(docs).first()
    assert row["n_hex"] == 40_000 and row["spans"].endswith(f"hex:{33 * 39_999}:{33 * 40_000 - 1}")
    assert ss.redact_secrets(docs).first()["text"] == " ".join(["[SECRET]"] * 40_000)
    assert time.perf_counter() - begin < 90
