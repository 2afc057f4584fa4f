"""Mined phrases against counting all of them."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from stowage.llm import collocations as co


def plain_phrases(rows, support=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and p in (q[:-1], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "c", "É", "é", "New", "york", "city", "x-1", "日本", "A", "tail"]
    rows = []
    for _ in range(400):
        words = list(rng.choice(vocabulary, rng.integers(0, 30)))
        if rng.random() < 0.5:
            words += ["New", "York", "City"]
        joins = rng.choice([" ", "  ", "\t", ", ", ".", "\n"], len(words) + 1, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])
        rows.append(("".join(w + j for w, j in zip(words, joins)), [None, "en", "de", ""][rng.integers(0, 4)]))
    return rows + [(None, "en"), ("", "en"), (None, None), ("...", "xx"), ("only two words", "yy")] + [("so it goes", "en")] * 12


def test_against_counting_everything(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS k", "2 AS n", "3 AS phrase")
    for shards in (1, 3):
        assert sorted(map(tuple, co.collocations(docs, shards=shards).collect())) == plain_phrases(rows)
    assert sorted(map(tuple, co.collocations(docs, 3, top=5).collect())) == plain_phrases(rows, 3, 5)
    assert co.collocations(docs.limit(0)).count() == 0


def test_small_limits_give_the_same_sums(monkeypatch):
    """What a task sends on early adds up to what it would send at once."""
    rows = [(t or "", lang or "und", i % 3) for i, (t, lang) in enumerate(corpus())]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["text", "lang", "shard"])

    class Given:
        value = np.full(64, 2**64 - 1, np.uint64)  # lets everything through

    def sums():
        out = []
        for job in (co._mine_short, co._mine_long(Given), co._count(Given)):
            total = Counter()
            for part in job(iter([batch])):
                *key, n = (part.column(i).to_pylist() for i in range(part.num_columns))
                for k, count in zip(zip(*key), n):
                    total[k] += count
            out.append(total)
        return out

    whole = sums()
    for name, value in {"BLOCK": 200, "HELD_KEYS": 64, "HELD_PHRASES": 20}.items():
        monkeypatch.setattr(co, name, value)
    assert sums() == whole and all(whole)


def test_windows_and_blocks(monkeypatch):
    """Windows of few words give the phrases of one large window."""
    texts, languages = [b"a b c, d e f g. h", b"i", b"", b"j k  l\tm"], ["en", "en", "de", "de"]
    block = co.Block(texts, languages, [0, 1, 2, 0])

    def found():
        return {
            k: [(int(i) + s.low, int(h)) for s in block.windows() for i, h in zip(s.at[k], s.keys(k))] for k in (1, 2, 3)
        }

    whole = found()
    text, lengths = block.phrases(np.array([i for i, _ in whole[3]]), 3)
    assert text.tobytes() == b"a b c" b"d e f" b"e f g" b"j k l" b"k l m" and lengths.tolist() == [5] * 5
    for size in (1, 2, 5):
        monkeypatch.setattr(co, "WINDOW", size)
        assert found() == whole


def test_long_texts(spark):
    text = "left right " * 60_000 + "z" * 700_000
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    rows = {r["phrase"]: r["a"] for r in co.collocations(docs).collect()}
    assert rows == {"left right left": 59_999, "right left right": 59_999}


def test_a_filter_keeps_what_it_was_given(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    given = spark.createDataFrame([(int(k),) for k in keys], "key long")
    passing = co.Filter(co.filter_of(given).value)
    assert passing.passes(keys.view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert passing.passes(others).mean() < 0.03
