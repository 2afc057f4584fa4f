"""The Jaccard join against all pairs of sets."""

import re

import numpy as np
import pytest

from stowage.llm import jaccard, words

SF = "/root/testdata/sf0.001"


def plain_set(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return frozenset()
    return frozenset(" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1)))


def plain_components(rows, num=90, den=100):
    """Smallest id each row can reach, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            smallest[find(i)] = min(number, smallest.get(find(i), number))
    return sorted(
        ((n if n is not None else -1), len(s), (smallest.get(find(i), -1) if s else (n if n is not None else -1)))
        for i, ((n, _), s) in enumerate(zip(rows, sets))
    )


def got(df):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in df.collect())


@pytest.mark.parametrize("chunk", [7, words.CHUNK])
def test_words(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    texts = ["", " ", "a", "ab cd", " lead  tail\t", "x" * 40 + " y " + "x" * 40, "é ñ é", "one two\nthree " * 5]
    for text in texts:
        data = text.encode()
        found = words.hashed_words(data)
        assert [data[b:e] for b, e in zip(found.begin, found.end)] == data.split()
        by_word = {}
        for b, e, v in zip(found.begin, found.end, found.value.tolist()):
            assert by_word.setdefault(data[b:e], v) == v
        assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    data = b"some words, and a verylongwordthatspansseveralpieces here " * 3
    whole = words.hashed_words(data).value.tolist()
    for chunk in (1, 3, 16):
        monkeypatch.setattr(words, "CHUNK", chunk)
        assert words.hashed_words(data).value.tolist() == whole


def test_sets_at_the_threshold_share_a_key():
    rng, bands = np.random.default_rng(1), jaccard.Bands()
    for size in [*range(1, 60), 97, 130, 131, 500, 2000]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            gone, more = 0, 0
            while True:  # the largest changes that stay at the threshold, in a random mix
                step = rng.integers(0, 2)
                g, m = gone + step, more + 1 - step
                if 100 * (len(a) - g) < 90 * (len(a) + m):
                    break
                gone, more = g, m
            b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**64, more, np.uint64)])
            assert set(bands.keys(a)) & set(bands.keys(b))


@pytest.mark.parametrize("bits", [1 << 29, 64])
def test_trees_find_what_all_pairs_find(monkeypatch, bits):
    monkeypatch.setattr(jaccard, "BITMAP_BITS", bits)
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 10, 40, 41, 150)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(0, len(base))]
        cut = rng.permutation(s)[rng.integers(0, 1 + len(s) // 8):]
        sets.append(np.unique(np.r_[cut, rng.integers(0, 2**64, rng.integers(0, 3), np.uint64)]))
    for sides in (np.zeros(len(sets), np.int64), (np.arange(len(sets)) % 3 == 0).astype(np.int64)):
        forest = jaccard.Forest(np.arange(len(sets)))
        for a, b in jaccard.tree_links(sets, np.arange(len(sets)), sides):
            forest.join(a, b)
        plain = jaccard.Forest(np.arange(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if (not sides.any() or sides[i] != sides[j]) and 190 * both >= 90 * (len(a) + len(b)):
                    plain.join(i, j)
        assert forest.roots().tolist() == plain.roots().tolist()


def near_copies(rng, count):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = list(rng.choice(vocabulary, [2, 5, 12, 40, 120, 300][family]))
        for _ in range(count):
            text = list(base)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(0, len(text))] = str(rng.choice(vocabulary))
            rows.append(" ".join(text))
    return rows


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(jaccard.jaccard_groups(docs)) == plain_components(rows)


def test_near_copies_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), t) for i, t in enumerate(near_copies(rng, 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert got(jaccard.jaccard_groups(docs)) == want
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 400)
    assert got(jaccard.jaccard_groups(docs)) == want


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \n"), (None, "a b c d"), (9, "A  b\tC d"), (9, "a b c d"), (7, "x"), (8, "X"),
            (2, "a b"), (1, "a b c"), (None, "only null"), (11, long), (10, long + " end"), (12, "y" * 600_000), (13, "É b c d"), (14, "é b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS n", "2 AS c1", "3 AS grp", "4 AS id", "5 AS place")
    assert got(jaccard.jaccard_groups(docs)) == plain_components(rows)
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0
