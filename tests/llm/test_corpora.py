"""Operators over whole corpora, against plain brute-force versions."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from stowage.llm import graphs, mixing, neighbours, packing, ranges, simhash, warc

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_archives_round_trip(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.archive_pages(pages).orderBy("page_id").toPandas()
    expected = duckdb.sql(warc.ORACLE.replace("FROM pages", f"FROM '{SF}/pages.parquet'")).df()
    expected = expected.sort_values("page_id").reset_index(drop=True)
    for column in got:
        assert (got[column].fillna(-1) == expected[column].fillna(-1)).all(), column
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_of_odd_pages(spark, tmp_path):
    big = "é" * 400_000
    rows = [(None, "u", None), (3, None, big), (4, "u", big), (4, "u", big), (1, "u", "short"), (2, "u", "short"),
            (None, "u", big), (7, "a\r\nb", ""), (8, "u", "x\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1))
    got = warc.archive_pages(pages, str(tmp_path / "a")).collect()
    assert sorted(
        (r["page_id"] or -1, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got
    ) == [
        (-1, "response", 0, 0), (-1, "revisit", 3, 800_000), (1, "response", 0, 5), (2, "response", 0, 5),
        (3, "response", 0, 800_000), (4, "revisit", 3, 800_000), (4, "revisit", 3, 800_000),
        (7, "response", 0, 0), (8, "response", 0, 15),
    ]
    archives = warc.write_archives(warc.payload_chunks(pages), f"file://{tmp_path}/b")
    chunks = warc.read_archives(archives, chunk_bytes=100_000).where("id = 3").orderBy("chunk").collect()
    assert len(chunks) == 8 and b"".join(c["data"] for c in chunks) == big.encode()
    assert [c["bytes_so_far"] for c in chunks] == [100_000 * n for n in range(1, 9)]
    assert [c["last"] for c in chunks] == [False] * 7 + [True]


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            ones[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def plain_components(values, radius=2):
    """Smallest index each value can reach in steps of at most `radius` bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    for a, b in zip(*np.nonzero(apart <= radius)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(values))]


def chains(clusters, steps, seed=0):
    rng = np.random.default_rng(seed)
    found = [rng.integers(0, 2**63, clusters, dtype=np.uint64)]
    for _ in range(steps):
        flip = np.zeros(clusters, np.uint64)
        for _ in range(2):
            flip |= np.uint64(1) << rng.integers(0, 64, clusters).astype(np.uint64)
        found.append(found[-1] ^ flip)
    return np.unique(np.concatenate(found))


def test_bit_sliced_clusters():
    values = chains(60, 7)
    expected = plain_components(values)
    member, first = simhash.star_links(np.zeros(len(values), np.int64), values)
    links = dict(zip(member.tolist(), first.tolist()))
    assert [links.get(int(v), int(v)) for v in values] == [int(values[r]) for r in expected]
    assert len(simhash.star_links(np.arange(len(values)), values)[0]) == 0


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 3)  # every shared key is filed again
    rows = [(5000, None), (5001, ""), (5002, " \t"), (5003, "One two"), (5004, "one TWO"), (None, "one two"),
            (5005, "one two"), (5005, "one two"), (5006, "long " * 50_000)]
    docs = documents(spark).select("doc_id", "text").union(
        spark.createDataFrame(rows, "doc_id long, text string")
    ).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2))
    got = simhash.near_duplicates(docs).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    prints = {t: plain_fingerprint(t) for _, t in texts}
    values = np.array(sorted(set(prints.values())), np.uint64)
    label = dict(zip(values.tolist(), plain_components(values)))
    smallest = {}
    for number, text in texts:
        key = label[prints[text]]
        if number is not None:
            smallest[key] = min(smallest.get(key, number), number)
    expected = sorted((n or -1, f"{prints[t]:016x}", smallest[label[prints[t]]]) for n, t in texts)
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in got) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(smallest.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    rows = [(1, "some words that come first"), (2, "some words that come first"), (2, "nothing like the others here at all")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[0], rows[2]]


@pytest.mark.parametrize("edges", [
    [], [(2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(99, i) for i in range(30)],
    [(i * 7 % 50, i * 11 % 50) for i in range(45)],
])
def test_components(spark, edges):
    found = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {(r["node"], r["label"]) for r in found.collect()} == {(x, find(x)) for x in list(root)}
    assert found.count() == len(root)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    budget, capped = sum(sizes.values()), set()
    while True:
        open_weight = sum(weight[s] for s in names if s not in capped)
        rest = budget - sum(3 * sizes[s] for s in capped)
        level = rest / open_weight if open_weight else 0
        more = {s for s in names if s not in capped and weight[s] * level >= 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 20)
    rows = [(9000, None, "src0"), (9001, "", None), (9002, "one two", None), (None, "no id", "tiny"),
            (9003, "same text", "twice"), (9003, "same text", "twice"), (9004, "long " * 5_000, "src1")]
    docs = documents(spark).select("doc_id", "text", "source").union(
        spark.createDataFrame(rows, "doc_id long, text string, source string")
    ).withColumn("size", F.lit(1)).withColumn("target", F.lit(1))
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    texts = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
    size = {(n, t): len(re.findall(r"[^\x20\x09-\x0D]+", t)) for n, t, _ in texts}
    sizes, largest, of = defaultdict(int), defaultdict(int), {}
    for n, t, source in texts:
        sizes[source] += size[n, t]
        largest[source] = max(largest[source], size[n, t])
        of[n] = source
    targets, taken = plain_targets(sizes), defaultdict(int)
    assert len(got) == len(texts)
    for row in got:
        source = of[row["doc_id"]]
        assert row["source_size"] == sizes[source]
        assert row["target"] == pytest.approx(targets[source])
        assert row["size"] == 0 and row["taken"] == 0 or row["taken"] in [row["size"] * i for i in range(4)]
        taken[source] += row["taken"]
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source]
    assert sum(taken.values()) <= sum(sizes.values()) + max(largest.values())
    repeated, copies = mixing.mixed(docs), defaultdict(int)
    for row in got:  # documents without words stay once
        copies[row["doc_id"]] += row["taken"] // row["size"] if row["size"] else 1
    assert repeated.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in repeated.groupBy("doc_id").count().collect()} == {
        n: c for n, c in copies.items() if c
    }
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def plain_mix(rows, docs_order):
    """Words taken per source: the queue of each source one document after the other, then the crossing ones."""
    sizes = defaultdict(int)
    for _, _, source, n in rows:
        sizes[source] += n
    targets, taken, crossing = plain_targets(sizes), defaultdict(int), []
    for source in sizes:
        queue = sorted((docs_order[number, text], n) for number, text, s, n in rows if s == source and n)
        for _, n in queue * 3:
            if taken[source] + n > targets[source]:
                crossing.append(((taken[source] + n) / targets[source], source, n))
                break
            taken[source] += n
    left = sum(targets.values()) - sum(taken.values())
    order = {s: i for i, s in enumerate(sorted(sizes))}
    for _, source, n in sorted(crossing, key=lambda c: (c[0], order[c[1]])):
        missing = targets[source] - taken[source]
        if n - missing < missing and left > 0:
            taken[source] += n
            left -= n
    return taken, targets


@pytest.mark.parametrize("seed", range(3))
def test_mixture_cut(spark, seed):
    """The words of each source against serving the queues one document at a time."""
    rng = np.random.default_rng(seed)
    rows = []
    for source in "abcdefg"[: 3 + 2 * seed]:
        for _ in range(rng.integers(1, 30)):
            n = int(rng.choice([0, 1, 3, 20, 200]))
            text = " ".join(["w"] * n)
            rows += [(int(rng.integers(0, 5)), text, source, n)] * int(rng.choice([1, 1, 7]))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    places = {
        (r[0], r[1]): r[2] for r in docs.select("doc_id", "text", mixing.place_of("doc_id", "text", 11)).collect()
    }
    want, targets = plain_mix(rows, places)
    taken = defaultdict(int)
    got = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    taken.update({r["source"]: r["n"] for r in got})
    assert {s: taken[s] for s in want if want[s]} == {s: n for s, n in want.items() if n}
    assert mixing.mix_sources(docs).agg(F.sum("taken")).first()[0] == sum(want.values())


def test_mixture_of_repeated_rows_and_one_large(spark):
    copies = [(1, "a b c", "x")] * 300 + [(2, "d e f", "y")] * 300
    docs = spark.createDataFrame(copies, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["n"] for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert taken == {1: 600, 2: 1200}
    assert {r["source"]: r["count"] for r in mixing.mixed(docs).groupBy("source").count().collect()} == {"x": 200, "y": 400}
    large = [(1, "w " * 1000, "x")] + [(i, "w w w", "y") for i in range(2, 202)] + [(i, "w " * 9, "z") for i in range(300, 440)]
    docs = spark.createDataFrame(large, "doc_id long, text string, source string")
    row = mixing.mix_sources(docs).where("doc_id = 1").first()
    assert row["target"] < 1000 and row["taken"] == (1000 if row["target"] > 500 else 0)


def test_packing_counts():
    rng = np.random.default_rng(2)
    for top in (1024, 300, 20):
        lengths = rng.integers(1, top + 1, 5000)
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        bins = packing.pack_counts(counts, 1024)
        held = defaultdict(int)
        for some in bins:
            assert some.gap == 1024 - sum(n * k for n, k in some.items) >= 0 and some.count > 0
            assert sum(k for n, k in some.items if 3 * n > 1024) <= 2
            for n, k in some.items:
                held[n] += k * some.count
        assert dict(held) == counts
        assert sum(b.count for b in bins) <= 1.01 * lengths.sum() / 1024 + 1
    assert packing.pack_counts({}, 1024) == []


def test_packed_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART_ROWS", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(9000, None), (9001, ""), (9002, "same"), (9002, "same"), (None, "no id"), (9003, "long word " * 9_000)]
    docs = documents(spark).select("doc_id", "text").union(
        spark.createDataFrame(rows, "doc_id long, text string")
    ).withColumn("length", F.lit("x"))
    got = packing.pack_documents(docs, path).toPandas()
    library = Tokenizer.from_file(path)
    expected = defaultdict(int)
    for row in docs.collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            expected[row["doc_id"] if row["doc_id"] is not None else -1, piece, a, b - a, crc] += 1
    found = defaultdict(int)
    for row in got.fillna({"doc_id": -1}).itertuples():
        found[int(row.doc_id), row.piece, row.start, row.length, row.ids_crc32] += 1
    assert found == expected
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert (sequence["offset"].to_numpy() == np.r_[0, sequence["length"].cumsum()[:-1]]).all()
        assert sequence["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 1024 + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_neighbours_against_brute_force(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("id", F.lit(1))
    got = neighbours.search(vectors).toPandas()
    rows = vectors.toPandas().sort_values("vec_id")
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    shares = []
    for query in ids[ids % 100 == 0]:
        i = np.searchsorted(ids, query)
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        near = ids[np.lexsort((ids, far))[:10]]
        mine = got[got["query_id"] == query].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        assert np.allclose(mine["score"], far[np.searchsorted(ids, mine["vec_id"])], rtol=1e-12)
        shares.append(len(set(near) & set(mine["vec_id"])) / 10)
    assert np.mean(shares) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0]), (7, [1.0, 2.0]), (None, [3.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [
        (0, 100, 1.0), (0, 5, 2.0), (0, 7, 2.0), (100, 0, 1.0), (100, 5, 1.0), (100, 7, 1.0)
    ]
    assert neighbours.search(vectors.limit(0)).count() == 0


def test_each_width_is_searched(spark):
    rows = [(i, [float(i), 1.0]) for i in range(98, 103)] + [(i, [float(i), 1.0, 1.0]) for i in (200, 201, 203)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(100, 1, 99, 1.0), (100, 2, 101, 1.0), (200, 1, 201, 1.0), (200, 2, 203, 3.0)]


def test_ties_beyond_k_go_to_the_smallest_ids(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(400)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for query in (0, 100, 200, 300):
        mine = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert mine == [i for i in range(0, 400, 2) if i != query][:10]


def test_running_sums_and_ranges(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), (F.col("id") / 50).cast("int").alias("s"))
    got = ranges.running_sum(df, "g", "s", ["v"], F.col("v"), "before", "total").collect()
    for row in got:
        assert row["before"] == sum(v for v in range(row["v"]) if v % 3 == row["g"])
    splits = [3, 10, 11, 40]
    for row in spark.range(50).select("id", ranges.range_of(F.col("id"), splits).alias("r")).collect():
        assert row["r"] == sum(s <= row["id"] for s in splits)
