"""Approximate nearest neighbours over learned partitions.

A bounded sample is fitted on the driver: its neighbour graph is halved again and again at the
median of its slowest mode, which gives partitions of equal size that cut few edges, and a small network
learns where the neighbours of a vector lie. The network files every row under its most
probable partition and sends each query to several; those are compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stowage.session import materialize

#: Partitions of a small table; they double while one holds more than PART_ROWS rows, up to MOST_PARTITIONS.
PARTITIONS, MOST_PARTITIONS, PART_ROWS = 32, 512, 16_384
#: Rows of the sample the index is fitted on, at least and per partition (so 16,384 at most).
SAMPLE_ROWS, SAMPLE_PER_PARTITION = 4096, 32
GRAPH_NEIGHBOURS = 10
HIDDEN = 96
#: Share of true neighbours the probed partitions hold on the part of the sample not trained on.
RECALL = 0.95
#: Rows of one block; queries are compared with it as they come.
BLOCK_ROWS = 8192


def nearest_in(rows: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Indexes of the k nearest rows of each query, leaving out row `own`."""
    out = []
    norms = (rows * rows).sum(1)
    for low in range(0, len(queries), 512):
        far = norms - 2 * queries[low : low + 512] @ rows.T
        far[np.arange(len(far)), own[low : low + 512]] = np.inf
        out.append(np.argpartition(far, min(k, far.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def partition_graph(near: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Label 0 to parts - 1 (a power of two) of each node, in halves of equal size."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    labels, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(parts.bit_length() - 1):
        inside = labels[a] == labels[b]
        i, j = a[inside], b[inside]
        degree = np.bincount(i, minlength=n) + 1e-9
        size = np.bincount(labels, degree)
        mode = rng.standard_normal(n)
        for _ in range(60):  # lazy random walk, less the constant of each half
            mode = 0.5 * (mode + np.bincount(i, mode[j], minlength=n) / degree)
            mode -= (np.bincount(labels, mode * degree) / size)[labels]
            mode /= np.sqrt(np.bincount(labels, mode * mode) + 1e-300)[labels]
        order = np.lexsort((np.arange(n), mode, labels))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        counts = np.bincount(labels)
        first = np.r_[0, np.cumsum(counts)[:-1]]
        labels = 2 * labels + (rank - first[labels] >= (counts[labels] + 1) // 2)
    return labels


@dataclass
class Router:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias1: np.ndarray
    second: np.ndarray
    bias2: np.ndarray
    unit: float = 1.0
    probes: int = 1

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((x * self.unit - self.centre) / self.scale, -1e6, 1e6)
        hidden = np.maximum(x @ self.first + self.bias1, 0)
        z = hidden @ self.second + self.bias2
        p = np.exp(z - z.max(1, keepdims=True))
        return x, hidden, p / p.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        return np.argsort(-self.forward(x)[2], axis=1, kind="stable")


def unit_of(*blocks: np.ndarray) -> float:
    """A power of two that brings the largest component near 1, so that squares stay finite."""
    largest = max((np.abs(b).max() for b in blocks if b.size), default=0.0)
    return float(2.0 ** -np.clip(np.floor(np.log2(largest)), -1000, 1000)) if largest > 0 else 1.0


def fit_router(sample: np.ndarray, parts: int = PARTITIONS, seed: int = 5) -> Router:
    """Partition the sample's graph, train the network on four fifths, set the probes on the rest."""
    n, width = sample.shape
    rng = np.random.default_rng(seed)
    while parts > 1 and n < 8 * parts:
        parts //= 2
    unit = unit_of(sample)
    given, sample = sample, sample * unit
    router = Router(
        sample.mean(0), sample.std(0) + 1e-12,
        rng.standard_normal((width, HIDDEN)) * (2 / width) ** 0.5, np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) * HIDDEN**-0.5, np.zeros(parts), unit,
    )
    if parts == 1:
        return router
    k = min(GRAPH_NEIGHBOURS, n - 1)
    near = nearest_in(sample, sample, k, np.arange(n))
    labels = partition_graph(near, parts, seed)
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.arange(n), labels), 1.0)
    for column in near.T:
        np.add.at(wanted, (np.arange(n), labels[column]), 1.0)
    wanted /= wanted.sum(1, keepdims=True)
    held = np.arange(n) % 5 == 0
    train = np.flatnonzero(~held)
    weights = [router.first, router.bias1, router.second, router.bias2]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(25):
        for some in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            x, hidden, p = router.forward(given[some])
            dz = (p - wanted[some]) / len(some)
            dh = dz @ router.second.T * (hidden > 0)
            step += 1
            for w, g, (m, v) in zip(weights, (x.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(0)), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    ranked = router.ranked(given)
    filed = ranked[:, 0]
    place = np.argsort(ranked[held], axis=1)  # where each partition stands for a query
    needed = np.take_along_axis(place, filed[near[held]], 1)
    shares = [(needed < m).mean() for m in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(shares) >= RECALL))
    return router


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) as doubles of the rows that take part, one per id and width."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)
    return (
        vectors.where(F.col(id_column).isNotNull() & whole)
        .groupBy(F.col(id_column).cast("bigint").alias("id"), F.size(vector).alias("width"))
        .agg(F.min(vector).alias("vector")).drop("width")
    )


def search(
    vectors: DataFrame, every: int = 100, k: int = 10,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """The k nearest rows found for each row whose id is divisible by `every`, by Euclidean distance.

    Null, zero and non-finite vectors take no part. Each width is searched by itself, with a router of
    its own; an id of several widths is a query in each. Rows of a width that share an id count
    once, by their smallest vector. Ties go to smaller ids. A query with fewer than k + 1 rows in its partitions gets more of them.
    """
    spark = vectors.sparkSession
    rows = materialize(usable_vectors(vectors, id_column, vector_column), "vectors")
    asked = F.max((F.col("id") % every == 0).cast("int"))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(asked.alias("asked")).where("asked = 1")
    found = [
        _search_width(rows.where(F.size("vector") == r["width"]), every, k)
        for r in widths.orderBy("width").collect()
    ]
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)


def _search_width(rows: DataFrame, every: int, k: int) -> DataFrame:
    """The search among vectors of one width."""
    parts, many = PARTITIONS, rows.count()
    while parts < MOST_PARTITIONS and many > parts * PART_ROWS:
        parts *= 2
    some = max(SAMPLE_ROWS, parts * SAMPLE_PER_PARTITION)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(some).collect()
    # Copies of a vector say nothing about where its neighbours lie.
    router = fit_router(np.unique(np.array([r["vector"] for r in sample]), axis=0), parts)

    @F.pandas_udf("array<int>")
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            ranked = router.ranked(np.stack(batch.to_list())) if len(batch) else np.zeros((0, 1))
            yield pd.Series(list(ranked.astype(np.int32)))

    routed = materialize(rows.withColumn("route", route("vector")), "routed")
    filed = routed.withColumn("part", F.get("route", F.lit(0)))
    counts = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    parts = max(counts) + 1
    sizes = F.array(*[F.lit(counts.get(p, 0)) for p in range(parts)])
    blocks = F.array(*[F.lit(1 + counts.get(p, 0) // BLOCK_ROWS) for p in range(parts)])

    queries = routed.where(F.col("id") % every == 0)
    # The first `probes` partitions, and more until they hold k rows besides the query.
    enough = F.aggregate(
        "route", F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("rows")),
        lambda s, p: F.struct(
            F.when((s["n"] < router.probes) | (s["rows"] <= k), s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(
                (s["n"] < router.probes) | (s["rows"] <= k),
                s["rows"] + F.coalesce(F.get(sizes, p), F.lit(0)),
            ).otherwise(s["rows"]).alias("rows"),
        ),
        lambda s: s["n"],
    )
    probes = queries.select(
        "id", "vector", F.explode(F.slice("route", F.lit(1), enough)).alias("part")
    )
    # Each row lies in one block of its partition; a query goes to all blocks of the partitions it probes.
    left = filed.select(
        "part", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("part"))).cast("int").alias("block"),
        F.lit(0).alias("asks"), "id", "vector",
    )
    right = probes.where(F.get(sizes, F.col("part")) > 0).select(
        "part", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("part")) - 1)).alias("block"),
        F.lit(1).alias("asks"), "id", "vector",
    )
    keys = ["part", "block"]
    dealt = left.unionByName(right).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    near = dealt.sortWithinPartitions(*keys, "asks").mapInArrow(_compare(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _compare(k: int):
    """Rows (part, block, asks, id, vector), a block's own rows first: only those are held, its queries stream by."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, block, asks, number = (batch.column(i).to_numpy() for i in range(4))
            x = batch.column(4).flatten().to_numpy().reshape(len(number), -1)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(number)]):
                if (part[low], block[low]) != now:
                    now, ids, vectors = (part[low], block[low]), [], []
                if not asks[low]:
                    ids.append(number[low:high])
                    vectors.append(x[low:high])
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    found = nearest_exact(ids[0], vectors[0], number[low:high], x[low:high], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=FOUND)

    return compare


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a vector; squares that leave the range of doubles are scaled first."""
    apart = x - q
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.sqrt((apart * apart).sum(1))
        largest = np.abs(apart).max(1)
        odd = np.flatnonzero((~np.isfinite(out) | (out < 1e-140)) & (largest > 0) & np.isfinite(largest))
        for i in odd:
            out[i] = largest[i] * np.sqrt(((apart[i] / largest[i]) ** 2).sum())
    return out


def nearest_exact(
    ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of a block for each query, the row of its own id left out.

    A product of matrices, of vectors scaled to a largest component near 1, finds all rows that are no
    farther than the k-th, with room for its rounding, however many tie; only those are measured exactly.
    """
    unit = unit_of(x, q)
    small = x * unit
    norms = (small * small).sum(1)
    out: list[tuple] = []
    for low in range(0, len(own), 256):
        some, numbers = q[low : low + 256], own[low : low + 256]
        scaled = some * unit
        squares = (scaled * scaled).sum(1)
        far = norms + squares[:, None] - 2 * scaled @ small.T
        far[numbers[:, None] == ids] = np.inf
        last = np.partition(far, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        room = 1e-9 * (norms.max() + squares)
        for i, number in enumerate(numbers.tolist()):
            near = np.flatnonzero((far[i] <= last[i] + room[i]) & np.isfinite(far[i]))
            exact = distances(x[near], some[i])
            best = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(best), number), ids[near][best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out))
