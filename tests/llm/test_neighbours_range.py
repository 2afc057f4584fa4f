"""Vectors at the ends of the range of doubles, clusters, and blocks smaller than their partition."""

import numpy as np
import pytest

from stowage.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def test_vectors_far_apart(spark):
    rows = [(0, [1e200, 0.0]), (1, [0.0, 1e200]), (2, [1e200, 1.0]), (100, [1e-300, 0.0]), (3, [3e-300, 0.0]), (4, [1.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), k=5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [
        (0, 2), (0, 3), (0, 4), (0, 100), (0, 1), (100, 3), (100, 4), (100, 0), (100, 1), (100, 2),
    ]
    score = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert score[0, 1] == pytest.approx(2**0.5 * 1e200) and score[100, 3] == pytest.approx(2e-300)
    assert score[0, 2] == 1.0 and score[100, 4] == 2**0.5


@pytest.mark.parametrize("case", ["clusters", "directions"])
def test_recall_also_of_the_worst(spark, monkeypatch, case):
    rng = np.random.default_rng(1)
    if case == "clusters":
        x = rng.standard_normal((60, 24))[rng.integers(0, 60, 6000)] * 3 + rng.standard_normal((6000, 24)) * 0.4
    else:
        x = rng.standard_normal((6000, 24))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = neighbours.search(vectors).toPandas()
    shares = []
    for query, rows in got.groupby("query_id"):
        far = ((x - x[query]) ** 2).sum(1)
        far[query] = np.inf
        order = np.lexsort((np.arange(len(x)), far))[:10]
        rows = rows.sort_values("rank")
        assert rows["score"].tolist() == np.sqrt(((x[rows["vec_id"]] - x[query]) ** 2).sum(1)).tolist()
        shares.append(len(set(order) & set(rows["vec_id"])) / 10)
    assert len(shares) == 60 and np.mean(shares) >= 0.9 and np.quantile(shares, 0.05) >= 0.5


def test_nearest_exact_with_ties_and_few_rows():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (40, 3)).astype(float)
    ids, q = np.arange(40), x[:5]
    query, row, score = neighbours.nearest_exact(ids, x, ids[:5], q, 10)
    for i in range(5):
        want = sorted((float(np.sqrt(((x[j] - q[i]) ** 2).sum())), j) for j in range(40) if j != i)[:10]
        assert [(s, r) for n, r, s in zip(query, row, score) if n == i] == want
    assert neighbours.nearest_exact(ids[:1], x[:1], ids[:1], q[:1], 10)[0].tolist() == []
