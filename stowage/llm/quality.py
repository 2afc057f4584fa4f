"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and cut into blocks of `BLOCK`; a chunk is `REACH` consecutive blocks and
one begins at every block, so chunks overlap and cover the whole text. Each chunk goes through
learned filters and a second layer, the largest answer of every unit over the whole text
is kept, and a logistic unit makes one probability of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK, REACH = 4, 4
EMBED, FILTERS, UNITS = 8, 24, 24


def blocks_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (n, BLOCK) of all texts, zero-padded by REACH - 1 blocks, and where each text's begin and end."""
    counts = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    begins = np.r_[0, np.cumsum(counts + REACH - 1)[:-1]]
    padded = b"".join(t.ljust(int(n + REACH - 1) * BLOCK, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(padded, np.uint8).reshape(-1, BLOCK), begins, begins + counts


@dataclass
class Network:
    embed: np.ndarray  # 256, EMBED
    first: np.ndarray  # REACH * BLOCK * EMBED, FILTERS
    bias1: np.ndarray
    second: np.ndarray  # FILTERS, UNITS
    bias2: np.ndarray
    last: np.ndarray  # UNITS
    bias3: np.ndarray  # 1

    @staticmethod
    def start(seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        wide = REACH * BLOCK * EMBED
        return Network(
            normal(256, EMBED, scale=0.5), normal(wide, FILTERS, scale=(2 / wide) ** 0.5),
            np.zeros(FILTERS, np.float32), normal(FILTERS, UNITS, scale=(2 / FILTERS) ** 0.5),
            np.zeros(UNITS, np.float32), normal(UNITS, scale=0.1), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.bias1, self.second, self.bias2, self.last, self.bias3]

    def chunk_answers(self, blocks: np.ndarray) -> np.ndarray:
        """Answers (chunks, UNITS) of the second layer; chunk i begins at block i."""
        x = self.embed[blocks].reshape(len(blocks), BLOCK * EMBED)
        # One product per block serves the REACH chunks it is part of.
        by_place = self.first.reshape(REACH, BLOCK * EMBED, FILTERS).transpose(1, 0, 2)
        y = (x @ by_place.reshape(BLOCK * EMBED, REACH * FILTERS)).reshape(-1, REACH, FILTERS)
        n = len(blocks) - REACH + 1
        hidden = y[:n, 0] + self.bias1
        for place in range(1, REACH):
            hidden += y[place : n + place, place]
        np.maximum(hidden, 0, out=hidden)
        return hidden @ self.second + self.bias2

    def pooled(self, texts: list[bytes], at_once: int = 65_536) -> np.ndarray:
        """Largest answer of each unit over all chunks of each text, in pieces of bounded size."""
        blocks, begins, ends = blocks_of_texts(texts)
        out = np.full((len(texts), UNITS), -np.inf, np.float32)
        for low in range(0, len(blocks) - REACH + 1, at_once):
            high = min(low + at_once, len(blocks) - REACH + 1)
            answers = self.chunk_answers(blocks[low : high + REACH - 1])
            inside = np.flatnonzero((begins < high) & (ends > low))
            cuts = np.stack([np.maximum(begins[inside], low), np.minimum(ends[inside], high)], 1) - low
            if len(inside):
                padded = np.vstack([answers, np.full((1, UNITS), -np.inf, np.float32)])
                best = np.maximum.reduceat(padded, cuts.ravel(), axis=0)[::2]
                out[inside] = np.maximum(out[inside], best)
        return np.maximum(out, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.pooled(texts).astype(np.float64) @ self.last + self.bias3
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy. Through the maximum only the winning chunks are changed."""
        blocks, begins, ends = blocks_of_texts(texts)
        answers = self.chunk_answers(blocks)
        winner = np.stack([b + answers[b:e].argmax(0) for b, e in zip(begins, ends)])
        pooled = np.maximum(np.take_along_axis(answers, winner, 0), 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.last + self.bias3, -40, 40)))
        dz = ((p - labels) / len(texts)).astype(np.float32)
        dpool = dz[:, None] * self.last * (pooled > 0)
        chunks = blocks[winner.ravel()[:, None] + np.arange(REACH)].reshape(-1, REACH * BLOCK)
        x = self.embed[chunks].reshape(len(chunks), -1)
        hidden = np.maximum(x @ self.first + self.bias1, 0)
        unit = np.tile(np.arange(UNITS), len(texts))
        d2 = np.zeros((len(chunks), UNITS), np.float32)
        d2[np.arange(len(chunks)), unit] = dpool.ravel()
        d1 = (d2 @ self.second.T) * (hidden > 0)
        dx = (d1 @ self.first.T).reshape(-1, EMBED)
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, chunks.ravel(), dx)
        return [dembed, x.T @ d1, d1.sum(0), hidden.T @ d2, d2.sum(0), pooled.T @ dz, dz.sum(keepdims=True)]


def fit(
    texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, seed: int = 7
) -> Network:
    """Adam on minibatches in a seeded order; without labelled texts an untrained, undecided network."""
    net = Network.start(seed)
    if not len(texts):
        net.last[:] = 0
        return net
    rng = np.random.default_rng(seed)
    share = float(np.clip(np.mean(labels), 0.01, 0.99))
    net.bias3[:] = np.log(share / (1 - share))
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            step += 1
            rate = 0.004 * min(1, step / 50) * (1 - 0.95 * step / steps)
            for p, g, (m, v) in zip(
                net.parts(), net.gradients([texts[j] for j in some], labels[some]), moment
            ):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def train_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 32_768
) -> Network:
    """Fit on at most `max_rows` labelled texts of at most `max_bytes` bytes: the driver's bound.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used, those with the smallest hashes
    first. Null ids, texts and labels are no training rows; several labels of one
    document count as their mean.
    """
    usable = labels.where(F.col("quality").isNotNull() & (fold("doc_id") != 0))
    one = usable.groupBy("doc_id").agg(F.avg("quality").alias("_label"))
    text = docs.where(
        F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)
    ).select("doc_id", "text")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (
        text.join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows).collect()
    )
    return fit([r["text"].encode() for r in rows], np.array([r["_label"] for r in rows], np.float64))


def fold(id_column: str):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5


def score_quality(
    docs: DataFrame, net: Network, text_column: str = "text", name: str = "score", block: int = 1 << 20
) -> DataFrame:
    """The input with the probability that a text is of good quality; an input column `name` is replaced.

    Every chunk of the text is read. Null texts count as empty, which the network scores like any
    other text. Rows are scored one by one: repeated rows get equal scores.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t.encode() for t in batch]
            out, low, held = [], 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= block or i == len(texts) - 1:
                    out.append(net.scores(texts[low : i + 1]))
                    low, held = i + 1, 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score(F.coalesce(F.col(text_column), F.lit(""))))


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null id is not held out."""
    net = train_quality(docs, labels)
    return score_quality(docs.select("doc_id", "text"), net).select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose predicted quality is good, with the input's columns."""
    net = train_quality(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    return score_quality(rows, net).where(F.col("score") >= least).select("_doc.*")
