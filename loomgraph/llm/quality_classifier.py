"""A quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Bytes are embedded, learned filters slide
over each chunk and are max-pooled there; the means and the maxima of the chunks' answers are combined into one
probability. The network is trained here on at most TRAIN_ROWS labelled rows (those with the least hashed
doc_id), on all chunks of their whole texts; scoring covers whole texts too.

Defined results: a null or empty text is one chunk of padding and gets a score like any other; equal texts
score alike; rows without label, or with a null one, teach nothing; with one class or none in the labels every
score is the share of that class (0.5 without labels); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import keep, small_batches
from .common import text_of, tidy

TRAIN_ROWS = 3000
CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, EMBED, FILTERS = 12, 4, 6, 32
EPOCHS, BATCH = 5, 32
WINDOWS = (CHUNK - WIDTH) // STRIDE + 1
PREDICT = 0.7


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, each beginning OVERLAP before the last one's end; the last is padded with 0."""
    step = CHUNK - OVERLAP
    n = max(1, -(-max(len(data) - OVERLAP, 1) // step))
    padded = np.zeros(step * (n - 1) + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (step, 1))


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": (rng.standard_normal((256, EMBED)) * 0.5).astype(f),
            "filters": (rng.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "dense": (rng.standard_normal(2 * FILTERS) * 0.1).astype(f),
            "offset": np.zeros(1, f),
        }

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        x = self.p["embed"][rows].reshape(len(rows), CHUNK * EMBED)
        step = x.strides[1]
        return np.lib.stride_tricks.as_strided(x, (len(rows), WINDOWS, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * step, step))

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best answer of each filter in each chunk, and the window that gave it."""
        answers = self._windows(rows).reshape(-1, WIDTH * EMBED) @ self.p["filters"]
        answers = answers.reshape(len(rows), WINDOWS, FILTERS)
        where = answers.argmax(1)
        best = np.take_along_axis(answers, where[:, None, :], 1)[:, 0] + self.p["bias"]
        return np.maximum(best, 0), where

    def best(self, rows: np.ndarray) -> np.ndarray:
        answers = (self._windows(rows).reshape(-1, WIDTH * EMBED) @ self.p["filters"]).reshape(len(rows), WINDOWS, FILTERS)
        return np.maximum(answers.max(1) + self.p["bias"], 0)

    def combine(self, best: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Means and maxima over each text's chunks; starts: the first chunk of each text."""
        sizes = np.diff(np.append(starts, len(best)))[:, None]
        return np.concatenate([np.add.reduceat(best, starts) / sizes, np.maximum.reduceat(best, starts)], axis=1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.p["dense"] + self.p["offset"]).astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(epochs):
            for at in range(0, len(texts), BATCH):
                some = (order := rng.permutation(len(texts)) if at == 0 else order)[at : at + BATCH]
                picked = [chunks(texts[i]) for i in some]
                starts = np.cumsum([0] + [len(c) for c in picked[:-1]])
                step += 1
                for k, g in self._gradients(np.concatenate(picked), starts, labels[some], weight[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - np.float32(0.004) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
        parts = [self.pooled(rows[a : a + 128]) for a in range(0, len(rows), 128)]
        best, where = (np.concatenate(x) for x in zip(*parts))
        features = self.combine(best, starts)
        error = ((self.probability(features) - labels) * weight / len(labels)).astype(np.float32)
        g = {"dense": features.T @ error, "offset": error.sum(keepdims=True)}
        back = error[:, None] * self.p["dense"]
        text = np.repeat(np.arange(len(starts)), sizes := np.diff(np.append(starts, len(rows))))
        to_mean = back[text, :FILTERS] / sizes[text][:, None]
        top = features[text, FILTERS:] == best
        to_best = (to_mean + back[text, FILTERS:] * top) * (best > 0)
        g["bias"] = to_best.sum(0)
        g["filters"], g["embed"] = np.zeros_like(self.p["filters"]), np.zeros((256, EMBED))
        for a in range(0, len(rows), 512):
            some = slice(a, a + 512)
            chunk = np.arange(len(rows[some]))[:, None, None]
            seen = rows[some][chunk, where[some][..., None] * STRIDE + np.arange(WIDTH)]
            inputs = self.p["embed"][seen].reshape(-1, FILTERS, WIDTH * EMBED)
            g["filters"] += np.einsum("cf,cfx->xf", to_best[some], inputs, optimize=True)
            to_input = (to_best[some][..., None] * self.p["filters"].T[None]).reshape(-1, EMBED)
            g["embed"] += np.stack([np.bincount(seen.ravel(), to_input[:, e], 256) for e in range(EMBED)], axis=1)
        g["embed"] = g["embed"].astype(np.float32)
        return g


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | float:
    """A trained network from labels(doc_id, quality); a constant where the labels have fewer than two classes."""
    some = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taught = docs.select("doc_id", text_of().alias("t")).join(F.broadcast(some), "doc_id")
    # A doc_id may have many rows; the bound is on rows, so it is kept before anything is collected.
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(rows).toPandas()
    y = taught["quality"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    network = Network()
    network.train([t.encode() for t in taught["t"]], y)
    return network


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score of every row of docs; kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, network if isinstance(network, float) else 0.0)
            if isinstance(network, Network):
                waiting, size = [], 0
                for i, text in enumerate(batch.column("t")):
                    cut = chunks(text.as_py().encode())
                    # The chunks of one text may come in several parts.
                    found = [network.best(cut[a : a + 256]) for a in range(0, len(cut), 256)] if len(cut) > 256 else cut
                    waiting.append((i, found))
                    size += 1 if isinstance(found, list) else len(cut)
                    if size >= 256 or i == batch.num_rows - 1:
                        flush(network, waiting, scores)
                        waiting, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])
        tidy()

    def flush(network: Network, waiting: list, scores: np.ndarray) -> None:
        plain = [found for _, found in waiting if not isinstance(found, list)]
        best = network.best(np.concatenate(plain)) if plain else None
        at, parts = 0, []
        for _, found in waiting:
            if isinstance(found, list):
                parts.append(np.concatenate(found))
            else:
                parts.append(best[at : at + len(found)])
                at += len(found)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        scores[[i for i, _ in waiting]] = network.probability(network.combine(np.concatenate(parts), starts))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(run, "doc_id long, score double")
    with small_batches(docs.sparkSession):
        return keep(scored)


def held_out(modulus: int = 4, held: int = 2):
    """Rows never learned from, by crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
