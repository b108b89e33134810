"""Dense vectors: hashed embeddings, cosine search, passage pooling and similar pairs."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows and queries of a block.
BLOCK = 4096
DIMENSION = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_unit(a: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def cosine(a: Column, b: Column) -> Column:
    """Cosine, not below 0; 0 for a zero vector. Vectors of different length are an error."""
    size = norm(a) * norm(b)
    checked = F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), dot(a, b) / size)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.when(size == 0, 0.0).otherwise(checked)


#: Words that a worker keeps with their places; beyond that it begins anew, so memory doesn't grow with the corpus.
KNOWN_WORDS = 400_000
#: Words of a text that are added up at a time.
WORDS_AT_ONCE = 8192


@lru_cache(maxsize=200_000)
def _piece(piece: str, dimension: int) -> tuple[int, float]:
    h = hashlib.sha256(piece.encode()).digest()
    return int.from_bytes(h[:4], "big") % dimension, 0.4 * (1.0 - 2.0 * (h[4] % 2))


def _word(word: str, dimension: int) -> tuple[tuple[int, float], tuple[int, float]]:
    h = hashlib.sha256(word.encode()).digest()
    first = int.from_bytes(h[:4], "big") % dimension, 1.5 * (1.0 - 2.0 * (h[4] % 2))
    return first, (int.from_bytes(h[5:9], "big") % dimension, 0.8 * (1.0 - 2.0 * (h[9] % 2)))


class _Places:
    """What each word adds to a vector: places and amounts, one word's after another's in two arrays."""

    def __init__(self, dimension: int):
        self.dimension, self.weights = dimension, np.zeros(0)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.at, self.amount = array("q", [0]), array("q"), array("d")

    def learn(self, word: str) -> int:
        added = [*_word(word, self.dimension), *(_piece(word[i : i + n], self.dimension) for n in (3, 4) for i in range(len(word) - n + 1))]
        at, amount = zip(*added)
        self.at.extend(at)
        self.amount.extend(amount)
        self.starts.append(len(self.at))
        self.rows[word] = len(self.rows)
        return self.rows[word]

    def weight(self, n: int) -> np.ndarray:
        if n > len(self.weights):
            self.weights = np.array([1.0 / math.log2(pos + 3.0) for pos in range(max(n, 2 * len(self.weights)))])
        return self.weights

    def add(self, vector: np.ndarray, words: list[str], first: int) -> None:
        """Add words that stand at `first` and after it, one after another, so that sums are those of single steps."""
        if len(self.rows) > KNOWN_WORDS:
            self.clear()
        known = self.rows.get
        rows = np.array([known(w, -1) for w in words], np.int64)
        for i in np.flatnonzero(rows < 0).tolist():
            row = known(words[i])
            rows[i] = self.learn(words[i]) if row is None else row
        starts = np.frombuffer(self.starts, np.int64)
        begin, size = starts[rows], starts[rows + 1] - starts[rows]
        ends = np.cumsum(size)
        entry = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        weight = np.repeat(self.weight(first + len(words))[first : first + len(words)], size)
        np.add.at(vector, np.frombuffer(self.at, np.int64)[entry], np.frombuffer(self.amount)[entry] * weight)


@lru_cache(maxsize=8)
def _places(dimension: int) -> _Places:
    return _Places(dimension)


def hash_embedding(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Signed hashes of words and of their 3- and 4-grams, weighted down with position, to unit length."""
    vector, places = np.zeros(dimension), _places(dimension)
    words = re.findall(r"[a-z0-9_]+", (text or "").lower())
    for at in range(0, len(words), WORDS_AT_ONCE):
        places.add(vector, words[at : at + WORDS_AT_ONCE], at)
    size = np.linalg.norm(vector)
    return vector / size if size else np.full(dimension, 1 / math.sqrt(dimension))


def embedder(dimension: int = DIMENSION):
    """The embedding seam: a vectorised function from text to array<double>."""

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hash_embedding(t, dimension))

    return embed


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, key, score, rank for a stated batch of queries(query_id, query_vector), best first, ties by key.

    Rows and queries are dealt into blocks; a pair of blocks is a matrix product that gives back k rows a query, so
    neither side is broadcast and no pair of rows is ever written. Scores are rounded to nine places.
    """
    parts = {}
    for name, side in (("r", vectors), ("q", queries)):
        parts[name] = max(1, -(-side.count() // BLOCK))
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v")).withColumn("r", F.pmod(F.xxhash64("k"), F.lit(parts["r"])).cast("int"))
    asks = queries.select(F.col("query_id").cast("long").alias("k"), F.col("query_vector").cast("array<double>").alias("v")).withColumn("q", F.pmod(F.xxhash64("k"), F.lit(parts["q"])).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts["q"] - 1)))).groupBy("r", "q")
    asks = asks.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(parts["r"] - 1)))).groupBy("r", "q")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "k": [], "score": []}).astype({"query_id": "int64", "k": "int64"})
        if len(a) and len(b):
            x, y = (np.stack(t["v"].to_numpy()) for t in (a, b))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            score, ids, asked = np.round(x @ y.T, 9), b["k"].to_numpy(), a["k"].to_numpy()
            n = min(k, len(ids))
            least = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
            i, j = np.nonzero((score >= least[:, None]) & (score > 0))
            order = np.lexsort((ids[j], -score[i, j], i))
            i, j = i[order], j[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out = pd.DataFrame({"query_id": asked[i[kept]], "k": ids[j[kept]], "score": score[i[kept], j[kept]]})
        return out

    found = asks.cogroup(rows).applyInPandas(best, "query_id long, k long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "k")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("k", key)


def write_vectors(vectors: DataFrame, path: str, model: str, dimension: int, corpus_hash: str) -> None:
    """Vectors and, in a table of one row, what they were made with; what has another length or isn't of unit length fails."""
    fine = (F.size("embedding") == dimension) & (F.abs(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)) - 1) < 1e-3)
    checked = vectors.where(F.when(fine, True).otherwise(F.raise_error(F.lit("vector of wrong length")).cast("boolean")))
    checked.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(model, dimension, corpus_hash)], "model string, dimension int, corpus_hash string").write.mode("overwrite").parquet(f"{path}/made")


def read_vectors(spark, path: str, model: str, dimension: int, corpus_hash: str | None = None) -> tuple[DataFrame, bool]:
    """The vectors at path and whether they are fresh: made by that model, of that dimension and for that corpus."""
    made = spark.read.parquet(f"{path}/made").first()
    fresh = made["model"] == model and made["dimension"] == dimension and (corpus_hash is None or made["corpus_hash"] == corpus_hash)
    return spark.read.parquet(f"{path}/vectors"), fresh


def best_passage(scored: DataFrame, group: str, chunk: str, score: str = "score") -> DataFrame:
    """Best positive passage of each group; the first one wins ties."""
    best = F.max_by(F.struct(chunk, score), F.struct(F.col(score), -F.col(chunk))).alias("b")
    return scored.where(F.col(score) > 0).groupBy(group).agg(best).select(group, F.col(f"b.{chunk}").alias(chunk), F.col(f"b.{score}").alias(score))


def mean_pool(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """group, pooled: mean of each coordinate. A row per group and coordinate meets in the shuffle, not the vectors."""
    flat = vectors.select(group, F.posexplode(column).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pooled"))


def similar_pairs(vectors: DataFrame, least: float, group: str, key: str = "vec_id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """Pairs a < b of a group with cosine of at least `least`, tile by tile.

    Rows are dealt into blocks; each pair of blocks of a group is one small matrix product, so memory is bounded
    by two blocks and a large group is many tasks.
    """
    rows = vectors.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v"))
    blocks = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(blocks), "g").withColumn("b", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    left = rows.withColumn("c", F.explode(F.sequence(F.col("b"), F.col("blocks") - 1))).select("g", "b", "c", "k", "v")
    right = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b")))).select("g", F.col("o").alias("b"), F.col("b").alias("c"), "k", "v")

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"g": [], "a": [], "b": [], "similarity": []})
        if len(a) and len(b):
            x, y = (np.stack(t["v"].to_numpy()) for t in (a, b))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            score = x @ y.T
            ka, kb = a["k"].to_numpy(), b["k"].to_numpy()
            same = a["b"].iloc[0] == a["c"].iloc[0]
            i, j = np.nonzero((score >= least) & ((ka[:, None] < kb[None, :]) if same else (ka[:, None] != kb[None, :])))
            out = pd.DataFrame({"g": a["g"].iloc[0], "a": np.minimum(ka[i], kb[j]), "b": np.maximum(ka[i], kb[j]), "similarity": score[i, j]})
        return out.astype({"g": "int64", "a": "int64", "b": "int64", "similarity": "float64"})

    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy("g", "b", "c").cogroup(right.groupBy("g", "b", "c")).applyInPandas(tile, "g long, a long, b long, similarity double")
