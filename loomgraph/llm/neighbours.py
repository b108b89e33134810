"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size (spectral bisection, refined by
swaps); a small network learns from it which part a vector's neighbours lie in. Every row is then indexed under
its most probable part, and a query goes to its most probable parts, as many as add up to a certain probability,
for exact reranking. That probability is read off the sample: the least one with which the sample's own queries
find TARGET of their true neighbours. A query goes on to further parts until they hold more than k rows, so none
is short of neighbours. The number of parts follows the square root of the rows up to PARTS_MOST.

Parts are divided into blocks of rows and of queries, so a crowded part is many tasks. Scores are inner
products summed left to right in double precision, so equal vectors tie exactly and ties go to the smaller id.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
numbers take no part; repeated rows are separate rows, each with its own neighbours; fewer candidates than k
give all of them; an empty table gives an empty result; further columns are ignored. Columns are named.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import keep

SAMPLE_ROWS = 4096
GRAPH_NEIGHBOURS = 10
PARTS_MOST = 256
TARGET = 0.94
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
HIDDEN = 128


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product with each row, itself left out; some rows at a time."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 256):
        near = x[at : at + 256] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at : at + 256] = np.argpartition(near, len(x) - k, axis=1)[:, len(x) - k :]
    return out


def balanced_parts(graph: np.ndarray, parts: int, passes: int = 4) -> np.ndarray:
    """A part for each node: halves of equal size again and again along the slowest-mixing direction, then swaps
    between parts that bring more edges inside."""
    n, rng = len(graph), np.random.default_rng(3)
    weight = np.zeros((n, n), np.float32)
    weight[np.arange(n)[:, None], graph] = 1
    weight += weight.T
    label = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        fresh = label * 2
        for p in range(count):
            nodes = np.flatnonzero(label == p)
            w = weight[np.ix_(nodes, nodes)]
            degree = np.sqrt(w.sum(1) + 1e-6)
            w /= degree[:, None]
            w /= degree[None, :]
            top = degree / np.linalg.norm(degree)
            v = rng.standard_normal(len(nodes)).astype(np.float32)
            for _ in range(30):
                v = w @ v + v
                v -= top * (top @ v)
                v /= np.linalg.norm(v) + 1e-12
            fresh[nodes[np.argsort(v / degree, kind="stable")[len(nodes) // 2 :]]] += 1
        label, count = fresh, count * 2
    for _ in range(passes):
        member = np.zeros((n, parts), np.float32)
        member[np.arange(n), label] = 1
        inside = weight @ member
        own = inside[np.arange(n), label]
        inside[np.arange(n), label] = -np.inf
        wish, gain = inside.argmax(1), inside.max(1) - own
        order = np.argsort(-gain, kind="stable")
        waiting: dict = {}
        for i in order[gain[order] > 0].tolist():
            a, b = int(label[i]), int(wish[i])
            if waiting.get((b, a)):
                j = waiting[b, a].pop()
                label[i], label[j] = b, a
            else:
                waiting.setdefault((a, b), []).append(i)
    return label


class Router:
    """A network of one hidden layer from vectors to probabilities of parts."""

    def __init__(self, x: np.ndarray, goal: np.ndarray, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.scale = float(np.sqrt((x**2).sum(1).mean())) or 1.0
        x = self._in(x)
        d, parts = x.shape[1], goal.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                some = order[at : at + 256]
                a, y = x[some], goal[some]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                g = (p - y) / len(some)
                back = (g @ self.w[2].T) * (h > 0)
                step += 1
                for i, grad in enumerate((a.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    grad = grad + 1e-4 * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad**2
                    self.w[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def _in(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale * np.sqrt(x.shape[1])

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(self._in(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def parts_for(rows: int, sample: int) -> int:
    """A power of two of about a quarter of the square root of the rows; 2 at least, if the sample has 4 rows."""
    most = min(PARTS_MOST, np.sqrt(rows) / 4, sample / 16)
    return 1 << max(1, int(np.log2(max(most, 1)))) if sample >= 4 else 1


def fit(x: np.ndarray, rows: int, k: int) -> tuple[Router | None, int, float]:
    """Router, number of parts, and the probability that a query's parts must add up to."""
    parts = parts_for(rows, len(x))
    if parts == 1:
        return None, 1, 1.0
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    label = balanced_parts(graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    goal[np.arange(len(x)), label] += graph.shape[1] / 2
    goal /= goal.sum(1, keepdims=True)
    # Half of the sample teaches, the other half says how far queries must go.
    taught = np.arange(len(x)) % 2 == 0
    router = Router(x[taught], goal[taught])
    chance = router.probabilities(x)
    asked = np.flatnonzero(~taught)[:1024]
    true = neighbour_graph(x, k)[asked]
    before = _before(chance[asked])
    needed = np.sort(np.take_along_axis(before, chance.argmax(1)[true], 1).ravel())
    return router, parts, float(needed[int(np.ceil(TARGET * len(needed))) - 1])


def _before(chance: np.ndarray) -> np.ndarray:
    """For each part, what more probable parts add up to."""
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.take_along_axis(chance, order, 1)
    out = np.empty_like(chance)
    np.put_along_axis(out, order, np.cumsum(ranked, 1) - ranked, 1)
    return out


def probes(chance: np.ndarray, reach: float, sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """The parts of each query: all that come before reach, and further ones until they hold more than k rows."""
    order = np.argsort(-chance, axis=1, kind="stable")
    before = np.take_along_axis(_before(chance), order, 1)
    held = np.cumsum(sizes[order], 1) - sizes[order]
    many = np.maximum((before <= reach).sum(1), (held <= k).sum(1))
    return [o[:n].astype(np.int32) for o, n in zip(order, many)]


def nearest(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """row (the query's), vec_id, score of the k best of a block for each query."""
    out = []
    length = np.sqrt((vectors**2).sum(1).max())
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], query_rows[at : at + 256]
        rough = q @ vectors.T
        rough[own[:, None] == rows[None, :]] = -np.inf
        n = min(k, rough.shape[1])
        least = np.partition(rough, rough.shape[1] - n, axis=1)[:, rough.shape[1] - n]
        slack = 1e-9 * (np.sqrt((q**2).sum(1)) * length + 1e-300)
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        exact = np.zeros(len(i))
        for d in range(q.shape[1]):
            exact += q[i, d] * vectors[j, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(q)))
        best = np.arange(len(i)) - first[i] < k
        out.append(pd.DataFrame({"row": own[i[best]], "vec_id": ids[j[best]], "score": exact[best]}))
    return pd.concat(out)


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of each row for which is_query holds."""
    spark = vectors.sparkSession
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size(v) == lengths["n"]).select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
    sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE_ROWS).select("v").toPandas()
    x = np.stack(sample["v"].to_numpy()).astype(np.float64)
    router, parts, reach = fit(x, lengths["rows"], k)
    shared = spark.sparkContext.broadcast(router)

    def chances(batch: pd.DataFrame) -> np.ndarray:
        if shared.value is None:
            return np.ones((len(batch), 1))
        return shared.value.probabilities(np.stack(batch["v"].to_numpy()))

    def put(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(p=chances(batch).argmax(1).astype(np.int32))

    placed = keep(rows.select("row", "vec_id", "v", "asks").mapInPandas(put, "row long, vec_id long, v array<double>, asks boolean, p int"))
    # A row per part, at most PARTS_MOST.
    sizes = {r["p"]: r["n"] for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(p, 0) for p in range(parts)])

    def sent(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=probes(chances(batch), reach, held, k))

    asks = keep(placed.where("asks").select("row", "vec_id", "v").mapInPandas(sent, "row long, vec_id long, v array<double>, parts array<int>"))
    asked = {r["p"]: r["n"] for r in asks.select(F.explode("parts").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    row_blocks = F.array(*[F.lit(-(-sizes.get(p, 0) // BLOCK_ROWS) or 1) for p in range(parts)])
    query_blocks = F.array(*[F.lit(-(-asked.get(p, 0) // BLOCK_QUERIES) or 1) for p in range(parts)])
    mine = F.xxhash64("row", F.lit(1))

    def every(table, own):
        return F.sequence(F.lit(0), F.get(table, F.col("p")) - 1), F.pmod(own, F.get(table, F.col("p"))).cast("int")

    stored = placed.select("p", every(row_blocks, mine)[1].alias("r"), F.explode(every(query_blocks, mine)[0]).alias("q"), "row", "vec_id", "v")
    asking = asks.withColumn("p", F.explode("parts"))
    asking = asking.select("p", F.explode(every(row_blocks, mine)[0]).alias("r"), every(query_blocks, mine)[1].alias("q"), "row", "vec_id", "v")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "vec_id": [], "score": []}).astype({"row": "int64", "vec_id": "int64"})
        return nearest(np.stack(left["v"].to_numpy()), left["row"].to_numpy(), np.stack(right["v"].to_numpy()), right["row"].to_numpy(), right["vec_id"].to_numpy(), k)

    found = asking.groupBy("p", "r", "q").cogroup(stored.groupBy("p", "r", "q")).applyInPandas(rank, "row long, vec_id long, score double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    names = asks.select("row", F.col("vec_id").alias("query_id"))
    return found.join(names, "row").select("query_id", "rank", "vec_id", "score")
