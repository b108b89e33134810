"""Hard negatives by vantage-point trees over norm-augmented vectors.

Every vector gets one more component, so that all have the same length; a query gets a zero there. Then a larger inner
product is a smaller distance, a window of scores is an annulus around the query, and the rows of a window come
nearest first: a tree is walked by the least distance a node can have, nodes that the annulus misses are left out, and
the walk ends once the k-th row found is nearer than any node left. Results are exact.

A tree of a bounded sample cuts space into regions; every row goes to its region, and least and greatest distances of
each region to the vantage points above it are taken over all rows. Regions are cut into blocks by row, each with a
tree of its own, stored once. A query goes first to its most promising regions and then to all others that may still
hold something better. Scores are whole numbers: components are multiplied by SCALE and rounded down.

Defined results: rows with a null id, label or vector, or with null or non-finite components take no part, nor do rows
whose inner product with themselves doesn't fit 55 bits; vectors of different lengths are as if zeros followed the
shorter one; repeated rows are separate rows; ties go to the smaller id; an empty table gives an empty result; further
columns are ignored. Columns are named.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import forget, keep

SCALE = 256
SAMPLE_ROWS = 16384
REGIONS_MOST = 4096
BLOCK_ROWS, CHUNK_ROWS = 8192, 1024
LEAF_ROWS = 256
#: Regions that each window of a query is sent to before the others.
FIRST = 2
FOUND = "row long, w int, vec_id long, other long, score long"


class Space:
    """Distances between augmented vectors; `most` is the largest squared length of a row."""

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width
        self.kind = np.float64 if most < 1 << 53 else np.int64  # sums of doubles are exact below 2^53
        self.slack = 1e-6 * np.sqrt(most) + 1e-9

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.width), self.kind)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def rest(self, x: np.ndarray) -> np.ndarray:
        """The component that each row gets, squared."""
        return np.maximum(self.most - (x.astype(np.float64) ** 2).sum(1), 0)

    def apart(self, x: np.ndarray, rest: np.ndarray, at: np.ndarray, at_rest: float) -> np.ndarray:
        """Distances of rows to a row."""
        return np.sqrt(np.maximum(2.0 * self.most - 2 * (x @ at) - 2 * np.sqrt(rest * at_rest), 0))

    def asked(self, scores, own):
        """Distances of rows to queries of squared length own, from their inner products."""
        return np.sqrt(np.maximum(own + float(self.most) - 2.0 * scores, 0))


def _vantage(x: np.ndarray, rest: np.ndarray, space: Space) -> int:
    """A row far from the first one: balls around it cut better than balls around a middle."""
    return int(space.apart(x, rest, x[0], rest[0]).argmax())


class Regions:
    """The sample's tree: vantage points and radii in heap order, leaves are regions."""

    def __init__(self, x: np.ndarray, space: Space, levels: int):
        rest, inner = space.rest(x), (1 << levels) - 1
        self.space, self.levels = space, levels
        self.points, self.rests, self.radii = np.zeros((inner, space.width), space.kind), np.zeros(inner), np.full(inner, np.inf)
        members = {0: np.arange(len(x))}
        for node in range(inner):
            own = members.pop(node)
            if len(own):
                v = own[_vantage(x[own], rest[own], space)]
                self.points[node], self.rests[node] = x[v], rest[v]
                d = space.apart(x[own], rest[own], x[v], rest[v])
                self.radii[node] = np.median(d)
                members[2 * node + 1], members[2 * node + 2] = own[d <= self.radii[node]], own[d > self.radii[node]]
            else:
                members[2 * node + 1] = members[2 * node + 2] = own
        leaves = np.arange(1 << levels) + inner
        self.paths = np.stack([(leaves + 1 >> levels - k) - 1 for k in range(levels)], 1) if levels else np.zeros((1, 0), np.int64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Region of each row, and its distances to the vantage points on the way there."""
        node, rest, dist = np.zeros(len(x), np.int64), self.space.rest(x), np.zeros((len(x), self.levels))
        for k in range(self.levels):
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                dist[at, k] = self.space.apart(x[at], rest[at], self.points[n], self.rests[n])
                node[at] = 2 * n + 1 + (dist[at, k] > self.radii[n])
        return node - ((1 << self.levels) - 1), dist

    def bounds(self, q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that rows of each region can have to each query; low, high: of regions to their path."""
        if not self.levels:
            return np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        d = self.space.asked(q @ self.points.T, own[:, None])[:, self.paths]
        return np.maximum(np.maximum(d - high, low - d).max(2), 0), (d + high).min(2)


class Tree:
    """A vantage-point tree over a block of rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, space: Space):
        self.space, rest, order, self.nodes = space, space.rest(x), np.arange(len(x)), []

        def grow(start: int, stop: int, low: float, high: float) -> int:
            own, number = order[start:stop], len(self.nodes)
            mine = labels[own]
            node = [start, stop, low, high, mine.min(), mine.max(), None, -1, -1]
            self.nodes.append(node)
            if stop - start > LEAF_ROWS:
                v = own[_vantage(x[own], rest[own], space)]
                d = space.apart(x[own], rest[own], x[v], rest[v])
                by = np.argsort(d, kind="stable")
                order[start:stop], d, half = own[by], d[by], (stop - start) // 2
                node[6] = x[v]
                node[7] = grow(start, start + half, d[0], d[half - 1])
                node[8] = grow(start + half, stop, d[half], d[-1])
            return number

        grow(0, len(x), 0.0, np.inf)
        self.x, self.ids, self.rows, self.labels = x[order], ids[order], rows[order], labels[order]

    def dumped(self) -> bytes:
        out = io.BytesIO()
        points = np.stack([self.x[0] if n[6] is None else n[6] for n in self.nodes])
        flat = np.array([[n[0], n[1], n[4], n[5], n[7], n[8]] for n in self.nodes], np.int64)
        np.savez(out, x=self.x, ids=self.ids, rows=self.rows, labels=self.labels, points=points, flat=flat, bounds=np.array([n[2:4] for n in self.nodes], np.float64))
        return out.getvalue()

    @classmethod
    def loaded(cls, content: bytes, space: Space) -> Tree:
        tree, held = cls.__new__(cls), np.load(io.BytesIO(content))
        tree.space, tree.x, tree.ids, tree.rows, tree.labels = space, held["x"], held["ids"], held["rows"], held["labels"]
        tree.nodes = [[a, b, low, high, c, d, p, left, right] for (a, b, c, d, left, right), (low, high), p in zip(held["flat"].tolist(), held["bounds"].tolist(), held["points"])]
        return tree

    def walk(self, q: np.ndarray, own: float, row: int, label: int, same: bool, windows: list[tuple], k: int) -> list[list[tuple]]:
        """For each window (least score, greatest score, score to beat or None) its k best rows here: (-score, id, row)."""
        space, slack = self.space, self.space.slack
        near = [float(space.asked(high, own)) - slack for _, high, _ in windows]
        far = [float(space.asked(low if least is None else max(low, least), own)) + slack for low, _, least in windows]
        best: list[list[tuple]] = [[] for _ in windows]
        heap = [(0.0, 0, np.inf)]
        while heap:
            low, number, high = heapq.heappop(heap)
            open_ = [w for w in range(len(windows)) if near[w] <= far[w] and low <= far[w] and high >= near[w]]
            if not open_:
                continue
            start, stop, _, _, first, last, point, left, right = self.nodes[number]
            if (label < first or label > last) if same else (first == last == label):
                continue
            if left >= 0:
                d = float(space.asked(q @ point, own))
                for child in (left, right):
                    inner, outer = self.nodes[child][2:4]
                    heapq.heappush(heap, (max(low, d - outer, inner - d), child, min(high, d + outer)))
                continue
            scores = self.x[start:stop] @ q
            fits = (self.labels[start:stop] == label) & (self.rows[start:stop] != row) if same else self.labels[start:stop] != label
            for w in open_:
                least, most, beat = windows[w]
                floor = max(least, -best[w][-1][0]) if len(best[w]) == k else least if beat is None else max(least, beat)
                at = np.flatnonzero(fits & (scores >= floor) & (scores <= most))
                if len(at) > k:  # all that tie with the k-th stay for the order of ids
                    at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
                if len(at):
                    found = zip((-scores[at]).tolist(), self.ids[start:stop][at].tolist(), self.rows[start:stop][at].tolist())
                    best[w] = sorted([*best[w], *found])[:k]
                    if len(best[w]) == k:
                        far[w] = min(far[w], float(space.asked(-best[w][-1][0], own)) + slack)
        return best


class Index:
    """All rows in blocks with trees, and what the driver knows of regions: at most REGIONS_MOST rows."""

    def __init__(self, rows: DataFrame, width: int, most: int, count: int):
        self.space = space = Space(most, max(width, 1))
        sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE_ROWS).select("c").toPandas()
        levels = 0
        while (1 << levels) * BLOCK_ROWS < count and (2 << levels) <= min(REGIONS_MOST, len(sample) // 4):
            levels += 1
        self.regions = regions = Regions(space.matrix(sample["c"].to_numpy()), space, levels)

        def put(batches):
            for batch in batches:
                region, dist = regions.place(space.matrix(batch["c"].to_numpy()))
                yield batch.assign(region=region.astype(np.int32), dist=list(dist))

        kind = "row long, vec_id long, label long, c array<long>, region int, dist array<double>"
        placed = keep(rows.select("row", "vec_id", "label", "c").mapInPandas(put, kind))
        ends = [f(F.get("dist", F.lit(k))).alias(f"{name}{k}") for k in range(levels) for name, f in (("low", F.min), ("high", F.max))]
        told = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last"), *ends).collect()
        shape = (1 << levels, levels)
        self.low, self.high, self.blocks = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape[0], np.int64)
        self.first, self.last = np.zeros(shape[0], np.int64), np.zeros(shape[0], np.int64)
        for r in told:
            self.low[r["region"]], self.high[r["region"]] = [r[f"low{k}"] for k in range(levels)], [r[f"high{k}"] for k in range(levels)]
            self.blocks[r["region"]], self.first[r["region"]], self.last[r["region"]] = -(-r["n"] // BLOCK_ROWS), r["first"], r["last"]

        def build(block: pd.DataFrame) -> pd.DataFrame:
            tree = Tree(space.matrix(block["c"].to_numpy()), block["vec_id"].to_numpy(), block["row"].to_numpy(), block["label"].to_numpy(), space)
            return pd.DataFrame({"region": block["region"].iloc[:1], "block": block["block"].iloc[:1], "tree": [tree.dumped()]})

        which = F.pmod(F.xxhash64("row"), F.get(F.array(*[F.lit(int(max(b, 1))) for b in self.blocks]), F.col("region"))).cast("int")
        self.trees = keep(placed.drop("dist").withColumn("block", which).groupBy("region", "block").applyInPandas(build, "region int, block int, tree binary"))
        forget(placed)

    def _sent(self, queries: DataFrame, same: bool, first: bool) -> DataFrame:
        """queries with the regions they go to; windows hold (low, high, beat)."""
        regions, low, high, blocks, begin, end = self.regions, self.low, self.high, self.blocks, self.first, self.last
        space = self.space

        def reach(windows, label: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
            fits = (blocks > 0) & ((begin <= label) & (label <= end) if same else ~((begin == label) & (end == label)))
            asked = np.zeros((2, len(near)), bool)
            for low_, high_, beat, own in windows:
                inner, outer = space.asked(high_, own) - space.slack, space.asked(low_, own) + space.slack
                cut = fits & (near <= outer) & (far >= inner) & (inner <= outer)
                order = np.flatnonzero(cut)
                soon = order[np.argsort(np.maximum(near[order], inner), kind="stable")[:FIRST]]
                asked[0, soon] = True
                asked[1] |= cut if beat is None else cut & (near <= space.asked(beat, own) + space.slack)
            return asked[0] if first else asked[1]

        def send(batches):
            for batch in batches:
                q = space.matrix(batch["c"].to_numpy())
                own = (q.astype(np.float64) ** 2).sum(1)
                near, far = regions.bounds(q, own, low, high)
                out = []
                for i, (label, windows, before) in enumerate(zip(batch["label"], batch["windows"], batch["before"])):
                    asked = np.flatnonzero(reach([(w["low"], w["high"], w["beat"], own[i]) for w in windows], label, near[i], far[i]))
                    out.append(np.setdiff1d(asked, before).astype(np.int32))
                yield batch.assign(before=out)

        kind = "row long, label long, c array<long>, windows array<struct<low:long,high:long,beat:long>>, before array<int>"
        return queries.select("row", "label", "c", "windows", "before").mapInPandas(send, kind)

    def _visit(self, sent: DataFrame, same: bool, k: int) -> DataFrame:
        space = self.space
        asks = sent.withColumn("region", F.explode("before")).drop("before")
        counts = {r["region"]: r["n"] for r in asks.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
        chunks = F.array(*[F.lit(-(-counts.get(r, 0) // CHUNK_ROWS)) for r in range(len(self.blocks))])
        blocks = F.array(*[F.lit(int(b)) for b in self.blocks])
        of_region = F.get(chunks, F.col("region"))
        asks = asks.withColumn("chunk", F.pmod(F.xxhash64("row"), of_region).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("region")).cast("int") - 1)))
        trees = self.trees.where(of_region > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), of_region.cast("int") - 1)))

        def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(held):
                tree = Tree.loaded(held["tree"].iloc[0], space)
                q = space.matrix(asked["c"].to_numpy())
                own = (q.astype(np.float64) ** 2).sum(1)
                for i, (row, label, windows) in enumerate(zip(asked["row"], asked["label"], asked["windows"])):
                    found = tree.walk(q[i], own[i], row, label, same, [(w["low"], w["high"], w["beat"]) for w in windows], k)
                    out += [(row, w, vec_id, other, -int(score)) for w, best in enumerate(found) for score, vec_id, other in best]
            frame = pd.DataFrame(out, columns=["row", "w", "vec_id", "other", "score"])
            return frame.astype({"row": "int64", "w": "int32", "vec_id": "int64", "other": "int64", "score": "int64"})

        key = ["region", "block", "chunk"]
        found = asks.groupBy(*key).cogroup(trees.groupBy(*key)).applyInPandas(search, FOUND)
        return keep(_best(found, k))

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """row, w, rank, vec_id, other, score: the k best rows, of the query's label or of others, in each of its windows.

        queries(row, label, c, windows of (low, high)); the first visit gives each window a score to beat for the second.
        """
        open_ = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.lit(None).cast("long").alias("beat")))
        queries = queries.withColumn("windows", open_).withColumn("before", F.array().cast("array<int>"))
        sent = keep(self._sent(queries, same, True))
        found = self._visit(sent, same, k)
        if len(self.blocks) > FIRST:
            least = found.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_least"))
            beat = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.try_element_at("_least", i.cast("int")).alias("beat")))
            again = keep(self._sent(sent.join(least, "row", "left").withColumn("windows", beat), same, False))
            more = self._visit(again, same, k)
            both = keep(_best(found.drop("rank").unionByName(more.drop("rank")), k))
            forget(found, again, more)
            found = both
        forget(sent)
        return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    rows of the same label, the first rows of other labels whose score is at most the positive's and at least `share`
    hundredths of it."""
    spark = vectors.sparkSession
    v, most = F.col(column), float(1 << 31) / SCALE
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < most))
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & label.isNotNull() & F.col(key).isNotNull())
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("c"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    own = F.aggregate("c", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = rows.withColumn("own", own).where(F.col("own") < float(1 << 55)).withColumn("row", F.monotonically_increasing_id())
    rows = keep(rows)
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("most"), F.max(F.size("c")).alias("width")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known["n"]:
        return spark.createDataFrame([], schema)
    index = Index(rows, known["width"], int(known["most"]), known["n"])
    anchors = rows.where("asks").select("row", "vec_id", "label", "c")
    all_scores = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    close = index.search(anchors.withColumn("windows", all_scores), True, positives)
    picked = close.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("picked"))
    picked = keep(picked)
    # The least whole number of at least share / 100 of the score; it lies above a negative score, whose window is empty.
    windows = F.expr(f"transform(picked, p -> struct((p.positive_score * {share} + if(p.positive_score > 0, 99, 0)) div 100 as low, p.positive_score as high))")
    hard = index.search(anchors.join(picked, "row").withColumn("windows", windows), False, negatives)
    found = hard.join(picked, "row").join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").withColumn("p", F.get("picked", F.col("w")))
    out = keep(found.select("anchor_id", "p.positive_id", "rank", F.col("vec_id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score")))
    forget(rows, index.trees, close, picked, hard)
    return out
