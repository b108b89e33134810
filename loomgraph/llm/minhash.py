"""Near-duplicate detection with DartMinHash signatures and a banded join.

A document is a weighted set of five-word shingles. Every shingle throws hashed darts into the plane of weight
and rank; the darts that land below its weight are the same in every document that holds it. Ranks are
explored cell by cell until about K ln K + 2K darts have landed, each dart falls on one of K coordinates, and
the earliest of each coordinate is the signature. Two signatures agree in a coordinate with the weighted
Jaccard similarity as probability.

Signatures are cut into bands that are joined. A band's bucket never expands into its pairs: its members are
compared with its hub, the member that lies in the most and largest buckets, the middle of a group of copies.
Only members that don't end in the hub's component are compared with the hub's other members, in tiles of
bounded size that count shared shingles by matrix products and give back one link for each join of components.
So in each bucket every pair either lies in one component or has been compared. Comparison is exact, on sets.

Defined results: a null text is empty; texts without words are near only to equal texts, which always share a
class; texts of fewer than five words have one shingle; the class is the smallest doc_id in it (null if all
are null); repeated rows share a class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import forget, keep, release, small_batches
from .common import text_of, tidy, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Sets, and shingles of them, on each side of a tile.
TILE, TILE_SHINGLES = 512, 1 << 18
#: Cells of rank below 1 halve down to this power of two.
FINEST = -5
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, by: int) -> np.uint64:
    return np.uint64(n * by % (1 << 64))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _cells() -> Iterator[tuple[float, float]]:
    """Cells of rank: doubling up to 1, growing by halves beyond, where most limits lie."""
    yield 0.0, 2.0**FINEST
    for j in range(FINEST, 0):
        yield 2.0**j, 2.0 ** (j + 1)
    low = 1.0
    while True:
        yield low, 1.5 * low
        yield 1.5 * low, 2 * low
        low *= 2


def _poisson(area: float) -> np.ndarray:
    """Probabilities of at most 0, 1, 2 ... darts in a cell."""
    k = np.arange(int(area + 12 * math.sqrt(area) + 30))
    logs = k * math.log(area) - area - np.array([math.lgamma(x + 1) for x in k])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """Signatures, owners x k. elements: 64-bit hashes; owner: which set each element is in. Sets must not be empty.

    Ranks rise from cell to cell, so a coordinate that has a dart is done, and only darts on open coordinates are
    compared. A set with open coordinates goes on beyond its limit.
    """
    # A weight is cut into cells of width 1, the last one cut off at the weight.
    cells = np.ceil(weights).astype(np.int64)
    where = np.repeat(np.arange(len(elements)), cells)
    nth = np.arange(len(where)) - np.repeat(np.cumsum(cells) - cells, cells)
    base = mix(elements[where] + (nth.astype(np.uint64) + np.uint64(1)) * GOLD)
    top = np.minimum(weights[where] - nth, 1.0)
    cut = bool((top < 1.0).any())
    own = owner[where].astype(np.int64)
    total = np.bincount(owner, weights, minlength=owners)
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    answer, filled = np.zeros(owners * k, np.uint64), np.zeros(owners * k, bool)
    active = np.arange(len(base))
    for number, (low, high) in enumerate(_cells()):
        if number:
            active = active[low < limit[own[active]]]
        if not len(active):
            unfilled = ~filled.reshape(owners, k).all(axis=1)
            if not unfilled.any():
                break
            limit[unfilled] = max(limit[unfilled].max(), high)
            active = np.flatnonzero(unfilled[own])
        seed = mix(base[active] ^ _odd(number + 1, 0xD6E8FEB86659FD93))
        cdf = _poisson(high - low)
        u = _unit(seed)
        hit = np.flatnonzero(u > cdf[0])
        count = np.searchsorted(cdf, u[hit])
        at = np.repeat(hit, count)
        each = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(seed[at] + (each.astype(np.uint64) + np.uint64(1)) * GOLD)
        at = active[at]
        if cut:
            inside = _unit(mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < top[at]
            at, dart = at[inside], dart[inside]
        key = own[at] * k + (dart % np.uint64(k)).astype(np.int64)
        open_ = ~filled[key]
        key, dart = key[open_], dart[open_]
        order = np.argsort(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))[::-1]
        answer[key[order]] = dart[order]  # the last one written has the least rank in the cell
        filled[key] = True
    return answer.reshape(owners, k)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The different shingles of each list of word hashes, sorted."""
    h = hashes.astype(np.uint64, copy=False)
    n = len(h) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        rolled = mix(rolled * GOLD + h[i : i + n] + np.uint64(1))
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if high - low >= width:
            yield np.unique(rolled[low : high - width + 1])
        elif high > low:
            one = np.zeros(1, np.uint64)
            for x in h[low:high]:
                one = mix(one * GOLD + x + np.uint64(1))
            yield one + np.uint64(high - low)
        else:
            yield np.zeros(0, np.uint64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parts(batch: pa.RecordBatch, words_most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many words, so that memory doesn't follow the batch's text."""
    offsets = batch.column("w").offsets.to_numpy()
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + words_most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def signatures(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """th, bands (a hash per band) of texts(th, w: hashes of the words); texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            column = batch.column("w")
            values, offsets = _lists(column)
            sets = list(shingles(values, offsets))
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            elements = np.concatenate([sets[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(sets[i]) for i in some])
            signature = dart_minhash(elements, np.ones(len(elements)), owner, len(some), bands * rows)
            keys = np.zeros((len(some), bands), np.uint64)
            for j in range(rows):
                keys = mix(keys * GOLD + signature[:, j::rows])
            flat = pa.array(keys.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("th").take(pa.array(some)), lists], ["th", "bands"])
        tidy()

    return texts.mapInArrow(run, "th string, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            column = batch.column("w")
            values, offsets = _lists(column)
            sets = list(shingles(values, offsets))
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["th", "s"])
        tidy()

    return texts.mapInArrow(run, "th string, s array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) of every node of edges(a, b); kept.

    Least labels spread along edges and jump over roots, so the rounds grow with the logarithm of a component's
    width. Only counts come to the driver.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
        near = near.groupBy("a").agg(F.min("other").alias("other"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        jumps = labels.select(F.col("node").alias("r"), F.col("root").alias("far"))
        moved = keep(stepped.join(jumps, F.col("root") == F.col("r"), "left").select("node", "old", F.least("root", "far").alias("root")))
        changed = moved.where("old <> root").limit(1).count()
        forget(labels)
        labels = moved.select("node", "root")
        labels.kept_path = moved.kept_path
        if not changed:
            forget(both)
            return labels


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the similarity; counts are compared as whole thousandths."""
    left = sets.select(F.col("th").alias("b"), F.col("s").alias("sb"))
    right = sets.select(F.col("th").alias("a"), F.col("s").alias("sa"))
    joined = pairs.join(left, "b").join(right, "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    whole = F.size("sa") + F.size("sb") - F.col("shared")
    least = int(round(similarity * 1000))
    return joined.select("a", "b", "sa", "sb", shared.alias("shared")).where(F.col("shared") * 1000 >= whole * least).select("a", "b")


def _joined(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets with the similarity, as many as join components of the two lists' graph."""
    ends = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*flat)
    shared = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(common, f) for f in flat]
    fits = [common[np.minimum(a, len(common) - 1)] == f if len(common) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    order = [np.flatnonzero(fit)[np.argsort(a[fit], kind="stable")] for a, fit in zip(at, fits)]
    for low in range(0, len(common), 2048):
        blocks = []
        for a, o, end, side in zip(at, order, ends, (left, right)):
            some = o[np.searchsorted(a[o], low) : np.searchsorted(a[o], low + 2048)]
            block = np.zeros((len(side), 2048), np.float32)
            block[end[some], a[some] - low] = 1
            blocks.append(block)
        shared += blocks[0] @ blocks[1].T
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    whole = sizes[0][:, None] + sizes[1][None, :] - shared
    parent = list(range(len(left) + len(right)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(shared * 1000 >= whole * int(round(similarity * 1000))))):
        a, b = find(i), find(len(left) + j)
        if a != b:
            parent[a] = b
            yield i, j


def _tiled(waiting: DataFrame, of_hub: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) between waiting(hub, th) and all members of the same hub in of_hub(hub, th)."""
    members = of_hub.join(waiting.select("hub").distinct(), "hub", "left_semi")
    sizes = sets.select("th", F.size("s").alias("k"))
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("k") / TILE_SHINGLES)).cast("int")
    counts = waiting.join(sizes, "th").groupBy("hub").agg(tiles.alias("ni"))
    counts = keep(counts.join(members.join(sizes, "th").groupBy("hub").agg(tiles.alias("nj")), "hub"))

    def dealt(rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        rows = rows.join(counts, "hub").withColumn(mine, F.pmod(F.xxhash64("th"), F.col(f"n{mine}")).cast("int"))
        rows = rows.join(sets, "th").withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"n{theirs}") - 1)))
        return rows.select(*[F.col(c).alias(c) for c in ("hub", "i", "j", "th", "s")])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            a, b = left["th"].tolist(), right["th"].tolist()
            rows = [(min(a[i], b[j]), max(a[i], b[j])) for i, j in _joined(left["s"].tolist(), right["s"].tolist(), similarity) if a[i] != b[j]]
        return pd.DataFrame({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}, dtype=object)

    left = dealt(waiting, "i", "j").groupBy("hub", "i", "j")
    return left.cogroup(dealt(members, "j", "i").groupBy("hub", "i", "j")).applyInPandas(compare, "a string, b string")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, root, class_id) of every row of docs, and the links found between different texts."""
    spark = docs.sparkSession
    base = docs.select("doc_id", text_of().alias("t"))
    hashed = base.select(F.md5(F.col("t").cast("binary")).alias("th"), "t")
    whole = keep(hashed.dropDuplicates(["th"]))
    texts = whole.select("th", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("w"))
    signed = signatures(texts, bands, rows)
    with small_batches(spark):
        members = keep(signed.select("th", F.posexplode("bands").alias("band", "key")))
    # Texts in many large buckets are the middle of their group of near copies; they are the first hubs.
    full = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = keep(members.join(full, ["band", "key"]))
    middle = keep(buckets.groupBy("th").agg(F.sum("n").alias("weight")))
    with_weight = buckets.join(middle, "th")
    hub = with_weight.groupBy("band", "key").agg(F.max(F.struct("weight", "th")).alias("top")).select("band", "key", F.col("top.th").alias("hub"))
    hubbed = keep(with_weight.join(hub, ["band", "key"]).select("th", "band", "key", "n", "weight", "hub"))
    with small_batches(spark):
        sets = keep(shingle_sets(texts.join(buckets.select("th").distinct(), "th", "left_semi")))
    schema = "a string, b string"
    release(spark)
    of_hub = hubbed.where("th <> hub").select("hub", "th").distinct()
    pairs = keep(of_hub.select(F.least("hub", "th").alias("a"), F.greatest("hub", "th").alias("b")).distinct())
    links = keep(_similar(pairs, sets, similarity))
    labels = components(links)
    release(spark)
    own = labels.select(F.col("node").alias("th"), "root")
    hubs = labels.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    marked = of_hub.join(own, "th", "left").join(hubs, "hub", "left")
    waiting = keep(marked.where(F.coalesce("root", "th") != F.coalesce("hub_root", "hub")).select("hub", "th"))
    if waiting.limit(1).count():
        links = keep(links.union(_tiled(waiting, of_hub, sets, similarity)))
        labels = components(links)
    forget(whole, members, middle, buckets, hubbed, sets, pairs, waiting)
    release(spark)
    ids = keep(base.select("doc_id", F.md5(F.col("t").cast("binary")).alias("th")))
    least = ids.groupBy("th").agg(F.min("doc_id").alias("least"))
    rooted = least.join(labels.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    rooted = keep(rooted)
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    by_text = rooted.join(classes, "root").select("th", "root", "class_id")
    return ids.join(by_text, "th").select("doc_id", "th", "root", "class_id"), links


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one with the least doc_id, once; null ids come last."""
    columns = docs.columns
    found, _ = near_duplicates(docs.select("doc_id", "text"), **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")).alias("first")
    chosen = keep(found.groupBy("root").agg(first).select(F.col("first.id").alias("_id"), F.col("first.th").alias("_th")))
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    rows = docs.select(whole, F.md5(text_of().cast("binary")).alias("_h"))
    kept = rows.join(chosen, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left_semi")
    first = kept.groupBy(F.col("_row.doc_id").alias("_id"), "_h").agg(F.first("_row").alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in columns])
