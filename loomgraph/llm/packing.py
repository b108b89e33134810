"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Texts are tokenised on the executors and cut into pieces of at most `capacity` tokens. Packing then needs the
number of pieces of each length only, so the driver works on a histogram of at most `capacity` counts and on
groups of equal bins: best fit by falling length, then a local search over all underfull groups that moves a
piece, exchanges one for one or two for one wherever that raises the squared fill, as many bins at a time as
both groups have, until no step gains or no fewer bins are possible.
Pieces get their places back by a running number within their length.

Defined results: a null or empty text is the end token alone; equal texts and repeated rows are packed
separately; an empty table gives an empty result; further columns are ignored. Texts of any length are
tokenised whole and cut by tokens, never by characters.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import keep, small_batches
from .common import buckets_for, running_sum, tidy

CAPACITY = 2048
END_ID = 0
BUCKETS = 256
#: Words whose tokens a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Marks that are one token string however many follow a word (an apostrophe may begin one of its own), and how many such
#: endings are remembered; letters whose lower case and bytes are known.
MARKS, ENDINGS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"), 10_000
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict = {}


class _Words(dict):
    """Token bytes by word. White space only ends tokens here, so a text's ids are those of its words in turn.

    Once half of CACHE_WORDS are known they become the older ones and those before them go, so that words in use stay.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        told = {c.encode().decode("latin-1"): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.moved = [(c, d) for c, d in told.items() if c != d]
        self.marks: dict = {}
        self.older: dict = {}
        self[""] = b""

    def learn(self, words: list) -> None:
        if len(self) > CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        fresh = [w for w in words if w not in self.older and len(w) <= CACHE_CHARS and not self._plain(w)]
        for at in range(0, len(fresh), 512):  # encoding words one by one costs most of its time around the calls
            some = fresh[at : at + 512]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            firsts = np.fromiter(map(itemgetter(0), found.offsets), np.int64)
            cuts = (4 * np.searchsorted(firsts, starts)).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            self.update((w, ids[low:high]) for w, low, high in zip(some, cuts, cuts[1:]))

    def _plain(self, word: str) -> bool:
        """Latin letters are one token string of the tokenizer, and the marks after them are another: no need to split those."""
        stem = word.rstrip(MARKS)
        if not (stem.isalpha() or not stem if stem.isascii() else LETTERS.fullmatch(stem)):
            return False
        low, end = stem.lower(), word[len(stem) :]
        ids = self.get(low) or self.older.get(low)
        if ids is None:
            ids = self._ids(low)
        if end:
            marks = self.marks.get(end)
            if marks is None:
                marks = self._ids(end)
                if len(self.marks) < ENDINGS:
                    self.marks[end] = marks
            ids += marks
        self[word] = ids
        return True

    def _ids(self, string: str) -> bytes:
        if not string.isascii():
            string = string.encode().decode("latin-1")
            for c, d in self.moved:
                string = string.replace(c, d)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(string)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids


def token_bytes(texts: list[str], path: str, end_id: int = END_ID) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit numbers, the end token included.

    Some hundred texts at a time are split and their different words numbered; each of these is looked up once.
    """
    known = _tokenizers.get(path) or _tokenizers.setdefault(path, _Words(path))
    end = end_id.to_bytes(4, "little")
    for at in range(0, len(texts), 512):
        split = pc.ascii_split_whitespace(pa.array(texts[at : at + 512], pa.large_string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = list(map(known.get, words))
        known.learn([w for w, x in zip(words, ids) if x is None])
        ids = pa.array([known[w] if x is None else x for w, x in zip(words, ids)], pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        cuts = np.frombuffer(places, np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        for low, high in zip(cuts, cuts[1:]):
            yield b"".join((data[low:high], end))


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document, without texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None), token_bytes([t or "" for t in batch["text"]], path)):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})
        tidy()

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(run, PIECES)


# --- bins, on the driver: at most `capacity` lengths, groups of equal bins ---


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Groups (lengths in a bin, number of such bins) by best fit over falling lengths."""
    groups: dict[int, list] = {}
    free: list[int] = []

    def put(left: int, group: list) -> None:
        if left not in groups:
            bisect.insort(free, left)
            groups[left] = []
        groups[left].append(group)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = capacity // length
                if todo // each:
                    put(capacity - each * length, [(length,) * each, todo // each])
                if todo % each:
                    put(capacity - todo % each * length, [(length,) * (todo % each), 1])
                break
            left = free[at]
            items, many = groups[left].pop()
            if not groups[left]:
                del groups[left]
                free.pop(at)
            # As many of this length as the room left takes, in as many of these bins as there are pieces for.
            fit = min(left // length, todo)
            used = min(many, todo // fit)
            put(left - fit * length, [items + (length,) * fit, used])
            if many > used:
                put(left, [items, many - used])
            todo -= fit * used
    return [(items, many) for left in groups for items, many in groups[left]]


def _improve(bins: list[list[int]], capacity: int, rounds: int | None = None) -> list[list[int]]:
    """The local search on single bins, at most so many steps."""
    counts = Counter(tuple(sorted(b, reverse=True)) for b in bins if b)
    return [list(items) for items, many in _search(counts, capacity, 0, rounds) for _ in range(many)]


def _search(counts: dict[tuple, int], capacity: int, least: int, rounds: int | None = None) -> list[tuple[tuple, int]]:
    """Local search on groups of equal bins: pieces go from emptier to fuller bins by the step that fills the fuller one most.

    A step is done min(sources, targets) times at once and splits the groups; inside one group, half of its bins are
    sources. Every step raises the sum of squared fills, so the search ends: when no pair of underfull bins has a
    step, or with `least` bins. Every pair of groups is looked at once after the younger one came about.
    """
    counts = {items: many for items, many in counts.items() if items and many}
    total, steps, clock = sum(counts.values()), 0, 0
    slack = {items: sum(items) for items in counts if sum(items) < capacity}
    born, seen = dict.fromkeys(slack, 0), {}
    queue = [(fill, items) for items, fill in slack.items()]
    heapq.heapify(queue)

    def add(items: tuple, many: int) -> None:
        fill, before = sum(items), counts.get(items, 0)
        counts[items] = before + many
        # A group that was one bin has a pair in itself now.
        if fill < capacity and (before == 0 or (before == 1 and items in seen)):
            slack[items], born[items] = fill, clock
            seen.pop(items, None)
            heapq.heappush(queue, (fill, items))

    def take(items: tuple, many: int) -> None:
        counts[items] -= many
        if not counts[items]:
            del counts[items], slack[items], born[items]
            seen.pop(items, None)

    while queue and total > least:
        _, x = heapq.heappop(queue)
        if x not in slack or x in seen:
            continue
        clock += 1
        seen[x] = clock
        for y in sorted(slack, key=slack.__getitem__, reverse=True):
            if y not in slack or seen.get(y, clock) < clock and born[x] < seen[y] or (x == y and counts[x] < 2):
                continue
            source, target = (x, y) if slack[x] <= slack[y] else (y, x)
            step = _step(source, target, capacity - slack[target])
            if not step and slack[x] == slack[y]:
                source, target = target, source
                step = _step(source, target, capacity - slack[target])
            if not step:
                continue
            if steps == rounds:
                return list(counts.items())
            many = counts[x] // 2 if x == y else min(counts[x], counts[y])
            clock += 1
            steps += 1
            for items in (source, target):
                take(items, many)
            fuller, emptier = list(target), list(source)
            for goes, comes, moved in ((emptier, fuller, step[0]), (fuller, emptier, step[1])):
                for piece in moved:
                    goes.remove(piece)
                    comes.append(piece)
            add(tuple(sorted(fuller, reverse=True)), many)
            if emptier:
                add(tuple(sorted(emptier, reverse=True)), many)
            else:
                total -= many
            if x not in slack or x not in seen or total <= least:
                break
    return list(counts.items())


@lru_cache(maxsize=1 << 16)
def _offers(items: tuple) -> tuple[int, int, tuple]:
    """A bit for each length in a bin, a bit for each sum of two of its pieces, and the different lengths."""
    kinds = Counter(items)
    single = double = 0
    for a, many in kinds.items():
        single |= 1 << a
    for a, many in kinds.items():
        double |= (single & ~(1 << a)) << a
        if many > 1:
            double |= 1 << 2 * a
    return single, double, tuple(sorted(kinds, reverse=True))


def _step(source: list[int], target: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """What to take from source and give back from target so that target gains most, at most room; None if nothing gains."""
    single, double, _ = _offers(tuple(source))
    back = _offers(tuple(target))[2]
    inside = (1 << room + 1) - 2
    best, gain = None, 0
    for offer, backs in ((single, (0,)), (single, back), (double, back)):
        for b in backs:
            most = (offer >> b & inside).bit_length() - 1
            if most > gain:
                best, gain = (offer, b), most
        if gain == room:
            break
    if best is None:
        return None
    (offer, b), given = best, gain + best[1]
    if offer is single:
        return [given], [b] if b else []
    kinds = Counter(source)
    first = next(a for a in sorted(kinds, reverse=True) if kinds[given - a] > (2 * a == given))
    return [first, given - first], [b]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Groups of equal bins for a histogram of lengths; the search works on all of them, and no bin is ever added."""
    groups = best_fit(counts, capacity)
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    same: Counter = Counter()
    for items, many in groups:
        same[tuple(sorted(items, reverse=True))] += many
    return _search(same, capacity, least)


def places(groups: list[tuple[tuple, int]]) -> dict[int, list[tuple]]:
    """For each length runs (first index, sequence of the first, offset of the first, of this length in a bin)."""
    runs: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, many in groups:
        offset, ordered = 0, sorted(items, reverse=True)
        for length in dict.fromkeys(ordered):
            each = ordered.count(length)
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset, each))
            used[length] = used.get(length, 0) + each * many
            offset += each * length
        sequence += many
    return runs


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = tokenised(docs, path, capacity)
    spread = F.col("ids_crc32") + F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 20))
    with small_batches(spark):
        pieces = keep(pieces.withColumn("one", F.lit(1).cast("long")))
    pieces = pieces.withColumn("bucket", F.pmod(spread, F.lit(buckets_for(pieces, BUCKETS))).cast("int"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A row per length, so at most `capacity` rows however many pieces there are.
    runs = [(length, [r[0] for r in found], found) for length, found in places(pack(counts, capacity)).items()]
    kind = "length long, firsts array<long>, runs array<struct<first:long,sequence:long,offset:long,each:long>>"
    side = F.broadcast(spark.createDataFrame(runs, kind))
    order = [F.col("ids_crc32"), F.col("doc_id").asc_nulls_first(), F.col("piece")]
    numbered = running_sum(pieces, ["length"], "bucket", order, "one", "nth")
    run = F.get("runs", F.size(F.filter("firsts", lambda x: x <= F.col("nth"))) - 1)
    placed = numbered.join(side, "length").withColumn("run", run).withColumn("into", F.col("nth") - F.col("run.first"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.expr("into div run.each")).alias("sequence_id"),
        (F.col("run.offset") + F.col("length") * F.expr("into % run.each")).alias("offset"),
    )
