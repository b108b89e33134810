"""Removing repeated byte windows with a depth-limited radix sort of suffixes.

Two suffixes share a window of `length` bytes exactly if they fall into one group after a radix sort that is
cut off at that depth. The passes go from the most significant digit down; a group of one is never looked at
again, and a group whose members are equal to the full depth is done:

1. Only suffixes at anchors are sorted first. An anchor is the least of the hashed DIGIT-byte strings in some
   window, so equal windows have equal anchors. The digit is that string; if all members of a group share the
   whole stretch of bytes that the anchor's windows cover, the group is settled.
2. In the other groups members are sorted by their stretches. Equal stretches are settled.
3. What is left are stretches of one member whose group has others: one member of each stretch gives its windows
   to be sorted by themselves.

A pass is an aggregation of polynomial hashes (64 bits for digits, 128 for what is removed) with partial sums, so large groups of copies never meet in
one task. Which digits go on comes back to the scans as a bitmap of fixed size (its false hits only cost work);
what is removed is joined exactly. Texts move once, to meet their ranges.

Defined results: a null text is empty; texts shorter than the window keep all bytes; repeated rows are copies
of one another; an empty table gives an empty result; further columns are ignored. Matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import keep, release, small_batches
from .common import text_of
from .minhash import GOLD, mix

LENGTH = 400
DIGIT = 300
#: Bits of the bitmaps of digits, a power of two.
BITS = 1 << 27
#: Bases of the polynomial hashes, odd; the byte tables follow from the seeds.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of all substrings of a text from running sums: H(s, n) = (P[s+n] - P[s]) / base**s."""

    tables = [np.random.default_rng(seed).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (7, 11)]
    powers: list = []
    inverses: list = []

    @classmethod
    def reach(cls, n: int) -> None:
        if cls.powers and len(cls.powers[0]) >= n:
            return
        size = max(1 << 16, 1 << (n - 1).bit_length())
        cls.powers, cls.inverses = [], []
        for base in BASES:
            for where, value in ((cls.powers, base), (cls.inverses, pow(base, -1, 1 << 64))):
                steps = np.full(size, value, np.uint64)
                steps[0] = 1
                where.append(np.cumprod(steps))

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.reach(n + 1)
        self.sums = []
        for table, powers in zip(self.tables, self.powers):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(table[data] * powers[:n], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = self.sums[which]
        return (total[ends] - total[starts]) * self.inverses[which][starts]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if reach < width else x


def anchors(data: np.ndarray, length: int = LENGTH, digit: int = DIGIT, roll: Rolling | None = None) -> tuple[np.ndarray, ...]:
    """(digit, hash of the stretch, low, high) of each anchor: it stands for the windows low..high.

    A window's anchor is the leftmost of its least digits. Windows with one minimum value form runs; a run has
    several anchors only if the minimum repeats inside the run.
    """
    roll = roll or Rolling(data)
    n = len(data)
    at = np.arange(n - digit + 1)
    value = mix(roll.of(0, at, at + digit))
    width = length - digit + 1
    low_value = _least(value, width)
    runs = np.concatenate([[0], np.flatnonzero(low_value[1:] != low_value[:-1]) + 1])
    ends = np.concatenate([runs[1:], [len(low_value)]]) - 1
    places, lows, highs = [], [], []
    start, stop = runs, ends
    for _ in range(6):
        if not len(start):
            break
        place = start + value[start[:, None] + np.arange(width)].argmin(axis=1)
        places.append(place)
        lows.append(start)
        highs.append(np.minimum(place, stop))
        again = place < stop
        start, stop = place[again] + 1, stop[again]
    for a, b in zip(start.tolist(), stop.tolist()):  # long periodic stretches
        ties = a + np.flatnonzero(value[a : b + width] == low_value[a])
        ties = ties[: int(np.searchsorted(ties, b)) + 1]
        places.append(ties)
        lows.append(np.concatenate([[a], ties[:-1] + 1]))
        highs.append(np.minimum(ties, b))
    place, low, high = map(np.concatenate, (places, lows, highs))
    return value[place], _stretch(roll, place, low, high, length), low, high


def _stretch(roll: Rolling, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Hash of all bytes of the windows low..high, and of where they lie around the anchor."""
    shape = (place - low).astype(np.uint64) * GOLD + (high - low).astype(np.uint64)
    return mix(roll.of(0, low, high + length) ^ mix(shape))


def _bytes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column("t"):
        yield np.frombuffer((text.as_py() or "").encode(), np.uint8)


class _Rows:
    """Gathers rows of many texts into record batches: th first, then numbers."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.count = names, [], 0

    def add(self, th: bytes, *columns: np.ndarray) -> None:
        self.parts.append((th, columns))
        self.count += len(columns[0])

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.parts and (last or self.count > 50_000):
            arrays = [self._column(x) for x in zip(*(c for _, c in self.parts))]
            if "th" in self.names:
                sizes = [len(c[0]) for _, c in self.parts]
                arrays.insert(0, pa.array([p[0] for p in self.parts], pa.binary()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))))
            yield pa.RecordBatch.from_arrays(arrays, self.names)
            self.parts, self.count = [], 0


    @staticmethod
    def _column(parts: tuple) -> pa.Array:
        """Numbers, or lists of them given as (values, ends)."""
        if isinstance(parts[0], tuple):
            starts = np.cumsum([0] + [len(v) for v, _ in parts[:-1]])
            ends = np.concatenate([[0], *(e + s for (_, e), s in zip(parts, starts))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), _Rows._column(tuple(v for v, _ in parts)))
        flat = np.concatenate(parts)
        return pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64))


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of keys modulo bits: `bits` / 8 bytes whatever the number of keys."""
    place = F.pmod("key", F.lit(bits)) + 1
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["m"], np.uint8)
    return out


def _marked(key: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = (key & np.uint64(len(marks) * 8 - 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _windows_of(roll: Rolling, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (of both bases in one) of all windows of the stretches, one after another, and the stretches' ends."""
    ends = np.cumsum(high - low + 1)
    at = np.arange(ends[-1]) + np.repeat(low - np.concatenate([[0], ends[:-1]]), high - low + 1)
    return mix(roll.of(0, at, at + length)) ^ roll.of(1, at, at + length), ends


def _scan(texts: DataFrame, names: list[str], kind: str, emit, length: int, digit: int) -> DataFrame:
    """Rows that emit(rows, th, roll, anchors) adds for each text of texts(th, t) that holds a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(names)
        for batch in batches:
            for th, data in zip(batch.column("th").to_pylist(), _bytes_of(batch)):
                if len(data) >= length:
                    roll = Rolling(data)
                    emit(rows, th, roll, anchors(data, length, digit, roll))
                    yield from rows.batches()
        yield from rows.batches(True)

    return texts.select("th", "t").mapInArrow(run, kind)


def spans_of(ranges: list, length: int) -> list[tuple[int, int]]:
    """Removed byte ranges from ranges of window starts."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        end = high + length
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((low, end))
    return out


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, th, n_bytes, spans, kept_sha256 of texts(doc_id, th, t, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        schema = pa.schema([("n_bytes", pa.int64()), ("spans", kind), ("kept_sha256", pa.string())])
        for batch in batches:
            out = []
            for ranges, text in zip(batch.column("ranges").to_pylist(), batch.column("t")):
                data = (text.as_py() or "").encode()
                spans = spans_of([(x["low"], x["high"]) for x in ranges or []], length)
                digest, at = hashlib.sha256(), 0
                for low, high in spans:
                    digest.update(data[at:low])
                    at = high
                digest.update(data[at:])
                out.append({"n_bytes": len(data), "spans": [{"low": a, "high": b} for a, b in spans], "kept_sha256": digest.hexdigest()})
            made = pa.RecordBatch.from_pylist(out, schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *made.columns], ["doc_id", "th", *schema.names])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "th", "t", "ranges")
    return rows.mapInArrow(run, "doc_id long, th binary, n_bytes long, spans array<struct<low:long,high:long>>, kept_sha256 string")


def _hash(text):
    return F.unhex(F.md5(text.cast("binary")))


def repeated(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """doc_id, th (hash of the text), n_bytes, spans (byte ranges to remove), kept_sha256 of every row; kept."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("t")).withColumn("th", _hash(F.col("t")))
    texts = rows.where(F.octet_length("t") >= length)

    def digits(out: _Rows, th: bytes, roll: Rolling, found: tuple) -> None:
        out.add(th, found[0], found[1])

    def stretches(out: _Rows, th: bytes, roll: Rolling, found: tuple) -> None:
        key, f, low, high = found
        on = _marked(key, going.value)
        if on.any():
            w, ends = _windows_of(roll, low[on], high[on], length)
            out.add(th, key[on], f[on], (w, ends))

    def answers(out: _Rows, th: bytes, roll: Rolling, found: tuple) -> None:
        key, f, low, high = found
        for level, marks in enumerate((done.value, going.value)):
            on = _marked(key, marks)
            if on.any():
                out.add(th, key[on], f[on] if level else np.zeros(on.sum(), np.uint64), (low[on] << 16) + (high - low)[on])

    with small_batches(spark):
        first = _scan(texts, ["key", "f"], "key long, f long", digits, length, digit)
        groups = first.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).where("n > 1")
        groups = keep(groups.select("key", (F.col("a") == F.col("b")).alias("done")))
        release(spark)
        going, done = (spark.sparkContext.broadcast(bitmap(groups.where(c))) for c in ("not done", "done"))
        second = _scan(texts, ["key", "f", "w"], "key long, f long, w array<long>", stretches, length, digit)
        # Marked by mistake are keys that aren't going on; they are few and end here.
        members = keep(second.groupBy("key", "f").agg(F.count(F.lit(1)).alias("n"), F.first("w").alias("w")).withColumn("id", F.monotonically_increasing_id()))
        release(spark)
        # Equal windows have equal digits, so that the digit is the other half of a window's 128 bits.
        double = keep(members.select("key", F.explode("w").alias("x")).groupBy("key", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "x"))
        single = members.where("n = 1").select("id", "key", F.posexplode("w").alias("at", "x"))
        places = keep(single.join(double, ["key", "x"], "left_semi").groupBy("id").agg(F.collect_list("at").alias("at")))
        release(spark)
        settled = groups.where("done").select("key", F.lit(0).cast("long").alias("f"), F.lit(None).cast("array<int>").alias("at"))
        twice = members.where("n > 1").select("key", "f", F.lit(None).cast("array<int>").alias("at"))
        alone = members.where("n = 1").select("id", "key", "f").join(places, "id").select("key", "f", "at")
        third = _scan(texts, ["th", "key", "f", "range"], "th binary, key long, f long, range long", answers, length, digit)
        found = third.join(settled.union(twice).union(alone), ["key", "f"])
        low = F.shiftright("range", 16)
        whole = F.struct(low.alias("low"), (low + F.col("range").bitwiseAND(F.lit(0xFFFF))).alias("high"))
        some = F.transform("at", lambda x: F.struct((low + x).alias("low"), (low + x).alias("high")))
        found = found.select("th", F.coalesce(some, F.array(whole)).alias("r"))
        ranges = keep(found.groupBy("th").agg(F.array_distinct(F.flatten(F.collect_set("r"))).alias("ranges")))
        release(spark)
        return keep(_kept(rows.join(ranges, "th", "left"), length))


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["high"] - x["low"])
    return repeated(docs, length).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of text; characters that lose a byte are lost."""
    found = repeated(docs, length).groupBy("th").agg(F.first("spans").alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text, found):
            data, at, out = text.encode(), 0, []
            for x in found:
                out.append(data[at : x["low"]])
                at = x["high"]
            return b"".join([*out, data[at:]]).decode(errors="ignore")

        return texts.combine(spans, one)

    # The row travels in a struct, so that no column of the caller's meets one of ours.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), text_of().alias("_text")).withColumn("_h", _hash(F.col("_text")))
    rows = rows.join(found.withColumnRenamed("th", "_h"), "_h", "left")
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    own["text"] = F.when(F.size("_spans") > 0, cut(F.col("_text"), F.col("_spans"))).otherwise(own["text"])
    return rows.select(*[value.alias(c) for c, value in own.items()])
