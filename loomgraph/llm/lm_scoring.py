"""Language-model scores by prediction by partial matching (PPM) over a byte trie.

A text is its UTF-8 bytes, ASCII letters in lower case, white space included, and an end symbol. Each symbol is
predicted from its ORDER preceding bytes, then from ORDER - 1 and so on down to none, across words alike; bytes
before the text are a symbol of their own in contexts. A context gives its symbols count / (total + kinds) and
escapes with kinds / (total + kinds) (method C); symbols that a longer context has seen are excluded from the
shorter ones, and below order 0 what is left is equal. Counts come from the whole training part of the corpus.

What a symbol costs depends on its ORDER + 1 bytes alone, so texts are cut into blocks of about BLOCK_BYTES, and
only a block's different strings of that length leave it, with their training counts. The trie is split into
buckets by the hash of the three nearest context bytes; a bucket has all strings that agree in them, derives its
orders from ORDER down to 3, and sends the cost of each string back to the blocks that asked. Orders 2 to 0 have a
bound that is proven (256 ** 3 counts) and are broadcast. Words are counted by blocks and buckets in the same way,
by 64-bit hashes.

A block's answers meet its texts by a join on the block, so nothing that grows with the corpus is broadcast or
collected, and no task holds more than one block or one bucket. Larger workers may take larger blocks, of which
fewer strings leave for each byte.

Defined results: a null text is an end alone; a null doc_id is in training; without training rows all symbols
are equal, and the base is that of 1 / (0 + 1); repeated rows count as often as they come; an empty table gives an
empty result; further columns are ignored. A single text longer than a block is a block of its own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import forget, keep, release, small_batches
from .common import text_of, tidy
from .minhash import GOLD, mix

ORDER = 5
#: Near context bytes whose hash says the bucket; orders below are broadcast.
NEAR = 3
BLOCK_BYTES = 8 << 20
BUCKETS_MOST = 1 << 16
#: Bytes that UTF-8 never uses stand for what is before a text and for its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 255
END_WORD = np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, BEFORE, END]] = True
#: Random numbers by place in a word and byte (tabulation hashing), from a fixed seed.
_TABLE = np.random.default_rng(17).integers(1, 1 << 63, (64, 256)).astype(np.uint64) * np.uint64(2)


def joined(texts: list[str | None]) -> np.ndarray:
    """The bytes of texts in one array, each after ORDER bytes BEFORE and closed by END."""
    head, tail = bytes([BEFORE]) * ORDER, bytes([END])
    parts = [bytes([BEFORE]) * (7 - ORDER)]
    for text in texts:
        parts += (head, (text or "").encode().lower(), tail)
    return np.frombuffer(b"".join(parts), np.uint8)


def strings(data: np.ndarray) -> np.ndarray:
    """For each symbol its context, the nearest byte foremost, and the symbol last: one number of ORDER + 1 bytes."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    code = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,)).copy()
    code >>= np.uint64(8 * (7 - ORDER))
    symbol = code >> np.uint64(8 * ORDER)
    code &= np.uint64((1 << 8 * ORDER) - 1)
    code <<= np.uint64(8)
    code |= symbol
    return code[data[7:] != BEFORE]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the place of its first byte."""
    inside = ~_IS_SPACE[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # the first byte is always BEFORE
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    begin = np.zeros(len(data), np.int32 if len(data) < 1 << 31 else np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place = np.arange(len(data), dtype=begin.dtype) - begin
    value = _TABLE[place & 63, data]
    far = np.flatnonzero(inside & (place > 63))
    value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * GOLD)
    value[~inside] = 0
    return np.add.reduceat(value, starts) | np.uint64(2), starts  # never END_WORD


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def counted(all_: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of both, sorted, and how often each is in trained."""
    some, n = _distinct(trained)
    every = some if all_ is trained else _distinct(np.concatenate([some, _distinct(all_)[0]]))[0]
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, some)] = n
    return every, counts


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as bytes: differences if they rise, least bytes of all first, compressed."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=kind) if rising else x


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((codes >> np.uint64(8 * (ORDER + 1 - NEAR))) + GOLD) % np.uint64(buckets)).astype(np.int32)


class Block:
    """Texts in two runs, those in training first, with their strings and words."""

    def __init__(self, ids: list, trained: list, texts: list):
        order = sorted(range(len(ids)), key=lambda i: not trained[i])
        self.ids, self.trained = [ids[i] for i in order], [trained[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.cut = sum(map(bool, trained))
        self.data = [joined(part) for part in (self.texts[: self.cut], self.texts[self.cut :])]
        self.codes = [strings(d) for d in self.data]

    def words(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each run the word hashes, the ends' included at last, and the text of each."""
        out = []
        for data, many in zip(self.data, (self.cut, len(self.ids) - self.cut)):
            hashes, starts = word_hashes(data)
            text = np.searchsorted(np.flatnonzero(data == END), starts)
            out.append((np.append(hashes, np.full(many, END_WORD)), np.append(text, np.arange(many))))
        return out

    def tables(self, buckets: int) -> tuple:
        """(strings, counts, rows of each bucket) and the same of words."""
        found = []
        words = [w for w, _ in self.words()]
        for both, where in ((self.codes, bucket_of), (words, lambda x, n: (x % np.uint64(n)).astype(np.int32))):
            every, counts = counted(np.concatenate(both) if len(both[1]) else both[0], both[0])
            at = where(every, buckets)
            order = np.argsort(at, kind="stable")
            found.append((every, counts, order, np.searchsorted(at[order], np.arange(buckets + 1))))
        return tuple(found)

    def stored(self) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(self.trained, pa.bool_()), pa.array(self.texts, pa.large_string())], ["i", "r", "t"])
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return zstandard.ZstdCompressor(level=1).compress(sink.getbuffer())

    @classmethod
    def restored(cls, data: bytes) -> Block:
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data, max_output_size=0)).read_all()
        return cls(*(table.column(i).to_pylist() for i in range(3)))


class Level:
    """The contexts of one order: of each its total, its kinds of symbols, and what those come to one order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: Level | None):
        self.keys, self.counts = keys, counts.astype(np.float64)
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
        self.totals = np.add.reduceat(self.counts, first) if len(keys) else self.counts
        self.shared = np.zeros(len(first))
        if below is not None and len(keys):
            self.shared = np.add.reduceat(below.counts[np.searchsorted(below.keys, shorter(keys))], first)


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys (context, symbol) without the farthest context byte."""
    return (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def low_levels(keys: np.ndarray, counts: np.ndarray, order: int = NEAR - 1) -> list[Level]:
    """Levels 0 to `order` from the counts of the last one."""
    tables = [(keys, counts)]
    for _ in range(order):
        tables.append(_summed(shorter(tables[-1][0]), tables[-1][1]))
    levels: list[Level] = []
    for k, c in reversed(tables):
        levels.append(Level(k, c, levels[-1] if levels else None))
    return levels


def costs(codes: np.ndarray, counts: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 of the probability of each string's last symbol; codes are sorted, with their training counts."""
    seen = counts > 0
    tables = [(codes[seen], counts[seen])]
    for _ in range(ORDER - len(low)):
        tables.append(_summed(shorter(tables[-1][0]), tables[-1][1]))
    levels = list(low)
    for k, c in reversed(tables):
        levels.append(Level(k, c, levels[-1]))
    out, rest = np.zeros(len(codes)), np.arange(len(codes))
    keys, less_total, less_kinds = codes, np.zeros(len(codes)), np.zeros(len(codes))
    for level in reversed(levels):
        if not len(level.keys):
            keys = shorter(keys)
            continue
        at, known = _find(level.contexts, keys >> np.uint64(8))
        total, kinds = level.totals[at] - less_total, level.kinds[at] - less_kinds
        where, found = _find(level.keys, keys)
        out[rest[found]] += np.log10(level.counts[where[found]] / (total + kinds)[found])
        escapes = known & ~found & (kinds > 0)
        out[rest[escapes]] += np.log10(kinds[escapes] / (total + kinds)[escapes])
        on = ~found
        less_total, less_kinds = np.where(known, level.shared[at], 0)[on], np.where(known, level.kinds[at], 0)[on]
        rest, keys = rest[on], shorter(keys[on])
    out[rest] -= np.log10(SYMBOLS - less_kinds)
    return out


ROWS = "block long, bucket int, docs binary, low binary, low_counts binary, codes binary, counts binary, words binary, word_counts binary"


def _blocks(docs: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    """Of each block a row with its texts and its counts of order 2 (bucket -1), and a row for each bucket it reaches."""

    def rows(block: Block, number: int) -> pa.RecordBatch:
        (codes, counts, order, ends), (words, word_counts, word_order, word_ends) = block.tables(buckets)
        seen = counts > 0
        low, low_counts = _summed((codes[seen] >> np.uint64(8 * (ORDER + 2 - NEAR)) << np.uint64(8)) | (codes[seen] & np.uint64(255)), counts[seen])
        out = [(number, -1, block.stored(), packed(low, True), packed(low_counts), None, None, None, None)]
        for b in range(buckets):
            at, words_at = order[ends[b] : ends[b + 1]], word_order[word_ends[b] : word_ends[b + 1]]
            if len(at) or len(words_at):
                out.append((number, b, None, None, None, packed(codes[at], True), packed(counts[at].astype(np.uint32)), packed(words[words_at], True), packed(word_counts[words_at].astype(np.uint32))))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
        names = [c.split()[0] for c in ROWS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, waiting = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(3))):
                doc_id, trained, text = (x.as_py() for x in row)
                if size and size + len(text) > block_bytes:
                    yield rows(Block(*waiting), number)
                    number, size, waiting = number + 1, 0, ([], [], [])
                for column, x in zip(waiting, (doc_id, trained, text)):
                    column.append(x)
                size += len(text) + 8
        if waiting[0]:
            yield rows(Block(*waiting), number)
        tidy()

    return docs.mapInArrow(run, ROWS)


def _low_counts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of symbols after two bytes: at most 256 ** 3 of them, whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["low"], batch["low_counts"]):
                yield pd.DataFrame({"key": unpacked(keys, np.uint64, True).astype(np.int64), "n": unpacked(counts, np.int64)})

    found = blocks.where("bucket = -1").select("low", "low_counts").mapInPandas(run, "key long, n long")
    found = found.groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return found["key"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)


def score(docs: DataFrame, trained=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score. trained: a condition on docs."""
    spark = docs.sparkSession
    trained = F.lit(True) if trained is None else trained
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), trained.alias("trained"), text_of().alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    buckets = min(max(4, -(-size // block_bytes)), BUCKETS_MOST)
    with small_batches(spark):
        blocks = keep(_blocks(rows, buckets, block_bytes))
    shared = spark.sparkContext.broadcast(_low_counts(blocks))

    def bucket(part: pd.DataFrame) -> pd.DataFrame:
        low = low_levels(*shared.value)
        out = {"block": part["block"].tolist()}
        for name, kind, values, counts in (("costs", np.float32, "codes", "counts"), ("word_counts", np.int64, "words", "word_counts")):
            keys = [unpacked(x, np.uint64, True) for x in part[values]]
            n = [unpacked(x, np.uint32).astype(np.int64) for x in part[counts]]
            every, total = _summed(np.concatenate(keys), np.concatenate(n))
            answer = costs(every, total, low).astype(np.float32) if name == "costs" else total
            out[name] = [packed(answer[np.searchsorted(every, k)]) for k in keys]
        first = np.arange(len(part)) == 0
        frame = pd.DataFrame(out).assign(bucket=int(part["bucket"].iloc[0]), tokens=np.where(first, total.sum(), 0), kinds=np.where(first, (total > 0).sum(), 0))
        return frame[["block", "bucket", "costs", "word_counts", "tokens", "kinds"]]

    asked = blocks.where("bucket >= 0").select("block", "bucket", "codes", "counts", "words", "word_counts")
    answers = keep(asked.groupBy("bucket").applyInPandas(bucket, "block long, bucket int, costs binary, word_counts binary, tokens long, kinds long"))
    release(spark)
    total, kinds = answers.agg(F.sum("tokens"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0
    least = float(np.log10(total + kinds + 1))

    def finish(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for stored in texts["docs"]:
            block = Block.restored(bytes(stored))
            have = found.set_index("bucket")
            (codes, _, order, _), (words, _, word_order, _) = block.tables(buckets)
            cost, known = np.zeros(len(codes)), np.zeros(len(words), np.int64)
            some = [b for b in range(buckets) if b in have.index]
            cost[order] = np.concatenate([unpacked(have.at[b, "costs"], np.float32) for b in some])
            known[word_order] = np.concatenate([unpacked(have.at[b, "word_counts"], np.int64) for b in some])
            scores, n_tokens, n_known, base = [], [], [], []
            for run, (hashes, text) in zip(range(2), block.words()):
                many = (block.cut, len(block.ids) - block.cut)[run]
                if not many:
                    continue
                each = _placed(block.codes[run], codes, cost)
                data = block.data[run]
                ends = np.cumsum(data[7:] != BEFORE)[np.flatnonzero(data == END) - 7]
                scores.append(np.add.reduceat(each, np.concatenate([[0], ends[:-1]])))
                counts = known[np.searchsorted(words, hashes)]
                n_tokens.append(np.bincount(text, minlength=many))
                n_known.append(np.bincount(text, counts > 0, many).astype(np.int64))
                base.append(np.bincount(text, np.log10(counts + 1.0) - least, many))
            columns = [np.concatenate(x) for x in (n_tokens, n_known, base, scores)]
            frames.append(pd.DataFrame({"doc_id": pd.array(block.ids, "Int64"), "trained": block.trained, **dict(zip(("n_tokens", "n_known", "base_score", "score"), columns))}))
        kind = {"doc_id": "Int64", "trained": bool, "n_tokens": "int64", "n_known": "int64", "base_score": float, "score": float}
        return pd.concat(frames) if frames else pd.DataFrame({k: pd.Series(dtype=v) for k, v in kind.items()})

    texts = blocks.where("bucket = -1").select("block", "docs")
    scored = texts.groupBy("block").cogroup(answers.select("block", "bucket", "costs", "word_counts").groupBy("block"))
    result = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    done = keep(scored.applyInPandas(finish, result))
    forget(blocks, answers)
    return done.select("doc_id", "trained", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _placed(codes: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each code; table is sorted. Sorting first makes one pass of the table do."""
    order = np.argsort(codes)
    inside = codes[order]
    step = np.concatenate([[True], inside[1:] != inside[:-1]])
    out = np.empty(len(codes))
    out[order] = values[np.searchsorted(table, inside[step])][np.cumsum(step) - 1]
    return out


def in_training(modulus: int = 7, held: int = 2):
    """Training rows by crc32 of doc_id as text; a null doc_id is in training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held, F.lit(True))
