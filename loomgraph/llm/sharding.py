"""Sharding by jump consistent hashing, without a ring table, in DataFrame functions only.

A key visits an increasing series of shard numbers driven by a 64-bit linear congruential generator that
the key seeds; it lives in the last number below the shard count. With one more shard, a key either stays
or moves into that shard.

Null keys count as key 0, repeated rows share their shard and take one slot each, null texts have no bytes,
an empty table gives an empty result, and columns other than key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import buckets_for, running_sum

#: Fixed value: the generator's multiplier, in halves of 32 bits.
MULTIPLIER = 2862933555777941757
LOW, HIGH, MASK = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32, 0xFFFFFFFF
BUCKETS = 1024


def _times_low(x: Column, c: int) -> Column:
    """x * c modulo 2**32, without leaving 63 bits."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c)
    high = F.shiftleft((F.shiftrightunsigned(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state as two halves; long products would overflow under ANSI arithmetic."""
    low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(LOW)
    high = F.shiftrightunsigned(lo, 16) * F.lit(LOW)
    total = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    up = F.shiftrightunsigned(total, 32) + F.shiftrightunsigned(high, 16) + _times_low(hi, LOW) + _times_low(lo, HIGH)
    return up.bitwiseAND(F.lit(MASK)), total.bitwiseAND(F.lit(MASK))


def jump_shards(key: Column, shards: int) -> Column:
    """struct(now, grown): the key's shard among shards and among shards + 1."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"),
        F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1))).cast("long")
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), jump.alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["now"]).alias("now"), s["j"].alias("grown"),
        )
        return F.when(s["j"] <= shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard and grown_shard added (columns of these names are replaced); nothing is shuffled."""
    rest = [c for c in docs.columns if c not in ("shard", "grown_shard")]
    placed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_row"), jump_shards(F.col(key), shards).alias("_jump"))
    return placed.select(*[F.col("_row")[c].alias(c) for c in rest], F.col("_jump.now").cast("int").alias("shard"), F.col("_jump.grown").cast("int").alias("grown_shard"))


def layout(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document with its shard and a gapless slot in it.

    Equal rows are counted first and expanded last, so that one repeated key doesn't fill a task; slots are
    running counts by shard and bucket.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = (
        docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    )
    buckets = F.lit(buckets_for(docs, BUCKETS))
    rows = assign(rows, shards).withColumn(
        "bucket", F.pmod(F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), buckets) + F.col("text_crc32"), buckets).cast("int")
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = running_sum(rows, ["shard"], "bucket", order, "copies", "first")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"), "grown_shard",
    )
