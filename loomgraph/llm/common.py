"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: White space between words, and what is not.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side that one number per group describes may be broadcast.
BROADCAST_ROWS = 50_000


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words without building them: runs between separators, less the empty ends."""
    core = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, SPACE, -1))).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def mixed(key: Column, seed: int = 0) -> Column:
    """A repeatable 32-bit order of whole numbers; null is 0. Plain arithmetic, so SQL can restate it."""
    k = F.pmod(F.coalesce(key.cast("long"), F.lit(0)), F.lit(1 << 31))
    first = F.pmod(k * F.lit(2654435761) + F.lit(seed + 1), F.lit(1 << 32))
    return F.pmod(F.pmod(F.floor(first / F.lit(65536.0)).cast("long") + first * F.lit(40503), F.lit(1 << 31)) * F.lit(2246822519), F.lit(1 << 32))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list, amount: str, out: str) -> DataFrame:
    """Add out: the sum of amount over the rows before, by group, in order of bucket and then order.

    No task sees more than one bucket of a group: sums inside buckets come from one window, and those of
    the buckets before from a window over one row per group and bucket.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy(*group, bucket).agg(F.sum(amount).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    )
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(bucket).alias("_b"), "_before")
    same = F.col(bucket) == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(totals, same, "left")
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before", "_b", *[f"_g{i}" for i in range(len(group))])
    )


def buckets_for(df: DataFrame, least: int, rows_each: int = 1 << 17) -> int:
    """A power of two of at least `least` buckets of about so many rows each."""
    buckets, rows = least, df.count()
    while buckets * rows_each < rows:
        buckets *= 2
    return buckets


def tidy() -> None:
    """Give a worker's free memory back to the system: reused workers would hold on to it while others run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def attach(df: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Left join a kept table of one row per group; broadcast only if it is counted to be small."""
    names = [c for c in small.columns if c != on]
    side = small.select(F.col(on).alias("_on"), *names)
    if small.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, F.col(on).eqNullSafe(F.col("_on")), "left").drop("_on")
