"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule w(t) over training time 0..1, linear between knots. Its integral, scaled
to the source's target, is the source's cumulative demand D(t); the word that ends at cumulative demand m
belongs at t with D(t) = m, so every copy of a document gets the position that inverts D at its middle word.
The mix is the copies range-sorted by position.

Defined results: a null or empty text has size 0 and is taken once; a null source is a source of its
own, last in order; repeated rows are separate documents; an empty table gives an empty mix; further columns
are carried by mix() and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import keep
from .common import attach, buckets_for, mixed, n_words, running_sum, text_of

WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 1024
#: Weight schedules by place in WEIGHTS, as values at equally spaced knots: early, even, late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> with place, weight and target.

    Resharing the excess by weight until no source is above its cap ends where target = min(cap * size,
    level * weight) adds up to all sizes. With sources by size / weight, the level follows from running sums:
    it is the first one at which the next source stays below its cap.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1).cast("double"))
    limit = (F.col("source_size") * cap).cast("double")
    order = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = (
        table.withColumn("_limit", limit)
        .withColumn("_full", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
        .withColumn("_fits", F.when(F.col("_limit") >= F.col("_level") * F.col("weight"), F.col("_level")))
        .withColumn("_final", F.first("_fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("_limit"), F.col("_final") * F.col("weight"))
    return table.withColumn("target", F.coalesce(target, F.col("_limit"))).select("source", "source_size", "place", "weight", "target")


def invert(schedule: tuple, demand: Column) -> Column:
    """t with the schedule's integral up to t equal to demand, a share of its whole integral.

    Integrates piece by piece (trapezoids) and solves the quadratic inside the piece that demand falls in.
    """
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    total, done, answer = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for i, area in enumerate(areas):
        pieces.append((done, area, schedule[i], (schedule[i + 1] - schedule[i]) / step, i * step))
        done += area
    for start, area, w, slope, t0 in reversed(pieces):
        rest = F.greatest(demand * total - start, F.lit(0.0))
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + rest * (2 * slope), F.lit(0.0)))
        inside = F.lit(t0) + F.when(root > 0, rest * 2 / root).otherwise(F.lit(0.0))
        answer = F.when(demand * total <= start + area, inside).otherwise(answer)
    return answer


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, carry: tuple = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, position.

    Sources are walked in a repeatable random order of doc_id. A source's target is so many whole rounds and a
    rest; the rest takes documents while the middle of the document is below it, then adds or removes the one
    document that brings the sum nearest. A hot source is spread over buckets; no window holds a whole source.
    """
    rows = docs.select("doc_id", "source", n_words(text_of()).alias("size"), *carry)
    buckets = buckets_for(docs, BUCKETS)
    rows = keep(rows.withColumn("order", mixed(F.col("doc_id"))).withColumn("bucket", F.pmod(F.col("order") + F.col("size"), F.lit(buckets)).cast("int")))
    sources = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    rows = attach(rows, sources, "source")
    order = [F.col("order"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    rows = running_sum(rows, ["source"], "bucket", order, "size", "before")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    rows = rows.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    rows = keep(rows.withColumn("extra", ((F.col("before") + F.col("size") / 2) < F.col("rest")) & (F.col("rounds") < cap)))
    gaps = rows.groupBy("source").agg(
        F.first("rest").alias("rest"), F.sum(F.when(F.col("extra"), F.col("size")).otherwise(F.lit(0))).alias("got")
    )
    gaps = keep(gaps.select("source", (F.col("rest") - F.col("got")).alias("gap")))
    rows = attach(rows, gaps, "source")
    fits = (F.col("size") > 0) & (F.col("rounds") < cap) & (F.col("extra") == (F.col("gap") < 0)) & (F.abs(F.abs(F.col("gap")) - F.col("size")) < F.abs(F.col("gap")))
    best = F.struct(F.abs(F.abs(F.col("gap")) - F.col("size")), F.col("order"), F.col("doc_id").alias("id"), F.col("size"))
    swaps = keep(rows.where(fits).groupBy("source").agg(F.min(best).alias("best")).select("source", F.col("best.id").alias("swap_id"), F.col("best.size").alias("swap_size"), F.lit(True).alias("swap")))
    # Of equal rows (one doc_id and size, repeated), the first in order alone is swapped.
    rows = attach(rows, swaps, "source")
    chosen = F.col("swap").isNotNull() & F.col("doc_id").eqNullSafe(F.col("swap_id")) & (F.col("size") == F.col("swap_size")) & fits
    one = Window.partitionBy("source", "swap_id", "swap_size").orderBy("before")
    picked = rows.where(chosen).withColumn("_n", F.row_number().over(one)).where("_n = 1").select("source", F.col("before").alias("swap_before"))
    rows = attach(rows, keep(picked), "source")
    swapped = F.coalesce(chosen & (F.col("before") == F.col("swap_before")), F.lit(False))
    copies = F.col("rounds") + (F.col("extra") != swapped).cast("long")
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(copies))
    share = F.when(F.col("target") > 0, F.least((F.col("before") + F.col("size") / 2) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        position(share, F.col("place"), len(weights)).alias("position"), "before", "place", *carry,
    )


def position(share: Column, place: Column, kinds: int = len(WEIGHTS)) -> Column:
    """Training time of a share of a source's demand, under the schedule of the source's place."""
    answer = invert(SCHEDULES[0], share)
    for k in range(1, kinds):
        answer = F.when(place == k, invert(SCHEDULES[k % len(SCHEDULES)], share)).otherwise(answer)
    return answer


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs as the mix takes them: every copy a row, range-sorted by training position.

    Planning sees numbers only; whole rows are joined back by a row number that the kept copy fixes.
    """
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    base = keep(docs.select(whole, F.monotonically_increasing_id().alias("_id")))
    slim = base.select("_id", *[F.col("_row")[c].alias(c) for c in ("doc_id", "source", "text")])
    planned = plan(slim, weights, cap, carry=("_id",)).where("copies > 0")
    copies = planned.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    middle = F.col("_k") * F.col("source_size") + F.col("before") + F.col("size") / 2
    share = F.when(F.col("target") > 0, F.least(middle / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    placed = copies.select("_id", "_k", position(share, F.col("place"), len(weights)).alias("_t"))
    rows = base.join(placed, "_id")
    return rows.orderBy("_t", "_id", "_k").select(*[F.col("_row")[c].alias(c) for c in columns])
