"""Posteriors, class offsets and abstention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import keep

ABSTAIN = 0.65


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """map token -> probability of map token -> logit."""
    warm = max(temperature, 1e-5)
    top = F.array_max(F.map_values(logits))
    powers = F.transform_values(logits, lambda _, v: F.exp((v - top) / warm))
    total = F.aggregate(F.map_values(powers), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(powers, lambda _, v: v / total)


def entropy(posterior: Column) -> Column:
    return F.aggregate(F.map_values(posterior), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def top(posterior: Column) -> Column:
    """struct(token, p) of the most probable token, the first by name of equals."""
    entries = F.transform(F.map_entries(posterior), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("token")))
    best = F.array_min(entries)
    return F.struct(best["token"].alias("token"), (-best["minus"]).alias("p"))


def decide(posterior: Column, offsets: dict[str, float] | None = None, threshold: float = ABSTAIN) -> Column:
    """The answer, or ABSTAIN: offsets move the choice, but its own probability must reach the threshold."""
    table = F.create_map(*[F.lit(x) for pair in (offsets or {"": 0.0}).items() for x in pair])
    moved = F.transform_values(posterior, lambda k, v: v + F.coalesce(F.element_at(table, k), F.lit(0.0)))
    chosen = top(moved)["token"]
    return F.when(F.element_at(posterior, chosen) >= threshold, chosen).otherwise("ABSTAIN")


def fit_offsets(dev: DataFrame, classes: list[str], steps: int = 21, bound: float = 0.5) -> dict[str, float]:
    """Class offsets that raise accuracy on dev(posterior, gold), one class after another.

    Each class is one aggregation over all its grid values; only the accuracies come to the driver.
    """
    offsets = {c: 0.0 for c in classes}
    grid = [-bound + 2 * bound * i / (steps - 1) for i in range(steps)]

    def accuracy(tries: list[dict[str, float]]) -> list[float]:
        hits = []
        for i, t in enumerate(tries):
            table = F.create_map(*[F.lit(x) for pair in t.items() for x in pair])
            moved = F.transform_values("posterior", lambda k, v: v + F.coalesce(F.element_at(table, k), F.lit(0.0)))  # noqa: B023
            hits.append(F.avg((top(moved)["token"] == F.col("gold")).cast("double")).alias(f"a{i}"))
        row = dev.agg(*hits).first()
        return [x or 0.0 for x in row]

    best = accuracy([offsets])[0]
    for c in classes:
        tries = [offsets | {c: g} for g in grid]
        for g, found in zip(grid, accuracy(tries)):
            if found > best + 1e-12:
                best, offsets = found, offsets | {c: g}
    return offsets


def percentile(rows: DataFrame, column: str, share: float) -> DataFrame:
    """One row with the exact, interpolated percentile, as F.percentile defines it; null where no value is known.

    Values are counted, dealt into ranges, and the ranges' totals (a row each) say which of them hold the two places
    that matter; only these are put in order. No task holds all values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts.repartitionByRange("v").withColumn("_range", F.spark_partition_id()))
    totals = sorted((r["_range"], r["n"]) for r in counts.groupBy("_range").agg(F.sum("n").alias("n")).collect())
    place = share * (sum(n for _, n in totals) - 1)
    low, high, before, wanted = math.floor(place), math.ceil(place), 0, []
    for at, n in totals:
        wanted += [(at, before, k) for k in sorted({low, high}) if before <= k < before + n]
        before += n
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy("v"))
    near = counts.where(F.col("_range").isin([at for at, _, _ in wanted])).withColumn("_upto", upto)
    value = {k: F.min(F.when((F.col("_range") == at) & (F.col("_upto") > k - first), F.col("v"))) for at, first, k in wanted}
    a, b = (value.get(k, F.lit(None).cast("double")) for k in (low, high))
    return near.agg(a.alias("a"), b.alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - place) * F.col("a") + (place - low) * F.col("b")).alias("percentile"))
