"""Streams: incremental files, time to live and the repetition guard, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import staging


def tail(spark: SparkSession, path: str, schema: str, format: str = "json", files_a_batch: int = 100) -> DataFrame:
    """New files of a folder; the query's checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(format).load(path)


def ttl_stream(rows: DataFrame, now: str, days: int, grace: int, created: str = "created_at", status: str = "status") -> DataFrame:
    return staging.ttl(rows, now, days, grace, created, status)


def upsert_stream(rows: DataFrame, key: str, time: str, watermark: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def ring_stream(events: DataFrame, group: str, signature: str, mutated: str, size: int = 20, least: int = 5) -> DataFrame:
    """group, signature, repeats of each event that fills the ring of the last `size` signatures too often.

    Events of a batch are taken in order of seq; a mutating event empties the ring.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for sign, change in zip(rows[signature], rows[mutated]):
            ring = [] if change else [*ring, sign][-size:]
            if not change and ring.count(sign) >= least:
                out.append((key[0], sign, ring.count(sign)))
        state.update((ring,))
        yield pd.DataFrame(out, columns=[group, signature, "repeats"]).astype({"repeats": "int32"})

    kind = dict(events.dtypes)[group]
    return events.groupBy(group).applyInPandasWithState(step, f"{group} {kind}, {signature} string, repeats int", "ring array<string>", "append", "NoTimeout")


def count_by_window(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
