"""Lifetimes of proposals as a stream: expiry, purge and quarantine fall due by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import CLOSED_STATES

DAY = 86_400_000
OUT = "proposal_id string, outcome string, at timestamp"
STATE = "state string, created long, at long, until long"
#: States in which nothing falls due any more.
SETTLED = ("approved", *(s for s in CLOSED_STATES if s != "expired"))


class Lifetimes(StatefulProcessor):
    """A proposal's state, and one timer for what falls due next.

    A pending proposal expires at created + ttl; an expired one is purged grace after it expired; settled ones are
    remembered as long as a pending one could have lived, so that a repeated event doesn't bring them back, and then
    forgotten. A proposal without time of creation is quarantined, once, and has no timer. Events of a proposal count
    by their time, not by the order they come in.
    """

    def __init__(self, ttl_days: int, grace_days: int):
        self.ttl, self.grace = ttl_days * DAY, grace_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("proposal", STATE)

    def _rows(self, key, outcome: str, at: int | None) -> pd.DataFrame:
        at = pd.NaT if at is None else pd.Timestamp(at, unit="ms")
        return pd.DataFrame({"proposal_id": [key[0]], "outcome": [outcome], "at": [at]})

    def _wait(self, until: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.get() if self.held.exists() else None
        state, created, last, until = known if known else ("", None, None, None)
        told = state == "quarantined"
        fresh = pd.concat(list(rows)).sort_values("at_ms", kind="stable")
        for name, made, at in zip(fresh["state"], fresh["created_ms"], fresh["at_ms"]):
            created = created if created is not None else None if pd.isna(made) else int(made)
            if last is None or at >= last:
                # What has ended stays so.
                state, last = (state if state in CLOSED_STATES and name not in CLOSED_STATES else name), int(at)
        if created is None:
            if not told:
                yield self._rows(key, "quarantine", None)
            self.held.update(("quarantined", None, last, None))
            return
        if state == "pending" or state == "in_review":
            until = created + self.ttl if state == "pending" else None
        elif state == "expired":
            until = last + self.grace
        else:
            until = max(created, last) + self.ttl + self.grace
        self.held.update((state, created, last, until))
        self._wait(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        state, created, last, until = self.held.get()
        if state == "pending":
            yield self._rows(key, "expire", until)
            if until + self.grace <= timerValues.getCurrentWatermarkInMs():
                yield self._rows(key, "purge", until + self.grace)
                self.held.clear()
            else:
                self.held.update(("expired", created, until, until + self.grace))
                self._wait(until + self.grace)
            return
        if state == "expired":
            yield self._rows(key, "purge", until)
        self.held.clear()

    def close(self) -> None:
        pass


def lifetimes(events: DataFrame, ttl_days: int, grace_days: int, late: str) -> DataFrame:
    """proposal_id, outcome (expire, purge, quarantine), at: what falls due for a stream of
    events(proposal_id, state, created_at, at), each a state that a proposal took at a time.

    State needs the RocksDB store (`stateful`). Events later than `late` behind the newest are dropped by the watermark.
    """
    rows = events.select("proposal_id", "state", F.unix_millis("created_at").alias("created_ms"), F.unix_millis("at").alias("at_ms"), "at")
    return rows.withWatermark("at", late).groupBy("proposal_id").transformWithStateInPandas(
        statefulProcessor=Lifetimes(ttl_days, grace_days), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def stateful(spark: SparkSession) -> None:
    """Let this session keep state with timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
