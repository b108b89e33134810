"""The stream of lifetimes against the batch reaper over the same events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import lifecycle
from loomgraph.streaming import lifetimes

START = datetime(2024, 1, 1)
SCHEMA = "proposal_id string, state string, created_at timestamp, at timestamp"
TTL, GRACE, LATE = 10, 5, 2


def events():
    out = []
    for i in range(24):
        made = START + timedelta(days=i)
        out.append((f"p{i}", "pending", made, made))
        if i % 4 == 1:
            out.append((f"p{i}", "approved", made, made + timedelta(days=i % 9)))
        if i % 6 == 2:
            out.append((f"p{i}", "expired", made, made + timedelta(days=4)))
        if i % 8 == 5:
            out.append((f"p{i}", "pending", made, made))  # comes again
    out += [("q", "pending", None, START + timedelta(days=3)), ("q", "pending", None, START + timedelta(days=9))]
    return sorted(out, key=lambda e: e[3])


def batch(spark, now):
    """Expiries of one pass, purges of a second pass over what the first one expired."""
    rows = spark.createDataFrame([e for e in events() if e[3] <= now], SCHEMA)
    latest = rows.groupBy("proposal_id").agg(F.max_by("state", F.struct("at", F.col("state") != "pending")).alias("state"), F.max("created_at").alias("created_at"))
    history = rows.where("state = 'expired'").select("proposal_id", F.col("state").alias("new_state"), "at")
    first = lifecycle.reap(latest, history, str(now), TTL, GRACE)
    out = {(r.proposal_id, r.outcome) for r in first.where("outcome in ('expire', 'quarantine')").collect()}
    due = F.col("created_at") + F.make_interval(days=F.lit(TTL))
    after = first.withColumn("state", F.when(F.col("outcome") == "expire", "expired").otherwise(F.col("state"))).drop("outcome")
    history = history.union(first.where("outcome = 'expire'").select("proposal_id", F.lit("expired"), due))
    return out | {(r.proposal_id, r.outcome) for r in lifecycle.reap(after, history, str(now), TTL, GRACE).where("outcome = 'purge'").collect()}


@pytest.mark.parametrize("cuts", [(), (4, 20, 31)])
def test_stream_equals_batch(spark, tmp_path, cuts):
    lifetimes.stateful(spark)
    now = START + timedelta(days=27)
    told = [e for e in events() if e[3] <= now]
    parts = [told[a:b] for a, b in zip([0, *cuts], [*cuts, len(told)])]
    parts.append([("tick", "rejected", START, now + timedelta(days=LATE, seconds=1))])
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        out = lifetimes.lifetimes(source, TTL, GRACE, f"{LATE} days")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == len({(r.proposal_id, r.outcome) for r in rows})
    assert {(r.proposal_id, r.outcome) for r in rows} == batch(spark, now)
    made = {e[0]: e[2] for e in events()}
    assert all(r.at == made[r.proposal_id] + timedelta(days=TTL) for r in rows if r.outcome == "expire")
