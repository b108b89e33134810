"""Proposals from creation to decision and expiry, operation journals, routing and the budget guard.

States are tables. A decision, an expiry or a recovery is a join that gives the new state rows and the audit rows;
nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import content_hash
from .validate import ACTOR_PATTERN

#: What a decision may follow, states that end a proposal and those that end an operation.
OPEN_STATES = ("pending", "in_review")
CLOSED_STATES = ("promoted", "rejected", "expired", "superseded")
DONE_STATES = ("COMPLETED", "FAILED")
BEFORE_COMMIT = ("PREPARED", "TEMPORARY_OUTPUT_WRITTEN", "VALIDATED")


def propose(rows: DataFrame, key: str, now: str, *content: str) -> DataFrame:
    """Proposals of rows: proposal_id, state, revision, hash of the content columns and the time of creation."""
    return rows.withColumns({
        "proposal_id": F.concat(F.lit("CAND-"), F.col(key).cast("string")), "state": F.lit("pending"), "revision": F.lit(1),
        "proposal_hash": content_hash(*content), "created_at": F.lit(now).cast("timestamp")})


def listed(proposals: DataFrame, state: str | None = None) -> DataFrame:
    """Proposals of a state by time and id."""
    rows = proposals.where(F.col("state") == state) if state else proposals
    return rows.orderBy("created_at", "proposal_id")


def decide(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals after, audit rows, refused decisions with a reason) for decisions(proposal_id, decision, reviewer,
    revision, proposal_hash, decided_at), one for a proposal.

    A decision holds for the very revision and hash it names. Approval needs an open proposal, rejection one that
    isn't closed.
    """
    mine = proposals.select("proposal_id", "state", F.col("revision").alias("_r"), F.col("proposal_hash").alias("_h"))
    joined = decisions.join(mine, "proposal_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("reviewer"), F.lit("")).rlike(ACTOR_PATTERN), "invalid actor")
        .when(F.col("state").isNull(), "unknown proposal")
        .when(~F.col("revision").eqNullSafe(F.col("_r")) | ~F.col("proposal_hash").eqNullSafe(F.col("_h")), "another revision")
        .when((F.col("decision") == "approve") & ~F.col("state").isin(*OPEN_STATES), "illegal state")
        .when((F.col("decision") == "reject") & F.col("state").isin(*CLOSED_STATES), "illegal state")
        .when(~F.col("decision").isin("approve", "reject"), "unknown decision"))
    judged = joined.withColumn("reason", reason)
    fine = judged.where("reason is null").withColumn("new_state", F.when(F.col("decision") == "approve", "approved").otherwise("rejected"))
    audit = fine.select("proposal_id", "revision", F.col("state").alias("previous_state"), "new_state", F.col("reviewer").alias("actor"), F.col("decided_at").alias("at"))
    after = proposals.join(fine.select("proposal_id", "new_state"), "proposal_id", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    return after, audit, judged.where("reason is not null").select("proposal_id", "decision", "reviewer", "reason")


def reap(proposals: DataFrame, history: DataFrame, now: str, ttl_days: int, grace_days: int) -> DataFrame:
    """proposals with outcome: quarantine (no time of creation), expire, purge or keep.

    history(proposal_id, new_state, at): grace runs from the last transition to expired, or from creation and ttl.
    """
    last = history.where("new_state = 'expired' and at is not null").groupBy("proposal_id").agg(F.max("at").alias("_at"))
    at = F.lit(now).cast("timestamp")
    created = F.col("created_at")
    anchor = F.coalesce("_at", created + F.make_interval(days=F.lit(ttl_days)))
    outcome = (
        F.when(created.isNull(), "quarantine")
        .when((F.col("state") == "pending") & (created + F.make_interval(days=F.lit(ttl_days)) <= at), "expire")
        .when((F.col("state") == "expired") & (anchor + F.make_interval(days=F.lit(grace_days)) <= at), "purge")
        .otherwise("keep"))
    return proposals.join(last, "proposal_id", "left").withColumn("outcome", outcome).drop("_at")


def reap_summary(outcomes: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.agg(count("expire").alias("expired"), count("purge").alias("purged"), count("quarantine").alias("quarantined"))


def journal_state(entries: DataFrame) -> DataFrame:
    """The last state of each operation of entries(operation_id, seq, state, ...)."""
    rest = F.struct(*[c for c in entries.columns if c != "operation_id"])
    return entries.groupBy("operation_id").agg(F.max_by(rest, "seq").alias("_last")).select("operation_id", "_last.*")


def uncompleted(entries: DataFrame) -> DataFrame:
    return journal_state(entries).where(~F.col("state").isin(*DONE_STATES))


def recover(entries: DataFrame, expected: DataFrame, present: DataFrame) -> DataFrame:
    """operation_id, action, reason for operations that a crash left open.

    expected(operation_id, path, digest) are the files of an operation, present(path, digest) those that are there.
    Before the commit an operation is rolled back; after it, it is complete only if all its files are as expected.
    """
    there = present.select("path", F.col("digest").alias("_d"))
    off = expected.join(there, "path", "left").where(~F.col("digest").eqNullSafe(F.col("_d"))).select("operation_id").distinct().withColumn("_off", F.lit(True))
    rows = uncompleted(entries).join(off, "operation_id", "left")
    action = F.when(F.col("state").isin(*BEFORE_COMMIT), "rolled_back").when(F.col("state") == "CANONICAL_COMMITTED", F.when(F.col("_off"), "failed").otherwise("completed"))
    reason = F.when(action == "rolled_back", "crash_pre_commit").when(action == "completed", "crash_post_commit").otherwise("canonical_file_missing_or_mismatch")
    return rows.select("operation_id", action.alias("action"), reason.alias("reason")).where("action is not null")


def cursors(stored: DataFrame, moved: DataFrame) -> DataFrame:
    """The furthest position of each source of (source, position)."""
    return stored.unionByName(moved).groupBy("source").agg(F.max("position").alias("position"))


def route(proposals: DataFrame) -> DataFrame:
    """proposals(state, scope, confidence, body) with target table, scope-bound root objects and rejection reason."""
    target = F.when(F.col("state") == "rejected", "rejected_low_quality").when(F.coalesce("scope", F.lit("ambiguous")) == "ambiguous", "ambiguous_scope").otherwise("concept_proposals")
    root = F.to_json(F.struct(F.col("body").alias("body")))
    return proposals.withColumns({
        "target": target, "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.9)),
        "incident": F.when(F.col("scope") == "engineering", root), "observation": F.when(F.coalesce(F.col("scope") != "engineering", F.lit(True)), root),
        "promotion_status": F.when(F.col("state") == "promoted", "promoted").otherwise("staged"), "rejection_reason": F.when(F.col("state") == "rejected", "LOW_QUALITY")})


def source_findings(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """source_id, code for sources(source_id, source_type, semantic_kind, identity, provenance: maps) that break a profile.

    profiles(source_type, executable, kinds, identity_any_of: lists of lists, provenance_all_of), one row a type.
    """
    rows = sources.join(profiles, "source_type", "left")

    def given(fields: Column, where: str) -> Column:
        return F.forall(fields, lambda f: F.coalesce(F.element_at(F.col(where), f), F.lit("")) != "")

    identified = (F.size("identity_any_of") == 0) | F.exists("identity_any_of", lambda fields: given(fields, "identity"))
    code = (
        F.when(F.col("executable").isNull(), "E130").when(~F.col("executable"), "E131")
        .when(F.col("semantic_kind").isNotNull() & ~F.array_contains("kinds", F.col("semantic_kind")), "E134")
        .when(~identified, "E132").when(~given(F.col("provenance_all_of"), "provenance"), "E133"))
    return rows.withColumn("code", code).where("code is not null").select("source_id", "code")


def budget_guard(events: DataFrame, group: str, order: list, signature: str, failed: Column, mutated: Column, tokens: str, budget: str, share: float = 0.4) -> DataFrame:
    """Failing events at which a run of failures with one signature has spent `share` of the last known budget.

    A mutation ends a run, as does a failure with another signature; other successes don't.
    """
    ordered = Window.partitionBy(group).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"_m": mutated, "_f": failed}).withColumn("_segment", F.sum(F.col("_m").cast("int")).over(upto)).where(~F.col("_m"))
    rows = rows.withColumn("_budget", F.last(budget, ignorenulls=True).over(upto)).where("_f")
    inside = Window.partitionBy(group, "_segment").orderBy(*order)
    changed = (~F.col(signature).eqNullSafe(F.lag(signature).over(inside))).cast("int")
    rows = rows.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(group, "_segment", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("spent", F.sum(tokens).over(run))
    return rows.where((F.col("_budget") > 0) & (F.col("spent") >= share * F.col("_budget"))).drop("_m", "_f", "_segment", "_budget", "_c", "_run")
