"""Staged tables: idempotent upserts, schema evolution, lifecycles, equivalence and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Transitions that a proposal may make.
TRANSITIONS = (
    ("pending", "in_review"), ("pending", "approved"), ("pending", "rejected"), ("pending", "expired"),
    ("in_review", "approved"), ("in_review", "rejected"), ("in_review", "expired"), ("approved", "promoted"),
)


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """incoming with outcome: insert (new key), noop (same hash) or conflict (another hash)."""
    known = stored.select(F.col(key), F.col(digest).alias("_stored"))
    outcome = F.when(F.col("_stored").isNull(), "insert").when(F.col("_stored") == F.col(digest), "noop").otherwise("conflict")
    return incoming.join(known, key, "left").withColumn("outcome", outcome).drop("_stored")


def apply_upsert(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """stored and the new keys; a conflict fails the job when it is read."""
    marked = upsert(stored, incoming, key, digest)
    checked = marked.where(F.when(F.col("outcome") == "conflict", F.raise_error(F.concat(F.lit("conflict at "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col("outcome") == "insert"))
    return stored.unionByName(checked.drop("outcome"), allowMissingColumns=True)


def evolve(rows: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """rows in schema {column: (type, default)}: missing columns get the default, others a tolerant cast, the rest go."""
    out = []
    for name, (kind, default) in schema.items():
        value = F.col(name).try_cast(kind) if name in rows.columns else F.lit(default).cast(kind)
        out.append(value.alias(name))
    return rows.select(*out)


def equivalence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, status (same, differs, left_only, right_only) and the columns that differ."""
    columns = [c for c in left.columns if c != key and c in right.columns]
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    joined = a.join(b, key, "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.size(differing) > 0, "differs").otherwise("same")
    return joined.select(key, status.alias("status"), F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.array().cast("array<string>")).otherwise(differing).alias("fields"))


def ttl(rows: DataFrame, now: str, days: int, grace: int, created: str = "created_at", status: str = "status") -> DataFrame:
    """rows with outcome: quarantine (no time), expire (pending too long), purge (expired beyond grace) or keep."""
    age = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    purge = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days + grace))
    at = F.col(created)
    outcome = F.when(at.isNull(), "quarantine").when((F.col(status) == "expired") & (at <= purge), "purge").when((F.col(status) == "pending") & (at <= age), "expire").otherwise("keep")
    return rows.withColumn("outcome", outcome)


def illegal_transitions(history: DataFrame) -> DataFrame:
    """history(old_state, new_state) rows that the lifecycle doesn't allow."""
    allowed = history.sparkSession.createDataFrame(list(TRANSITIONS), "old_state string, new_state string")
    return history.join(allowed, ["old_state", "new_state"], "left_anti")


def duplicates(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows that repeat an earlier row's key, with their place."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth > 1")


def ring_guard(events: DataFrame, group: str, order: list, signature: str, mutated: Column, size: int = 20, least: int = 5) -> DataFrame:
    """Events whose signature fills at least `least` of the last `size` places since the last mutation."""
    ordered = Window.partitionBy(group).orderBy(*order)
    rows = events.withColumn("_m", mutated).withColumn("_segment", F.sum(F.col("_m").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_m"))
    recent = F.collect_list(signature).over(Window.partitionBy(group, "_segment").orderBy(*order).rowsBetween(-(size - 1), 0))
    rows = rows.withColumn("_recent", recent)
    return rows.withColumn("repeats", F.size(F.filter("_recent", lambda x: x == F.col(signature)))).where(F.col("repeats") >= least).drop("_m", "_segment", "_recent")


def manifest(rows: DataFrame, path: str, digest: str) -> DataFrame:
    """One hash over all (path, hash) lines in order of path. It is sequential by definition, so all lines meet in one
    task: for lists of files. Tables of any size take manifest_tree."""
    line = F.concat(F.col(path).cast("string"), F.lit("\x00"), F.col(digest), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))), lambda x: x["l"])
    return rows.agg(F.sha2(F.array_join(lines, ""), 256).alias("corpus_hash"), F.count(F.lit(1)).alias("files"))


def manifest_tree(rows: DataFrame, path: str, digest: str, bucket: Column) -> DataFrame:
    """As manifest, by bucket, and one hash over the buckets' hashes in order; no task holds more than a bucket."""
    line = F.concat(F.col(path).cast("string"), F.lit("\x00"), F.col(digest), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l")))), lambda x: x["l"])
    parts = rows.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(lines, ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("corpus_hash"), F.sum("n").alias("files"))


def debt(rows: DataFrame, pending: Column, canonical: Column) -> DataFrame:
    """Share of pending work, three decimals, with its label."""
    totals = rows.agg(F.sum(pending.cast("int")).alias("pending"), F.sum(canonical.cast("int")).alias("canonical"))
    index = F.round(F.col("pending") / F.greatest(F.lit(1), F.col("canonical") + F.col("pending")), 3)
    label = F.when(F.col("debt_index") == 0, "none").when(F.col("debt_index") < 0.1, "low").when(F.col("debt_index") < 0.3, "moderate").otherwise("high")
    return totals.withColumn("debt_index", index).withColumn("label", label)
