"""Selections of objects to hand on: selector and firewall, fingerprints, manifests, conformance and budgets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from . import exchange, fusion

#: Milliseconds a query, and parsing or checking a document, may take.
QUERY_MS, DOCUMENT_MS = 100.0, 50.0


class CrossScope(ValueError):
    """Personal objects were asked for without leave."""


def select(objects: DataFrame, scopes: tuple = (), taxonomy: tuple = (), descendants: bool = True, object_types: tuple = (), domains: tuple = (), statuses: tuple = (),
           min_confidence: float = 0.0, valid_at: str | None = None, facets: dict | None = None, allow_personal: bool = False) -> DataFrame:
    """Objects that a selector takes; asking for personal ones without leave raises if there are any."""
    rows = objects
    if not allow_personal:
        if "personal" in scopes and rows.where("scope = 'personal'").limit(1).count():
            raise CrossScope("personal objects need leave or redaction")
        rows = rows.where("coalesce(scope, '') <> 'personal'")
    for column, wanted in (("scope", scopes), ("object_type", object_types), ("domain", domains), ("status", statuses)):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    if taxonomy:
        fits = F.lit(False)
        for name in taxonomy:
            fits = fits | (F.col("taxonomy_id").startswith(name) if descendants else F.col("taxonomy_id") == name)
        rows = rows.where(fits)
    rows = rows.where(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= min_confidence)
    if valid_at:
        rows = rows.where(fusion.valid_at(F.col("valid_from"), F.col("valid_until"), F.lit(valid_at)))
    for name, wanted in (facets or {}).items():
        if dict(rows.dtypes)[name].startswith("array"):
            rows = rows.where(F.arrays_overlap(name, F.array(*map(F.lit, wanted))))
        else:
            rows = rows.where(F.col(name).isin(*wanted))
    return rows


def fingerprint(selector: dict) -> str:
    """sha256 of a selector, the same whatever the order of its keys and lists."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items())}
        return sorted(x) if isinstance(x, list | tuple | set) else x

    return hashlib.sha256(json.dumps(plain(selector), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def generated_at(objects: DataFrame, column: str = "last_modified") -> DataFrame:
    """The latest change as a date, 1970-01-01 where there is none."""
    return objects.agg(F.coalesce(F.max(F.substring(F.col(column).cast("string"), 1, 10)), F.lit("1970-01-01")).alias("generated_at"))


def bundle_manifest(objects: DataFrame, kind: str = "object_type") -> DataFrame:
    """Members and kinds of a bundle with the hash of each kind's ids and digests in order."""
    line = F.struct("id", "digest")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat_ws(":", x["id"], x["digest"])), "\n")
    return objects.groupBy(kind).agg(F.count(F.lit(1)).alias("members"), F.sha2(joined.cast("binary"), 256).alias("digest"))


def markdown(objects: DataFrame) -> DataFrame:
    """id, text: each object as a Markdown file with its frontmatter, the same bytes every time."""
    front = [F.concat(F.lit(f"{c}: "), F.to_json(F.array(F.col(c).cast("string")))) for c in ("id", "title", "object_type", "scope", "status") if c in objects.columns]
    return objects.select("id", F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def write_markdown(objects: DataFrame, path: str) -> None:
    """`<path>/<id>.md` for each object."""
    exchange.write(markdown(objects), path)


def write_json(rows: DataFrame, path: str, key: str) -> None:
    """A cache as JSON lines in order of key, columns in order of name."""
    rows.select(*sorted(rows.columns)).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def conformance(families: DataFrame, files: DataFrame) -> DataFrame:
    """family, status of families(family, implementation, test: paths or null) against files(path, asserts)."""
    own = files.select(F.col("path").alias("implementation"), F.lit(True).alias("built"))
    tests = files.select(F.col("path").alias("test"), "asserts")
    rows = families.join(own, "implementation", "left").join(tests, "test", "left")
    status = F.when(F.col("built") & (F.coalesce("asserts", F.lit(0)) > 0), "CONFORMANCE_TESTED").when(F.col("built"), "IMPLEMENTED").otherwise("UNIMPLEMENTED")
    return rows.select("family", status.alias("status"))


def drift(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Families whose declared(family, declared) status isn't the one found."""
    return declared.join(found, "family").where("declared <> status")


def assessment(timings: DataFrame, parse_ms: float, check_ms: float) -> DataFrame:
    """mean_ms, p95_ms, status of timings(ms) of queries and the time of a document."""
    row = timings.agg(F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.percentile("ms", 0.95), 3).alias("p95_ms"))
    over = (F.col("mean_ms") > QUERY_MS) | (F.col("p95_ms") > QUERY_MS) | F.lit(parse_ms > DOCUMENT_MS or check_ms > DOCUMENT_MS)
    return row.withColumn("status", F.when(over, "exceeds_budget").otherwise("within_baseline_limits"))


def by_length(rows: DataFrame, length: str, key: str) -> DataFrame:
    """rows from short to long, so that batches hold alike lengths; key restores the order."""
    return rows.repartitionByRange(length, key).sortWithinPartitions(length, key)
