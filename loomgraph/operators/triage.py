"""Triage of staged evidence units: what they mention, what looks like an injection, which relations may be drafted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules, text as X
from .exchange import yaml_json

UNIT = "evidence_unit_ref string, source_refs array<string>, representation_refs array<string>, fenced_content string, injections_detected array<string>"


def units(files: DataFrame) -> DataFrame:
    """Units of files(path, content) of YAML; fault says why a file is none. Hidden files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(F.col("path").rlike(r"\.ya?ml$") & ~name.startswith("."))
    rows = rows.select(F.regexp_replace(name, r"\.ya?ml$", "").alias("stem"), yaml_json(F.col("content").cast("string")).alias("j")).withColumn("u", F.from_json("j", UNIT))
    missing = F.col("u.evidence_unit_ref").isNull()
    fault = F.when(F.col("j").isNull(), "invalid YAML structure").when(missing, "missing evidence_unit_ref")
    own = [f"u.{c.strip().split(' ')[0]}" for c in UNIT.split(",")[1:]]
    return rows.select(F.coalesce("u.evidence_unit_ref", "stem").alias("evidence_unit_ref"), *own, fault.alias("fault"))


def report(rows: DataFrame) -> DataFrame:
    """A row per unit of units(): its references, mentions in order, signs of injection and status.

    Signs that came with the unit stand; where none did, its content is looked through. A faulty unit has neither.
    """
    none = F.array().cast("array<string>")
    content = F.coalesce("fenced_content", F.lit(""))
    fine = F.col("fault").isNull()
    given = F.coalesce(F.size("injections_detected") > 0, F.lit(False))
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(rules.INTAKE_LINK), F.lit(1))))
    return rows.select(
        "evidence_unit_ref", F.coalesce("source_refs", none).alias("source_refs"), F.coalesce("representation_refs", none).alias("representation_refs"), F.when(fine, "concept").otherwise("error").alias("suggested_object_type"),
        F.when(fine, links).otherwise(none).alias("candidate_relations"), F.when(fine, F.when(given, F.col("injections_detected")).otherwise(X.injection_indicators(content))).otherwise(none).alias("injections_detected"),
        F.when(fine, "staged").otherwise(F.concat(F.lit("error: "), "fault")).alias("status"))


def drafts(found: DataFrame, objects: DataFrame) -> DataFrame:
    """evidence_unit_ref, mention, target: each mention of a report with the object of objects(id, aliases) that it names
    by id or alias, if one does; of several the least id."""
    named = objects.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("_k"))
    named = named.groupBy("_k").agg(F.min("id").alias("target"))
    mentions = found.select("evidence_unit_ref", F.explode("candidate_relations").alias("mention")).withColumn("_k", F.lower("mention"))
    return mentions.join(named, "_k", "left").select("evidence_unit_ref", "mention", "target")


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total_count"), F.coalesce(F.sum(F.size("injections_detected")), F.lit(0)).cast("long").alias("injections_count"))
