"""Bundles of Markdown files to and from other systems: one tolerant parse into objects and findings, and the writer.

A concept file has a head of few common fields and, where it comes from a system like this one, an extension block that
holds the rest. Nothing is refused: what is missing or broken becomes a finding, and a file without a block gets
conservative defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fields of a concept's head, its states and ours, and files that are no concepts.
FIELDS = ("type", "title", "tags", "status", "generated", "verified", "sources", "stale_after")
STATES = {"stable": "established", "draft": "draft", "deprecated": "deprecated"}
INDEX, LOG = "index.md", "log.md"
BLOCK = """struct<id:string,schema_version:string,domain:string,taxonomy_id:string,taxonomy_path:string,status:string,
    epistemology:struct<evidence:string,verification:string,authority:string,consensus:string>,provenance:struct<confidence:double,source_type:string>,
    relations:array<struct<type:string,target:string>>>"""


@F.pandas_udf(T.StringType())
def yaml_json(texts: pd.Series) -> pd.Series:
    """YAML mappings as JSON, an empty text as an empty mapping; null for what is none."""
    import json

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text):
        if text is None:
            return None
        try:
            told = yaml.load(text, Loader=loader) or {}
        except Exception:  # whatever YAML makes of it, the file is taken without its head
            return None
        return json.dumps({str(k): v for k, v in told.items()}, default=str) if isinstance(told, dict) else None

    return texts.map(one)


def read(files: DataFrame, scope: str = "engineering", extension: str = "loomgraph") -> tuple[DataFrame, DataFrame]:
    """(objects, findings(level, file, code, detail)) of files(path, content) of a bundle.

    Links count as whole if they name a concept by its path, from the root or not. Objects of files without a block are
    named after the file.
    """
    name = F.element_at(F.split("path", "/"), -1)
    concepts = files.where(F.col("path").endswith(".md") & (F.col("path") != INDEX) & (name != LOG))
    rows = concepts.select("path", F.regexp_replace(name, r"\.md$", "").alias("stem"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    parts = F.split("text", "---", 3)
    fenced = F.size(parts) == 3
    rows = rows.withColumns({"fenced": F.coalesce(fenced, F.lit(False)), "raw_body": F.when(fenced, F.regexp_replace(F.get(parts, F.lit(2)), r"^\r?\n", "")).otherwise(F.col("text")), "_head": F.when(fenced, F.get(parts, F.lit(1)))})
    rows = rows.withColumn("_json", yaml_json("_head")).withColumn("head", F.coalesce("_json", F.lit("{}")))
    field = lambda path: F.get_json_object("head", f"$.{path}")
    block = F.get_json_object("head", f"$['{extension}']")
    keys = F.array_except(F.coalesce(F.json_object_keys("head"), F.array().cast("array<string>")), F.array(*map(F.lit, (*FIELDS, extension))))
    sources = F.coalesce(F.from_json(field("sources"), "array<string>"), F.array().cast("array<string>"))
    refs = F.filter(F.transform(sources, lambda s: F.when(s.startswith("{"), F.get_json_object(s, "$.resource")).otherwise(s)), lambda s: s.isNotNull())
    rows = rows.withColumns({"extra_keys": keys, "b": F.when(block.startswith("{") & (block != "{}"), F.from_json(block, BLOCK)), "_refs": refs})
    own = F.col("b").isNotNull()
    given = lambda path, default: F.coalesce(F.col(f"b.{path}"), F.lit(default))
    found = rows.where("text is not null").select(
        "path", F.coalesce("b.id", "stem").alias("id"), F.coalesce(field("title"), F.col("b.id"), F.col("stem")).alias("title"), F.lit(scope).alias("scope"),
        given("taxonomy_path", "01. Domain & Architecture").alias("taxonomy_path"), F.when(own, F.col("b.taxonomy_id")).otherwise("TX-GEN-01").alias("taxonomy_id"),
        F.coalesce(field("type"), F.lit("Article")).alias("object_type"), given("domain", "software_engineering").alias("domain"),
        F.when(own, given("status", "draft")).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STATES.items() for x in p]), field("status")), F.lit("draft"))).alias("status"),
        *[given(f"epistemology.{c}", d).alias(c) for c, d in (("evidence", "derived"), ("verification", "unverified"), ("authority", "informative"), ("consensus", "accepted"))],
        F.when(own, given("provenance.confidence", 0.7)).otherwise(0.5).alias("confidence"), given("provenance.source_type", "external").alias("source_type"), F.when(own, F.array().cast("array<string>")).otherwise(F.col("_refs")).alias("source_refs"),
        F.coalesce("b.relations", F.array()).alias("relations"), F.coalesce(field("generated.by"), F.lit("unknown")).alias("author"), field("generated.at").alias("last_modified"), "raw_body", "extra_keys")

    def finding(level: str, code: str, when: Column, source: DataFrame = rows, detail: Column | None = None) -> DataFrame:
        return source.where(when).select(F.lit(level).alias("level"), F.col("path").alias("file"), F.lit(code).alias("code"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))

    readable = F.col("text").isNotNull()
    known = concepts.where(name != INDEX).select(F.regexp_replace("path", r"\.md$", "").alias("_to")).distinct()
    links = rows.where(readable).select("path", F.explode(F.regexp_extract_all("raw_body", F.lit(r"\[.*?\]\((.*?)\)"), F.lit(1))).alias("link"))
    links = links.where(F.col("link").endswith(".md") & ~F.col("link").startswith("http")).withColumn("_to", F.regexp_replace(F.regexp_replace("link", "^/+", ""), r"\.md$", ""))
    no_index = files.agg(F.count_if(F.col("path") == INDEX).alias("n")).where("n = 0").select(F.lit(INDEX).alias("path"))
    findings = [
        finding("INFO", "no_index", F.lit(True), no_index), finding("ERROR", "unreadable", ~readable), finding("WARNING", "no_head", readable & ~F.col("fenced")), finding("WARNING", "malformed_head", readable & F.col("fenced") & F.col("_json").isNull()),
        finding("INFO", "unknown_fields", readable & (F.size("extra_keys") > 0), detail=F.array_join(F.array_sort("extra_keys"), ",")), finding("INFO", "no_extension", readable & ~own),
        finding("WARNING", "broken_link", F.lit(True), links.join(known, "_to", "left_anti"), F.col("link")),
    ]
    out = findings[0]
    for more in findings[1:]:
        out = out.unionByName(more)
    return found, out


def text(objects: DataFrame, extension: str = "loomgraph") -> DataFrame:
    """id, text: each object as a concept file; a value is written as JSON, which YAML reads. The same bytes every time."""
    alone = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    state = F.when(F.col("status") == "established", "stable").when(F.col("status") == "deprecated", "deprecated").otherwise("draft")
    block = F.to_json(F.struct(
        "id", "domain", "taxonomy_id", "taxonomy_path", "status", F.struct("evidence", "verification", "authority", "consensus").alias("epistemology"), F.struct("confidence", "source_type").alias("provenance"),
        F.transform("relations", lambda r: F.struct(r["type"].alias("type"), r["target"].alias("target"))).alias("relations")))
    lines = [F.concat(F.lit("type: "), alone("object_type")), F.concat(F.lit("title: "), alone("title")), F.concat(F.lit("status: "), state), F.concat(F.lit(f"{extension}: "), block)]
    return objects.select("id", F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---\n"), F.coalesce("raw_body", F.lit(""))).alias("text"))


def write(rows: DataFrame, path: str) -> None:
    """`<path>/<id>.md` for each of rows(id, text). Files are put in place whole; a task that runs again writes the same."""

    def put(part: Iterator) -> None:
        import uuid

        from ..sources.connectors import place

        system, base = place(path)
        system.create_dir(base)
        for row in part:
            own = f"{base}/.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as stream:
                stream.write(row["text"].encode())
            system.move(own, f"{base}/{row['id']}.md")

    rows.select("id", "text").foreachPartition(put)
