"""Legacy notes to objects: one parse with two outcomes, a plan against what was written, and an execution that may be
repeated.

Every file gives one row: an object, or a reason why it is set aside, or the mark that it holds no note. Only the YAML of
a file's head is read by Python, a row at a time; all rules after it are columns and joins with the small registries.
What is written goes to a staged table by target path and content, so a second run over the same files writes nothing
and a changed file is refused unless it is forced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import rules, text as X
from .store import Committed, StagedTable
from .validate import ACTOR_PATTERN, ID_PATTERN

#: Files that only lead to others, macros that name people, what a scope falls back to.
NAVIGATION = ("index.md", "README.md", "SUMMARY.md")
PRIVATE_MACROS = ("%docResp", "%docOwnerLineMgr", "%docApprover")
DEFAULT_TAXONOMY = {"engineering": "TX-ENG-01", "personal": "TX-PERS-01"}
PREFIX = {"engineering": "ENG", "personal": "PERS"}
DEFAULT_FACETS = {"language": ["en"], "toolchain": ["none"], "lifecycle": ["ongoing"], "architecture": ["none"], "prog_language": ["none"]}
HEAD = T.StructType([
    T.StructField("ok", T.BooleanType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("refs", T.ArrayType(T.StringType()))])
WRITTEN = "target string, source string, content string, digest string"


@dataclass(frozen=True)
class Mapping:
    """What legacy words mean, and what holds where a file says nothing."""

    derived: bool = False
    scope: str | None = None
    taxonomy: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    macros: tuple = PRIVATE_MACROS
    domain: str = "software_engineering"


@F.pandas_udf(HEAD)
def head(texts: pd.Series) -> pd.DataFrame:
    """The head's values as texts, its tags and references as lists; not ok if it isn't a mapping."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text):
        if text is None:
            return False, None, None, None
        try:
            told = yaml.load(text, Loader=loader)
        except Exception:  # whatever YAML makes of it, the file is set aside
            return False, None, None, None
        if not isinstance(told, dict):
            return False, None, None, None
        tags = told.get("tags") or told.get("keywords") or []
        tags = tags.split(",") if isinstance(tags, str) else tags if isinstance(tags, list) else []
        refs = [told.get("source_ref")] + (told["source_refs"] if isinstance(told.get("source_refs"), list) else [])
        fields = {str(k): str(v) for k, v in told.items() if v is not None and not isinstance(v, list | dict)}
        return True, fields, [str(t).strip() for t in tags if str(t).strip()], list(dict.fromkeys(str(r) for r in refs if r))

    return pd.DataFrame([one(t) for t in texts], columns=["ok", "fields", "tags", "refs"])


def _look(mapping: dict, key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parsed(files: DataFrame, mapping: Mapping, types: DataFrame, taxonomy: DataFrame, domains: tuple, now: str) -> DataFrame:
    """A row per file of files(path, content): reason (null for objects, excluded, or why it is set aside) and the
    object's columns.

    types(name, code, tag_strategy) and taxonomy(taxonomy_id, name, scope) are the registries.
    """
    name = F.element_at(F.split("path", "/"), -1)
    note = F.col("path").endswith(".md") & ~name.isin(*NAVIGATION)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = files.select("path", text.alias("text"), note.alias("note"), stem.alias("stem"))
    if mapping.derived:
        body = F.col("text")
        for macro in mapping.macros:
            body = F.regexp_replace(body, rf"%\Q{macro.lstrip('%')}\E[:\s]+[^\r\n]*", "")
        title = F.coalesce(*[F.when(F.col("text").rlike(p), _strip(F.regexp_extract(F.col("text") if i == 0 else body, p, 1))) for i, p in enumerate((r"%docTitle[:\s]+([^\r\n]+)", r"(?m)^#\s+([^\r\n]+)"))], F.initcap(F.translate("stem", "_-", "  ")))
        rows = rows.withColumns({"body": body, "h": F.struct(F.lit(True).alias("ok"), F.create_map(F.lit("title"), title).alias("fields"), F.array().cast("array<string>").alias("tags"), F.array("path").alias("refs"))})
        rows = rows.withColumn("early", F.when(F.col("text").isNull(), "unicode_decode_error"))
    else:
        parts = F.split("text", "---", 3)
        rows = rows.withColumns({"body": F.get(parts, F.lit(2)), "_head": F.when(F.col("note") & (F.size(parts) == 3), F.get(parts, F.lit(1)))})
        rows = rows.withColumn("h", head("_head"))
        rows = rows.withColumn("early", F.when(F.col("text").isNull(), "unicode_decode_error").when(F.col("body").isNull(), "missing_frontmatter").when(~F.col("h.ok"), "malformed_metadata"))
    said = lambda c: F.when(F.try_element_at("h.fields", F.lit(c)) != "", F.try_element_at("h.fields", F.lit(c)))
    scope = F.when(said("scope").isin(*PREFIX), said("scope")).otherwise(F.lit(mapping.scope))
    raw = F.coalesce(said("taxonomy_id"), said("taxonomy_path"), said("category"))
    rows = rows.withColumns({"scope": scope, "_raw": raw, "_base": _look(DEFAULT_TAXONOMY, scope)})
    known = taxonomy.select(F.col("taxonomy_id").alias("_raw"), F.col("taxonomy_id").alias("_known"))
    rows = rows.join(known, "_raw", "left").withColumn("_first", F.coalesce(_look(mapping.taxonomy, F.col("_raw")), "_known", "_base"))
    rows = rows.join(taxonomy.select(F.col("taxonomy_id").alias("_first"), F.col("scope").alias("_scope"), F.lit(True).alias("_there")), "_first", "left")
    rows = rows.withColumn("taxonomy_id", F.when(F.col("_scope") == F.col("scope"), F.col("_first")).otherwise(F.col("_base")))
    rows = rows.join(taxonomy.select("taxonomy_id", F.col("name").alias("taxonomy_path")), "taxonomy_id", "left")
    kind = F.coalesce(said("object_type"), said("type"), F.lit("Article"))
    rows = rows.withColumn("_type", F.coalesce(_look(mapping.types, kind), kind))
    rows = rows.join(types.select(F.col("name").alias("_type"), F.col("name").alias("_named")), "_type", "left").withColumn("object_type", F.coalesce("_named", F.lit("Article")))
    rows = rows.join(types.select(F.col("name").alias("object_type"), "code", "tag_strategy"), "object_type", "left")
    reason = F.when(~F.col("note"), "excluded").otherwise(F.coalesce("early", F.when(F.col("scope").isNull(), "ambiguous_scope"), F.when(F.col("_there").isNull(), "invalid_taxonomy")))
    title = F.coalesce(said("title"), F.initcap(F.translate("stem", "_", " ")))
    prefix = _look(PREFIX, F.col("scope"))
    slug = F.upper(F.translate(F.substring(X.ascii_slug(F.coalesce(said("title"), F.lit("untitled"))), 1, 12), "-", "_"))
    tag = F.when(F.col("tag_strategy") == "year", F.lit(now[:4])).otherwise(F.when(slug == "", "NOTE").otherwise(slug))
    made = F.concat_ws("-", prefix, F.coalesce("code", F.upper(F.substring("object_type", 1, 3))), tag, F.format_string("%04d", rules.migration_number(F.col("path"))))
    given = said("id")
    who = F.lower(_strip(said("author")))
    clean = F.regexp_replace(F.regexp_replace(who, "[^a-z0-9._-]", "_"), "^_+|_+$", "")
    sure = said("confidence").try_cast("double")
    return rows.withColumn("reason", reason).select(
        "path", "reason",
        *[F.when(F.col("reason").isNull(), value).alias(c) for c, value in {
            "id": F.when(given.rlike(ID_PATTERN) & given.startswith(prefix), given).otherwise(made), "title": title, "scope": F.col("scope"), "taxonomy_id": F.col("taxonomy_id"), "taxonomy_path": F.col("taxonomy_path"),
            "object_type": F.col("object_type"), "domain": F.when(said("domain").isin(*domains), said("domain")).otherwise(F.lit(mapping.domain) if mapping.domain in domains else F.when(F.col("scope") == "engineering", "software_engineering").otherwise("formal_science")),
            "consensus": F.when(said("consensus").isin("proposed", "contested"), said("consensus")).otherwise("proposed"),
            "author": F.when(who.rlike(ACTOR_PATTERN), who).when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit("human:"), clean)).otherwise("process:migration"),
            "confidence": F.when(sure.between(0, 1), sure).otherwise(0.5), "status": F.lit("draft"),
            "source_refs": F.when(F.size("h.refs") > 0, F.col("h.refs")).otherwise(F.array("path")), "last_modified": F.coalesce(said("last_modified"), F.lit(now[:10])), "next_review": F.date_format(F.date_add(F.lit(now[:10]).cast("date"), 365), "yyyy-MM-dd"),
            "legacy_tags": F.col("h.tags"), "body": _strip(F.col("body")), "wikilinks": F.transform(F.regexp_extract_all("body", F.lit(rules.MIGRATION_LINK), F.lit(1)), lambda x: F.trim(x)),
        }.items()],
    )


def objects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("reason <> 'excluded'").select("path", "reason")


def counts(rows: DataFrame) -> DataFrame:
    """total_source_files, eligible_files, excluded_files, quarantined_files: the last three add up to the first."""
    out = F.coalesce("reason", F.lit(""))
    return rows.agg(F.count(F.lit(1)).alias("total_source_files"), F.count_if(out == "").alias("eligible_files"), F.count_if(out == "excluded").alias("excluded_files"), F.count_if(~out.isin("", "excluded")).alias("quarantined_files"))


#: Shares of the links of one name.
SALTS = 16


def link_proposals(found: DataFrame) -> DataFrame:
    """source_file, raw_link, target: wiki links of objects with the object that they name by id or by file, if one does.

    Of several objects with one name the first id counts. Links are dealt by name and file into SALTS shares, each of
    which gets the names, so that a link that every file has is no task of its own.
    """
    links = found.select(F.col("path").alias("source_file"), F.explode("wikilinks").alias("raw_link")).withColumns({"_key": F.lower("raw_link"), "_salt": F.pmod(F.xxhash64("source_file"), F.lit(SALTS))})
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    names = found.select(F.explode(F.array_distinct(F.array(F.lower("id"), F.lower(stem)))).alias("_key"), "id").groupBy("_key").agg(F.min("id").alias("target"))
    names = names.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return links.join(names, ["_key", "_salt"], "left").drop("_key", "_salt")


def facet_proposals(found: DataFrame, facets: DataFrame) -> DataFrame:
    """source_file, raw_term, facet, accepted: each legacy tag against each facet of facets(name, values)."""
    tags = found.select(F.col("path").alias("source_file"), F.explode("legacy_tags").alias("raw_term"))
    known = facets.select(F.col("name").alias("facet"), F.explode("values").alias("_v"))
    hits = tags.join(known, F.lower("raw_term") == F.col("_v")).select("source_file", "raw_term", "facet").distinct().withColumn("accepted", F.lit(True))
    every = tags.withColumn("facet", F.explode(F.array_sort(F.array(*[F.lit(r[0]) for r in facets.select("name").distinct().collect()]).cast("array<string>"))))
    return every.join(hits, ["source_file", "raw_term", "facet"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def written(found: DataFrame) -> DataFrame:
    """target, source, content, digest of each object's file; the head's fields are in the order of the columns."""
    fields = ["id", "title", "scope", "taxonomy_path", "taxonomy_id", "object_type", "domain", "consensus", "author", "confidence", "status", "source_refs", "last_modified", "next_review"]
    # A JSON text is a YAML text too: values are written as JSON, which quotes what needs it.
    alone = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    line = [F.concat(F.lit(f"{c}: "), F.to_json(c) if c == "source_refs" else alone(c)) for c in fields]
    content = F.concat(F.lit("---\n"), F.array_join(F.array(*line), "\n"), F.lit("\n---\n\n"), "body", F.lit("\n"))
    return found.select(F.concat_ws("/", "scope", "taxonomy_id", F.concat("id", F.lit(".md"))).alias("target"), F.col("path").alias("source"), content.alias("content"), F.sha2(content, 256).alias("digest"))


def plan(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """target, source, action of written files against manifest(target, source, digest): write, same, changed, or collision,
    where two sources have one target or the target came from another source."""
    before = manifest.select("target", F.col("source").alias("_s"), F.col("digest").alias("_d"))
    many = files.groupBy("target").agg(F.count_distinct("source").alias("_n"))
    action = F.when((F.col("_n") > 1) | (F.col("_s") != F.col("source")), "collision").when(F.col("_d").isNull(), "write").when(F.col("_d") == F.col("digest"), "same").otherwise("changed")
    return files.join(many, "target").join(before, "target", "left").select("target", "source", action.alias("action"))


def execute(spark: SparkSession, files: DataFrame, path: str) -> Committed:
    """Write what is new to the staged table at path. Running it again writes nothing; a collision or a changed file ends it
    before anything is written."""
    staged = StagedTable(spark, path, WRITTEN, "target", "digest")
    return staged.commit(files)
