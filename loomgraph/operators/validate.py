"""Rules over knowledge objects; each rule is a DataFrame of findings.

Registries are small tables: types(name, code, tag_strategy, required_facets, engineering_only), domains(name),
facets(name, values, allows_none), relations(name, source_types, target_types, dag, inverse_view),
governance(status, allowed_consensus) and taxonomy(id, name, scope). The clock is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import broken_diagrams
from ..functions.text import links, section_map
from ..session import keep
from . import graph

#: How ids and actors are written, and relations that rank.
ID_PATTERN = r"^(PERS|ENG)-[A-Z]{2,5}-[A-Z0-9][A-Z0-9_]*-([0-9]{4})$"
ACTOR_PATTERN = r"^(human:[a-z0-9._-]+|process:[a-z0-9._-]+|[a-z0-9._-]+/[A-Za-z0-9._-]+)$"
HIERARCHY = ("PART_OF", "INSTANCE_OF", "TYPE_OF")
LISTS = ("toolchain", "prog_language", "language", "architecture", "test_level")
MOST_RELATIONS = 20


def _finding(rows: DataFrame, condition: Column, code: str, field: str | Column) -> DataFrame:
    level = "WARNING" if code.startswith("W") else "ERROR"
    field = F.lit(field) if isinstance(field, str) else field
    return rows.where(condition).select(F.lit(code).alias("code"), field.alias("field"), F.col("path").alias("file"), F.lit(level).alias("level"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_rules(objects: DataFrame) -> DataFrame:
    unknown = objects.select("path", F.explode("unknown_fields").alias("name"))
    return _union([_finding(objects, F.col("load_error").isNotNull(), "E000", "frontmatter"), _finding(unknown, F.lit(True), "E000", F.col("name"))])


def _small(registry: DataFrame) -> DataFrame:
    """A registry to join objects with, counted first: up to graph.BROADCAST_ROWS rows are broadcast, so that objects stay
    where they are; one value that most of them have is no task of its own."""
    return F.broadcast(registry) if registry.count() <= graph.BROADCAST_ROWS else registry


def structural_rules(objects: DataFrame, types: DataFrame, taxonomy: DataFrame) -> DataFrame:
    rows = objects.where("load_error is null").withColumn("_parts", F.split("id", "-"))
    fits = F.col("id").rlike(ID_PATTERN)
    prefix = F.when(F.col("scope") == "personal", "PERS").when(F.col("scope") == "engineering", "ENG").otherwise("")
    typed = rows.join(_small(types.select(F.col("name").alias("object_type"), "code", "tag_strategy", "engineering_only")), "object_type")
    tag = F.get("_parts", 2)
    placed = rows.join(_small(taxonomy.select(F.col("id").alias("taxonomy_id"), F.col("name").alias("_leaf"), F.col("scope").alias("_scope"))), "taxonomy_id", "left")
    named = F.coalesce(F.col("taxonomy_id"), F.lit("")) != ""
    return _union([
        _finding(rows, ~F.coalesce(fits, F.lit(False)), "E005", "id"),
        _finding(rows, fits & (F.get("_parts", 0) != prefix), "E005", "id"),
        _finding(typed, F.get("_parts", 1) != F.col("code"), "E005", "id"),
        _finding(typed, (F.col("tag_strategy") == "year") & ~tag.rlike("^[0-9]{4}$"), "E005", "id"),
        _finding(typed, (F.col("tag_strategy") == "domain") & ~tag.rlike("^[A-Z][A-Z0-9_]*$"), "E005", "id"),
        _finding(typed, F.col("engineering_only") & (F.col("scope") == "personal"), "E006", "object_type"),
        _finding(rows, ~named, "W001", "taxonomy_id"),
        _finding(placed, named & F.col("_leaf").isNull(), "E017", "taxonomy_id"),
        _finding(placed, F.col("_leaf").isNotNull() & ~F.col("taxonomy_path").eqNullSafe(F.col("_leaf")), "E016", "taxonomy_path"),
        _finding(placed, F.col("_leaf").isNotNull() & ~F.col("scope").eqNullSafe(F.col("_scope")), "E016", "scope"),
    ])


def semantic_rules(objects: DataFrame, types: DataFrame, domains: DataFrame, facets: DataFrame, governance: DataFrame, today: str) -> DataFrame:
    rows = objects.where("load_error is null")
    present = [c for c in (*LISTS, "audience", "lifecycle") if c in rows.columns]
    as_list = {c: (F.col(c) if c in LISTS else F.when(F.col(c).isNotNull(), F.array(c))) for c in present}
    long = rows.select("path", "object_type", F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), v.alias("v"), F.lit(c in LISTS).alias("many")) for c, v in as_list.items()])).alias("f")).select("path", "object_type", "f.*")
    needed = types.select(F.col("name").alias("object_type"), F.explode("required_facets").alias("facet"))
    missing = long.join(needed, ["object_type", "facet"]).where("v is null or size(v) = 0")
    known = long.where("v is not null").join(facets.select(F.col("name").alias("facet"), "values", "allows_none"), "facet")
    none, unknown = F.array_contains("v", "none"), F.array_contains("v", "unknown")
    concrete = F.exists("v", lambda x: ~x.isin("none", "unknown"))
    each = known.where("size(v) > 0").withColumn("x", F.explode("v"))
    off = ((F.col("x") == "none") & ~F.col("allows_none")) | ((F.col("x") != "none") & ~F.array_contains("values", F.col("x"))) | ((F.col("x") == "none") & F.col("allows_none") & ~F.array_contains("values", F.col("x")))
    ruled = rows.join(governance, "status")
    day = F.lit(today).cast("date")
    at = {c: F.col(c).try_cast("date") for c in ("next_review", "last_verified", "last_modified")}
    refs = F.coalesce("source_refs", F.array())
    return _union([
        _finding(rows.join(domains.select(F.col("name").alias("domain")), "domain", "left_anti"), F.lit(True), "E027", "domain"),
        _finding(missing, F.lit(True), "E020", F.col("facet")),
        _finding(known, F.col("many") & (F.size("v") == 0), "E013", F.col("facet")),
        _finding(known, F.col("many") & (F.size(F.array_distinct("v")) < F.size("v")), "E014", F.col("facet")),
        _finding(known, (none & concrete) | (unknown & concrete) | (none & unknown), "E015", F.col("facet")),
        _finding(each, off, "E026", F.col("facet")),
        _finding(each, (F.col("x") == "unknown") & ~off, "W011", F.col("facet")),
        _finding(ruled, ~F.coalesce(F.array_contains("allowed_consensus", F.col("consensus")), F.lit(False)), "E004", "consensus"),
        _finding(rows, (F.col("author") != "") & ~F.col("author").rlike(ACTOR_PATTERN), "E028", "author"),
        _finding(rows, (F.col("reviewer") != "") & ~F.col("reviewer").rlike(ACTOR_PATTERN), "E028", "reviewer"),
        _finding(rows, F.col("reviewer").isNull() != F.col("last_verified").isNull(), "E029", "reviewer"),
        _finding(rows, (F.size(refs) == 0) | (F.size(F.array_distinct(refs)) < F.size(refs)), "E030", "source_refs"),
        _finding(rows, F.col("validity.valid_until").try_cast("date") < F.col("validity.valid_from").try_cast("date"), "E007", "validity.valid_until"),
        _finding(rows, at["next_review"] < day, "W002", "next_review"),
        _finding(rows, at["last_verified"] > day, "W003", "last_verified"),
        _finding(rows, at["last_modified"] > day, "W012", "last_modified"),
        _finding(rows, at["last_modified"] > at["last_verified"], "W013", "last_modified"),
    ])


def relations_of(objects: DataFrame) -> DataFrame:
    return objects.where("id is not null").select("path", "id", "scope", "status", "object_type", F.posexplode("relations").alias("pos", "r")).select("path", "id", "scope", "status", "object_type", "pos", "r.type", "r.target", F.coalesce("r.soft_link", F.lit(False)).alias("soft_link"))


def by_id(objects: DataFrame) -> DataFrame:
    """One object per id, the first by path."""
    order = Window.partitionBy("id").orderBy("path")
    return objects.where("id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def graph_rules(objects: DataFrame, relations: DataFrame, most: int = MOST_RELATIONS) -> DataFrame:
    edges = relations_of(objects)
    repeats = edges.withColumn("_n", F.row_number().over(Window.partitionBy("path", "type", "target").orderBy("pos")))
    views = relations.where("inverse_view is not null").select(F.col("inverse_view").alias("type"))
    targets = by_id(objects).select(F.col("id").alias("target"), F.col("object_type").alias("_target_type"))
    known = edges.join(relations.withColumnRenamed("name", "type"), "type").join(targets, "target", "left")
    return _union([
        _finding(objects, F.size("relations") > most, "W015", "relations"),
        _finding(edges, F.col("target") == F.col("id"), "E011", "relations"),
        _finding(repeats, F.col("_n") > 1, "E012", "relations"),
        _finding(edges.join(views, "type", "left_semi"), F.lit(True), "E019", "relations.type"),
        _finding(known, ~F.array_contains("source_types", F.col("object_type")), "E021", "relations.type"),
        _finding(known, F.col("_target_type").isNotNull() & ~F.array_contains("target_types", F.col("_target_type")), "E021", "relations.target"),
        _finding(known, (F.col("type") == "DESCRIBES") & F.col("_target_type").isNotNull(), "E031", "relations.type"),
    ])


def cycle_rules(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Files with an edge on a cycle of one relation that forbids them, or of the hierarchy as a whole."""
    edges = relations_of(objects).select("path", "type", F.col("id").alias("u"), F.col("target").alias("v"))
    names = [r["name"] for r in relations.where("dag").select("name").collect()]  # a row per relation type
    out = []
    for group in [[n] for n in names] + [list(HIERARCHY)]:
        own = edges.where(F.col("type").isin(group))
        left = graph.cycles(own)
        out.append(_finding(own.join(left, ["u", "v"], "left_semi").select("path").distinct(), F.lit(True), "E010", "relations"))
    return _union(out)


def cross_object_rules(objects: DataFrame) -> DataFrame:
    twice = objects.where("id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("path")))
    targets = by_id(objects).select(F.col("id").alias("target"), F.col("status").alias("_status"), F.col("scope").alias("_scope"), F.lit(True).alias("_there"))
    edges = relations_of(objects).join(targets, "target", "left")
    there = F.col("_there").isNotNull()
    return _union([
        _finding(twice, F.col("_n") > 1, "E001", "id"),
        _finding(edges, ~there & ~F.col("soft_link"), "E009", "relations.target"),
        _finding(edges, there & F.col("soft_link"), "W005", "relations.soft_link"),
        _finding(edges, (F.col("status") == "established") & (F.col("_status") == "deprecated"), "W006", "relations.target"),
        _finding(edges, (F.col("status") == "established") & (F.col("_status") == "archived"), "W007", "relations.target"),
        _finding(edges, there & (F.col("type") == "SUPERSEDES") & ~F.coalesce(F.col("_status").isin("deprecated", "archived"), F.lit(False)), "W008", "relations.target"),
        _finding(edges, F.col("_scope") != F.col("scope"), "W009", "relations.target"),
    ])


def exit_code(findings: DataFrame) -> int:
    levels = {r["level"] for r in findings.select("level").distinct().collect()}
    return 1 if "ERROR" in levels else 0


def body_rules(objects: DataFrame, headings: tuple) -> DataFrame:
    """W014 headings outside the template, W016 relation targets without a link in the body, W017 broken diagrams."""
    rows = objects.where("load_error is null")
    named = rows.select("path", F.explode(F.transform(section_map(F.col("raw_body")), lambda s: s["title"])).alias("title"))
    linked = F.transform(links(F.col("raw_body")), lambda x: F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"(#.*)?$|\.md(#.*)?$", ""))
    targets = rows.select("path", F.explode("relations.target").alias("target"), F.concat(links(F.col("raw_body")), linked).alias("_links"))
    broken = rows.select("path", F.explode(broken_diagrams(F.col("raw_body"))).alias("fault"))
    return _union([
        _finding(named, ~F.col("title").isin(*headings), "W014", F.concat(F.lit("sections."), "title")),
        _finding(targets, (F.coalesce("target", F.lit("")) != "") & ~F.array_contains("_links", F.col("target")), "W016", "relations"),
        _finding(broken, F.lit(True), "W017", "body"),
    ])


def placement_rules(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """E002: a file that doesn't lie where its taxonomy node says; paths(taxonomy_id, folder)."""
    rows = objects.join(paths, "taxonomy_id")
    return _finding(rows, ~F.col("path").endswith(F.concat("folder", "id", F.lit(".md"))), "E002", "taxonomy_id")


#: Constraints between registries as (code, registry, key, field, where the field stands, registry and
#: column that must have its values) and keys that may come once.
REFERENCES = (
    ("E081", "spec_ownership", "family_id", "owner", "invariant_families.{}.owner", "paths", "path"),
    ("E083", "threshold_policy", "threshold_id", "owner", "thresholds.{}.owner", "paths", "path"),
    ("E085", "source_registry", "name", "root", "source_types.{}.source_taxonomy", "source_taxonomy", "root"),
    ("E023", "relation_registry", "name", "source_types", "relations.{}.source_types", "object_registry", "name"),
    ("E023", "relation_registry", "name", "target_types", "relations.{}.target_types", "object_registry", "name"),
    ("E020", "object_registry", "name", "required_facets", "object_types.{}.required_facets", "facet_registry", "name"),
    ("E018", "taxonomy_registry", "taxonomy_id", "parent_id", "taxonomy.{}.parent_id", "taxonomy_registry", "taxonomy_id"),
)
UNIQUE = (("E080", "spec_ownership", "family_id", "invariant_families.{}"), ("E082", "threshold_policy", "threshold_id", "thresholds.{}"))


def _named(pattern: str, key: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), key.cast("string"), F.lit(after))


def taxonomy_rounds(taxonomy: DataFrame) -> DataFrame:
    """id, entry of taxonomy(taxonomy_id, parent_id) rows whose parents run into a round: the first node met twice."""
    steps = taxonomy.where("parent_id is not null").select(F.col("taxonomy_id").alias("u"), F.col("parent_id").alias("v")).distinct()
    found = step = keep(graph.cycles(steps).select(F.col("u").alias("id"), F.col("u").alias("entry")).distinct())
    while step.head(1):
        more = steps.join(step.select(F.col("id").alias("v"), "entry").hint("merge"), "v").select(F.col("u").alias("id"), "entry")
        step = keep(more.join(found.select("id").hint("merge"), "id", "left_anti"))
        found = found.union(step)
    return found


def registry_rules(registries: dict[str, DataFrame]) -> DataFrame:
    """code, registry, field: what breaks inside and between registries; those that aren't given aren't looked at.

    spec_ownership(family_id, owner), threshold_policy(threshold_id, owner), paths(path), source_registry(name,
    source_taxonomy), source_taxonomy(root, children), relation_registry(name, source_types, target_types, symmetric,
    inverse_view), object_registry(name, required_facets), facet_registry(name, values, allows_none),
    taxonomy_registry(taxonomy_id, parent_id, scope). References become anti-joins, one for each row of REFERENCES.
    """
    given = dict(registries)
    out = []

    def add(rows: DataFrame, code: str, registry: str, field: Column) -> None:
        out.append(rows.select(F.lit(code).alias("code"), F.lit(registry).alias("registry"), field.alias("field")))

    if "source_registry" in given:
        given["source_registry"] = given["source_registry"].withColumns({"root": F.get("source_taxonomy", F.lit(0)), "child": F.get("source_taxonomy", F.lit(1))})
    for code, registry, key, pattern in UNIQUE:
        if registry in given:
            repeats = given[registry].groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            add(repeats.withColumn("_again", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))), code, registry, _named(pattern, F.col(key)))
    for code, registry, key, field, pattern, target, column in REFERENCES:
        if registry in given and target in given:
            rows = given[registry]
            value = F.explode(field) if rows.schema[field].dataType.typeName() == "array" else F.col(field)
            used = rows.select(F.col(key).alias("_k"), value.alias("_v")).where("_v is not null")
            add(used.join(given[target].select(F.col(column).alias("_v")).distinct().hint("merge"), "_v", "left_anti"), code, registry, _named(pattern, F.col("_k")))
    if "source_registry" in given:
        sources = given["source_registry"]
        add(sources.where("coalesce(size(source_taxonomy), 0) < 1"), "E084", "source_registry", _named("source_types.{}.source_taxonomy", F.col("name")))
        if "source_taxonomy" in given:
            under = sources.where("child is not null").join(given["source_taxonomy"], "root")
            add(under.where(~F.coalesce(F.array_contains("children", F.col("child")), F.lit(False))), "E086", "source_registry", _named("source_types.{}.source_taxonomy", F.col("name")))
    if "relation_registry" in given:
        relations = given["relation_registry"]
        own = F.coalesce(F.col("inverse_view") == F.col("name"), F.lit(False))
        view = _named("relations.{}.inverse_view", F.col("name"))
        add(relations.where(F.col("symmetric") & ~own), "E025", "relation_registry", view)
        shared = relations.where(~F.col("symmetric")).withColumn("_n", F.row_number().over(Window.partitionBy("inverse_view").orderBy("name")))
        add(shared.where("_n > 1"), "E025", "relation_registry", view)
    if "taxonomy_registry" in given:
        nodes = given["taxonomy_registry"]
        parents = nodes.select(F.col("taxonomy_id").alias("parent_id"), F.col("scope").alias("_scope"))
        add(nodes.join(parents.hint("merge"), "parent_id").where("scope <> _scope"), "E018", "taxonomy_registry", _named("taxonomy.{}.parent_id", F.col("taxonomy_id")))
        add(taxonomy_rounds(nodes), "E024", "taxonomy_registry", _named("taxonomy.{}", F.col("entry")))
    if "facet_registry" in given:
        facets = given["facet_registry"]
        add(facets.where(~F.col("allows_none") & F.array_contains("values", "none")), "E026", "facet_registry", _named("facets.{}", F.col("name")))
    return _union(out)
