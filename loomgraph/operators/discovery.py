"""What a corpus lacks and what it touches: ontological gaps, node metrics, code search, links to code, closures,
renames, taxonomy paths and incremental indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules
from ..session import keep, parts_of
from . import graph

#: Relations and types that settle an incident or put a lesson to work.
RESOLVING = ("RESOLVED_BY", "SATISFIES", "RESOLVES")
RESOLVING_TYPES = ("Lesson", "Component", "Procedure")
IMPLEMENTING = ("SATISFIES", "INTRODUCED_IN", "IMPLEMENTS", "APPLIES")
#: Characters at the end of a path by which references to it are looked for.
ANCHOR = 12
#: Up to so many different ends of paths (with their widths) are looked for in references by themselves.
MOST_ENDS = 1000
REFERENCES_A_TASK = 25_000
BRIDGE_STATUSES = ("pending", "reviewed", "approved", "rejected")


def ontological_gaps(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """candidate_id, pattern, confidence, sources from objects(id, object_type, title, confidence) and
    relations(src, type, dst): incidents without resolution, lessons that nothing applies, contradictions between
    objects of equal confidence."""
    title = F.lower(F.coalesce("title", F.lit("")))
    kind = F.coalesce("object_type", F.lit(""))
    known = objects.select(F.col("id").alias("dst"), F.col("object_type").alias("_type"))
    settled = relations.join(known, "dst", "left").where(F.col("type").isin(*RESOLVING) | F.col("_type").isin(*RESOLVING_TYPES)).select(F.col("src").alias("id")).distinct()
    incidents = objects.where(kind.isin("Incident", "TroubleReport") | title.contains("incident") | title.contains("outage"))

    def row(found: DataFrame, name: str, pattern: str, confidence: float) -> DataFrame:
        return found.select(F.concat(F.lit(f"DISC-GAP-ONTO-{name}-"), F.col("id")).alias("candidate_id"), F.lit(pattern).alias("pattern"), F.lit(confidence).alias("confidence"), F.array("id").alias("sources"))

    unresolved = row(incidents.join(settled, "id", "left_anti"), "UNRESOLVED", "unresolved_event", 0.90)
    used = relations.where(F.col("type").isin(*IMPLEMENTING)).select(F.col("dst").alias("id")).distinct()
    lessons = objects.where(kind.isin("Lesson", "Principle") | title.contains("lesson"))
    unused = row(lessons.join(used, "id", "left_anti"), "UNIMPLEMENTED", "unimplemented_lesson", 0.85)
    pairs = relations.where("type = 'CONTRADICTS'").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    u = objects.select(F.col("id").alias("u"), F.col("confidence").alias("cu"))
    v = objects.select(F.col("id").alias("v"), F.col("confidence").alias("cv"))
    tied = pairs.join(u, "u").join(v, "v").where(F.col("cu").eqNullSafe(F.col("cv")))
    conflicts = tied.select(F.concat_ws("-", F.lit("DISC-GAP-ONTO-CONFLICT"), "u", "v").alias("candidate_id"), F.lit("unreconciled_conflict").alias("pattern"), F.lit(0.95).alias("confidence"), F.array("u", "v").alias("sources"))
    return unresolved.union(unused).union(conflicts)


def topological_gaps(nodes: DataFrame, together: DataFrame, similar: DataFrame, relations: DataFrame, least: int = 3, near: float = 0.80) -> DataFrame:
    """candidate_id, a, b, community, together, similar, shared, confidence: pairs of nodes(id, scope, community) of one
    scope without a relation of relations(src, dst) either way, for which two of three hold: the same community, at
    least `least` shared chunks in together(a, b, shared), a cosine of at least `near` in similar(a, b, similarity).

    Any two of the three include one of the last two, so only their pairs are candidates; communities are never paired.
    Confidence is the cosine where it is known, else null.
    """
    pair = lambda rows, *more: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)
    often = pair(together.where(F.col("shared") >= least), "shared")
    like = pair(similar.where(F.col("similarity") >= near), "similarity")
    found = often.join(like, ["a", "b"], "full_outer")
    told = nodes.select("id", "scope", "community")
    side = lambda x: told.select(F.col("id").alias(x), F.col("scope").alias(f"_s{x}"), F.col("community").alias(f"_c{x}"))
    found = found.join(side("a"), "a").join(side("b"), "b").where("_sa = _sb")
    linked = pair(relations.select(F.col("src").alias("a"), F.col("dst").alias("b"))).distinct()
    found = found.withColumn("community", F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).join(linked, ["a", "b"], "left_anti")
    votes = sum((F.col(c).cast("int") for c in ("community", "together", "similar")), F.lit(0))
    found = found.withColumns({"together": F.col("shared").isNotNull(), "similar": F.col("similarity").isNotNull()}).where(votes >= 2)
    return found.select(F.concat_ws("-", F.lit("DISC-GAP-TOPO"), F.col("a").cast("string"), F.col("b").cast("string")).alias("candidate_id"), "a", "b", "community", "together", "similar", F.coalesce("shared", F.lit(0)).alias("shared"), F.round("similarity", 4).alias("confidence"))


def scan(*found: DataFrame) -> DataFrame:
    """All candidates of several searches by candidate_id."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).orderBy("candidate_id")


def _inner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Different edges(u, v) between known nodes, without loops; kept."""
    ids = nodes.select(F.col("id").alias("u")).hint("merge")
    e = edges.select("u", "v").where("u <> v").distinct().join(ids, "u", "left_semi").join(ids.withColumnRenamed("u", "v").hint("merge"), "v", "left_semi")
    return keep(e.select("u", "v"))


def _degrees(rows: DataFrame, e: DataFrame) -> DataFrame:
    """rows(id, ...) with in_degree, out_degree and total_degree over e(u, v); each end is counted as one row."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("o")), F.struct(F.col("v").alias("id"), F.lit(0).alias("o")))).alias("_e"))
    counts = ends.groupBy("_e.id").agg(F.sum(1 - F.col("_e.o")).alias("in_degree"), F.sum("_e.o").alias("out_degree"))
    return rows.join(counts.hint("merge"), "id", "left").fillna(0, ["in_degree", "out_degree"]).withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, scope and the degrees of node_metrics, without looking for components."""
    return _degrees(nodes.select("id", "scope"), _inner(nodes, edges)).withColumnRenamed("id", "node_id")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, scope, in_degree, out_degree, total_degree, component_id, community_id of nodes(id, scope).

    Edges to unknown nodes and loops don't count. Components, and those inside a scope, are numbered by least member.
    """
    e = _inner(nodes, edges)
    scope = nodes.select(F.col("id").alias("u"), F.col("scope").alias("su"))
    own = e.join(scope.hint("merge"), "u").join(scope.select(F.col("u").alias("v"), F.col("su").alias("sv")).hint("merge"), "v").where("su = sv")

    def least(edge_rows: DataFrame, name: str) -> DataFrame:
        found = graph.components(edge_rows.select("u", "v")).withColumnsRenamed({"node": "id", "component": name})
        return nodes.select("id", "scope").join(found.hint("merge"), "id", "left").withColumn(name, F.coalesce(name, "id"))

    whole = keep(least(e, "root"))
    numbers = graph.dense_ids(whole.select(F.col("root").alias("id")).distinct()).select(F.col("id").alias("root"), (F.col("idx") + 1).alias("n"))
    local = keep(least(own, "local"))
    firsts = graph.dense_ids(local.select(F.struct("scope", F.col("local").alias("m")).alias("id")).distinct())
    starts = firsts.groupBy(F.col("id.scope").alias("scope")).agg(F.min("idx").alias("first"))
    firsts = firsts.select(F.col("id.scope").alias("scope"), F.col("id.m").alias("local"), "idx").join(starts, "scope").select("scope", "local", (F.col("idx") - F.col("first") + 1).alias("c"))
    rows = whole.join(numbers.hint("merge"), "root").join(local.select("id", "local").hint("merge"), "id").join(firsts, ["scope", "local"])
    rows = _degrees(rows, e)
    return rows.select(F.col("id").alias("node_id"), "scope", "in_degree", "out_degree", "total_degree",
                       rules.component_id(F.col("n")).alias("component_id"), rules.community_id(F.col("scope"), F.col("c")).alias("community_id"))


def code_search(nodes: DataFrame, queries: DataFrame, k: int = 10, kind: str | None = None) -> DataFrame:
    """query_id, node_id, score, rank: nodes(node_id, kind, name, path) for a stated batch queries(query_id, query).

    The batch is packed into one row, so that nodes are scanned once and no pair that scores 0 is made.
    """
    rows = nodes.where(F.col("kind") == kind) if kind else nodes
    asked = [(r["query_id"], r["query"].strip().lower()) for r in queries.select("query_id", "query").collect() if (r["query"] or "").strip()]
    name, path, node = F.lower(F.coalesce("name", F.lit(""))), F.lower("path"), F.lower("node_id")

    def score(q: str) -> Column:
        return (F.when(name == q, 1.0).when(name.endswith(f".{q}") | name.startswith(f"{q}."), 0.8).when(name.contains(q), 0.6)
                .when(path.contains(q), 0.4).when(node.contains(q), 0.2))

    one = F.array(*[F.struct(F.lit(i).alias("query_id"), score(q).alias("score")) for i, q in asked]) if asked else F.array().cast("array<struct<query_id:int,score:double>>")
    hits = rows.select("node_id", F.explode(F.filter(one, lambda x: x["score"].isNotNull())).alias("h")).select("h.query_id", "node_id", "h.score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mentions(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, term of wanted(term, ...) that stands in an object's body as a whole; joined on its first word."""
    first = lambda c: F.regexp_extract(c, r"\w+", 0)
    words = objects.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"\w+"), F.lit(0)))).alias("_w"))
    terms = wanted.select("term").distinct().withColumn("_w", first(F.col("term")))
    hits = words.join(terms, "_w").select("id", "term")
    simple = hits.where(~F.col("term").rlike(r"\W"))
    bodies = objects.select("id", "body")
    whole = F.expr(r"rlike(body, concat('\\b\\Q', term, '\\E\\b'))")
    return simple.union(hits.where(F.col("term").rlike(r"\W")).join(bodies, "id").where(whole).select("id", "term"))


def _contained(refs: DataFrame, files: DataFrame) -> DataFrame:
    """id, node_id of refs(id, r) whose text contains the path of files(node_id, term).

    Paths are joined on their last ANCHOR characters with the windows of that width in a reference, so only pairs that
    share a path's end are compared; shorter paths are joined whole. Where paths have few different last two
    characters, only windows that end like a path are made. References are dealt out before that, a task however
    large a file is; no side is broadcast.
    """
    keyed = files.where("length(term) > 0").withColumn("_key", F.expr(f"right(term, {ANCHOR})"))
    ends = keyed.select(F.length("_key").alias("w"), F.expr("right(_key, 2)").alias("end")).distinct().limit(MOST_ENDS + 1).collect()
    if not ends:
        return refs.join(files, F.lit(False)).select("id", "node_id")
    widths = sorted({r["w"] for r in ends}) if len(ends) <= MOST_ENDS else list(range(1, ANCHOR + 1))

    def windows(w: int) -> Column:
        every = F.expr(f"if(length(r) < {w}, array(), sequence({w}, length(r)))")  # where a window may end
        if len(ends) <= MOST_ENDS:
            mine = [F.lit(r["end"]) for r in ends if r["w"] == w]
            every = F.filter(every, lambda i: F.substr("r", i - (min(w, 2) - 1), F.lit(min(w, 2))).isin(*mine))
        return F.transform(every, lambda i: F.substr("r", i - (w - 1), F.lit(w)))

    rows = refs.where("r is not null")
    rows = rows.repartition(parts_of(rows.count(), REFERENCES_A_TASK))
    each = rows.withColumn("_key", F.explode(F.array_distinct(F.flatten(F.array(*map(windows, widths))))))
    return each.hint("merge").join(keyed, "_key").where(F.contains("r", "term")).select("id", "node_id").distinct()


def code_bridges(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """bridge_id, object_id, node_id, bridge_type, status: objects(id, body, source_refs) that name files or symbols.

    nodes(node_id, kind, name, path); a file's own node has kind FILE. Symbols of fewer than four letters don't count.
    """
    files = nodes.where("kind = 'FILE'").select("node_id", F.col("path").alias("term"))
    refs = _contained(objects.select("id", F.explode("source_refs").alias("r")), files)
    named = _mentions(objects, files).join(files, "term").select("id", "node_id").union(refs.select("id", "node_id")).distinct().withColumn("bridge_type", F.lit("represented_by"))
    symbols = nodes.where("kind <> 'FILE' and length(name) >= 4").select("node_id", "kind", F.col("name").alias("term"))
    told = _mentions(objects, symbols).join(symbols, "term").select("id", "node_id", F.when(F.col("kind") == "TEST", "tested_by").otherwise("documents").alias("bridge_type"))
    rows = named.union(told).distinct()
    return rows.select(F.concat_ws("#", F.lit("bridge"), "id", "node_id", "bridge_type").alias("bridge_id"), F.col("id").alias("object_id"), "node_id", "bridge_type", F.lit("pending").alias("status"))


def merge_bridges(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored bridges as they were reviewed, and those found that aren't among them."""
    return stored.unionByName(found.join(stored.select("bridge_id"), "bridge_id", "left_anti"))


def review(bridges: DataFrame, reviews: DataFrame) -> DataFrame:
    """bridges with the statuses of reviews(bridge_id, status); unknown ids and statuses change nothing."""
    fresh = reviews.where(F.col("status").isin(*BRIDGE_STATUSES)).groupBy("bridge_id").agg(F.max("status").alias("_s"))
    return bridges.join(fresh, "bridge_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def closure(objects: DataFrame, relations: DataFrame, selected: DataFrame, types: tuple, depth: int, allow_personal: bool = False) -> DataFrame:
    """id, depth of selected(id) and what relations of the types reach from there; personal objects only if allowed."""
    allowed = objects if allow_personal else objects.where("coalesce(scope, '') <> 'personal'")
    steps = relations.where(F.col("type").isin(*types)).select(F.col("src").alias("id"), F.col("dst"))
    steps = keep(steps.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "dst").distinct())
    seen = frontier = selected.select("id").distinct().withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.select("id").join(steps, "id").select(F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.union(frontier)
    return seen


def rename(objects: DataFrame, relations: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """objects(id, body) and relations(src, type, dst) after a rename; wiki links keep their labels."""
    import re

    bare = rf"\[\[\s*{re.escape(old)}\s*\]\]"
    piped = rf"\[\[\s*{re.escape(old)}\s*\|\s*([^\]]*)\]\]"
    plain = new.replace("\\", "\\\\").replace("$", "\\$")  # as a replacement, not as a reference to a group
    body = F.regexp_replace(F.regexp_replace("body", piped, f"[[{plain}|$1]]"), bare, f"[[{plain}]]")
    moved = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return objects.withColumn("body", body).withColumn("id", moved("id")), relations.select(moved("src"), "type", moved("dst"))


def taxonomy_paths(nodes: DataFrame, most: int = 32) -> DataFrame:
    """id, scope, path, fault of nodes(id, name, parent_id, scope): names from the root down, made into slugs.

    A missing parent is E018; a chain that hasn't ended after `most` steps goes round, E024. A row per node and round.
    """
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    table = keep(nodes.select("id", "parent_id", slug.alias("slug"), "scope"))
    open_ = table.select("id", "scope", F.array("slug").alias("chain"), F.col("parent_id").alias("next"))
    done = None
    parents = table.select(F.col("id").alias("next"), F.col("slug").alias("s"), F.col("parent_id").alias("p"), F.lit(True).alias("there"))
    for _ in range(most):
        ended = open_.where("next is null").select("id", "scope", "chain", F.lit(None).cast("string").alias("fault"))
        done = ended if done is None else done.union(ended)
        step = keep(open_.where("next is not null").join(parents, "next", "left"))
        done = done.union(step.where("there is null").select("id", "scope", "chain", F.lit("E018")))
        open_ = step.where("there").select("id", "scope", F.concat(F.array("s"), "chain").alias("chain"), F.col("p").alias("next"))
        if not step.where("there").limit(1).count():
            break
    done = done.union(open_.select("id", "scope", "chain", F.when(F.col("next").isNotNull(), "E024")))
    return done.select("id", "scope", F.when(F.col("fault").isNull(), F.concat("scope", F.lit("/"), F.array_join("chain", "/"), F.lit("/"))).alias("path"), "fault")


def index_changes(stored: DataFrame, files: DataFrame) -> DataFrame:
    """path, change (unchanged, changed, added, deleted) between stored(path, digest) and files(path, digest)."""
    joined = stored.select("path", F.col("digest").alias("a")).join(files.select("path", F.col("digest").alias("b")), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return joined.select("path", change.alias("change"))


def refreshed(nodes: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of nodes(path, ...) of unchanged files, and fresh rows of added and changed ones."""
    same = changes.where("change = 'unchanged'").select("path")
    new = changes.where("change in ('added', 'changed')").select("path")
    return nodes.join(same, "path", "left_semi").unionByName(fresh.join(new, "path", "left_semi"))
