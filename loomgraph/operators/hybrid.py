"""Hybrid retrieval for batches of queries: filters, seeds, bounded expansion, graph features and the result bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import body_excerpt, content_tokens, entailment, passage_budget, scoring_window, tokenize_with_ids
from ..session import keep
from . import fusion, graph

#: Order in which categories of relations are followed.
CATEGORIES = ("structural", "dependency", "engineering", "evolution", "derivation", "verification", "epistemic", "procedural", "documentation", "semantic")
#: Weights of the six graph features.
PHI_WEIGHTS = (0.30, 0.20, 0.15, 0.10, 0.15, 0.10)


def eligible(objects: DataFrame, scope: str | None = None, object_types: list[str] | None = None, domain: str | None = None, drafts: bool = False, deprecated: bool = False, min_confidence: float = 0.0, valid_at: str | None = None) -> DataFrame:
    """Objects that governance lets through; archived ones stay, a confidence that isn't a number is 0."""
    rows = objects
    for column, wanted in (("scope", [scope] if scope else None), ("object_type", object_types), ("domain", [domain] if domain else None)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    dropped = [s for s, keep_it in (("draft", drafts), ("deprecated", deprecated)) if not keep_it]
    if dropped:
        rows = rows.where(~F.coalesce(F.col("status").isin(dropped), F.lit(False)))
    rows = rows.where(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= min_confidence)
    if valid_at:
        rows = rows.where(fusion.valid_at(F.col("validity.valid_from"), F.col("validity.valid_until"), F.lit(valid_at)))
    return rows


def seeds(lexical: DataFrame, vector: DataFrame, k: int, key: str = "id") -> DataFrame:
    """query_id, key, ord: the k best lexical hits, then the k best vector hits that are new."""
    first = fusion.ranked(lexical, "r", key).where(F.col("r") <= k).select("query_id", key, F.lit(0).alias("m"), "r")
    both = first.union(fusion.ranked(vector, "r", key).where(F.col("r") <= k).select("query_id", key, F.lit(1), "r"))
    best = both.groupBy("query_id", key).agg(F.min(F.struct("m", "r")).alias("o"))
    return best.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy("o")).alias("ord"))


def expand(starts: DataFrame, edges: DataFrame, allowed: DataFrame, depth: int = 2, neighbours: int = 25, most: int = 200) -> DataFrame:
    """query_id, id, depth, ord: what outgoing edges(src, dst, category, type) reach from starts(query_id, id, ord).

    A node's edges are cut to `neighbours` by category, type and target before targets that aren't in allowed(id)
    are left out; nodes come in first-in-first-out order, and a query stops at `most` nodes, its seeds included.
    """
    priority = F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), F.lit(0))
    priority = F.when(priority == 0, len(CATEGORIES) + 1).otherwise(priority)
    order = Window.partitionBy("src").orderBy(priority, "type", "dst")
    near = keep(edges.withColumn("n", F.row_number().over(order)).where(F.col("n") <= neighbours).select("src", F.col("dst").alias("id"), "n").join(allowed.select("id").distinct(), "id", "left_semi"))
    seen = frontier = starts.select("query_id", "id", F.lit(0).alias("depth"), F.col("ord").cast("long").alias("ord"))
    for level in range(1, depth + 1):
        step = frontier.select("query_id", F.col("id").alias("src"), F.col("ord").alias("parent")).join(near, "src")
        step = step.groupBy("query_id", "id").agg(F.min(F.struct("parent", "n")).alias("o")).join(seen, ["query_id", "id"], "left_anti")
        counts = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.max("ord").alias("last"))
        step = step.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("o"))).join(counts, "query_id")
        frontier = keep(step.where(F.col("have") + F.col("k") <= most).select("query_id", "id", F.lit(level).alias("depth"), (F.col("last") + F.col("k")).alias("ord")))
        seen = seen.union(frontier)
    return seen


def graph_scores(expanded: DataFrame) -> DataFrame:
    """1 / (1 + depth) of each reached node, for queries whose expansion reached more than its seeds."""
    beyond = expanded.where("depth > 0").select("query_id").distinct()
    return expanded.join(beyond, "query_id", "left_semi").select("query_id", "id", (1 / (1 + F.col("depth"))).alias("score"))


def phi_scores(candidates: DataFrame, starts: DataFrame, distances: DataFrame, refs: DataFrame, communities: DataFrame, degrees: DataFrame) -> DataFrame:
    """query_id, id, score: six features of candidates(query_id, id) against the query's seeds.

    distances(root, node, depth) are directed, to 3 steps; refs(id, ref); communities(id, community);
    degrees(id, degree). The fifth feature is 0.
    """
    pairs = candidates.join(starts.select("query_id", F.col("id").alias("seed")), "query_id")
    pairs = pairs.join(distances.select(F.col("root").alias("seed"), F.col("node").alias("id"), "depth"), ["seed", "id"], "left")
    mine, theirs = refs.select("id", "ref"), refs.select(F.col("id").alias("seed"), "ref")
    shared = pairs.select("query_id", "id", "seed").join(mine, "id").join(theirs, ["seed", "ref"]).groupBy("query_id", "id", "seed").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.join(shared, ["query_id", "id", "seed"], "left")
    pairs = pairs.join(communities.select("id", F.col("community").alias("c")), "id", "left").join(communities.select(F.col("id").alias("seed"), F.col("community").alias("d")), "seed", "left")
    one = F.when(F.col("depth").isNotNull() | (F.col("id") == F.col("seed")), 1 / (1 + F.coalesce("depth", F.lit(0)))).otherwise(0.0)
    three = F.least(F.lit(1.0), F.coalesce("shared", F.lit(0)) / 5)
    four = F.coalesce(F.col("c") == F.col("d"), F.lit(False)).cast("double")
    found = pairs.groupBy("query_id", "id").agg(F.max(one).alias("f1"), F.max(three).alias("f3"), F.max(four).alias("f4"))
    found = found.join(degrees.select("id", "degree"), "id", "left").withColumn("f2", (F.col("f1") > 0).cast("double")).withColumn("f5", F.lit(0.0)).withColumn("f6", F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 50))
    score = sum((F.col(f"f{i + 1}") * w for i, w in enumerate(PHI_WEIGHTS)), F.lit(0.0))
    return found.select("query_id", "id", F.round(score, 6).alias("score"))


def bundle(fused: DataFrame, objects: DataFrame, most: int = 20, min_relevance: float = 0.0) -> DataFrame:
    """The best results of each query with what an answer needs from their objects, one nested row a result."""
    best = fused.where(F.col("score") >= min_relevance).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)
    epistemology = F.struct("verification", "authority", "consensus", "evidence", "confidence")
    return best.join(objects, "id").select("query_id", "rank", "id", "title", "score", F.split("matched_by", ",").alias("matched_by"), epistemology.alias("epistemology"), "validity", F.slice("relations", 1, 25).alias("relations"))


#: The facets that a result shows.
FACETS = ("toolchain", "prog_language", "language", "audience", "architecture", "lifecycle", "test_level")


def evidence(fused: DataFrame, objects: DataFrame, lexical: DataFrame, vector: DataFrame | None = None, walked: DataFrame | None = None, relations: DataFrame | None = None,
             conflicts: DataFrame | None = None, most: int = 20, min_relevance: float = 0.0, body: bool = False) -> DataFrame:
    """A nested row for each of the best results of fused(query_id, id, score, matched_by), as an answer needs it.

    lexical(query_id, id, score) is normalised. vector(query_id, id, score, chunk_index, passage) and walked(query_id, id,
    score, depth) may be absent: then their scores are null. Where they are there, a result that they don't have scores 0;
    a query whose walk reached nothing but its seeds has no graph score either. Relations are those to other results of
    the query, and contradictions to anything. conflicts(id, other, kind) marks results; facets and fields that objects
    lack are null.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = fused.where(F.col("score") >= min_relevance).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    best = best.select("query_id", "id", "rank", F.col("score").alias("rrf"), F.split("matched_by", ",").alias("matched_by"))
    rows = best.join(lexical.select("query_id", "id", F.col("score").alias("_bm25")), ["query_id", "id"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    passage = "struct<chunk_index:int,passage_text:string>"
    if vector is None:
        rows = rows.withColumns({"_vector": none("double"), "passage_attribution": none(passage)})
    else:
        told = F.struct(F.col("chunk_index").cast("int").alias("chunk_index"), F.substring(F.coalesce("passage", F.lit("")), 1, 200).alias("passage_text"))
        hits = vector.select("query_id", "id", F.round("score", 6).alias("_vector"), told.alias("passage_attribution"))
        rows = rows.join(hits, ["query_id", "id"], "left").withColumn("_vector", F.coalesce("_vector", F.lit(0.0)))
    if walked is None:
        rows = rows.withColumn("_graph", none("double"))
    else:
        reached = walked.where("depth > 0").select("query_id").distinct().withColumn("_reached", F.lit(True))
        rows = rows.join(walked.select("query_id", "id", F.col("score").alias("_graph")), ["query_id", "id"], "left").join(reached, "query_id", "left")
        rows = rows.withColumn("_graph", F.when(F.col("_reached"), F.coalesce("_graph", F.lit(0.0))))
    if relations is None:
        rows = rows.withColumn("subgraph_relations", F.array().cast("array<struct<type:string,target:string>>"))
    else:
        near = best.select("query_id", F.col("id").alias("dst")).withColumn("_in", F.lit(True))
        told = best.select("query_id", F.col("id").alias("src")).join(relations, "src").join(near, ["query_id", "dst"], "left").where("_in or type = 'CONTRADICTS'")
        told = told.groupBy("query_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("type", F.col("dst").cast("string").alias("target")))).alias("subgraph_relations"))
        rows = rows.join(told, ["query_id", "id"], "left").withColumn("subgraph_relations", F.coalesce("subgraph_relations", F.array()))
    if conflicts is None:
        rows = rows.withColumn("conflict", none("struct<node_id:string,relation:string>"))
    else:
        one = conflicts.groupBy("id").agg(F.min(F.struct(F.col("other").cast("string").alias("node_id"), F.col("kind").alias("relation"))).alias("conflict"))
        rows = rows.join(one, "id", "left")
    has = lambda c, kind="string": F.col(c) if c in objects.columns else none(kind)
    text = has("raw_body")
    facts = objects.select(
        "id", *[has(c).alias(c) for c in ("title", "scope", "taxonomy_path", "taxonomy_id", "object_type", "domain", "status", "path")],
        F.struct(*[has(c).alias(c) for c in ("evidence", "verification", "authority", "consensus")]).alias("epistemology"), F.struct(*[has(c).alias(c) for c in FACETS]).alias("facets"), has("validity", "struct<valid_from:string,valid_until:string>").alias("validity"),
        F.struct(has("source_type").alias("source_type"), has("source_refs", "array<string>")[0].alias("source_ref"), has("confidence").alias("confidence"), has("last_verified").alias("last_verified")).alias("provenance"),
        body_excerpt(text).alias("body_excerpt"), scoring_window(text).alias("_window"), (text if body else none("string")).alias("body"))
    scores = F.struct(F.coalesce("_bm25", F.lit(0.0)).alias("bm25_raw"), F.col("_vector").alias("vector_raw"), F.col("_graph").alias("graph_raw"), F.col("rrf").alias("rrf_score"), F.col("rrf").alias("reranker_score"), F.col("rrf").alias("final"), F.col("_window").alias("scoring_window"))
    found = rows.join(facts, "id")
    return found.select("query_id", "rank", F.col("id").alias("node_id"), *[c for c in facts.columns if c not in ("id", "_window")], "matched_by", scores.alias("score_components"),
                        F.col("conflict").isNotNull().alias("conflict_detected"), "conflict", "subgraph_relations", "passage_attribution")


def vocabulary(objects: DataFrame) -> DataFrame:
    """term: what a query may be about, from ids, titles, keywords, aliases and taxonomy paths of objects."""
    lists = F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>")))
    text = F.concat_ws(" ", "title", F.array_join(lists, " "), F.regexp_replace(F.coalesce("taxonomy_path", F.lit("")), "/", " "))
    words = objects.select(F.explode(content_tokens(text)).alias("term")).where("length(term) > 2")
    return words.union(objects.select(F.lower("id"))).distinct()


def gates(queries: DataFrame, candidates: DataFrame, objects: DataFrame, terms: DataFrame, relations: DataFrame, depth: int = 2, enforce: bool = False) -> DataFrame:
    """query_id, grounding, path, terminal, retraction, reason, retrieval_status of each query of (query_id, query).

    candidates(query_id, id) are what survived retrieval; objects(id, status, body); relations(src, type, dst).
    A gate without anything to look at passes. Paths between mentioned objects (either way along relations) are
    looked for only where gates are enforced, and only then a gate refuses.
    """
    asked = queries.select("query_id", F.explode(F.filter(content_tokens(F.col("query")), lambda t: F.length(t) > 2)).alias("term"))
    ground = asked.join(terms.withColumn("_k", F.lit(1)), "term", "left").groupBy("query_id").agg((F.count("_k") > 0).alias("g"))
    found = candidates.join(objects.select("id", F.lower(F.coalesce("status", F.lit(""))).alias("s"), F.trim(F.coalesce("body", F.lit(""))).alias("b")), "id")
    gone = relations.where(F.col("type").isin("SUPERSEDED_BY", "INVALIDATED_BY")).select(F.col("src").alias("id")).distinct().withColumn("_x", F.lit(True))
    alive = ~F.col("s").isin("superseded", "retracted") & F.col("_x").isNull()
    ends = found.join(gone, "id", "left").groupBy("query_id").agg(F.max(F.col("b") != "").alias("t"), F.max(alive).alias("r"))
    rows = queries.select("query_id").join(ground, "query_id", "left").join(ends, "query_id", "left")
    if enforce:
        named = queries.select("query_id", F.explode(F.array_distinct(F.transform(tokenize_with_ids(F.col("query")), lambda x: F.upper(x)))).alias("id")).join(objects.select("id"), "id", "left_semi")
        pairs = named.join(named.select("query_id", F.col("id").alias("o")), "query_id").where("id < o").select("query_id", F.col("id").alias("source"), F.col("o").alias("target"))
        both = relations.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(relations.select("dst", "src")).distinct()
        linked = graph.has_path(both, pairs, depth).groupBy("query_id").agg(F.max("connected").alias("p"))
        rows = rows.join(linked, "query_id", "left")
    else:
        rows = rows.withColumn("p", F.lit(None).cast("boolean"))
    for name in "gptr":
        rows = rows.withColumn(name, F.coalesce(name, F.lit(True)))
    reason = F.when(~F.col("g"), "UNGROUNDED_DESCRIPTOR").when(~F.col("p"), "NO_ADMISSIBLE_PATH").when(~F.col("t"), "EMPTY_BODY_TERMINAL").when(~F.col("r"), "SUPERSEDED_EVIDENCE")
    status = F.when(F.lit(enforce) & reason.isNotNull(), "REFUSED").otherwise("ADMISSIBLE")
    return rows.select("query_id", F.col("g").alias("grounding"), F.col("p").alias("path"), F.col("t").alias("terminal"), F.col("r").alias("retraction"), reason.alias("reason"), status.alias("retrieval_status"))


def verified(claims: DataFrame, passages: DataFrame, least: float = 0.5, abstain: float = 0.65, tokens: int = 512) -> DataFrame:
    """claim_id, score, source_ref, decision: the best passage of each claim of (claim_id, claim, confidence).

    passages(claim_id, source_ref, text), cut to the budget. Of equal passages the first by source_ref counts, a
    claim without any scores 0; a confidence that is absent passes.
    """
    told = passages.join(claims.select("claim_id", "claim"), "claim_id")
    told = told.select("claim_id", "source_ref", entailment(F.col("claim"), passage_budget(F.col("text"), tokens)).alias("score")).where("score > 0")
    top = told.groupBy("claim_id").agg(F.max("score").alias("score"))
    best = told.join(top, ["claim_id", "score"]).groupBy("claim_id", "score").agg(F.min("source_ref").alias("source_ref"))
    rows = claims.join(best, "claim_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    fine = (F.col("score") >= least) & (F.coalesce("confidence", F.lit(1.0)) >= abstain)
    return rows.select("claim_id", "score", "source_ref", F.when(fine, "GROUNDED").otherwise("EPISTEMIC_ABSTENTION").alias("decision"))


def pre_scored(claims: DataFrame, spans: DataFrame, least: float = 0.70) -> DataFrame:
    """claim_id, score, spans, flag: PRE_SCORE_PASSED or _FAILED by the best span, _UNAVAILABLE without spans."""
    told = spans.join(claims.select("claim_id", "claim"), "claim_id").select("claim_id", entailment(F.col("claim"), F.col("text")).alias("s"))
    best = told.groupBy("claim_id").agg(F.max("s").alias("score"), F.count(F.lit(1)).alias("spans"))
    flag = F.when(F.col("spans").isNull(), "PRE_SCORE_UNAVAILABLE").when(F.col("score") < least, "PRE_SCORE_FAILED").otherwise("PRE_SCORE_PASSED")
    return claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", "score", F.coalesce("spans", F.lit(0)).alias("spans"), flag.alias("flag"))


def cited_spans(refs: DataFrame, captures: DataFrame, files: int = 5, chars: int = 200_000, hops: int = 3) -> DataFrame:
    """claim_id, path, text: the first files that refs(claim_id, ord, path) lead to among captures(path, text, location).

    A file that names another one's location leads on to it, behind the refs given; unknown paths are passed over.
    The cut to so many characters of a file is the feature.
    """
    known = captures.select("path", F.substring("text", 1, chars).alias("text"), "location")
    level = refs.select("claim_id", F.col("ord").cast("long").alias("ord"), "path")
    found = None
    for hop in range(hops):
        met = level.join(known, "path").withColumn("hop", F.lit(hop))
        found = met if found is None else found.union(met)
        level = met.where("location is not null").select("claim_id", "ord", F.col("location").alias("path"))
    first = found.groupBy("claim_id", "path").agg(F.min(F.struct("hop", "ord")).alias("o"), F.first("text").alias("text"))
    order = Window.partitionBy("claim_id").orderBy("o", "path")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= files).select("claim_id", "n", "path", "text")


def parameters(given: dict, config: dict, defaults: dict) -> dict[str, tuple]:
    """value and origin of each parameter: what is given goes before the configuration, that before the defaults."""
    out = {}
    for name, value in defaults.items():
        out[name] = (given[name], "given") if given.get(name) is not None else (config[name], "config") if config.get(name) is not None else (value, "default")
    return out


def stage_one(bundles: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, retrieval_status of every query: REFUSED where no result is left."""
    found = bundles.select("query_id").distinct().withColumn("_f", F.lit(True))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.when(F.col("_f"), "ADMISSIBLE").otherwise("REFUSED").alias("retrieval_status"))
