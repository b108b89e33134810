"""Queries over structure: cycles, impact, gaps, links to files, renames, registries and result bundles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import discovery, graph, hybrid, validate, vectors
from ..session import table
from .catalogue import BATCH, SCORED_SQL, _scores, query

#: Customers point at others of their half dozen, some also into the next: rounds, ways into them and from round to round.
LINKS_SQL = """e AS (SELECT c_custkey::BIGINT AS u, (c_custkey // 6 * 6 + (c_custkey * 5 + c_nationkey) % 6)::BIGINT AS v FROM customer UNION SELECT c_custkey, c_custkey + 6 FROM customer WHERE c_nationkey % 5 = 3 AND c_custkey % 24 < 18)"""


def _links(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    near = F.expr("k div 6 * 6 + (k * 5 + n) % 6")
    return c.select(F.col("k").alias("u"), near.alias("v")).union(c.where("n % 5 = 3 and k % 24 < 18").select("k", F.col("k") + 6)).distinct()


@query(f"""WITH RECURSIVE {LINKS_SQL}, r(root, node) AS (SELECT u, v FROM e UNION SELECT root, v FROM r JOIN e ON r.node = e.u)
    SELECT u, v FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.root = e.v AND r.node = e.u) OR u = v""")
def hierarchy_cycles(spark, sf):
    """Edges on cycles; those from one cycle to another are none."""
    return graph.cycles(_links(spark, sf))


IMPACT_SQL = """e AS (SELECT DISTINCT l_orderkey AS o, l_returnflag AS t, -1 - l_partkey AS p FROM lineitem),
    c1 AS (SELECT o AS root, p AS node, min(t) AS t FROM e WHERE o % 100 = 0 GROUP BY ALL),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY t, node) AS k FROM c1),
    s1 AS (SELECT root, k AS seq, node, 1 AS depth, root AS src, t AS type, node AS dst FROM o1 WHERE k + 1 <= 20),
    h1 AS (SELECT root, max(k) + 1 > 20 AS hit, least(max(k), 19) AS have FROM o1 GROUP BY 1),
    c2 AS (SELECT s1.root, seq, e.o AS node, e.t, e.p, row_number() OVER (PARTITION BY s1.root, e.o ORDER BY seq, e.t) AS n FROM s1 JOIN h1 USING (root) JOIN e ON e.p = s1.node WHERE NOT hit AND e.o <> s1.root),
    o2 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq, t, p, node) AS k FROM c2 WHERE n = 1),
    s2 AS (SELECT root, have + k AS seq, node, 2 AS depth, node AS src, t AS type, p AS dst FROM o2 JOIN h1 USING (root) WHERE have + k + 1 <= 20),
    h2 AS (SELECT root, max(have + k) + 1 > 20 AS hit, least(max(have + k), 19) AS have FROM o2 JOIN h1 USING (root) GROUP BY 1)"""


def _impact(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders whose id 100 divides, over the parts they share with others, by return flag."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("type"), (-1 - F.col("l_partkey")).alias("dst"))
    return graph.impact(lines, lines.where("src % 100 = 0").select(F.col("src").alias("root")), "both", 2, 20)


@query(f"WITH {IMPACT_SQL} SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)")
def blast_radius(spark, sf):
    return _impact(spark, sf)[0]


@query(f"""WITH {IMPACT_SQL}, a AS (SELECT root, coalesce(h2.have, h1.have) AS affected, CASE WHEN h1.hit THEN 0 WHEN h2.root IS NULL THEN 1 WHEN h2.hit THEN 1 ELSE 2 END AS depth_reached, h1.hit OR coalesce(h2.hit, false) AS ceiling_hit FROM h1 LEFT JOIN h2 USING (root))
    SELECT root, affected, depth_reached, ceiling_hit, 50 + 35 * affected AS tokens FROM a""")
def impact_reports(spark, sf):
    return _impact(spark, sf)[1]


@query("""WITH n AS (SELECT s_suppkey AS id, s_suppkey % 3 AS scope, s_nationkey AS community FROM supplier),
    inc AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
    w AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM inc x JOIN inc y ON x.o = y.o AND x.s < y.s GROUP BY ALL HAVING count(*) >= 3),
    v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings JOIN supplier ON vec_id = s_suppkey),
    c AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS cos FROM v x JOIN v y ON x.id < y.id AND x.id % 3 = y.id % 3 WHERE list_cosine_similarity(x.v, y.v) >= 0.3),
    linked AS (SELECT least(s_suppkey, s_suppkey * 7 % 50) AS a, greatest(s_suppkey, s_suppkey * 7 % 50) AS b FROM supplier),
    p AS (SELECT coalesce(w.a, c.a) AS a, coalesce(w.b, c.b) AS b, shared, cos FROM w FULL JOIN c ON w.a = c.a AND w.b = c.b),
    g AS (SELECT p.*, x.community = y.community AS community FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.scope = y.scope AND (a, b) NOT IN (SELECT (a, b) FROM linked))
    SELECT 'DISC-GAP-TOPO-' || a || '-' || b AS candidate_id, a, b, community, shared IS NOT NULL AS together, cos IS NOT NULL AS similar, coalesce(shared, 0) AS shared, round(cos, 4) AS confidence
    FROM g WHERE community::INTEGER + (shared IS NOT NULL)::INTEGER + (cos IS NOT NULL)::INTEGER >= 2""")
def gap_2_of_3(spark, sf):
    """Suppliers in three scopes, nations as communities, orders as chunks; noise for vectors, so a low cosine counts."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("scope"), F.col("s_nationkey").alias("community"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("concept"))
    own = table(spark, sf, "embeddings").join(suppliers.select(F.col("id").alias("vec_id"), "scope"), "vec_id")
    linked = suppliers.select(F.col("id").alias("src"), (F.col("id") * 7 % 50).alias("dst"))
    return discovery.topological_gaps(suppliers, graph.cooccurrence(lines, 3), vectors.similar_pairs(own, 0.3, "scope"), linked, near=0.3)


@query("""WITH f AS (SELECT 'src/p' || (CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN 'x' ELSE '%' END) || p_partkey || '.py' AS path FROM part UNION ALL SELECT 'p_' || p_partkey FROM part WHERE p_partkey < 5),
    r AS (SELECT c_custkey AS id, 'repo/src/p' || (CASE c_nationkey % 3 WHEN 0 THEN '_' WHEN 1 THEN 'x' ELSE '%' END) || c_custkey || '.py#' || c_nationkey AS ref FROM customer)
    SELECT DISTINCT 'bridge#' || id || '#f=' || path || '#represented_by' AS bridge_id, id::VARCHAR AS object_id, 'f=' || path AS node_id, 'represented_by' AS bridge_type, 'pending' AS status FROM r JOIN f ON contains(ref, path)""")
def file_bridges(spark, sf):
    """References to files whose names hold _ and %, and short names inside them."""
    sign = lambda c: F.when(F.col(c) % 3 == 0, "_").when(F.col(c) % 3 == 1, "x").otherwise("%")
    parts = table(spark, sf, "part").select("p_partkey")
    paths = parts.select(F.concat(F.lit("src/p"), sign("p_partkey"), "p_partkey", F.lit(".py")).alias("path")).union(parts.where("p_partkey < 5").select(F.concat(F.lit("p_"), "p_partkey")))
    nodes = paths.select(F.concat(F.lit("f="), "path").alias("node_id"), F.lit("FILE").alias("kind"), F.col("path").alias("name"), "path")
    refs = F.concat(F.lit("repo/src/p"), sign("c_nationkey"), "c_custkey", F.lit(".py#"), "c_nationkey")
    objects = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("").alias("body"), F.array(refs).alias("source_refs"))
    return discovery.code_bridges(objects, nodes)


@query(r"""SELECT CASE WHEN c_custkey = 7 THEN 'N$1\2' ELSE c_custkey::VARCHAR END AS id, CASE WHEN c_custkey % 2 = 0 THEN '[[N$1\2]] and [[N$1\2|label ' || c_custkey || ']]' ELSE 'not [[77]]' END AS body FROM customer""")
def renamed_bodies(spark, sf):
    """A new id that holds what a replacement would take for a group."""
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("[[7]] and [[ 7 | label "), "c_custkey", F.lit("]]"))).otherwise("not [[77]]")
    objects = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), body.alias("body"))
    relations = objects.select(F.col("id").alias("src"), F.lit("X").alias("type"), F.col("id").alias("dst"))
    return discovery.rename(objects, relations, "7", "N$1\\2")[0]


@query("""WITH RECURSIVE own AS (SELECT n_nationkey % 20 AS k, 'r' || n_regionkey AS owner FROM nation), thr AS (SELECT s_suppkey % 50 AS k, 'r' || (s_nationkey % 6) AS owner FROM supplier),
    paths AS (SELECT 'r' || r_regionkey AS path FROM region WHERE r_regionkey <> 4),
    src AS (SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['r' || (n_regionkey + 2)] ELSE ['r' || n_regionkey, 'c' || (n_nationkey % 6)] END AS tax FROM nation),
    stax AS (SELECT 'r' || r_regionkey AS root, ['c' || r_regionkey, 'c5'] AS children FROM region),
    rel AS (SELECT n_name AS name, 'T' || n_regionkey AS s, 'T' || (n_nationkey % 7) AS t, n_nationkey % 5 = 0 AS sym, CASE WHEN n_nationkey % 10 = 0 THEN n_name ELSE 'V' || (n_nationkey % 8) END AS iv FROM nation),
    obj AS (SELECT 'T' || r_regionkey AS name, unnest(['F' || r_regionkey, 'F9']) AS f FROM region), fac AS (SELECT 'F' || r_regionkey AS name, r_regionkey % 2 = 0 AS fine FROM region WHERE r_regionkey <> 3),
    tax AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 1000000 WHEN c_custkey % 7 <> 0 THEN c_custkey // 6 * 6 + (c_custkey * 5 + c_nationkey) % 6 END AS p, c_custkey % 9 = 0 AS scope FROM customer),
    reach(a, b) AS (SELECT k, p FROM tax WHERE p IS NOT NULL UNION SELECT a, p FROM reach JOIN tax ON b = k WHERE p IS NOT NULL),
    round AS (SELECT a AS k FROM reach WHERE a = b),
    entry AS (SELECT a, b FROM reach WHERE b IN (SELECT k FROM round)),
    walk(a, b) AS (SELECT k, k FROM tax UNION ALL SELECT a, p FROM walk JOIN tax ON b = k WHERE p IS NOT NULL AND b NOT IN (SELECT k FROM round))
    SELECT 'E080' AS code, 'spec_ownership' AS registry, 'invariant_families.' || k AS field FROM (SELECT k, row_number() OVER (PARTITION BY k) AS n FROM own) WHERE n > 1
    UNION ALL SELECT 'E082', 'threshold_policy', 'thresholds.' || k FROM (SELECT k, row_number() OVER (PARTITION BY k) AS n FROM thr) WHERE n > 1
    UNION ALL SELECT 'E081', 'spec_ownership', 'invariant_families.' || k || '.owner' FROM own WHERE owner NOT IN (SELECT path FROM paths)
    UNION ALL SELECT 'E083', 'threshold_policy', 'thresholds.' || k || '.owner' FROM thr WHERE owner NOT IN (SELECT path FROM paths)
    UNION ALL SELECT 'E084', 'source_registry', 'source_types.' || name || '.source_taxonomy' FROM src WHERE len(tax) = 0
    UNION ALL SELECT 'E085', 'source_registry', 'source_types.' || name || '.source_taxonomy' FROM src WHERE len(tax) > 0 AND tax[1] NOT IN (SELECT root FROM stax)
    UNION ALL SELECT 'E086', 'source_registry', 'source_types.' || name || '.source_taxonomy' FROM src JOIN stax ON root = tax[1] WHERE len(tax) > 1 AND NOT list_contains(children, tax[2])
    UNION ALL SELECT 'E023', 'relation_registry', 'relations.' || name || '.source_types' FROM rel WHERE s NOT IN (SELECT name FROM obj)
    UNION ALL SELECT 'E023', 'relation_registry', 'relations.' || name || '.target_types' FROM rel WHERE t NOT IN (SELECT name FROM obj)
    UNION ALL SELECT 'E025', 'relation_registry', 'relations.' || name || '.inverse_view' FROM rel WHERE sym AND iv <> name
    UNION ALL SELECT 'E025', 'relation_registry', 'relations.' || name || '.inverse_view' FROM (SELECT *, row_number() OVER (PARTITION BY iv ORDER BY name) AS n FROM rel WHERE NOT sym) WHERE n > 1
    UNION ALL SELECT 'E020', 'object_registry', 'object_types.' || name || '.required_facets' FROM obj WHERE f NOT IN (SELECT name FROM fac)
    UNION ALL SELECT 'E018', 'taxonomy_registry', 'taxonomy.' || k || '.parent_id' FROM tax WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM tax)
    UNION ALL SELECT 'E018', 'taxonomy_registry', 'taxonomy.' || x.k || '.parent_id' FROM tax x JOIN tax y ON x.p = y.k WHERE x.scope <> y.scope
    UNION ALL SELECT 'E024', 'taxonomy_registry', 'taxonomy.' || b FROM walk WHERE b IN (SELECT k FROM round)
    UNION ALL SELECT 'E026', 'facet_registry', 'facets.' || name FROM fac WHERE NOT fine""")
def lint_registry(spark, sf):
    """Nations, regions, suppliers and customers as registries with every fault that the rules know."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    region, k = F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey")
    customers = table(spark, sf, "customer")
    path = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.concat(F.lit("r"), F.col("n_regionkey") + 2))).otherwise(F.array(region, F.concat(F.lit("c"), k % 6)))
    view = F.when(k % 10 == 0, F.col("n_name")).otherwise(F.concat(F.lit("V"), k % 8))
    parent = F.expr("case when c_custkey % 50 = 1 then c_custkey + 1000000 when c_custkey % 7 <> 0 then c_custkey div 6 * 6 + (c_custkey * 5 + c_nationkey) % 6 end")
    return validate.registry_rules({
        "spec_ownership": n.select((k % 20).alias("family_id"), region.alias("owner")),
        "threshold_policy": table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("threshold_id"), F.concat(F.lit("r"), F.col("s_nationkey") % 6).alias("owner")),
        "paths": r.where("r_regionkey <> 4").select(F.concat(F.lit("r"), "r_regionkey").alias("path")),
        "source_registry": n.select(F.col("n_name").alias("name"), path.alias("source_taxonomy")),
        "source_taxonomy": r.select(F.concat(F.lit("r"), "r_regionkey").alias("root"), F.array(F.concat(F.lit("c"), "r_regionkey"), F.lit("c5")).alias("children")),
        "relation_registry": n.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("T"), "n_regionkey")).alias("source_types"), F.array(F.concat(F.lit("T"), k % 7)).alias("target_types"), (k % 5 == 0).alias("symmetric"), view.alias("inverse_view")),
        "object_registry": r.select(F.concat(F.lit("T"), "r_regionkey").alias("name"), F.array(F.concat(F.lit("F"), "r_regionkey"), F.lit("F9")).alias("required_facets")),
        "facet_registry": r.where("r_regionkey <> 3").select(F.concat(F.lit("F"), "r_regionkey").alias("name"), F.array(F.lit("none"), F.lit("x")).alias("values"), (F.col("r_regionkey") % 2 == 0).alias("allows_none")),
        "taxonomy_registry": customers.select(F.col("c_custkey").alias("taxonomy_id"), parent.alias("parent_id"), (F.col("c_custkey") % 9 == 0).alias("scope")),
    })


@query(f"""WITH {SCORED_SQL}, f AS (SELECT query_id, doc_id AS id, round(score, 9) AS score, max(round(score, 9)) OVER (PARTITION BY query_id) AS top FROM scored),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 15),
    v AS (SELECT q.query_id, doc_id AS id, (n_chars % 100) / 100 AS score, doc_id % 3 AS chunk, substr(text, 1, 200) AS passage FROM documents, (VALUES (1), (2)) q(query_id) WHERE n_chars > 2000),
    w AS (SELECT 1 AS query_id, doc_id AS id, doc_id % 3 AS depth FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 3, doc_id, 0 FROM documents WHERE doc_id % 12 = 0),
    r AS (SELECT doc_id AS src, 'NEXT' AS type, doc_id + 1 AS dst FROM documents UNION ALL SELECT doc_id, 'CONTRADICTS', doc_id * 2 FROM documents WHERE doc_id % 5 = 0),
    near AS (SELECT b.query_id, b.id, string_agg(DISTINCT type || ':' || dst, ',' ORDER BY type || ':' || dst) AS relations FROM b JOIN r ON src = b.id WHERE type = 'CONTRADICTS' OR EXISTS (SELECT 1 FROM b x WHERE x.query_id = b.query_id AND x.id = dst) GROUP BY ALL)
    SELECT b.query_id, rank::INTEGER AS rank, b.id AS node_id, source AS title, round(b.score / top, 6) AS bm25_raw, CASE WHEN v.id IS NULL THEN 0 ELSE round(v.score, 6) END AS vector_raw,
        CASE WHEN b.query_id = 1 THEN coalesce(1 / (1 + w.depth), 0) END AS graph_raw, b.id % 10 = 0 AS conflict_detected, CASE WHEN b.id % 10 = 0 THEN (b.id * 2)::VARCHAR END AS conflicting, coalesce(relations, '') AS relations, v.chunk::INTEGER AS chunk_index, v.passage AS passage_text,
        lang AS scope, NULL::VARCHAR AS toolchain
    FROM b JOIN documents d ON d.doc_id = b.id LEFT JOIN v ON v.query_id = b.query_id AND v.id = b.id LEFT JOIN w ON w.query_id = b.query_id AND w.id = b.id LEFT JOIN near ON near.query_id = b.query_id AND near.id = b.id""")
def evidence_bundles(spark, sf):
    """Result bundles for the batch: long documents as vector hits, a walk that leaves its seeds for the first query only."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    found = _scores(spark, sf).select("query_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    top = found.groupBy("query_id").agg(F.max("score").alias("top"))
    normal = found.join(top, "query_id").select("query_id", "id", F.round(F.col("score") / F.col("top"), 6).alias("score"))
    asked = F.explode(F.array(*[F.lit(i) for i, _ in BATCH[:2]]))
    vector = docs.where("n_chars > 2000").select(asked.alias("query_id"), "id", (F.col("n_chars") % 100 / 100).alias("score"), (F.col("id") % 3).alias("chunk_index"), F.col("text").alias("passage"))
    walk = lambda n, every, depth: docs.where(F.col("id") % every == 0).select(F.lit(n).alias("query_id"), "id", (1 / (1 + depth)).alias("score"), depth.alias("depth"))
    walked = walk(1, 4, F.col("id") % 3).union(walk(3, 12, F.lit(0).cast("long")))
    relations = docs.select(F.col("id").alias("src"), F.lit("NEXT").alias("type"), (F.col("id") + 1).alias("dst")).union(docs.where("id % 5 = 0").select("id", F.lit("CONTRADICTS"), F.col("id") * 2))
    conflicts = docs.where("id % 10 = 0").select("id", (F.col("id") * 2).alias("other"), F.lit("CONTRADICTS").alias("kind"))
    objects = docs.select("id", F.col("source").alias("title"), F.col("lang").alias("scope"), F.col("text").alias("raw_body"))
    rows = hybrid.evidence(found.withColumn("matched_by", F.lit("bm25")), objects, normal, vector, walked, relations, conflicts, most=15)
    told = F.array_join(F.array_sort(F.transform("subgraph_relations", lambda r: F.concat_ws(":", r["type"], r["target"]))), ",")
    return rows.select("query_id", "rank", "node_id", "title", "score_components.bm25_raw", "score_components.vector_raw", "score_components.graph_raw", "conflict_detected", F.col("conflict.node_id").alias("conflicting"), told.alias("relations"),
                       "passage_attribution.chunk_index", "passage_attribution.passage_text", "scope", "facets.toolchain")
