"""Every query of the engine by name, with the SQL that says the same.

Each entry binds an operator to the standard tables. SQL is for DuckDB over views of the same names; queries whose
semantics SQL can't express (or only by restating an algorithm) have none and are held against plain Python in
the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import calibrate, fusion, graph, hybrid, lexical, staging, vectors
from ..session import keep, parts_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# --- text and lexical retrieval ---

#: A batch of text queries in the documents' own words.
BATCH = [(1, "anat du aux"), (2, "the edonre erdonon the"), (3, "mente de la que"), (4, "und der erlich")]
BATCH_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in BATCH) + ") q(query_id, query)"
#: The tokenizer in SQL: runs of letters, digits and _, those of ASCII only, in lower case.
TOKENS_SQL = r"list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '([\p{{L}}\p{{N}}_]+)', 1), lambda x: regexp_full_match(x, '[A-Za-z0-9_]+')), lambda x: lower(x))"
SCORED_SQL = f"""
    tok AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS ts FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
    post AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    terms AS (SELECT query_id, unnest({TOKENS_SQL.format("query")}) AS term FROM {BATCH_SQL}),
    scored AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM terms JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf).select("doc_id", "text"), spark.createDataFrame(BATCH, "query_id int, query string"))


@query(f"""WITH {SCORED_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
    SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10""")
def bm25_topk(spark, sf):
    scores = _scores(spark, sf).withColumn("score", F.round("score", 9))
    return lexical.top_k(scores, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_tokens, round(avg(len(ts)), 6) AS avgdl FROM (SELECT {TOKENS_SQL.format('text')} AS ts FROM documents)")
def bm25_stats(spark, sf):
    return lexical.corpus_stats(_docs(spark, sf))


@query(f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents)
    GROUP BY term ORDER BY df DESC, term LIMIT 50""")
def token_df_topk(spark, sf):
    return lexical.document_frequency(_docs(spark, sf)).orderBy(F.desc("df"), "term").limit(50)


@query(f"""WITH {SCORED_SQL}
    SELECT query_id, doc_id, CASE WHEN max(round(score, 9)) OVER (PARTITION BY query_id) > 0 THEN round(round(score, 9) / max(round(score, 9)) OVER (PARTITION BY query_id), 6) ELSE 0 END AS norm FROM scored""")
def bm25_normalized(spark, sf):
    scores = _scores(spark, sf).withColumn("score", F.round("score", 9))
    return lexical.normalized(scores).select("query_id", "doc_id", "norm")


@query(r"""SELECT doc_id, i::INTEGER AS chunk, substr(t, i * 450 + 1, 500) AS text FROM (
    SELECT doc_id, t, unnest(range(greatest(ceil((length(t) - 500) / 450.0), 0)::BIGINT + 1)) AS i
    FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents))""")
def chunk_windows(spark, sf):
    plain = _docs(spark, sf).select("doc_id", X.normalize_plain(F.col("text")).alias("t"))
    return plain.select("doc_id", F.posexplode(X.chunk_windows(F.col("t"))).alias("chunk", "text"))


@query(f"""WITH b AS (SELECT item_id, list_distinct(list_filter({TOKENS_SQL.format('text')}, lambda x: x NOT IN ({", ".join(repr(w) for w in X.STOPWORDS)}))) AS c FROM benchmark),
    d AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)
    SELECT item_id, doc_id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, list_distinct(t))) / len(c) ELSE 0 END, 6) AS covered
    FROM b, d WHERE len(list_intersect(c, list_distinct(t))) >= 0.5 * len(c)""")
def entailment(spark, sf):
    """Claims of benchmark against all documents: one that covers half of a claim shares a word with it."""
    claims = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim"), X.content_tokens(F.col("text")).alias("c"))
    passages = _docs(spark, sf).select("doc_id", F.array_distinct(X.tokenize(F.col("text"))).alias("t"))
    hits = claims.select("item_id", F.size("c").alias("n"), F.explode("c").alias("w")).join(passages.select("doc_id", F.explode("t").alias("w")), "w")
    covered = hits.groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("k"))
    return covered.where("k * 2 >= n").select("item_id", "doc_id", F.round(F.col("k") / F.col("n"), 6).alias("covered"))


@query(r"""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link FROM pages)""")
def link_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(X.hrefs(F.col("html")))).alias("link"))


@query("SELECT page_id, n FROM (SELECT page_id, " + " + ".join(f"regexp_matches(html, '{p.replace(chr(39), chr(39) * 2)}')::INTEGER" for p in X.INJECTION_PATTERNS) + " AS n FROM pages) WHERE n > 0")
def injection_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(X.injection_indicators(F.col("html"))).alias("n")).where("n > 0")


@query(r"""SELECT doc_id, CASE WHEN length(line) > 250 THEN rtrim(substr(line, 1, 250)) || '...' ELSE line END AS excerpt FROM (
    SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '') AS line FROM documents)""")
def body_excerpt(spark, sf):
    return _docs(spark, sf).select("doc_id", X.body_excerpt(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN length(text) > 2048 THEN rtrim(substr(text, 1, 2048)) || chr(10) || chr(10) || '[...]' ELSE text END AS passage FROM documents")
def passage_budget(spark, sf):
    return _docs(spark, sf).select("doc_id", X.passage_budget(F.col("text")).alias("passage"))


@query()
def hash_embed(spark, sf):
    embed = vectors.embedder(64)
    return _docs(spark, sf).select("doc_id", F.transform(embed(F.col("text")), lambda x: F.round(x, 6)).alias("vector"))


@query()
def md_sections(spark, sf):
    page = F.concat(F.lit("---\nid: x\n---\n# Page\n\n"), F.regexp_replace("text", r"\n", "\n\n## Part\n\n"))
    chunks = _docs(spark, sf).select("doc_id", F.explode(X.markdown_chunks(page)).alias("c"))
    return chunks.select("doc_id", "c.chunk_index", "c.word_count", "c.header")


# --- vectors ---


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(greatest(0, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qv::DOUBLE[], qv::DOUBLE[]))), 9) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf):
    rows = _vectors(spark, sf)
    batch = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.cosine_top_k(rows, batch, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
    s AS (SELECT label, vec_id, round(greatest(0, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qv::DOUBLE[], qv::DOUBLE[]))), 9) AS score FROM embeddings, q)
    SELECT label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s WHERE score > 0) WHERE n = 1""")
def max_over_groups_vector(spark, sf):
    rows = _vectors(spark, sf)
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("qv"))
    scored = rows.join(F.broadcast(one)).select("label", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("qv")), 9).alias("score"))
    return vectors.best_passage(scored, "label", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
    SELECT label, i::INTEGER AS i, round(x, 6) AS x FROM f""")
def mean_pool_vector(spark, sf):
    pooled = vectors.mean_pool(_vectors(spark, sf), "label")
    return pooled.select("label", F.posexplode("pooled").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings)
    SELECT a.label::BIGINT AS label, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (a.s * b.s), 6) AS similarity
    FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.3""")
def duplicate_pairs_cos(spark, sf):
    found = vectors.similar_pairs(_vectors(spark, sf), 0.3, "label")
    return found.select(F.col("g").alias("label"), "a", "b", F.round("similarity", 6).alias("similarity"))


# --- fusion, gates, evaluation ---


@query(f"""WITH {SCORED_SQL},
    a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored),
    l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS r FROM documents, {BATCH_SQL} WHERE n_chars > 4000),
    f AS (SELECT coalesce(a.query_id, l.query_id) AS query_id, coalesce(a.doc_id, l.doc_id) AS doc_id, coalesce(round(0.4 / (60 + a.r), 7), 0) + coalesce(round(0.2 / (60 + l.r), 7), 0) AS s,
        CASE WHEN a.r IS NOT NULL AND l.r IS NOT NULL THEN 'bm25,graph' WHEN a.r IS NOT NULL THEN 'bm25' ELSE 'graph' END AS matched_by
        FROM a FULL OUTER JOIN l ON a.query_id = l.query_id AND a.doc_id = l.doc_id)
    SELECT query_id, doc_id, round(s, 7) AS score, matched_by, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 7) DESC, doc_id) AS rank FROM f) WHERE rank <= 20""")
def rrf_fusion(spark, sf):
    lexical_scores = _scores(spark, sf).withColumn("score", F.round("score", 9))
    batch = spark.createDataFrame([(i,) for i, _ in BATCH], "query_id int")
    long_docs = _docs(spark, sf).where("n_chars > 4000").select("doc_id", F.col("n_chars").alias("score")).join(F.broadcast(batch))
    fused = fusion.rrf({"bm25": lexical_scores, "graph": long_docs}, {"bm25": 0.4, "graph": 0.2}, "doc_id")
    return lexical.top_k(fused, 20).select("query_id", "doc_id", "score", "matched_by", "rank")


@query("""WITH hit AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY 0 ORDER BY n DESC, item_id) AS rank FROM (SELECT item_id, count(*) AS n FROM hit GROUP BY 1))
    SELECT count(*) AS n, round(avg((coalesce(rank, 999) <= 1)::INTEGER), 6) AS recall_1, round(avg((coalesce(rank, 999) <= 5)::INTEGER), 6) AS recall_5, round(avg((coalesce(rank, 999) <= 10)::INTEGER), 6) AS recall_10
    FROM benchmark LEFT JOIN r USING (item_id)""")
def recall_at_k(spark, sf):
    """Items by how many documents hold them whole; the stated item set is broadcast."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim"))
    hits = _docs(spark, sf).select("doc_id", "text").join(F.broadcast(items), F.contains(F.col("text"), F.col("claim"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    ranks = hits.orderBy(F.desc("n"), "item_id").limit(10)
    from pyspark.sql import Window

    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "item_id")))
    return fusion.recall(items.join(ranks.select("item_id", "rank"), "item_id", "left"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1996-01-01' AND (o_orderstatus <> 'F' OR o_orderdate::DATE <= DATE '1997-06-30')")
def validity_filter(spark, sf):
    """Orders as objects valid from 1996, closed ones until mid-1997; each order's own date is the moment asked for."""
    rows = table(spark, sf, "orders")
    end = F.when(F.col("o_orderstatus") == "F", F.lit("1997-06-30"))
    return rows.where(fusion.valid_at(F.lit("1996-01-01"), end, F.date_format("o_orderdate", "yyyy-MM-dd"))).select("o_orderkey")


@query("SELECT p_partkey, (p_type = 'ECONOMY' OR p_size > 40) AS matches_any, (p_type = 'ECONOMY' AND p_size > 40) AS matches_all FROM part")
def facet_filter_any_all(spark, sf):
    conditions = [F.arrays_overlap(F.array("p_type"), F.array(F.lit("ECONOMY"))), F.col("p_size") > 40]
    return table(spark, sf, "part").select("p_partkey", fusion.facets(conditions, "any").alias("matches_any"), fusion.facets(conditions, "all").alias("matches_all"))


@query("SELECT doc_id, CASE WHEN quality >= 0.5 AND (1 - toxic * 0.5) >= 0.65 THEN 'ADMISSIBLE' ELSE 'REFUSED' END AS decision FROM labels")
def refusal_gates(spark, sf):
    rows = table(spark, sf, "labels")
    return fusion.refusal(rows, F.col("quality").cast("double"), 1 - F.col("toxic") * 0.5).select("doc_id", "decision")


@query("""WITH p AS (SELECT 'P' || p_partkey AS id, first_value('P' || p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey % 3 DESC, length('P' || p_partkey), 'P' || p_partkey) AS winner FROM part)
    SELECT id, CASE WHEN winner <> id THEN winner END AS suppressed_by FROM p""")
def conflict_cluster(spark, sf):
    """Parts of a brand and size contradict each other; the epistemic terms follow from their attributes."""
    part = table(spark, sf, "part")
    terms = {"verification": ["unverified", "self_verified", "peer_verified"], "authority": ["advisory", "informative", "normative"], "consensus": ["contested", "proposed", "accepted"], "evidence": ["inferred", "derived", "observed"]}
    rows = part.select(F.format_string("P%d", "p_partkey").alias("id"), *[F.get(F.array(*map(F.lit, v)), F.col("p_partkey").cast("int") % 3).alias(k) for k, v in terms.items()], (F.col("p_size") / 50).alias("confidence"), F.lit(None).cast("string").alias("last_verified"))
    groups = part.select("p_brand", "p_size", F.format_string("P%d", "p_partkey").alias("id"))
    return fusion.resolve_conflicts(rows, fusion.contradictions(groups, ["p_brand", "p_size"])).select("id", "suppressed_by")


# --- graphs ---


def _incidence(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as articles, parts as concepts, once for each line."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_custkey").alias("article"), F.col("l_partkey").alias("concept"))


INCIDENCE_SQL = "inc AS (SELECT o_custkey AS article, l_partkey AS concept FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers -> nations -> regions and suppliers -> nations, numbered apart."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 1_000_000).alias("u"), (F.col("c_nationkey") + 1000).cast("long").alias("v"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 2_000_000).alias("u"), (F.col("s_nationkey") + 1000).cast("long").alias("v"))
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("u"), F.col("n_regionkey").cast("long").alias("v"))
    return c.union(s).union(n)


EDGES_SQL = "e AS (SELECT c_custkey + 1000000 AS u, c_nationkey::BIGINT + 1000 AS v FROM customer UNION ALL SELECT s_suppkey + 2000000, s_nationkey::BIGINT + 1000 FROM supplier UNION ALL SELECT n_nationkey::BIGINT + 1000, n_regionkey::BIGINT FROM nation)"


@query("""SELECT l_partkey, l_suppkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS rank
    FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rank <= 5""")
def neighbor_cap(spark, sf):
    edges = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return graph.neighbour_cap(edges, 5, "l_partkey", [F.desc("n"), F.col("l_suppkey")]).select("l_partkey", "l_suppkey", "rank")


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS u, -1 - l_partkey AS v FROM lineitem), b AS (SELECT u, v FROM d UNION SELECT v, u FROM d)
    SELECT b.u AS node, coalesce(any_value(o.n), 0) AS out_degree, coalesce(any_value(i.n), 0) AS in_degree, count(*) AS total_degree FROM b
    LEFT JOIN (SELECT u, count(*) AS n FROM d GROUP BY 1) o ON o.u = b.u LEFT JOIN (SELECT v, count(*) AS n FROM d GROUP BY 1) i ON i.v = b.u GROUP BY b.u""")
def edge_degrees(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("u"), (-1 - F.col("l_partkey")).alias("v"))
    return graph.degrees(edges)


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem)")
def dense_ids(spark, sf):
    return graph.dense_ids(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct())


@query("""WITH e AS (SELECT 'O' || l_orderkey AS u, 'P' || l_partkey AS v FROM lineitem), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT u AS id FROM e UNION SELECT v FROM e)),
    d AS (SELECT n.idx, n.id AS node, count(e.u) AS degree FROM n LEFT JOIN e ON e.u = n.id GROUP BY ALL)
    SELECT idx, node, degree, (sum(degree) OVER (ORDER BY idx) - degree)::BIGINT AS start FROM d""")
def csr_indptr(spark, sf):
    """The order-part graph by string ids, a line an edge."""
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("u"), F.concat(F.lit("P"), "l_partkey").alias("v"))
    return graph.adjacency(lines)


@query(f"""WITH {INCIDENCE_SQL},
    a AS (SELECT concept, count(*) AS co_a FROM inc JOIN (SELECT article FROM inc WHERE concept = 1) USING (article) WHERE concept NOT IN (1, 2) GROUP BY 1),
    c AS (SELECT concept, count(*) AS co_c FROM inc JOIN (SELECT article FROM inc WHERE concept = 2) USING (article) WHERE concept NOT IN (1, 2) GROUP BY 1),
    d AS (SELECT concept, count(*) AS degree FROM inc GROUP BY 1)
    SELECT concept, co_a, co_c, degree, round(co_a * co_c / sqrt(degree), 6) AS score FROM a JOIN c USING (concept) JOIN d USING (concept) ORDER BY co_a * co_c / sqrt(degree) DESC, concept DESC LIMIT 15""")
def abc_bridges(spark, sf):
    return graph.bridges(_incidence(spark, sf), 1, 2, 15)


@query(f"""WITH {INCIDENCE_SQL}, m AS (SELECT article, max((concept = 1)::INTEGER) AS a, max((concept = 2)::INTEGER) AS c FROM inc WHERE concept IN (1, 2) GROUP BY 1)
    SELECT coalesce(sum(a), 0)::BIGINT AS n_a, coalesce(sum(c), 0)::BIGINT AS n_c, coalesce(sum(a * c), 0)::BIGINT AS n_both FROM m""")
def abc_overlap(spark, sf):
    return graph.overlap(_incidence(spark, sf), 1, 2)


@query("""WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS u, -1 - l_partkey AS v FROM lineitem), e AS (SELECT u, v FROM d UNION ALL SELECT v, u FROM d), r(root, node, depth) AS (SELECT u, u, 0 FROM (SELECT DISTINCT u FROM e WHERE u >= 0 AND u % 100 = 0) UNION SELECT root, v, depth + 1 FROM r JOIN e ON r.node = e.u WHERE depth < 2)
    SELECT root, node, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""")
def bfs_depth(spark, sf):
    """Orders whose id 100 divides, over the parts they share with others."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("u"), (-1 - F.col("l_partkey")).alias("v"))
    lines = keep(lines.repartition(parts_of(lines.count()), "u", "v").distinct())
    seeds = lines.where("u % 100 = 0").select(F.col("u").alias("root")).distinct()
    return graph.bfs(lines.union(lines.select("v", "u")), seeds, 2)


@query(f"""WITH RECURSIVE {EDGES_SQL}, r(root, node, depth) AS (SELECT u, u, 0 FROM (SELECT DISTINCT u FROM e WHERE u >= 2000000) UNION SELECT root, v, depth + 1 FROM r JOIN e ON r.node = e.u WHERE depth < 3)
    SELECT root, node, min(depth)::INTEGER AS depth FROM r WHERE node <> root GROUP BY ALL""")
def bounded_distances(spark, sf):
    edges = _edges(spark, sf)
    return graph.bounded_distances(edges, edges.where("u >= 2000000").select(F.col("u").alias("root")).distinct())


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(root, node) AS (SELECT v, v FROM e WHERE v < 1000 UNION SELECT root, b.v FROM r JOIN b ON r.node = b.u)
    SELECT node, min(root) AS component FROM r GROUP BY node""")
def components(spark, sf):
    return graph.components(_edges(spark, sf))


@query(f"""WITH {EDGES_SQL}, p AS (SELECT c_custkey + 1000000 AS source, (c_custkey % 5)::BIGINT AS target FROM customer)
    SELECT source, target, EXISTS (SELECT 1 FROM e a JOIN e b ON a.v = b.u WHERE a.u = source AND b.v = target) AS connected FROM p""")
def has_path(spark, sf):
    pairs = table(spark, sf, "customer").select((F.col("c_custkey") + 1_000_000).alias("source"), (F.col("c_custkey") % 5).alias("target"))
    return graph.has_path(_edges(spark, sf), pairs)


@query(f"""WITH inc AS (SELECT DISTINCT l_orderkey AS article, l_partkey AS concept FROM lineitem)
    SELECT x.concept AS a, y.concept AS b, count(*) AS shared FROM inc x JOIN inc y ON x.article = y.article AND x.concept < y.concept GROUP BY ALL HAVING count(*) >= 2""")
def cooccurrence_pairs(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("concept"))
    return graph.cooccurrence(lines, 2)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts with what links them: brand and type, shared suppliers, shared orders."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    traits = part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    orders, refs = line.select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("concept")), line.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("ref"))
    found = graph.pairs_with_refs(orders, refs, traits)
    return found.select("a", "b", F.col("shared").alias("shared_chunks"), "shared_refs", F.col("same_brand").cast("int").alias("canonical"), F.when(F.col("same_type"), 0.8).otherwise(0.1).alias("similarity"))


PAIRS_SQL = """inc AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), sup AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
    k AS (SELECT x.p AS a, y.p AS b, count(*) AS shared_chunks FROM inc x JOIN inc y ON x.o = y.o AND x.p < y.p GROUP BY ALL),
    r AS (SELECT k.a, k.b, count(*) AS shared_refs FROM k JOIN sup x ON x.p = k.a JOIN sup y ON y.p = k.b AND y.s = x.s GROUP BY ALL),
    pairs AS (SELECT k.a, k.b, shared_chunks, coalesce(shared_refs, 0) AS shared_refs, (pa.p_brand = pb.p_brand)::INTEGER AS canonical, CASE WHEN pa.p_type = pb.p_type THEN 0.8 ELSE 0.1 END AS similarity
        FROM k LEFT JOIN r USING (a, b) JOIN part pa ON pa.p_partkey = k.a JOIN part pb ON pb.p_partkey = k.b)"""


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT a, b, 0.5 * canonical + 0.2 * CASE WHEN similarity >= 0.75 THEN similarity ELSE 0 END + 0.15 * least(1, shared_refs / 5) + 0.15 * CASE WHEN shared_chunks >= 2 THEN least(1, shared_chunks / 10) ELSE 0 END AS score FROM pairs)
    SELECT a, b, round(score::DOUBLE, 6) AS score FROM s WHERE round(score::DOUBLE, 9) >= 0.15""")
def derived_edge_score(spark, sf):
    return graph.derived_edges(_pairs(spark, sf), 0.15 - 5e-10).select("a", "b", F.round("score", 6).alias("score"))


@query("""SELECT user_id, count(*) AS errors FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts) GROUP BY 1""")
def unresolved_events(spark, sf):
    """Incidents that nothing later settles: a user's errors after the last purchase."""
    events = table(spark, sf, "events")
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    open_ = events.where("event_type = 'error'").join(last, "user_id", "left").where("last is null or ts >= last")
    return open_.groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))


@query()
def cycle_edges(spark, sf):
    """Part follows part in an order's lines, from each line number to the next one there; what lies on cycles stays."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("after")
    steps = lines.select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", "l_linenumber", after).where("after is not null")
    first = lines.withColumnRenamed("l_partkey", "u").join(steps, ["l_orderkey", "l_linenumber"])
    second = lines.select("l_orderkey", F.col("l_linenumber").alias("after"), F.col("l_partkey").alias("v"))
    pairs = first.join(second, ["l_orderkey", "after"])
    return graph.cycles(pairs.where("u <> v").select("u", "v"))


# --- validation, staging, lifecycle ---


@query("""SELECT 'order' AS field, l_orderkey AS target, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
    UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) GROUP BY 2
    UNION ALL SELECT 'supplier', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 2""")
def broken_refs(spark, sf):
    """References without target; every seventh part is taken away to have some."""
    lines = table(spark, sf, "lineitem")
    sides = {"order": ("l_orderkey", table(spark, sf, "orders").select("o_orderkey")), "part": ("l_partkey", table(spark, sf, "part").where("p_partkey % 7 <> 0").select("p_partkey")), "supplier": ("l_suppkey", table(spark, sf, "supplier").select("s_suppkey"))}
    out = None
    for field, (column, targets) in sides.items():
        counts = lines.groupBy(F.col(column).alias("target")).agg(F.count(F.lit(1)).alias("n"))
        bad = counts.join(targets, F.col("target") == F.col(targets.columns[0]), "left_anti").select(F.lit(field).alias("field"), "target", "n")
        out = bad if out is None else out.union(bad)
    return out


@query("""SELECT doc_id, nth::INTEGER AS nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1""")
def dup_keys(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    return staging.duplicates(rows, ["h"], ["doc_id"]).select("doc_id", "nth")


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderdate) AS oldest FROM orders GROUP BY 1")
def status_transition_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("oldest"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' AND ts <= TIMESTAMP '2024-01-31' - INTERVAL 24 DAY THEN 'purge' WHEN event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY THEN 'expire' ELSE 'keep' END AS outcome FROM events""")
def ttl_expiry(spark, sf):
    """Events as proposals: signups have expired, the others are pending."""
    rows = table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "signup", "expired").otherwise("pending"))
    return staging.ttl(rows, "2024-01-31", 14, 10, "ts").select("event_id", "outcome")


@query("""WITH s AS (SELECT *, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
    r AS (SELECT event_id, user_id, event_type, list(event_type) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS recent FROM s WHERE event_type <> 'signup')
    SELECT event_id, user_id, len(list_filter(recent, lambda x: x = event_type))::INTEGER AS repeats FROM r WHERE len(list_filter(recent, lambda x: x = event_type)) >= 5""")
def ring_guard(spark, sf):
    rows = staging.ring_guard(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "signup")
    return rows.select("event_id", "user_id", "repeats")


@query("""WITH stored AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
    incoming AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents)
    SELECT doc_id, CASE WHEN s.h IS NULL THEN 'insert' WHEN s.h = i.h THEN 'noop' ELSE 'conflict' END AS outcome FROM incoming i LEFT JOIN stored s USING (doc_id)""")
def upsert_noop_conflict(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.concat("text", F.lit("!")), 256).alias("g"))
    incoming = rows.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("g")).otherwise(F.col("h")).alias("h"))
    return staging.upsert(rows.where("doc_id % 3 <> 0").select("doc_id", "h"), incoming, "doc_id", "h").select("doc_id", "outcome")


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 13 <> 0)
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'left_only' WHEN a.c_custkey IS NULL THEN 'right_only' WHEN a.c_mktsegment <> b.c_mktsegment THEN 'differs' ELSE 'same' END AS status,
        CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 'c_mktsegment' ELSE '' END AS fields FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey""")
def equivalence_full_outer(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    other = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    found = staging.equivalence(rows.where("c_custkey % 11 <> 0"), other.where("c_custkey % 13 <> 0"), "c_custkey")
    return found.select("c_custkey", "status", F.array_join("fields", ",").alias("fields"))


@query("SELECT event_id, try_cast(event_type AS BIGINT) AS event_type, try_cast(value AS INTEGER) AS value, 'unknown' AS origin FROM (SELECT event_id, event_type, floor(value) AS value FROM events)")
def schema_evolve(spark, sf):
    rows = table(spark, sf, "events").withColumn("value", F.floor("value"))
    return staging.evolve(rows, {"event_id": ("bigint", None), "event_type": ("bigint", None), "value": ("int", 0), "origin": ("string", "unknown")})


@query("SELECT sha256(string_agg(doc_id::VARCHAR || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS corpus_hash, count(*) AS files FROM documents")
def manifest_hash(spark, sf):
    return staging.manifest(_docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("SELECT pending, canonical, round(pending / greatest(1, canonical + pending), 3) AS debt_index, CASE WHEN pending = 0 THEN 'none' WHEN round(pending / greatest(1, canonical + pending), 3) < 0.1 THEN 'low' WHEN round(pending / greatest(1, canonical + pending), 3) < 0.3 THEN 'moderate' ELSE 'high' END AS label FROM (SELECT count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS canonical FROM orders)")
def debt_index(spark, sf):
    return staging.debt(table(spark, sf, "orders"), F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F")


@query("""SELECT conv_id, count(*) AS steps, count(*) FILTER (role = 'user') AS user_turns, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY 1""")
def trajectory_steps(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("role") == "user").alias("user_turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("p"))
    return rows.select("conv_id", "steps", "user_turns", F.array_join(F.transform("p", lambda x: x["role"]), ">").alias("path"))


# --- calibration and statistics ---


def _posteriors(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    logits = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", (F.col("n") / 4).alias("l"))))).alias("logits"))
    return logits.select("user_id", calibrate.softmax(F.col("logits")).alias("posterior"))


POSTERIOR_SQL = """n AS (SELECT user_id, event_type, count(*) / 4 AS l FROM events GROUP BY ALL),
    p AS (SELECT user_id, event_type, exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS p FROM n WINDOW w AS (PARTITION BY user_id))"""


@query(f"WITH {POSTERIOR_SQL} SELECT user_id, event_type, round(p, 6) AS p FROM p")
def softmax_posterior(spark, sf):
    return _posteriors(spark, sf).select("user_id", F.explode("posterior").alias("event_type", "p")).select("user_id", "event_type", F.round("p", 6).alias("p"))


@query(f"""WITH {POSTERIOR_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, event_type) AS r FROM p)
    SELECT user_id, CASE WHEN round(p, 9) >= 0.65 THEN event_type ELSE 'ABSTAIN' END AS decision FROM t WHERE r = 1""")
def abstain_gate(spark, sf):
    rounded = F.transform_values("posterior", lambda _, v: F.round(v, 9))
    return _posteriors(spark, sf).select("user_id", calibrate.decide(rounded).alias("decision"))


@query()
def fit_offsets(spark, sf):
    """Offsets that make the choice agree with each user's last event."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("gold"))
    dev = _posteriors(spark, sf).join(last, "user_id")
    found = calibrate.fit_offsets(dev, ["click", "error", "purchase", "signup", "view"])
    return spark.createDataFrame(sorted(found.items()), "class string, offset double")


@query("SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(l_extendedprice), 6) AS mean FROM lineitem")
def percentile_latency(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_extendedprice")
    mean = lines.agg(F.round(F.avg("l_extendedprice"), 6).alias("mean"))
    return calibrate.percentile(lines, "l_extendedprice", 0.95).select(F.round("percentile", 6).alias("p95")).join(mean)


# --- scalar functions, predicates and set operations, one query each ---


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_][A-Za-z0-9_-]*')) AS n FROM documents")
def tokens_with_ids(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(X.tokenize_with_ids(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, len(list_distinct(list_filter({TOKENS_SQL.format('text')}, lambda x: x NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)})))) AS n FROM documents")
def content_token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(X.content_tokens(F.col("text"))).cast("long").alias("n"))


@query("""SELECT page_id, '<untrusted_source>' || chr(10) || regexp_replace(html, '(?i)<(\\s*/?\\s*untrusted_source\\s*/?\\s*)>', '&lt;\\1&gt;', 'g') || chr(10) || '</untrusted_source>' AS fenced FROM pages""")
def fenced_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.fence(F.col("html")).alias("fenced"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def content_digests(spark, sf):
    return _docs(spark, sf).select("doc_id", X.sha256_id(F.col("text")).alias("digest"))


@query("SELECT o_orderkey, printf('PERS-ART-MED_%08d-0001', o_orderkey) AS node, 50 + 15 * (o_orderkey % 4) + 20 * (o_orderkey % 3) AS tokens FROM orders")
def canonical_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.format_string("PERS-ART-MED_%08d-0001", "o_orderkey").alias("node"), X.context_tokens(F.col("o_orderkey") % 4, F.col("o_orderkey") % 3).alias("tokens"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P') AND coalesce(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE), 0) >= 3")
def status_and_confidence(spark, sf):
    """Pending orders are drafts; the priority's digit is the confidence."""
    return table(spark, sf, "orders").where((F.col("o_orderstatus") != "P") & (F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("double"), F.lit(0.0)) >= 3)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1_' OR starts_with(p_type, 'ECO')")
def id_patterns(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").like("Brand#1_") | F.col("p_type").startswith("ECO")).select("p_partkey")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name FROM supplier")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'only', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_operations(spark, sf):
    orders = table(spark, sf, "orders")
    f, p = (orders.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FP")
    return f.intersect(p).select(F.lit("both").alias("side"), "k").union(f.subtract(p).select(F.lit("only"), "k"))


@query("""SELECT b.item_id, count(*) AS chunks FROM (SELECT item_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS alias FROM benchmark) b
    JOIN (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w, text FROM documents) d ON d.w = split_part(b.alias, ' ', 1) AND contains(d.text, b.alias) GROUP BY 1""")
def alias_in_chunk(spark, sf):
    """Containment as an equi-join on the alias' first token with the rest checked after it."""
    items = table(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", F.get(F.split("text", " "), 0), F.get(F.split("text", " "), 1)).alias("alias"))
    docs = _docs(spark, sf).select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    hits = docs.join(F.broadcast(items.withColumn("w", F.get(F.split("alias", " "), 0))), "w").where(F.contains(F.col("text"), F.col("alias")))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT o_custkey % 50 AS query, o_orderkey AS id, 1.0::DOUBLE AS score FROM orders WHERE contains('order ' || (o_custkey % 50)::VARCHAR || ' and 17', o_orderkey::VARCHAR)")
def exact_id_boost(spark, sf):
    text = F.concat(F.lit("order "), (F.col("o_custkey") % 50).cast("string"), F.lit(" and 17"))
    return table(spark, sf, "orders").where(F.contains(F.lower(text), F.col("o_orderkey").cast("string"))).select((F.col("o_custkey") % 50).alias("query"), F.col("o_orderkey").alias("id"), F.lit(1.0).alias("score"))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS backlog, count(*) FILTER (value IS NULL) AS corrupt, date_diff('day', min(ts) FILTER (event_type = 'error'), TIMESTAMP '2024-02-01') AS oldest_days, count(DISTINCT user_id) AS owners FROM events""")
def backlog_metrics(spark, sf):
    failed = F.col("event_type") == "error"
    return table(spark, sf, "events").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("backlog"), F.count_if(F.col("value").isNull()).alias("corrupt"),
        F.date_diff(F.lit("2024-02-01").cast("date"), F.min(F.when(failed, F.to_date("ts")))).cast("long").alias("oldest_days"), F.count_distinct("user_id").alias("owners"))


@query(f"""WITH {EDGES_SQL}, n AS (SELECT u AS id FROM e UNION SELECT v FROM e) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, true AS starts_at_zero, true AS ends_at_edges""")
def csr_invariants(spark, sf):
    rows = graph.adjacency(_edges(spark, sf))
    edges = F.sum("degree")
    return rows.agg(F.count(F.lit(1)).alias("nodes"), edges.alias("edges"), (F.min("start") == 0).alias("starts_at_zero"), (F.max(F.col("start") + F.col("degree")) == edges).alias("ends_at_edges"))


@query("""SELECT c_nationkey::INTEGER AS scope, count(*) AS members, min(c_custkey) AS community FROM customer GROUP BY 1""")
def scope_communities(spark, sf):
    """Components inside each scope: customers of a nation hang together through it."""
    edges = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    own = edges.select((F.col("c_custkey") + 1000).alias("u"), F.col("c_nationkey").cast("long").alias("v"))
    found = graph.components(own)
    named = edges.join(found.select((F.col("node") - 1000).alias("c_custkey"), "component"), "c_custkey")
    return named.groupBy("component").agg(F.first("c_nationkey").alias("scope"), F.count(F.lit(1)).alias("members"), F.min("c_custkey").alias("community")).select("scope", "members", "community")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE n > 1 AND role = before""")
def repeated_roles(spark, sf):
    """Turns whose role is that of the turn before."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("before", F.lag("role").over(order))
    return rows.where(F.col("role") == F.col("before")).select("conv_id", "turn", "role")


@query("""SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 5""")
def facet_counts(spark, sf):
    return table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query()
def code_nodes(spark, sf):
    """The code graph of three small sources that come with the query."""
    from ..sources import readers

    sources = [("a.py", "class A:\n    def m(self):\n        return f()\ndef f():\n    return 1\n"), ("b.py", "from a import A\nclass B(A):\n    pass\n"), ("tests/t.py", "def test_f():\n    f()\n")]
    nodes, _ = readers.code_graph(spark.createDataFrame(sources, "path string, text string"))
    return nodes.select("node_id", "kind", "path")


@query()
def hybrid_search(spark, sf):
    """Lexical and length seeds, expansion to a source's next documents, fusion of all three and the best five."""
    from pyspark.sql import Window

    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    lexical_scores = _scores(spark, sf).select("query_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    batch = spark.createDataFrame([(i,) for i, _ in BATCH], "query_id int")
    long_docs = docs.where("n_chars > 8000").select("id", F.col("n_chars").cast("double").alias("score")).join(F.broadcast(batch)).select("query_id", "id", "score")
    following = Window.partitionBy("source").orderBy("id")
    edges = docs.withColumn("dst", F.lead("id").over(following)).where("dst is not null").select(F.col("id").alias("src"), "dst", F.lit("structural").alias("category"), F.lit("NEXT").alias("type"))
    starts = hybrid.seeds(lexical_scores, long_docs, 10)
    reached = hybrid.graph_scores(hybrid.expand(starts, edges, docs, 2, 25, 200))
    fused = fusion.rrf({"bm25": lexical_scores, "vector": long_docs, "graph": reached}, dict(zip(("bm25", "vector", "graph"), fusion.WEIGHTS)))
    return lexical.top_k(fused, 5, "id").select("query_id", "id", "score", "matched_by", "rank")


@query("""SELECT sha256(string_agg(h, '' ORDER BY b)) AS corpus_hash, sum(n)::BIGINT AS files FROM (SELECT doc_id % 64 AS b, sha256(string_agg(doc_id::VARCHAR || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1)""")
def manifest_tree_hash(spark, sf):
    return staging.manifest_tree(_docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h", F.col("doc_id") % 64)
