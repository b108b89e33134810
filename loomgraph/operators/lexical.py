"""BM25 over an inverted index, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokenize
from ..session import forget, keep, parts_of

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf. Term counts are taken inside each row first, so the shuffle carries a term of a text once."""
    return docs.select(key, F.explode(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(tokenize(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    return doc_lengths(docs, docs.columns[0], text).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, cf. A row is a document: its words and its different words are told apart before anything is shuffled,
    so the shuffle carries a term of a task once."""
    words = docs.select(tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    both = words.select(F.explode(F.array(F.struct(F.col("_t").alias("ts"), F.lit(0).alias("d")), F.struct(F.array_distinct("_t").alias("ts"), F.lit(1).alias("d")))).alias("_b"))
    rows = both.select("_b.d", F.explode("_b.ts").alias("term"))
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.sum(1 - F.col("d")).alias("cf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, key, score for queries(query_id, query). A repeated query term counts each time.

    Texts are read once: a row a document with its length and those of its words that the batch asks for is kept, and
    statistics, document frequencies and scores come from these rows. The batch's different words come to the driver.
    """
    terms = keep(queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    wanted = sorted(r["term"] for r in terms.select("term").distinct().collect())
    tokens = docs.select(key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    found = keep(tokens.select(key, F.size("_t").alias("dl"), F.filter("_t", lambda w: w.isin(wanted)).alias("terms")))
    corpus = found.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    hits = found.select(key, "dl", F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = found.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _scored(hits, df, terms, corpus, key)


def _scored(hits: DataFrame, df: DataFrame, terms: DataFrame, corpus, key: str) -> DataFrame:
    """Scores of hits(key, term, tf, dl), df(term, df) and terms(query_id, term, times); corpus: n and avgdl."""
    idf = F.log((F.lit(corpus["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(corpus["avgdl"] or 1.0)))
    scored = hits.join(df.join(terms, "term"), "term")
    return scored.groupBy("query_id", key).agg(F.sum(F.col("times") * idf * weight).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "doc_id", score: str = "score", group: str = "query_id") -> DataFrame:
    """rank 1..k by falling score, ties by key."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalized(scores: DataFrame, score: str = "score", group: str = "query_id") -> DataFrame:
    """score over the group's best, six decimals; 0 where the best isn't positive. A group's best is one row, joined."""
    best = scores.groupBy(group).agg(F.max(score).alias("_top"))
    return scores.join(best, group).withColumn("norm", F.when(F.col("_top") > 0, F.round(F.col(score) / F.col("_top"), 6)).otherwise(0.0)).drop("_top")


# --- a persisted index ---

#: Parts that terms are dealt into by hash; a batch reads only the parts of its terms.
TERM_PARTS = 64
TOKENS_A_TASK = 500_000


def object_text(title: Column, aliases: Column, keywords: Column, body: Column) -> Column:
    """What is indexed of an object: its title twice, its aliases and keywords, its body."""
    some = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", title, title, some(aliases), some(keywords), body)


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Postings(part, term, key, tf, dl) sorted by term in folders by part, term counts, and the corpus counts.

    Words move once, to where they are counted, sorted and written.
    """
    tokens = keep(docs.select(key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_t")).withColumn("dl", F.size("_t").cast("long")))
    # A part's documents are dealt into slices, so that no task's share grows with a common term.
    slices = parts_of(tokens.agg(F.sum("dl")).first()[0] or 0, TERM_PARTS * TOKENS_A_TASK)
    rows = tokens.select(key, "dl", F.explode("_t").alias("term")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int"))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices))).repartition(TERM_PARTS * slices, "part", "_slice")
    rows = rows.groupBy("part", "_slice", key, "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select(key, "dl", "term", "tf", "part")
    rows.sortWithinPartitions("part", "term", key).write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    postings_ = tokens.sparkSession.read.parquet(f"{path}/postings")
    postings_.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df")).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms")
    tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("tokens")).write.mode("overwrite").parquet(f"{path}/corpus")
    forget(tokens)


def search_index(spark: SparkSession, path: str, queries: DataFrame, eligible: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """query_id, key, score for a stated batch; eligibility is looked at after scoring, so it changes no statistics.

    The batch's terms come to the driver: their parts are read, and within them the rows of these terms only.
    """
    terms = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int"))
    asked = terms.collect()
    words, parts = sorted({r["term"] for r in asked}), sorted({r["part"] for r in asked})
    corpus = spark.read.parquet(f"{path}/corpus").first()
    chosen = F.col("part").isin(parts) & F.col("term").isin(words)
    hits = spark.read.parquet(f"{path}/postings").where(chosen).select("term", key, "tf", "dl")
    df = spark.read.parquet(f"{path}/terms").where(chosen).select("term", "df")
    batch = spark.createDataFrame([(r["query_id"], r["term"], r["times"]) for r in asked], "query_id int, term string, times long")
    scored = _scored(hits, df, batch, corpus, key)
    return scored if eligible is None else scored.join(eligible.select(key).distinct(), key, "left_semi")
