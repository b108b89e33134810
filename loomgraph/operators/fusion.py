"""Rank fusion, conflicts, gates and evaluation for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import components

CONSTANT = 60
#: Weights of lexical, vector and graph ranks.
WEIGHTS = (0.4, 0.4, 0.2)
#: Ranks of epistemic terms.
RANKS = {
    "verification": {"formal_proof": 4, "peer_verified": 3, "self_verified": 2, "unverified": 1, "falsified": 0},
    "authority": {"normative": 4, "authoritative": 3, "informative": 2, "advisory": 1, "deprecated": 0},
    "consensus": {"accepted": 2, "proposed": 1, "contested": 0},
    "evidence": {"observed": 3, "derived": 2, "inferred": 1, "postulated": 0},
}


def ranked(scores: DataFrame, name: str, key: str = "id", depth: int | None = None) -> DataFrame:
    """query_id, key and the rank, down to depth: the limit reaches below the shuffle, so a task passes on no more."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranks = scores.select("query_id", key, F.row_number().over(order).alias(name))
    return ranks if depth is None else ranks.where(F.col(name) <= depth)


def rrf(modalities: dict[str, DataFrame], weights: dict[str, float], key: str = "id", depth: int | None = None) -> DataFrame:
    """query_id, key, score, matched_by: weighted reciprocal ranks, each rounded to 7 places, summed and rounded.

    With a depth only the first so many of each modality take part; without it whole lists are ranked, a task a query.
    The lists are put under each other and added up by key, whatever their number; a key stands once in each.
    """
    lists = None
    for name, scores in modalities.items():
        ranks = ranked(scores, name, key, depth)
        lists = ranks if lists is None else lists.unionByName(ranks, allowMissingColumns=True)
    fused = lists.groupBy("query_id", key).agg(*[F.min(n).alias(n) for n in modalities])
    part = {n: F.coalesce(F.round(F.lit(weights[n]) / (F.lit(CONSTANT) + F.col(n)), 7), F.lit(0.0)) for n in modalities}
    total = sum(part.values(), F.lit(0.0))
    matched = F.array_join(F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in modalities]), lambda x: x.isNotNull()), ",")
    return fused.select("query_id", key, F.round(total, 7).alias("score"), matched.alias("matched_by"))


def epistemic_key() -> Column:
    """What decides between objects that contradict each other; the greatest wins, then the shorter and lower id."""
    def rank(name: str) -> Column:
        table = F.create_map(*[F.lit(x) for pair in RANKS[name].items() for x in pair])
        return F.coalesce(F.get(F.array(table[F.col(name)]), 0), F.lit(0))

    return F.struct(*[rank(n).alias(n) for n in RANKS], F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("last_verified").cast("string"), F.lit("")).alias("last_verified"))


def contradictions(rows: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """u, v: the least of each group of rows that contradict each other, by keys, with every other one of it.

    These say as much about clusters as all pairs of a group do, and there are no more of them than rows.
    """
    first = rows.groupBy(*keys).agg(F.min(key).alias("u"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.select(*keys, F.col(key).alias("v")).join(first, keys).where("u < v").select("u", "v")


def resolve_conflicts(candidates: DataFrame, contradictions: DataFrame) -> DataFrame:
    """candidates(id, ...) with suppressed_by: in each cluster of contradicting candidates one object wins."""
    inside = contradictions.join(candidates.select(F.col("id").alias("u")), "u", "left_semi").join(candidates.select(F.col("id").alias("v")), "v", "left_semi")
    clusters = components(inside.select("u", "v")).withColumnsRenamed({"node": "id", "component": "cluster"})
    # Only objects inside a conflict are compared, and a cluster's winner is one aggregate.
    inside = candidates.withColumn("_k", epistemic_key()).join(clusters, "id").select("id", "cluster", "_k")
    top = inside.groupBy("cluster", "_k", F.length("id").alias("l")).agg(F.min("id").alias("id")).groupBy("cluster").agg(F.max_by("id", F.struct("_k", (-F.col("l")).alias("l"))).alias("winner"))
    lost = inside.join(top, "cluster").where("id <> winner").select("id", F.col("winner").alias("suppressed_by"))
    return candidates.join(lost, "id", "left")


def refusal(rows: DataFrame, entailment: Column, confidence: Column, least_entailment: float = 0.5, least_confidence: float = 0.65) -> DataFrame:
    """rows with decision; an absent score passes its gate."""
    fine = (F.coalesce(entailment, F.lit(1.0)) >= least_entailment) & (F.coalesce(confidence, F.lit(1.0)) >= least_confidence)
    return rows.withColumn("decision", F.when(fine, "ADMISSIBLE").otherwise("REFUSED"))


def recall(ranks: DataFrame, ks: tuple = (1, 5, 10)) -> DataFrame:
    """Share of queries whose relevant answer has rank <= k; rank is null where it wasn't found."""
    return ranks.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks])


def benchmark_report(questions: DataFrame, results: DataFrame, bodies: DataFrame, refused: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row of a retrieval benchmark: recall at 1, 5 and 10, kept conclusions, refused controls and, given the time
    that all questions took together, the mean milliseconds and the questions a second.

    questions(query_id, gold, conclusion) and results(query_id, id, rank); a conclusion is kept where the body of
    bodies(id, body) holds it or its first 50 characters, an empty one wherever the body is known. refused(refused) is
    a row a control question. Without questions or controls rates are 0.
    """
    asked = questions.select("query_id", "gold", F.coalesce("conclusion", F.lit("")).alias("conclusion"))
    ranks = results.select("query_id", F.col("id").alias("gold"), "rank").groupBy("query_id", "gold").agg(F.min("rank").alias("rank"))
    found = asked.join(ranks, ["query_id", "gold"], "left").join(bodies.select(F.col("id").alias("gold"), "body"), "gold", "left")
    held = F.col("body").isNotNull() & F.contains(F.coalesce("body", F.lit("")), F.substring("conclusion", 1, 50))
    rows = found.select(F.lit(True).alias("question"), "rank", held.alias("held"))
    rows = rows.unionByName(refused.select(F.lit(False).alias("question"), "refused"), allowMissingColumns=True)
    rate = lambda mine, c: F.round(F.coalesce(F.avg(F.when(mine, F.coalesce(c, F.lit(False)).cast("double"))), F.lit(0.0)), 6)
    told = rows.agg(
        F.count_if("question").alias("questions"), *[rate(F.col("question"), F.col("rank") <= k).alias(f"recall_{k}") for k in (1, 5, 10)], rate(F.col("question"), F.col("held")).alias("preservation"),
        F.count_if(~F.col("question")).alias("controls"), rate(~F.col("question"), F.col("refused")).alias("control_refusal"))
    time = F.lit(seconds).cast("double")
    return told.withColumns({
        "mean_query_ms": F.when(F.col("questions") > 0, time * 1000 / F.col("questions")).otherwise(time * 0),
        "queries_per_sec": F.when(time > 0, F.col("questions") / time).otherwise(time * 0)})


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Closed interval; a bound that is absent or isn't a date doesn't bind, nor does such a moment."""
    a, b, t = (x.try_cast("date") for x in (start, end, at))
    return t.isNull() | ((a.isNull() | (t >= a)) & (b.isNull() | (t <= b)))


def facets(conditions: list[Column], mode: str = "any") -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = (out & c) if mode == "all" else (out | c)
    return out
