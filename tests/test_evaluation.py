"""Large groups, hubs, ranks to a depth, benchmark rates and small rules against plain Python."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import fusion, graph, lexical


def brute_pairs(rows, least):
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    counts = {}
    for members in groups.values():
        for pair in combinations(sorted(members), 2):
            counts[pair] = counts.get(pair, 0) + 1
    return {p: n for p, n in counts.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2])
def test_cooccurrence_in_tiles(spark, least):
    rng = random.Random(5)
    rows = [(1, rng.randrange(70)) for _ in range(300)] + [(g, rng.randrange(70)) for g in range(2, 30) for _ in range(4)] + [(None, 1), (2, None), (1, None)]
    frame = spark.createDataFrame(rows, "article int, concept int")
    for width in (5, 64, 1000):
        got = [(r.a, r.b, r.shared) for r in graph.cooccurrence(frame, least, width=width).collect()]
        assert len(got) == len({g[:2] for g in got})
        assert {(a, b): n for a, b, n in got} == brute_pairs(rows, least)
    assert graph.cooccurrence(frame.limit(0), 1).count() == 0


def test_a_large_group_is_many_tiles(spark):
    rows = spark.range(300).select(F.lit(1).alias("article"), F.col("id").alias("concept"))
    assert graph.cooccurrence(rows, 1, width=20).count() == 300 * 299 // 2


@pytest.mark.parametrize("most", [3, 10_000])
def test_shared_refs_with_hubs(spark, most):
    rng = random.Random(2)
    refs = [(n, rng.randrange(12)) for n in range(8) for _ in range(1 + n)] + [(3, None), (None, 4)]
    pairs = [(a, b, f"{a}{b}") for a in range(10) for b in range(a + 1, 10)]
    sets = {n: {r for m, r in refs if m == n and r is not None} for n in range(10)}
    found = graph.shared_refs(spark.createDataFrame(pairs, "a int, b int, name string"), spark.createDataFrame(refs, "node int, ref int"), most)
    assert found.columns == ["a", "b", "name", "shared_refs"]
    assert sorted((r.a, r.b, r.name, r.shared_refs) for r in found.collect()) == sorted((a, b, n, len(sets[a] & sets[b])) for a, b, n in pairs)



def test_cooccurrence_pairs_classes_and_not_their_members(spark, monkeypatch):
    """Items of the same large groups are paired once as a class; those that also stand in small groups are added up."""
    rows = [(g, i) for g in range(6) for i in range(200)] + [(7, i) for i in range(0, 30)] + [(6, i) for i in range(150, 260)]
    seen = []
    plain = graph._group_pairs
    monkeypatch.setattr(graph, "_group_pairs", lambda r, w: (seen.append(r.select("i").distinct().count()), plain(r, w))[1])
    frame = spark.createDataFrame(rows, "article long, concept long")
    got = sorted((r.a, r.b, r.shared) for r in graph.cooccurrence(frame, 6, width=64).collect())
    groups = {}
    for g, i in rows:
        groups.setdefault(i, set()).add(g)
    expected = [(a, b, len(groups[a] & groups[b])) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) >= 6]
    assert got == sorted(expected)
    assert seen == [4]


def test_edge_records_are_in_order(spark):
    pairs = spark.createDataFrame([("a", "b", 1, 0.9, 2, 4), ("a", "c", 0, 0.5, 9, None), ("b", "c", 1, 0.9, 2, 4)], "a string, b string, canonical int, similarity double, shared_refs long, shared_chunks long")
    rows = graph.edge_records(graph.derived_edges(pairs), "h").collect()
    assert [r.edge_id for r in rows] == ["d_edge_a_b_1.0.0", "d_edge_b_c_1.0.0", "d_edge_a_c_1.0.0"]
    assert rows[0].component_scores.asDict() == {"canonical": 1.0, "similarity": 0.9, "proximity": 0.4, "cooccurrence": 0.4}
    assert rows[2].derivation.mode == "inferred" and rows[2].component_scores.similarity == 0.0 and rows[0].corpus_hash == "h"


def test_rank_depth(spark):
    one = spark.createDataFrame([(1, i, float(-i)) for i in range(10)], "query_id int, id int, score double")
    two = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "query_id int, id int, score double")
    got = {r.id: (r.score, r.matched_by) for r in fusion.rrf({"x": one, "y": two}, {"x": 0.4, "y": 0.2}, depth=2).collect()}
    assert got == {0: (round(0.4 / 61, 7), "x"), 1: (round(0.4 / 62, 7), "x"), 9: (round(0.2 / 61, 7), "y"), 8: (round(0.2 / 62, 7), "y")}
    whole = fusion.rrf({"x": one, "y": two}, {"x": 0.4, "y": 0.2})
    assert whole.count() == 10 and whole.where("matched_by = 'x,y'").count() == 10


def test_benchmark_report(spark):
    questions = spark.createDataFrame([(1, "a", "yes"), (2, "b", None), (3, "z", "no"), (4, "c", "x" * 60)], "query_id int, gold string, conclusion string")
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 4)], "query_id int, id string, rank int")
    bodies = spark.createDataFrame([("a", "oh yes"), ("b", None), ("c", "x" * 50)], "id string, body string")
    row = fusion.benchmark_report(questions, results, bodies, spark.createDataFrame([(True,), (True,), (False,), (None,)], "refused boolean"), 2.0).first()
    assert (row.questions, row.recall_1, row.recall_5, row.recall_10) == (4, 0.25, 0.5, 0.5)
    assert (row.preservation, row.controls, row.control_refusal, row.mean_query_ms, row.queries_per_sec) == (0.5, 4, 0.5, 500.0, 2.0)
    empty = fusion.benchmark_report(questions.limit(0), results, bodies, spark.createDataFrame([], "refused boolean")).first()
    assert (empty.questions, empty.recall_1, empty.controls, empty.mean_query_ms) == (0, 0.0, 0, None)


def test_bm25_equals_plain_python_on_repeats_and_empties(spark):
    import math

    docs = [(1, "red fox red"), (2, None), (3, ""), (4, "blue fox é"), (4, "blue fox é")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(frame.where("doc_id < 4"), spark.createDataFrame([(1, "red fox red"), (2, "none")], "query_id int, query string")).collect()}
    avg, df = 1.0, 1
    idf = math.log((3 - df + 0.5) / (df + 0.5) + 1)
    weigh = lambda tf: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert set(got) == {(1, 1)} and got[1, 1] == pytest.approx(2 * idf * weigh(2) + idf * weigh(1))
    assert lexical.bm25(frame.limit(0), spark.createDataFrame([(1, "red")], "query_id int, query string")).count() == 0


def test_words_beside_other_letters(spark):
    texts = ["𝐀abc 😀def x𝐀 y", "a𝐀b c", "é e éa aé aéb", "K k İ i İi", "a_b-c, 12x_ _", "", "áb c", "①a a① ½b", "\U0001f600a"]

    def plain(t):
        runs = re.findall(r"\w+", t)
        return [w.lower() for w in runs if re.fullmatch("[A-Za-z0-9_]+", w)]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokenize(F.col("t")).alias("w")).collect()
    assert all(r.w == plain(r.t) for r in rows), [(r.t, r.w, plain(r.t)) for r in rows]


def test_small_rules(spark):
    rows = spark.createDataFrame([("draft", "", "2024-02-01"), ("archived", "2024-01-01", None), (None, None, "")], "s string, u string, n string")
    got = rows.select(X.bundle_status(F.col("s")).alias("s"), X.stale_after(F.col("u"), F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("draft", "2024-02-01"), ("deprecated", "2024-01-01"), ("stable", None)]
    names = {" 1.2. Ångström & Co ": "1_2_angstrom_co", "3": "3", "4.": "4", "Straße (Øst)": "strasse_ost", "__": "", "10 a.b": "10_a_b", None: None}
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.segment(F.col("n")).alias("s")).collect()}
    assert got == names
    bodies = ["", "a\n" * 100, "a\n" * 100 + "b", "w " * 1000, "w " * 1001, " ".join("a" * 101), "a\r\n" * 101, "\n" * 100]
    got = {r.b: r.m for r in spark.createDataFrame([(b,) for b in bodies], "b string").select("b", X.needs_section_map(F.col("b")).alias("m")).collect()}
    assert got == {b: len(b.split()) > 1000 or len(b.splitlines()) > 100 for b in bodies}
    refs = spark.createDataFrame([([" A  b", "a b", "", None, " "],), (None,)], "r array<string>").select(X.source_refs(F.col("r")).alias("r")).collect()
    assert [r.r for r in refs] == [["a b"], []]
