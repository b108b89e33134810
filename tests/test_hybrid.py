"""Bounded expansion and graph features against plain Python."""

import random
from collections import defaultdict

from loomgraph.operators import hybrid


def test_expansion_equals_a_queue(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([*hybrid.CATEGORIES[:4], "odd"]), rng.choice("ab")) for _ in range(400)]
    allowed = set(rng.sample(nodes, 45))
    starts = {1: ["n01", "n05"], 2: ["n09"]}
    priority = {c: i for i, c in enumerate(hybrid.CATEGORIES)}
    out = defaultdict(list)
    for e in edges:
        out[e[0]].append((priority.get(e[2], 99), e[3], e[1]))
    for cap in (12, 200):
        expected = {}
        for q, seeds in starts.items():
            depth = {s: 0 for s in seeds}
            level = list(seeds)
            for d in (1, 2):
                following = []
                for node in level:
                    for _, _, target in sorted(out[node])[:5]:
                        if target in allowed and target not in depth and len(depth) < cap:
                            depth[target] = d
                            following.append(target)
                level = following
            expected |= {(q, n): d for n, d in depth.items()}
        found = hybrid.expand(
            spark.createDataFrame([(q, s, i) for q, ss in starts.items() for i, s in enumerate(ss)], "query_id int, id string, ord int"),
            spark.createDataFrame(edges, "src string, dst string, category string, type string"),
            spark.createDataFrame([(n,) for n in allowed], "id string"), 2, 5, cap)
        assert {(r.query_id, r.id): r.depth for r in found.collect()} == expected


def test_phi_scores_and_seeds(spark):
    lexical = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "query_id int, id string, score double")
    vector = spark.createDataFrame([(1, "b", 0.9), (1, "c", 0.8)], "query_id int, id string, score double")
    found = hybrid.seeds(lexical, vector, 2)
    assert [r.id for r in found.orderBy("ord").collect()] == ["a", "b", "c"]
    scores = hybrid.phi_scores(
        spark.createDataFrame([(1, "x"), (1, "y")], "query_id int, id string"), found.where("ord = 1"),
        spark.createDataFrame([("a", "x", 1)], "root string, node string, depth int"), spark.createDataFrame([("a", "r"), ("x", "r")], "id string, ref string"),
        spark.createDataFrame([("a", 1), ("x", 1), ("y", 2)], "id string, community int"), spark.createDataFrame([("x", 10)], "id string, degree int"))
    assert {r.id: r.score for r in scores.collect()} == {"x": round(0.3 * 0.5 + 0.2 + 0.15 * 0.2 + 0.1 + 0.1 * 0.2, 6), "y": 0.0}


def test_eligibility(spark):
    rows = [("a", "draft", "0.9", None), ("b", "archived", "x", None), ("c", "established", "0.5", ("2020-01-01", "2020-12-31")), ("d", None, None, ("bad", None))]
    objects = spark.createDataFrame([(i, s, c, v, "engineering", "Component", "build") for i, s, c, v in rows], "id string, status string, confidence string, validity struct<valid_from:string,valid_until:string>, scope string, object_type string, domain string")

    def ids(**options):
        return {r.id for r in hybrid.eligible(objects, **options).collect()}

    assert ids() == {"b", "c", "d"} and ids(drafts=True, min_confidence=0.5) == {"a", "c"}
    assert ids(valid_at="2021-05-05") == {"b", "d"} and ids(scope="personal") == set() and ids(object_types=["Component"], domain="build") == {"b", "c", "d"}


def test_absent_modalities_are_null_and_scores_of_missing_hits_zero(spark):
    fused = spark.createDataFrame([(1, "a", 0.02, "bm25,graph"), (1, "b", 0.01, "bm25"), (1, "gone", 0.03, "bm25"), (2, "a", 0.01, "bm25"), (2, "b", 0.001, "bm25")], "query_id int, id string, score double, matched_by string")
    objects = spark.createDataFrame([("a", "A", "# H\n\nfirst line", {"valid_from": "2020-01-01", "valid_until": None}, ["r1"]), ("b", None, None, None, None)], "id string, title string, raw_body string, validity struct<valid_from:string,valid_until:string>, source_refs array<string>")
    lexical = spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, score double")
    bare = {(r.query_id, r.node_id): r for r in hybrid.evidence(fused, objects, lexical, min_relevance=0.005).collect()}
    assert set(bare) == {(1, "a"), (1, "b"), (2, "a")}
    a, b = bare[1, "a"], bare[1, "b"]
    assert (a.rank, b.rank) == (2, 3) and a.matched_by == ["bm25", "graph"] and a.body is None
    assert (a.score_components.bm25_raw, b.score_components.bm25_raw) == (1.0, 0.0) and a.score_components.vector_raw is None and a.score_components.graph_raw is None
    assert a.body_excerpt == "first line" and a.validity.valid_from == "2020-01-01" and a.provenance.source_ref == "r1" and b.provenance.source_ref is None
    assert a.subgraph_relations == [] and a.conflict is None and not a.conflict_detected and a.passage_attribution is None
    vector = spark.createDataFrame([(1, "a", 0.5, 2, "x" * 300)], "query_id int, id string, score double, chunk_index int, passage string")
    walked = spark.createDataFrame([(1, "a", 1.0, 0), (1, "z", 0.5, 1), (2, "a", 1.0, 0)], "query_id int, id string, score double, depth int")
    relations = spark.createDataFrame([("a", "NEXT", "b"), ("a", "NEXT", "z"), ("b", "CONTRADICTS", "z"), ("a", "NEXT", "b")], "src string, type string, dst string")
    full = {(r.query_id, r.node_id): r for r in hybrid.evidence(fused, objects, lexical, vector, walked, relations, body=True).collect()}
    a, b, other = full[1, "a"], full[1, "b"], full[2, "a"]
    assert (a.score_components.vector_raw, b.score_components.vector_raw) == (0.5, 0.0) and len(a.passage_attribution.passage_text) == 200 and b.passage_attribution is None
    assert (a.score_components.graph_raw, b.score_components.graph_raw, other.score_components.graph_raw) == (1.0, 0.0, None)
    assert [tuple(r) for r in a.subgraph_relations] == [("NEXT", "b")] and [tuple(r) for r in b.subgraph_relations] == [("CONTRADICTS", "z")] and a.body.startswith("# H")
