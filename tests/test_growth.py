"""Work and memory that grow no faster than tables do."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from loomgraph.operators import graph, lexical, vectors


def plain_embedding(text, dimension):
    vector = np.zeros(dimension)

    def add(h, k, scale):
        vector[int.from_bytes(h[k : k + 4], "big") % dimension] += (1.0 - 2.0 * (h[k + 4] % 2)) * scale

    for pos, word in enumerate(re.findall(r"[a-z0-9_]+", text.lower())):
        weight = 1.0 / math.log2(pos + 3.0)
        h = hashlib.sha256(word.encode()).digest()
        add(h, 0, 1.5 * weight)
        add(h, 5, 0.8 * weight)
        for n in (3, 4):
            for i in range(len(word) - n + 1):
                add(hashlib.sha256(word[i : i + n].encode()).digest(), 0, 0.4 * weight)
    return vector / np.linalg.norm(vector)


def test_embedding_adds_each_word_from_what_is_known_of_it(monkeypatch):
    monkeypatch.setattr(vectors, "KNOWN_WORDS", 30)
    monkeypatch.setattr(vectors, "WORDS_AT_ONCE", 7)
    vectors._places.cache_clear()
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abc_9", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60)))
        assert (vectors.hash_embedding(text, 64) == plain_embedding(text, 64)).all()
    assert len(vectors._places(64).rows) <= 30 + 7


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "parts_of", lambda rows, each=100: max(1, -(-rows // each)))
    rows = [(g, i) for g in range(40) for i in range(5)]
    found = graph.cooccurrence(spark.createDataFrame(rows, "article long, concept long"), 2)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect())) == [(a, b, 40) for a in range(5) for b in range(a + 1, 5)]


def test_a_tile_is_not_exploded_at_once(spark):
    """Pairs of a tile are made an item at a time: both sides exploded in one generated stage pile up a whole tile on the heap."""
    rows = [(g, i) for g in range(3) for i in range(90)] + [(g, i) for g in (3, 4) for i in range(40, 130)]
    frame = spark.createDataFrame(rows, "article long, concept long")
    of = {i: {g for g, j in rows if j == i} for i in range(130)}
    for more in ([], [(9, 5)], [(9, 5), (9, 60), (9, 200), (8, 60), (8, 61)]):
        held = {i: of.get(i, set()) | {g for g, j in more if j == i} for i in [*of, 200]}
        found = graph.cooccurrence(frame.union(spark.createDataFrame(more, frame.schema)), 3, width=32)
        expected = [(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 3]
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        one, other = (set(re.findall(rf"\*\((\d+)\) Generate explode\({side}#", plan)) for side in ("xs", "ys"))
        assert one and other and not one & other
        if len(more) < 2:  # no pair stands in a small group: the rows aren't read again once their sets are kept
            assert "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_cycles_in_few_rounds(spark, monkeypatch):
    kept = []
    keep = graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(1) or keep(df))
    rng = random.Random(3)
    ring = [(i, (i + 1) % 48) for i in range(48)]
    loose = [(100 + rng.randrange(12), 100 + rng.randrange(12)) for _ in range(16)]
    edges = set(ring) | set(loose) | {(47, 100), (7, 111)}
    reach = {u: set() for e in edges for u in e}
    while True:
        more = {u: reach[u].union(*({v} | reach[v] for x, v in edges if x == u)) for u in reach}
        if more == reach:
            break
        reach = more
    found = graph.cycles(spark.createDataFrame(list(edges), "u long, v long")).collect()
    assert sorted(map(tuple, found)) == sorted((u, v) for u, v in edges if u in reach[v] or u == v)
    assert len(kept) < 150  # with a round a step of the ring, two passes are twice 2 x 48


def test_traversals_deal_edges_by_their_number(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graph, "parts_of", lambda rows, each=0: asked.append(rows) or 3)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "u long, v long")
    roots = spark.createDataFrame([(1,)], "root long")
    assert sorted((r.node, r.depth) for r in graph.bfs(edges, roots, 3).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted((r.node, r.depth) for r in graph.blast_radius(edges, roots, "down", 3).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert asked == [5, 5]


def test_references_are_compared_where_pairs_are_made(spark):
    rng = random.Random(5)
    incidence = [(g, i) for g in range(12) for i in rng.choices(range(9), k=5)]
    refs = [(i, rng.randrange(6)) for i in range(8) for _ in range(5)]
    kinds = {i: None if i == 3 else i % 2 for i in range(9) if i != 7}
    groups = {g: {i for x, i in incidence if x == g} for g in range(12)}
    of = {i: {r for x, r in refs if x == i} for i in range(9)}
    expected = []
    for a in kinds:
        for b in kinds:
            shared = sum({a, b} <= items for items in groups.values())
            if a < b and shared:
                expected.append((a, b, shared, len(of[a] & of[b]), None if 3 in (a, b) else kinds[a] == kinds[b]))
    tables = (spark.createDataFrame(incidence, "article long, concept long"), spark.createDataFrame(refs, "node long, ref long"), spark.createDataFrame(list(kinds.items()), "node long, kind int"))
    for limits in ({}, {"width": 2}, {"most": 2}):
        found = graph.pairs_with_refs(*tables, **limits)
        assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_index_counts_words_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS_A_TASK", 1)
    monkeypatch.setattr(lexical, "TERM_PARTS", 2)
    texts = {i: " ".join(random.Random(i).choices("ab cd ef".split(), k=i)) for i in range(12)}
    lexical.write_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/postings").select("doc_id", "term", "tf", "dl").collect()
    assert sorted(map(tuple, found)) == sorted((i, w, n, i) for i, text in texts.items() for w, n in Counter(text.split()).items())
    assert {r.term: r.df for r in spark.read.parquet(f"{tmp_path}/terms").collect()} == Counter(w for text in texts.values() for w in set(text.split()))
