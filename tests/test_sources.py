"""Readers, rules and streams over small files."""

import json

from loomgraph.operators import validate
from loomgraph.sources import readers
from loomgraph.streaming import guards

PAGE = """---
id: {id}
title: T
scope: engineering
object_type: Component
domain: build
taxonomy_id: t1
taxonomy_path: Leaf
status: {status}
consensus: accepted
author: human:kim
source_refs: [a]
language: [en, en]
relations:
{relations}
---
Body
"""


def write(root, name, **fields):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    relations = "".join(f"  - {{type: {t}, target: {x}}}\n" for t, x in fields.get("relations", [])) or "  []\n"
    path.write_text(PAGE.format(id=fields["id"], status=fields.get("status", "established"), relations=relations))


def test_markdown_corpus_and_rules(spark, tmp_path):
    write(tmp_path, "a/one.md", id="ENG-CMP-BUILD-0001", relations=[("PART_OF", "ENG-CMP-BUILD-0002"), ("PART_OF", "ENG-CMP-BUILD-0009")])
    write(tmp_path, "a/two.md", id="ENG-CMP-BUILD-0002", relations=[("PART_OF", "ENG-CMP-BUILD-0001")], status="deprecated")
    write(tmp_path, "a/twice.md", id="ENG-CMP-BUILD-0001")
    write(tmp_path, "docs/skipped.md", id="X")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "bad.md").write_text("---\n: [\n---\n")
    (tmp_path / "odd.md").write_text("---\nid: bad\nextra: 1\n---\n")
    objects = readers.markdown(spark, str(tmp_path)).cache()
    assert {r.path for r in objects.collect()} == {"a/one.md", "a/two.md", "a/twice.md", "bad.md", "odd.md"}
    assert objects.where("load_error is not null").count() == 1
    types = spark.createDataFrame([("Component", "CMP", "domain", ["language", "audience"], True)], "name string, code string, tag_strategy string, required_facets array<string>, engineering_only boolean")
    taxonomy = spark.createDataFrame([("t1", "Leaf", "engineering")], "id string, name string, scope string")
    domains = spark.createDataFrame([("build",)], "name string")
    facets = spark.createDataFrame([("language", ["en", "unknown"], False)], "name string, values array<string>, allows_none boolean")
    governance = spark.createDataFrame([("established", ["accepted"])], "status string, allowed_consensus array<string>")
    relations = spark.createDataFrame([("PART_OF", ["Component"], ["Component"], True, "HAS_PART")], "name string, source_types array<string>, target_types array<string>, dag boolean, inverse_view string")

    def codes(findings):
        return sorted((r.code, r.file) for r in findings.collect())

    assert codes(validate.schema_rules(objects)) == [("E000", "bad.md"), ("E000", "odd.md")]
    structural = codes(validate.structural_rules(objects, types, taxonomy))
    assert ("E005", "odd.md") in structural and ("W001", "odd.md") in structural and not any(f == "a/one.md" for _, f in structural)
    semantic = codes(validate.semantic_rules(objects, types, domains, facets, governance, "2026-01-01"))
    assert ("E014", "a/one.md") in semantic and ("E020", "a/one.md") in semantic and ("E027", "odd.md") in semantic
    assert codes(validate.cross_object_rules(objects)) == [("E001", "a/twice.md"), ("E009", "a/one.md"), ("W006", "a/one.md")]
    assert ("E010", "a/two.md") in codes(validate.cycle_rules(objects, relations))
    assert codes(validate.graph_rules(objects, relations)) == []


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="A">x</AbstractText><AbstractText Label="B">y</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="Y">M</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ReferenceList><Reference><ArticleIdList><ArticleId IdType="pubmed">9</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>""")
    rows = readers.articles(spark, str(tmp_path / "a.xml"))
    row = rows.first()
    assert (row.pmid, row.title, row.abstract, row.year, row.journal, row.citations) == (7, "T", "x y", 2001, "J", [9])
    assert row.mesh[0].ui == "D1" and row.mesh[0].major
    assert readers.article_edges(rows).count() == 3


def test_article_sections_corrections_and_objects(spark, tmp_path):
    def page(pmid, abstract="", more=""):
        return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><Title>Some J</Title></Journal><ArticleTitle/><Abstract>{abstract}</Abstract></Article>{more}</MedlineCitation></PubmedArticle>"

    abstract = '<AbstractText Label="Methods/results">a</AbstractText><AbstractText NlmCategory="AIM">b</AbstractText><AbstractText Label="METHODS/RESULTS"> c </AbstractText><AbstractText>d</AbstractText><AbstractText Label="E"> </AbstractText>'
    heading = "".join(f'<MeshHeading><DescriptorName UI="D{i}" MajorTopicYN="{"Y" if i % 2 else "N"}">H{i}</DescriptorName></MeshHeading>' for i in range(12))
    more = f'<CommentsCorrectionsList><CommentsCorrections RefType="ErratumFor"><PMID>5</PMID></CommentsCorrections><CommentsCorrections><PMID>x</PMID></CommentsCorrections><CommentsCorrections RefType="Cites"/></CommentsCorrectionsList><MeshHeadingList>{heading}</MeshHeadingList>'
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{page(7, abstract, more)}{page(8)}{page('no')}</PubmedArticleSet>")
    (tmp_path / "b.xml").write_text(f'<!DOCTYPE x [<!Entity a "b">]>\n<PubmedArticleSet>{page(9)}</PubmedArticleSet>')
    rows = readers.articles(spark, str(tmp_path))
    found = {r.pmid: r for r in rows.collect()}
    assert set(found) == {7, 8}
    assert [tuple(s) for s in found[7].sections] == [("METHODS/RESULTS", "c"), ("AIM", "b")] and found[7].abstract == "a b c d"
    assert [tuple(x) for x in found[7].corrections] == [("ErratumFor", "5"), ("CommentOn", "x")]
    assert found[8].title == "Untitled Article" and found[8].abstract == "" and found[8].sections == []
    assert [r.file.rsplit("/", 1)[-1] for r in readers.entity_files(spark, str(tmp_path)).collect()] == ["b.xml"]
    objects = {r.id: r for r in readers.article_objects(rows, "2026-03-01").collect()}
    one, two = objects["PERS-ART-MED_00000007-0001"], objects["PERS-ART-MED_00000008-0001"]
    assert one.aliases == ["PMID:7", "7", "H1", "H3", "H5", "H7"] and one.keywords == [f"h{i}" for i in range(10)] + ["some j"]
    assert [(r.type, r.target, r.soft_link) for r in one.relations] == [("SUPERSEDES", "PERS-ART-MED_00000005-0001", True)]
    assert one.raw_body == "# Untitled Article\n\n## Abstract\n\n### Methods/Results\n\nc\n\n### Aim\n\nb" and one.next_review == "2027-01-01"
    assert two.raw_body == "# Untitled Article\n\n*No abstract available.*" and two.aliases == ["PMID:8", "8"]


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"5": {"QUESTION": "q", "LABELS": ["L"], "CONTEXTS": ["c"]}, "x": {"QUESTION": "n"}}))
    assert [tuple(r) for r in readers.questions(spark, str(tmp_path / "q.json")).collect()] == [(5, "q", ["L"], ["c"])]


def test_questions_as_objects(spark):
    rows = spark.createDataFrame([(5, "Why??", ["A", "B", "A", "C"], ["x", "y", "z"]), (6, "Q", None, None)], "pubid long, question string, labels array<string>, contexts array<string>")
    found = {r.id[-13:-5]: r for r in readers.article_objects(readers.question_articles(rows), "2026-01-01").collect()}
    assert found["00000005"].raw_body == "# Why\n\n## Abstract\n\n### A\n\nz\n\n### B\n\ny" and found["00000005"].aliases == ["PMID:5", "5", "Biomedicine"]
    assert found["00000005"].keywords == ["biomedicine", "a"] and found["00000006"].keywords == ["biomedicine", "study"]


def test_scope_sources_and_cursors(spark, tmp_path):
    write(tmp_path, "a/one.md", id="X1")
    write(tmp_path, "docs/two.md", id="X2")
    (tmp_path / "CLAUDE.md").write_text("no")
    for name in ("p/a.py", "build/b.py", "p/dist/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("X = 1")
    assert [r.path for r in readers.markdown(spark, str(tmp_path), scope="a").collect()] == ["a/one.md"]
    assert [r.path for r in readers.markdown(spark, str(tmp_path), exclude=("a",)).collect()] == ["docs/two.md"]
    assert [r.path for r in readers.python_sources(spark, str(tmp_path)).collect()] == ["p/a.py"]
    first = spark.createDataFrame([(p, b"abc") for p in ("same", "more", "cut", "other")], "path string, content binary")
    none = spark.createDataFrame([], "path string, byte_offset long, file_sha256 string")
    start = readers.appended(first, none)
    assert {bytes(r.content) for r in start.collect()} == {b"abc"}
    then = spark.createDataFrame([("same", b"abc"), ("more", b"abcde"), ("cut", b"ab"), ("other", b"xbcd"), ("new", b"n"), ("void", b"")], "path string, content binary")
    assert {r.path: bytes(r.content) for r in readers.appended(then, start).collect()} == {"same": b"", "more": b"de", "cut": b"ab", "other": b"xbcd", "new": b"n", "void": b""}


def test_code_graph_and_changes(spark):
    sources = spark.createDataFrame([("p/a.py", "import os\nX = 1\nclass A:\n    def m(self):\n        return f()\ndef f():\n    return 1\n"), ("p/b.py", "from p.a import A\nclass B(A):\n    pass\n"), ("tests/t.py", "def test_f():\n    f()\n"), ("bad.py", "def (")], "path string, text string")
    nodes, edges = readers.code_graph(sources)
    kinds = {r.node_id: r.kind for r in nodes.collect()}
    assert kinds["p.a.A.m"] == "METHOD" and kinds["p.a.f"] == "FUNCTION" and kinds["tests.t.test_f"] == "TEST" and kinds["bad.py"] == "FILE"
    found = {(r.src, r.dst, r.type) for r in edges.collect()}
    assert {("p.b.B", "p.a.A", "INHERITS"), ("p.a.A.m", "p.a.f", "CALLS"), ("tests.t.test_f", "p.a.f", "TESTS_SYMBOL"), ("p.a", "os", "IMPORTS")} <= found
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string")
    assert {tuple(r) for r in readers.changed(old, new).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}


def test_ring_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"g": 1, "seq": i, "s": "x", "m": i == 3}) + "\n" for i in range(10)))
    events = guards.tail(spark, str(tmp_path / "in"), "g long, seq long, s string, m boolean")
    stream = guards.ring_stream(events, "g", "s", "m").writeStream.format("memory").queryName("rings").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(r.repeats for r in spark.table("rings").collect()) == [5, 6]
