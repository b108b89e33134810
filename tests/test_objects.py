"""Operators over objects that no query reaches, against plain expectations."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import rules, text as X
from loomgraph.operators import bundles, discovery, fusion, graph, hybrid, lexical, lifecycle, validate, vectors
from loomgraph.session import shared_folder


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


BODY = "intro\n## A\nfirst\n\n## B\nsecond\n## A\nlast\n"


def test_sections_and_lines(spark):
    assert one(spark, BODY, lambda t: rules.section(t, F.lit("B"))) == "second"
    assert one(spark, BODY, lambda t: rules.section(t, F.lit("none"))) is None
    mapped = spark.createDataFrame([(BODY,)], "t string").select("t", X.section_map(F.col("t")).alias("m"))
    assert mapped.select(rules.sections(F.col("t"), F.col("m")).alias("x")).first().x == {"A": "last", "B": "second"}
    assert one(spark, BODY, lambda t: rules.line_slice(t, F.lit(2), F.lit(3))) == "## A\nfirst"
    assert one(spark, BODY, lambda t: rules.line_slice(t, F.lit(9), F.lit(9))) is None
    assert one(spark, "3-7", lambda t: rules.line_range(t)["end"]) == 7 and one(spark, "x-7", rules.line_range) is None


def test_diagrams_links_and_citations(spark):
    body = "a\n```mermaid\ngraph TD\n A-->B\n```\nb\n```mermaid\nnonsense\n```\nc $1"
    out = one(spark, body, rules.degrade_diagrams)
    assert out.startswith("a\n```mermaid\ngraph TD\n A-->B\n```\nb\n<!-- LINT_FAILURE: mermaid syntax error: unrecognized") and out.endswith("```text\nnonsense\n```\nc $1")
    assert one(spark, "plain", rules.degrade_diagrams) == "plain"
    assert one(spark, "[[a/b|x]] [[c d]]", rules.intake_links) == ["a/b"] and one(spark, "[[a/b|x]] [[ c d ]]", rules.migration_links) == ["a/b", "c d"]
    assert one(spark, "so [12] and [13].", lambda t: rules.strip_citations(t, F.array(F.lit("12")))) == "so [12] and."


def test_signed_embedding_is_of_unit_length(spark):
    embed = rules.signed_embedder(16)
    x = spark.createDataFrame([("one two",), ("",)], "t string").select(embed("t").alias("v")).collect()
    assert sum(a * a for a in x[0].v) == pytest.approx(1) and x[1].v == pytest.approx([0.25] * 16)


def test_rename_keeps_labels(spark):
    objects = spark.createDataFrame([("A", "see [[A]] and [[ A | label]] not [[AB]]")], "id string, body string")
    relations = spark.createDataFrame([("A", "X", "B"), ("B", "X", "A")], "src string, type string, dst string")
    moved, edges = discovery.rename(objects, relations, "A", "N")
    assert tuple(moved.first()) == ("N", "see [[N]] and [[N|label]] not [[AB]]")
    assert {tuple(r) for r in edges.collect()} == {("N", "X", "B"), ("B", "X", "N")}


def test_references_make_few_windows(spark, monkeypatch):
    """Only windows that end like a path are joined; the same pairs are found where ends are too many for that."""
    refs = spark.createDataFrame([("o1", "repo/src/p_17.py#3"), ("o2", "x/src/p_1.py and p_2"), ("o3", "é"), ("o4", None), ("o5", "a")], "id string, r string")
    paths = ["src/p_17.py", "src/p_1.py", "a/very/long/path/src/p_17.py", "p_2", "é", "a", ""]
    files = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(paths)], "node_id string, term string")
    expected = {(i, f"f{j}") for i, r in [tuple(x) for x in refs.collect()] if r for j, p in enumerate(paths) if p and p in r}
    for most in (1000, 2):
        monkeypatch.setattr(discovery, "MOST_ENDS", most)
        found = discovery._contained(refs, files)
        assert {(r.id, r.node_id) for r in found.collect()} == expected
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_bridges_of_paths_and_dotted_names(spark):
    nodes = spark.createDataFrame([("f1", "FILE", "util.py", "pkg/util.py"), ("s1", "CLASS", "pkg.util.Loader", "pkg/util.py"), ("s2", "FUNCTION", "run", "pkg/util.py")], "node_id string, kind string, name string, path string")
    objects = spark.createDataFrame([("o1", "uses pkg/util.py and pkg.util.Loader to run", []), ("o2", "pkg.util.Loaders", ["repo/pkg/util.py"])], "id string, body string, source_refs array<string>")
    assert {(r.object_id, r.node_id, r.bridge_type) for r in discovery.code_bridges(objects, nodes).collect()} == {("o1", "f1", "represented_by"), ("o1", "s1", "documents"), ("o2", "f1", "represented_by")}


def test_refresh_takes_changed_files_only(spark):
    kind = "path string, node string"
    stored = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], kind)
    fresh = spark.createDataFrame([("a", "new"), ("b", "new"), ("d", "new")], kind)
    digests = "path string, digest string"
    changes = discovery.index_changes(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], digests), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], digests))
    assert {tuple(r) for r in discovery.refreshed(stored, changes, fresh).collect()} == {("a", "old"), ("b", "new"), ("d", "new")}


def test_firewall_and_fingerprint(spark):
    objects = spark.createDataFrame([("a", "personal", "T-1", "0.5", None, None, ["x"]), ("b", "engineering", "T-1-2", "0.9", "2020-01-01", None, ["y", "z"]), ("c", None, None, "odd", None, None, None)],
                                    "id string, scope string, taxonomy_id string, confidence string, valid_from string, valid_until string, language array<string>")
    with pytest.raises(bundles.CrossScope):
        bundles.select(objects, scopes=("personal",))
    assert [r.id for r in bundles.select(objects, taxonomy=("T-1",), valid_at="2021-01-01", facets={"language": ["z"]}).collect()] == ["b"]
    assert {r.id for r in bundles.select(objects).collect()} == {"b", "c"} and bundles.select(objects, scopes=("personal",), allow_personal=True).count() == 1
    assert bundles.fingerprint({"a": [2, 1], "b": None}) == bundles.fingerprint({"b": None, "a": [1, 2]})


def test_gates_look_for_paths_only_where_enforced(spark):
    objects = spark.createDataFrame([("X-1", "alpha beta", "", " "), ("X-2", "gamma", "", "text"), ("X-3", "delta", "", "text")], "id string, title string, status string, body string")
    none = F.lit(None).cast("array<string>")
    objects = objects.withColumns({"keywords": none, "aliases": none, "taxonomy_path": F.lit(None).cast("string")})
    relations = spark.createDataFrame([("X-1", "CITES", "X-2")], "src string, type string, dst string")
    queries = spark.createDataFrame([(1, "alpha x-1 x-2"), (2, "alpha x-1 x-3"), (3, "alpha"), (4, "unheard")], "query_id int, query string")
    found = spark.createDataFrame([(1, "X-2"), (2, "X-2"), (3, "X-1"), (4, "X-2")], "query_id int, id string")
    terms = hybrid.vocabulary(objects)
    got = {r.query_id: r.reason for r in hybrid.gates(queries, found, objects, terms, relations, enforce=True).collect()}
    assert got == {1: None, 2: "NO_ADMISSIBLE_PATH", 3: "EMPTY_BODY_TERMINAL", 4: "UNGROUNDED_DESCRIPTOR"}
    assert {r.retrieval_status for r in hybrid.gates(queries, found, objects, terms, relations).collect()} == {"ADMISSIBLE"}


def test_cited_spans_follow_locations(spark):
    refs = spark.createDataFrame([(1, 0, "e.yaml"), (1, 1, "b"), (1, 2, "lost")], "claim_id int, ord int, path string")
    captures = spark.createDataFrame([("e.yaml", "unit", "raw"), ("raw", "R" * 10, None), ("b", "B", "e.yaml")], "path string, text string, location string")
    got = [(r.n, r.path, r.text) for r in hybrid.cited_spans(refs, captures, chars=4).orderBy("n").collect()]
    assert got == [(1, "e.yaml", "unit"), (2, "b", "B"), (3, "raw", "RRRR")]
    claims = spark.createDataFrame([(1, "alpha beta"), (2, "x")], "claim_id int, claim string")
    flags = {r.claim_id: r.flag for r in hybrid.pre_scored(claims, spark.createDataFrame([(1, "alpha beta")], "claim_id int, text string")).collect()}
    assert flags == {1: "PRE_SCORE_PASSED", 2: "PRE_SCORE_UNAVAILABLE"}
    assert hybrid.parameters({"k": 3}, {"k": 4, "d": 2}, {"k": 1, "d": 1, "m": 1}) == {"k": (3, "given"), "d": (2, "config"), "m": (1, "default")}


def test_stores_check_what_they_read(spark):
    path = f"{shared_folder(spark)}/stores"
    vectors.write_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>"), f"{path}/v", "m", 2, "h")
    rows, fresh = vectors.read_vectors(spark, f"{path}/v", "m", 2, "h")
    assert fresh and rows.count() == 1 and not vectors.read_vectors(spark, f"{path}/v", "other", 2)[1]
    with pytest.raises(Exception, match="wrong length"):
        vectors.write_vectors(spark.createDataFrame([(1, [1.0, 1.0])], "vec_id long, embedding array<double>"), f"{path}/w", "m", 2, "h")
    nodes, edges = graph.compressed(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), (None, "c")], "u string, v string"), directed=False)
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1), (1, 0), (1, 1)]
    graph.write_compressed(nodes, edges.where("u = 0"), f"{path}/g")
    with pytest.raises(ValueError, match="bad_degrees"):
        graph.read_compressed(spark, f"{path}/g")


def test_sinks_are_repeatable(spark):
    path = f"{shared_folder(spark)}/sinks"
    rows = spark.createDataFrame([("b", "T2", "two"), ("a", "T1", None)], "id string, title string, body string")
    bundles.write_markdown(rows, f"{path}/md")
    assert spark.read.text(f"{path}/md/a.md", wholetext=True).first().value == '---\nid: ["a"]\ntitle: ["T1"]\n---\n\n\n'
    bundles.write_json(rows, f"{path}/json", "id")
    assert [r.value for r in spark.read.text(f"{path}/json").collect()][0].startswith('{"id":"a"') or spark.read.json(f"{path}/json").count() == 2
    assert [r.id for r in bundles.by_length(rows.withColumn("n", F.length("title")), "n", "id").collect()] == ["a", "b"]


def test_conflicts_leave_others_alone(spark):
    plan = fusion.resolve_conflicts(spark.range(3).select(F.col("id").cast("string").alias("id"), *[F.lit("x").alias(c) for c in ("verification", "authority", "consensus", "evidence", "confidence", "last_verified")]),
                                    spark.createDataFrame([("0", "1")], "u string, v string"))
    assert "Window" not in plan._jdf.queryExecution().toString() and {(r.id, r.suppressed_by) for r in plan.collect()} == {("0", None), ("1", "0"), ("2", None)}


def test_cursors_move_forward(spark):
    kind = "source string, position long"
    got = lifecycle.cursors(spark.createDataFrame([("a", 5), ("b", 1)], kind), spark.createDataFrame([("a", 3), ("c", 2)], kind))
    assert {tuple(r) for r in got.collect()} == {("a", 5), ("b", 1), ("c", 2)}


def test_index_text_and_placement(spark):
    rows = spark.createDataFrame([("T", ["al"], None, "body")], "t string, a array<string>, k array<string>, b string")
    assert rows.select(lexical.object_text(*map(F.col, "takb")).alias("x")).first().x.split() == ["T", "T", "al", "body"]
    objects = spark.createDataFrame([("engineering/a/ID.md", "ID", "X"), ("engineering/b/ID.md", "ID", "X")], "path string, id string, taxonomy_id string")
    found = validate.placement_rules(objects, spark.createDataFrame([("X", "engineering/a/")], "taxonomy_id string, folder string"))
    assert [r.file for r in found.collect()] == ["engineering/b/ID.md"]
