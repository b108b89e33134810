"""Migration against plain rules, twice over the same files, and with changed and colliding ones."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import migration
from loomgraph.operators.store import Conflict
from loomgraph.sources import readers

NOW = "2024-03-01T00:00:00Z"


@pytest.fixture(scope="module")
def registries(spark):
    types = spark.createDataFrame([("Article", "ART", "domain"), ("Journal", "JRN", "year")], "name string, code string, tag_strategy string")
    taxonomy = spark.createDataFrame([("TX-ENG-01", "root", "engineering"), ("TX-PERS-01", "own", "personal")], "taxonomy_id string, name string, scope string")
    return types, taxonomy, ("software_engineering",), NOW


def files(spark, **given):
    rows = [(k.replace("__", "/") + ".md", v if isinstance(v, bytes) else v.encode()) for k, v in given.items()]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_parse_has_two_outcomes(spark, registries):
    given = files(
        spark, a="---\nscope: engineering\ntitle: 'A: b'\nauthor: Jo Doe\nconfidence: 0.25\nsource_refs: [x, x, y]\nkeywords: a, b\n---\n\n See [[b|label]] [[ENG-ART-KEPT-0001]] [[none]]\n", b="no head", c="--- one --- two",
        d=b"\xff", e="---\nscope: shared\n---\n", sub__README="---\n---\n", f="---\nid: ENG-ART-KEPT-0001\nscope: engineering\ntaxonomy_id: TX-PERS-01\nobject_type: Odd\nconfidence: many\n---\n", g="---\nx: !!python/object:os.system {}\n---\n")
    rows = migration.parsed(given, migration.Mapping(), *registries)
    got = {r.path: r for r in rows.collect()}
    assert {p: r.reason for p, r in got.items()} == {
        "a.md": None, "b.md": "missing_frontmatter", "c.md": "malformed_metadata", "d.md": "unicode_decode_error", "e.md": "ambiguous_scope", "sub/README.md": "excluded", "f.md": None, "g.md": "malformed_metadata"}
    a, f = got["a.md"], got["f.md"]
    assert (a.title, a.author, a.confidence, a.source_refs, a.legacy_tags, a.body) == ("A: b", "human:jo_doe", 0.25, ["x", "y"], ["a", "b"], "See [[b|label]] [[ENG-ART-KEPT-0001]] [[none]]")
    assert a.id.startswith("ENG-ART-A_B-") and (f.id, f.taxonomy_id, f.object_type, f.confidence, f.author, f.source_refs) == ("ENG-ART-KEPT-0001", "TX-ENG-01", "Article", 0.5, "process:migration", ["f.md"])
    counted = migration.counts(rows).first()
    assert tuple(counted) == (8, 2, 1, 5) and migration.quarantine(rows).count() == 5
    links = {(r.raw_link, r.target) for r in migration.link_proposals(migration.objects(rows)).collect()}
    assert links == {("b", None), ("ENG-ART-KEPT-0001", "ENG-ART-KEPT-0001"), ("none", None)}
    facets = spark.createDataFrame([("language", ["a", "en"]), ("other", ["z"])], "name string, values array<string>")
    assert {tuple(r)[1:] for r in migration.facet_proposals(migration.objects(rows), facets).collect()} == {("a", "language", True), ("a", "other", False), ("b", "language", False), ("b", "other", False)}


def test_derived_mode_strips_names(spark, registries):
    rows = migration.parsed(files(spark, x_y="%docTitle: My Doc\n%docResp: Jo Doe\ntext", z="# Top\nbody", some_note="plain"), migration.Mapping(derived=True, scope="personal"), *registries).collect()
    assert {(r.path, r.title) for r in rows} == {("x_y.md", "My Doc"), ("z.md", "Top"), ("some_note.md", "Some Note")}
    assert all("Jo" not in r.body and r.source_refs == [r.path] for r in rows)


def test_execution_is_safe_to_repeat(spark, registries, tmp_path):
    head = "---\nscope: engineering\ntitle: {}\nid: {}\n---\n{}"
    first = files(spark, a=head.format("'Q \"x\": y'", "ENG-ART-A-0001", "one"), b=head.format("B", "ENG-ART-B-0001", "two"))
    made = lambda given: migration.written(migration.objects(migration.parsed(given, migration.Mapping(), *registries)))
    path = f"file://{tmp_path}/out"
    done = migration.execute(spark, made(first), path)
    assert (done.revision, done.inserted) == (1, 2)
    again = migration.execute(spark, made(first), path)
    assert (again.revision, again.inserted, again.repeated) == (1, 0, 2)
    more = files(spark, c=head.format("C", "ENG-ART-C-0001", "x"))
    assert migration.execute(spark, made(more), path).revision == 2
    changed = made(files(spark, a=head.format("A", "ENG-ART-A-0001", "changed"), d=head.format("D", "ENG-ART-A-0001", "x")))
    with pytest.raises(Conflict):
        migration.execute(spark, changed, path)
    manifest = made(first).select("target", "source", "digest")
    assert {r.action for r in migration.plan(made(first), manifest).collect()} == {"same"}
    assert {(r.source, r.action) for r in migration.plan(changed, manifest).collect()} == {("a.md", "collision"), ("d.md", "collision")}
    one = made(files(spark, a=head.format("A", "ENG-ART-A-0001", "changed"), e=head.format("E", "ENG-ART-E-0001", "")))
    assert {(r.source, r.action) for r in migration.plan(one, manifest).collect()} == {("a.md", "changed"), ("e.md", "write")}
    row = made(first).where("source = 'a.md'").first()
    back = readers.parse_objects(spark.createDataFrame([(row.target, row.content)], "path string, text string")).first()
    assert (back.id, back.title, back.raw_body, back.source_refs, back.load_error) == ("ENG-ART-A-0001", 'Q "x": y', "one", ["a.md"], None)


def test_a_link_that_all_files_have_is_many_shares(spark):
    found = spark.range(400).select(F.format_string("n/n_%d.md", "id").alias("path"), F.format_string("ID-%d", "id").alias("id"), F.array(F.lit("Lost"), F.lit("n_7")).alias("wikilinks"))
    shares = migration.link_proposals(found)
    got = shares.collect()
    assert {(r.raw_link, r.target) for r in got} == {("Lost", None), ("n_7", "ID-7")} and len(got) == 800
    assert "_salt" in shares._jdf.queryExecution().optimizedPlan().toString()
