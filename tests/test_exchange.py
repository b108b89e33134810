"""Bundles: round trip, and what a tolerant parse makes of broken ones."""

from loomgraph.operators import exchange
from loomgraph.sources import connectors


def test_round_trip(spark, tmp_path):
    kind = "id string, title string, taxonomy_path string, taxonomy_id string, object_type string, domain string, status string, evidence string, verification string, authority string, consensus string, confidence double, source_type string, relations array<struct<type:string,target:string>>, raw_body string"
    rows = [("A-1", 'T "q": x', "p", "TX-1", "Lesson", "d", "established", "e", "v", "a", "c", 0.25, "curated", [("CITES", "B-2")], "\n[b](B-2.md) é\n---\nmore"), ("B-2", "B", "p", "TX-1", "Article", "d", "archived", "e", "v", "a", "c", 1.0, "curated", [], "")]
    objects = spark.createDataFrame(rows, kind)
    for _ in range(2):
        exchange.write(exchange.text(objects), f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["A-1.md", "B-2.md"]
    connectors.register(spark)
    files = spark.read.format("loomgraph_tree").load(str(tmp_path / "out")).selectExpr("source_path as path", "content")
    found, findings = exchange.read(files)
    assert sorted(map(tuple, found.select(*objects.columns).collect())) == sorted(map(tuple, objects.collect()))
    assert [(r.level, r.code) for r in findings.collect()] == [("INFO", "no_index")]


def test_broken_bundles_are_taken_with_findings(spark):
    given = {"index.md": b"x", "sub/log.md": b"x", "notes.txt": b"x", "a.md": b"plain [l](gone.md) [m](/sub/b.md) [w](http://x/y.md)", "sub/b.md": b"---\ntype: Odd\nstatus: stable\nsources: [s1, {resource: s2}, {other: 1}]\ncolour: red\ngenerated: {by: me, at: 2024-01-02}\n---\nbody [a](a.md)", "c.md": b"---\n: [\n---\nrest", "d.md": b"\xff"}
    found, findings = exchange.read(spark.createDataFrame([(p, bytearray(c)) for p, c in given.items()], "path string, content binary"), "personal")
    got = {r.path: r for r in found.collect()}
    assert set(got) == {"a.md", "sub/b.md", "c.md"} and all(r.scope == "personal" for r in got.values())
    b = got["sub/b.md"]
    assert (b.id, b.object_type, b.status, b.source_refs, b.author, b.last_modified, b.extra_keys, b.confidence) == ("b", "Odd", "established", ["s1", "s2"], "me", "2024-01-02", ["colour"], 0.5)
    assert {(r.level, r.file, r.code, r.detail) for r in findings.collect()} == {
        ("WARNING", "a.md", "no_head", None), ("WARNING", "a.md", "broken_link", "gone.md"), ("WARNING", "c.md", "malformed_head", None), ("ERROR", "d.md", "unreadable", None), ("INFO", "sub/b.md", "unknown_fields", "colour"),
        *(("INFO", p, "no_extension", None) for p in ("a.md", "sub/b.md", "c.md"))}
    empty, told = exchange.read(spark.createDataFrame([], "path string, content binary"))
    assert empty.count() == 0 and [r.code for r in told.collect()] == ["no_index"]
