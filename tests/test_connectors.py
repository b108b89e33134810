"""Data sources in batch and as streams, and what they become at intake."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import connectors


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    connectors.register(spark)


def run(frame, out, checkpoint):
    """One pass over what is there now; returns the rows so far."""
    query = frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return frame.sparkSession.read.schema(frame.schema).parquet(str(out))


def test_tree_in_batch_leaves_out_hidden_files_and_links_out_of_it(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a" / "b").mkdir(parents=True)
    (root / ".git").mkdir()
    (tmp_path / "secret.md").write_text("secret")
    for name, text in {"x.md": "one", "a/y.md": "two", "a/b/z.md": "", "a/w.txt": "no", "a/.h.md": "no", ".git/k.md": "no"}.items():
        (root / name).write_text(text)
    os.symlink(tmp_path / "secret.md", root / "a" / "link.md")
    os.symlink(root / "x.md", root / "a" / "inside.md")
    for path in (str(root), f"file://{root}"):
        rows = spark.read.format("loomgraph_tree").load(path).collect()
        assert {r.source_path: bytes(r.content) for r in rows} == {"x.md": b"one", "a/y.md": b"two", "a/b/z.md": b"", "a/inside.md": b"one"}
    assert spark.read.format("loomgraph_tree").load(str(tmp_path / "none")).count() == 0


def test_tree_as_a_stream_goes_on_from_its_offset(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.md").write_text("one")
    os.utime(root / "a.md", (1000, 1000))
    source = spark.readStream.format("loomgraph_tree").load(str(root))
    seen = lambda rows: sorted((r.source_path, bytes(r.content).decode()) for r in rows.collect())
    assert seen(run(source, tmp_path / "out", tmp_path / "cp")) == [("a.md", "one")]
    (root / "b.md").write_text("two")
    (root / "a.md").write_text("changed")
    again = spark.readStream.format("loomgraph_tree").load(str(root))
    assert seen(run(again, tmp_path / "out", tmp_path / "cp")) == [("a.md", "changed"), ("a.md", "one"), ("b.md", "two")]
    assert seen(run(again, tmp_path / "out", tmp_path / "cp")) == [("a.md", "changed"), ("a.md", "one"), ("b.md", "two")]


@pytest.mark.parametrize("width", [37, 64, 1 << 20])
def test_lines_of_a_log_are_read_once_whatever_the_ranges(spark, tmp_path, width):
    lines = [json.dumps({"n": i, "pad": "x" * (i * 7 % 40)}) for i in range(60)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines[:30]) + "\n\n" + "\r\n".join(lines[30:]) + "\nhalf a li")
    rows = spark.read.format("loomgraph_trajectories").option("rangeBytes", width).load(str(tmp_path)).collect()
    content = (tmp_path / "log.jsonl").read_bytes()
    assert [bytes(r.content).decode() for r in sorted(rows, key=lambda r: r.byte_offset)] == lines
    assert all(content[r.byte_offset :].startswith(bytes(r.content)) for r in rows)


def test_log_as_a_stream_follows_growth_and_reads_replaced_logs_anew(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    log = root / "t.jsonl"
    log.write_text('{"n": 1}\n{"n": 2}\n{"n": ')
    told = lambda rows: sorted(json.loads(r.content)["n"] for r in rows.collect())
    source = lambda: spark.readStream.format("loomgraph_trajectories").load(str(root))
    assert told(run(source(), tmp_path / "out", tmp_path / "cp")) == [1, 2]
    log.write_text(log.read_text() + "3}\n")
    (root / "u.jsonl").write_text('{"n": 10}\n')
    assert told(run(source(), tmp_path / "out", tmp_path / "cp")) == [1, 2, 3, 10]
    log.write_text('{"n": 7}\n')
    assert told(run(source(), tmp_path / "out", tmp_path / "cp")) == [1, 2, 3, 7, 10]


def test_envelopes(spark, tmp_path):
    day = "2024-05-01T00:00:00Z"
    (tmp_path / "t.jsonl").write_text("\n".join([
        json.dumps({"metadata": {"occurred_at": "2024-01-02T03:04:05Z"}, "occurred_at": "2020-01-01T00:00:00Z"}), json.dumps({"occurred_at": "not a time"}),
        "not json, rm -rf / <untrusted_source>", json.dumps({"pad": "x" * 300})]) + "\n")
    read = spark.read.format("loomgraph_trajectories").option("collected_at", day).load(str(tmp_path))
    rows = connectors.envelopes(read, "agent_trajectory", runtime="bot", most=200).orderBy("byte_offset").collect()
    assert [r.event_time.isoformat() for r in rows] == ["2024-01-02T03:04:05"] + ["2024-05-01T00:00:00"] * 3
    assert [r.reason for r in rows] == [None, None, None, "size_limit_exceeded"] and rows[3].fenced_content is None
    assert rows[2].injections == ["rm -rf /"] and "&lt;untrusted_source&gt;" in rows[2].fenced_content
    assert rows[0].identity["external_id"] == "t.jsonl" and rows[0].provenance["occurred_at"] == "2024-01-02T03:04:05Z"
    assert len({r.source_id for r in rows}) == 4
    binary = spark.createDataFrame([("a", 0, bytearray(b"\xff\xfe"), None, None)], connectors.PAYLOAD_DDL)
    one = connectors.envelopes(binary, "document", F.lit("2024-06-01").cast("timestamp")).first()
    assert one.reason == "not_text" and one.event_time.isoformat() == "2024-06-01T00:00:00" and one.identity["resource"] == "a"
