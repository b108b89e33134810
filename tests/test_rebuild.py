"""Artefacts: only what changed is built again."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import rebuild


def test_only_stale_buckets_are_built(spark, tmp_path):
    path, calls = f"file://{tmp_path}/a", []

    def build(rows):
        calls.append(1)
        return rows.select("bucket", "path", F.upper("digest").alias("seen"))

    def files(**given):
        return spark.createDataFrame([(p, d) for p, d in given.items()] or [("x", "x")], "path string, digest string").where("true" if given else "false")

    def seen():
        return {r.path: r.seen for r in rebuild.load(spark, path).collect()}

    with pytest.raises(FileNotFoundError):
        rebuild.load(spark, path)
    corpus = {f"f{i}": f"h{i}" for i in range(40)}
    built = rebuild.rebuild(files(**corpus), build, path, 8)
    assert built == list(range(8)) and seen() == {p: d.upper() for p, d in corpus.items()}
    tree = sorted(p for p in (tmp_path / "a").rglob("*"))
    assert rebuild.rebuild(files(**corpus).repartition(5), build, path, 8) == [] and len(calls) == 1
    assert sorted(p for p in (tmp_path / "a").rglob("*")) == tree
    corpus["f3"] = "changed"
    assert len(rebuild.rebuild(files(**corpus), build, path, 8)) == 1 and seen() == {p: d.upper() for p, d in corpus.items()}
    corpus["new"] = "n"
    corpus.pop("f7")
    assert 1 <= len(rebuild.rebuild(files(**corpus), build, path, 8)) <= 2 and seen() == {p: d.upper() for p, d in corpus.items()}
    assert rebuild.rebuild(files(**corpus), build, path, 4) == [0, 1, 2, 3] and seen() == {p: d.upper() for p, d in corpus.items()}
    rebuild.rebuild(files(), build, path, 4)
    assert seen() == {}


def test_several_artefacts(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", "h") for i in range(9)], "path string, digest string")
    artefacts = {"paths": (lambda r: r.select("bucket", "path"), 4), "count": (lambda r: r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), 1)}
    path = f"file://{tmp_path}/all"
    assert set(rebuild.rebuild_all(files, artefacts, path)["count"]) == {0}
    assert rebuild.rebuild_all(files, artefacts, path) == {"paths": [], "count": []}
    more = files.union(spark.createDataFrame([("g", "h")], "path string, digest string"))
    done = rebuild.rebuild_all(more, artefacts, path)
    assert len(done["paths"]) == 1 and done["count"] == [0] and rebuild.load(spark, f"{path}/count").first().n == 10
