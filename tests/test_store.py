"""The staged table against an in-memory twin, and what crashes and races leave."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.store import Conflict, Damaged, StagedTable

SCHEMA = "id long, status string, digest string"


@pytest.fixture
def staged(spark, tmp_path):
    return StagedTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", "digest", ("status",))


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def test_twin(spark, staged):
    rng, twin, revision = random.Random(4), {}, 0
    for step in range(8):
        batch = [(i, rng.choice("ab"), f"h{i}") for i in rng.choices(range(14), k=rng.randrange(5))]
        batch = [(i, twin[i][0] if i in twin else s, h) for i, s, h in batch]
        bad = step in (3, 6)
        if bad:
            batch = [*batch, (99, "a", "x"), (99, "a", "y")] if step == 3 or not twin else [*batch, (min(twin), "a", "other")]
            with pytest.raises(Conflict):
                staged.commit(rows(spark, *batch), expected=revision)
        else:
            done = staged.commit(rows(spark, *batch).withColumn("more", F.lit(1)), expected=revision)
            new = {i for i, *_ in batch} - set(twin)
            assert (done.inserted, done.repeated) == (len(new), len(batch) - len(new))
            first = {}
            for i, s, h in batch:
                first.setdefault(i, (s, h))
            # Of rows that repeat a new key any may stay; they differ in status only.
            twin |= {i: first[i] for i in new}
            revision += bool(new)
        got = {r.id: (r.status, r.digest) for r in staged.read().collect()}
        assert {i: h for i, (_, h) in got.items()} == {i: h for i, (_, h) in twin.items()}
        twin = got
        assert staged.revision() == revision and staged.count() == len(twin)
        assert [r.id for r in staged.listed(status="a").collect()] == sorted(i for i, (s, _) in twin.items() if s == "a")
        assert {k: v for k, v in staged.manifest()["counts"]["status"].items() if v} == {s: n for s in "ab" if (n := sum(x == s for x, _ in twin.values()))}
    assert {r.id for r in staged.get(*list(twin)[:2]).collect()} == set(list(twin)[:2])
    before = staged.revision()
    assert staged.compact() == before + 1 and {r.id for r in staged.read().collect()} == set(twin)
    assert staged.read(1).count() <= len(twin) and StagedTable(spark, staged.path, SCHEMA, "id", "digest").count() == len(twin)


def test_empty_and_unexpected_revision(spark, staged):
    assert staged.read().count() == 0 and staged.count() == 0
    assert staged.commit(rows(spark)).revision == 0
    staged.commit(rows(spark, (1, "a", "h")))
    with pytest.raises(Conflict):
        staged.commit(rows(spark, (2, "a", "h")), expected=0)
    assert staged.commit(rows(spark, (1, "a", "h"))) == staged.commit(rows(spark, (1, "a", "h")), expected=1)


def test_a_commit_between_wins_and_the_late_one_changes_nothing(spark, staged):
    other = StagedTable(spark, staged.path, SCHEMA, "id", "digest", ("status",))
    put, staged._put = staged._put, lambda m: (other.commit(rows(spark, (5, "b", "h5"))), put(m))
    with pytest.raises(Conflict):
        staged.commit(rows(spark, (1, "a", "h1")))
    staged._put = put
    assert [r.id for r in staged.read().collect()] == [5]
    assert staged.recover() == {"manifests": 0, "folders": 1} and staged.read().count() == 1


def test_torn_writes_are_never_read(spark, staged, tmp_path):
    staged.commit(rows(spark, (1, "a", "h1")))
    whole, staged._put = staged._put, lambda m: 1 / 0  # the process ends before the manifest is there
    with pytest.raises(ZeroDivisionError):
        staged.commit(rows(spark, (2, "a", "h2")))
    staged._put = whole
    (tmp_path / "t/manifests/.half").write_text('{"rev')
    assert [r.id for r in staged.read().collect()] == [1]
    assert staged.recover() == {"manifests": 1, "folders": 1}
    (tmp_path / "t/manifests/000000000002.json").write_text('{"rev')
    with pytest.raises(Damaged):
        staged.read()
    assert staged.recover() == {"manifests": 1, "folders": 0} and staged.count() == 1
    part = next((tmp_path / "t/data").glob("*/part-*"))
    part.write_bytes(part.read_bytes()[:-5])
    with pytest.raises(Damaged):
        staged.read()


def test_a_stream_counts_each_batch_once(spark, staged, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        rows(spark, (i, "a", f"h{i}"), (0, "a", "h0")).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    query = source.writeStream.foreachBatch(staged.writer("s")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.id for r in staged.read().collect()) == [0, 1, 2]
    before = staged.revision()
    staged.writer("s")(rows(spark, (9, "a", "h9")), 0)  # a batch that comes again
    assert staged.revision() == before and staged.count() == 3
