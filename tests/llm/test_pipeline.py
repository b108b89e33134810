"""The pipeline: each stage on what its predecessor kept."""

from collections import Counter

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash", "pii", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "packing":
            assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            continue
        assert out.columns == columns and rows
        ids = Counter(r.doc_id for r in rows)
        assert set(ids) <= set(before) and (name == "mixing" or max(ids.values()) == 1)
        if name != "pii":
            assert all(r.text == before[r.doc_id] for r in rows)
        else:
            assert any("<EMAIL>" in r.text for r in rows)
        before = {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)


def test_run_equals_the_stages_and_handles_odd_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(None, None), (10**6, ""), (10**6 + 1, None), (10**6 + 2, "word " * 30_000)]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "kept", "x") for r in docs.collect()]
    rows += rows[:3] + [(i, t, None, None, None, None, "x") for i, t in odd]
    kind = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, _row string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        at = spark.createDataFrame(out.collect(), at.schema)
    pieces = lambda frame: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())
    got = corpus_pipeline.run(spark, str(tmp_path))
    expected = pieces(corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)))
    assert pieces(got) == expected and expected and not {None, 10**6, 10**6 + 1, 10**6 + 2} & {k[0] for k in expected}
    assert corpus_pipeline.ORACLE_SQL is None


def test_no_rows(spark, sf, tmp_path):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
