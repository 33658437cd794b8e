"""The pipeline's stages, each against what its operator says of its input."""

import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= seen.count()
        assert out.select("doc_id").subtract(seen.select("doc_id")).count() == 0
        seen = out
    assert seen.where("text like '%token = \"%'").count() == 0
    last = pipeline.STAGES[-1][1](spark, seen, sf)
    assert last.count() == seen.count() and last.where("n_tokens > 0").count() > 0


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 100


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf) if docs.columns[-1] == "n_chars" else docs
    assert docs.count() == 0


def test_contaminated_rows_go_by_their_own_hits(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "x a b c y"), (None, "clean"), (1, "a b c"), (1, "clean"), (2, None)], "doc_id bigint, text string")
    left = pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, "clean"), (1, "clean"), (2, "")]


def test_stages_read_small_batches(spark, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "repeat('a', if(id < 500, 50000, 1)) as text", "'en' as lang", "'x' as source", "0 as n_chars")
    names = list(pipeline.BATCHES)
    for _, stage in (pipeline.STAGES[3], pipeline.STAGES[4]):
        for name in names:
            spark.conf.unset(name)
        try:
            stage(spark, docs, str(tmp_path))
            seen = docs.select("text").mapInArrow(sizes, "rows bigint, bytes bigint").collect()
        finally:
            for name in names:
                spark.conf.unset(name)
        assert sum(r.rows for r in seen) == 2500
        assert max(r.rows for r in seen) <= 1_000 and max(r.bytes for r in seen) < 5_000_000
    for name, less in zip(names, ("10", "1m"), strict=True):
        spark.conf.set(name, less)
        try:
            pipeline.STAGES[4][1](spark, docs, str(tmp_path))
            assert spark.conf.get(name) == less
        finally:
            for other in names:
                spark.conf.unset(other)
