"""The pipeline's stages on a small input."""

import pytest

import corpus_pipeline
from lawloom.llm import decontamination, sharding


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    junk = [(200 + i, "JUNK!! " * 40, "en", "src1", 1) for i in range(30)]
    spark.createDataFrame(junk, docs.schema).write.mode("append").parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 60] + [(j[0], 0, 0) for j in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, " ".join((rows[4][1] or "").split()[3:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(200, 230)) and len(ids & set(range(60))) > 50
    single = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert single.count() < kept.count() and single.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, single, sf_dir)
    assert decontamination.find_overlaps(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir)
    assert mixed.columns == docs.columns and 0 < mixed.count()
    n = mixed.count()
    out = corpus_pipeline.shard(spark, mixed, sf_dir).collect()
    assert len(out) == n and {r["law"] for r in out} == {"rows"}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).columns
    assert out.count() > 10
