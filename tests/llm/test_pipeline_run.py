from __future__ import annotations

import corpus_pipeline


def test_stages_read_what_the_one_before_wrote(spark, sf_dir, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.filter(f"doc_id % {len(read) + 1} = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    out = corpus_pipeline.run(spark, sf_dir)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 12 = 0")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert all(shared not in f for f in read[0])
    assert all(files and all(shared in f for f in files) for files in read[1:])


def test_whole_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
