import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_in_order_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("kept"))
    columns = docs.columns
    sizes = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        path = f"file://{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if n < 4:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_stages_on_awkward_and_empty_tables(spark, docs, labels, tmp_path):
    """Null, empty, very long and repeated texts pass every stage; no rows give no rows."""
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    for name, frame in (("awkward", docs), ("empty", docs.limit(0))):
        stage_docs = frame
        for n, (stage, run) in enumerate(corpus_pipeline.STAGES):
            stage_docs = run(spark, stage_docs, folder)
            path = f"{folder}/{name}-{stage}"
            stage_docs.write.parquet(path)
            stage_docs = spark.read.schema(stage_docs.schema).parquet(path)
            if n < 4:
                assert stage_docs.columns == docs.columns
        assert stage_docs.count() == 0 or name == "awkward"
