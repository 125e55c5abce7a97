import corpus_pipeline
from conftest import SF


def test_stages_filter_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == cols and 0 < docs.count() <= n, name
        n = docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
