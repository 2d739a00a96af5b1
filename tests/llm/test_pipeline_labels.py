"""The toxicity stage with labels that teach nothing."""

import pytest

import corpus_pipeline


@pytest.mark.parametrize("grades", [[], [1] * 20, [0] * 20, [None, 7]])
def test_nothing_is_dropped_without_lessons(spark, documents, tmp_path, grades):
    labels = [(i, 1, grade) for i, grade in enumerate(grades)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(*[(i, f"text {i}") for i in range(20)], (None, None))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 21
