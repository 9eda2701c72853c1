"""The pipeline's stages on a small table, against what each should keep."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE.upper(), "en", "a", 1), (3, BASE + " more", None, "a", 1), (4, "quite other words here now and then again", "en", None, 1),
        (5, "password = hunter2hunter and some more text about it", "en", "a", 1), (6, None, "en", "a", 0), (7, "123 456", "en", "a", 1), (4, "quite other words here now and then again", "en", None, 1),
    ]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [[1, 2, 3, 4, 4, 5], [1, 3, 4, 5], [1, 4, 5], [1, 4]]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(r.doc_id for r in docs.collect()) == ids, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted(r.doc_id for r in packed.collect()) == [1, 4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_keeps_documents_where_nothing_was_learned(spark):
    rows = [(1, BASE, None, "a", 1), (2, "漢字 12", None, "a", 1), (3, "123 456", None, "a", 1), (4, None, None, "a", 0), (5, "", None, None, 0)]
    kept = corpus_pipeline.identified(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, kept.collect())) == [tuple(r) for r in rows[:2]]
