"""The pipeline's stages take effect and keep clean documents."""

import corpus_pipeline
from tests.llm.test_operators import odd, table, words


def test_stages(spark):
    clean = words(1, 200)
    texts = [clean, clean + " one more", "too short", "mail a@b.example.com " + words(2, 100), words(3, 90)]
    docs = table(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", "uid", "host"}, name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {0, 3, 4} and left[0] == clean and "<EMAIL>" in left[3] and left[4] == texts[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in pieces} == {0, 3, 4}


def test_odd_documents(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    docs.collect()
