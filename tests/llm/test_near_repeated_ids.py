"""The near-duplicate stage on tables that repeat ids."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_other_texts_of_an_id_stay(spark):
    random.seed(3)
    text = lambda: " ".join("".join(random.choice("abcdefghiklmnorstu") for _ in range(random.randint(3, 8))) for _ in range(400))
    one, unique, twice = text(), text(), text()
    rows = [(1, one), (5, one + " x"), (5, unique), (5, unique), (7, twice), (7, twice + " y"), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.unlike_documents(spark, docs, "").collect()]
    sevens = [t for i, t in got if i == 7]
    assert sorted((i, t) for i, t in got if i not in (7, None)) == sorted([(1, one), (5, unique), (5, unique)])
    assert len(sevens) == 1 and sevens[0] in (twice, twice + " y") and (None, one) in got
