"""Empty tables through every query and the pipeline, and texts of over a megabyte."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from stampline.llm import decontaminate, language, licenses, packing, queries, quality, secrets, simhash, substring


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_texts_of_a_megabyte(spark, data):
    text = " ".join(f"word{i} of" for i in range(130_000)) + ' password = "abc123def" end.'
    n = len(text.split())
    assert len(text) > 1_200_000
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, text, "en", "a"), (3, "short and different", "en", "b")], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([("i", "word129990 of word129991 of word129992 of word129993 of word129994 of"), ("j", "not in there")], "item_id string, text string")
    by = lambda frame, *names: {r["doc_id"]: tuple(r[c] for c in names) for r in frame.collect()}
    assert by(decontaminate.contamination(docs, items), "n_words", "n_hit") == {1: (260003, 10), 2: (260003, 10), 3: (3, 0)}
    assert by(simhash.classes(docs), "component_id") == {1: (1,), 2: (1,), 3: (3,)}
    assert by(substring.remove_repeats(docs), "n_words", "n_removed") == {1: (n, n), 2: (n, n), 3: (3, 0)}
    assert by(secrets.find_secrets(docs).select("doc_id", F.size("found").alias("n")), "n") == {1: (1,), 2: (1,), 3: (0,)}
    assert "abc123def" not in secrets.redact(docs).filter("doc_id = 1").first()["text"]
    ids = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"))
    got = by(ids, "n")
    assert got[1] == got[2] and got[1][0] > 260_000
    assert by(licenses.scan(docs), "n_words")[1] == (260003,)
    base = spark.read.parquet(f"{data}/documents.parquet")
    assert by(language.predict(docs, language.fit(base)), "lang_pred")[1] == by(language.predict(docs, language.fit(base)), "lang_pred")[2]
    scored = by(quality.score(docs, quality.fit(base, spark.read.parquet(f"{data}/labels.parquet"))), "score", "predicted")
    assert scored[1] == scored[2] and 0 <= scored[1][0] <= 1
