"""Inverse text normalisation of whole texts: the query over every document, and traced strings."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from stampline.operators import itn
from stampline.plans.queries import QUERIES

TRACED = {
    "twenty twenty two": "2022", "one hundred dollars": "$100", "five point five percent": "5.5%", "": "", "nothing here": "nothing here",
    "it was three hundred and he left. Then two thousand five came.": "it was 300 and he left. Then 2005 came.",
}


def plain(text):
    if text is None or not text.strip():
        return text
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    if len(parts) < 2:
        words = text.split()
        parts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    return " ".join(itn.normalise(p) for p in parts)


def test_traced(spark):
    rows = list(enumerate([*TRACED, " ".join(["w"] * 49 + ["twenty", "two"]), None]))
    got = spark.createDataFrame(rows, "id int, text string").select("id", itn.apply(F.col("text")).alias("text")).collect()
    assert {r["id"]: r["text"] for r in got} == dict(enumerate([*TRACED.values(), "w " * 49 + "20 2", None]))


def test_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["itn_apply"](spark, data)
    assert got.columns == ["doc_id", "text"]
    assert Counter(map(tuple, got.collect())) == Counter((r["doc_id"], plain(r["text"])) for r in docs)
