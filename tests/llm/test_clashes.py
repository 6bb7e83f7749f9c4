"""Columns of any name, and no text in the shuffles of near-dedup."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from stampline.llm import simhash


def test_deduplicate_keeps_columns_of_any_name(spark):
    said = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    rows = [(1, said[0]), (2, said[0]), (3, said[1]), (3, said[1]), (3, said[2]), (None, said[2]), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in ("_id", "_hash", "_none", "root", "n", "stays", "best")))
    got = simhash.deduplicate(frame)
    assert got.columns == frame.columns
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(1, said[0]), (3, said[1]), (3, said[2]), (None, None)])
    assert all(r["_id"] == r["_hash"] == 7 for r in out)
    assert simhash.deduplicate(frame.limit(0)).count() == 0


def test_near_dedup_shuffles_no_text(spark):
    said = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    frame = spark.createDataFrame([(1, said[0]), (2, said[0]), (3, said[1])], "doc_id long, text string")
    plan = simhash.deduplicate(frame)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
