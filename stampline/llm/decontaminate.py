"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scans the token windows of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, table
from .scan import covered, find, grams

#: Words of a window.
WINDOW = 10


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted ids of the items with occurring windows): one row per document row.

    docs: doc_id, text; benchmark: item_id, text; other columns, whatever their names, are not read. The n-grams are held
    in a broadcast hash set whose size is checked (a larger set is scanned in blocks); hits are verified by the n-gram's
    whole text. Null text and text without words: n_words 0, no hits. Null doc_id: a key like any other. Repeated rows
    give repeated result rows. Items without words have no window; items with null item_id mark words but are not listed.
    Empty benchmark: no hits; empty documents: no rows.
    """
    keys = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    hits = find(docs, keys, "text", grams(benchmark, "item_id", "text", window))
    real = F.col("n") > 0
    per_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(~real, F.col("start"))).cast("long").alias("n_words"),
        F.count(F.when(~real, 1)).alias("copies"),
        F.collect_set(F.when(real, F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    per_doc = per_doc.select("doc_id", "text_hash", "n_words", covered(F.col("spans")).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per_doc.drop("col")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_hit: int = 1) -> DataFrame:
    """The documents with fewer than ``min_hit`` hit words, all columns of ``docs`` kept. Same cases as contamination(). The keys of those that
    go are written and measured: few are broadcast, so that no text is shuffled; many are joined by a shuffle."""
    bad = contamination(docs, benchmark, window).filter(F.col("n_hit") >= min_hit).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    bad = table(bad, "contaminated")
    bad = F.broadcast(bad) if fits(bad, F.coalesce(F.octet_length(F.col("_d").cast("string")), F.lit(0)) + 16) else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_h"]), "left_anti")
