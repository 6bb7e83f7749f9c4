"""Which timestamps of a hypothesis are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels in the order of preference.
LEVELS = ("word", "segment", "char")


def level(counts: dict[str, Column], wanted: Column) -> Column:
    """The first level with stamps, else none; none if stamps are not wanted."""
    out = F.when(~wanted, "none")
    for name in LEVELS:
        out = out.when(counts[name] > 0, name)
    return out.otherwise("none")


def level_of_map(stamps: Column, wanted: Column) -> Column:
    return level({n: F.coalesce(F.size(F.element_at(stamps, F.lit(n))), F.lit(0)) for n in LEVELS}, wanted)


def choose(files: DataFrame, chunk_stamps: DataFrame) -> DataFrame:
    """file_id, was_chunked, level: stamps from chunks come first, even when none are wanted; their level is word if any has a word."""
    seen = chunk_stamps.groupBy("file_id").agg(F.max(F.col("word").isNotNull()).alias("any_word"))
    chosen = F.when(F.col("any_word").isNull(), F.col("level")).when(F.col("any_word"), "word").otherwise("segment")
    return files.join(seen, "file_id", "left").select("file_id", F.col("any_word").isNotNull().alias("was_chunked"), chosen.alias("level"))
