"""Statistics of batches from stored sketches: made once a file, merged for any group of files, without reading a text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

#: Base-2 logarithm of the registers that count distinct words, and the size of the sketches of lengths.
REGISTERS, SIZE = 14, 400
#: Relative error of a distinct count, three standard errors of 2 ** REGISTERS registers, and error of a quantile's rank, for which a sketch of SIZE stands
#: with 99 % of certainty. Merged sketches have the errors of one.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0075


def text_sketches(texts: DataFrame, key: str) -> DataFrame:
    """key, n_words, shortest, longest, distinct and lengths (sketches, binary) of ``texts`` (key, text): one row a key. Words are between white space and count
    by their lower case; keys without words, and null texts, have no row."""
    words = texts.select(key, F.explode(scalar.word_list(F.col("text"))).alias("_w"))
    length = F.length("_w").cast("long")
    return words.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_words"), F.min(length).alias("shortest"), F.max(length).alias("longest"),
        F.hll_sketch_agg(F.lower("_w"), REGISTERS).alias("distinct"), F.kll_sketch_agg_bigint(length, F.lit(SIZE)).alias("lengths"),
    )


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of all rows, or of each group of ``by``, as one row of the same columns, which can be merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("n_words").alias("n_words"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_bigint("lengths", F.lit(SIZE)).alias("lengths"),
    )


def distinct_words(sketch: Column) -> Column:
    """Distinct words, within DISTINCT_ERROR of the truth."""
    return F.hll_sketch_estimate(sketch)


def length_at(sketch: Column, rank: float) -> Column:
    """The length that a share ``rank`` of the words doesn't exceed; its true rank is within RANK_ERROR."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(rank)))
