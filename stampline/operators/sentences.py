"""Sentences of texts, with abbreviations that are learned from the texts themselves: words that have a period after them far oftener than chance says."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources.storage import stored

# How likely a period is after an abbreviation, and the least score of one.
SURE, LEAST = 0.99, 0.3
#: What may stand before a word and after it, which is not of it, and what may stand between the end of a sentence and white space.
OPENING, CLOSING, QUOTE = r"""["'(\[{«“‘]""", r"""["')\]}»”’,;:]""", r"""["')\]}»”’]"""


def tokens(text: Column) -> Column:
    """(stem, dotted) of each word that has a letter: in lower case, without what opens before it and closes after it, and without one period at its end."""
    bare = lambda w: F.regexp_replace(F.lower(w), f"^{OPENING}+|{CLOSING}+$", "")
    cut = F.transform(scalar.word_list(text), bare)
    known = F.filter(cut, lambda w: w.rlike(r"\p{L}") & ~F.endswith(w, F.lit("..")))
    return F.transform(known, lambda w: F.struct(F.regexp_replace(w, r"\.$", "").alias("stem"), F.endswith(w, F.lit(".")).alias("dotted")))


def abbreviations(texts: DataFrame, column: str = "text", least: float = LEAST) -> DataFrame:
    """stem, n_dotted, n_plain, score of the abbreviations in a column of texts.

    The score is the log-likelihood ratio of a period that is nearly sure after the word against one as likely as after any word, weighted down by
    the word's length and by each time that it stands without a period, and up by periods inside it. Counts are of the whole column and aggregated where
    they are read; null texts have no words, repeated texts count each time.
    """
    words = texts.select(F.explode(tokens(F.col(column))).alias("w")).select("w.stem", "w.dotted")
    counts = stored(words.groupBy("stem").agg(F.count_if("dotted").alias("n_dotted"), F.count_if(~F.col("dotted")).alias("n_plain")))
    totals = counts.agg(F.sum("n_dotted").alias("_dotted"), F.sum(F.col("n_dotted") + F.col("n_plain")).alias("_all"))
    chance = F.col("_dotted") / F.col("_all")
    ratio = 2 * (F.col("n_dotted") * F.log(F.lit(SURE) / chance) + F.col("n_plain") * F.log((1 - F.lit(SURE)) / (1 - chance)))
    inside = F.length(F.regexp_replace("stem", r"[^.]", ""))
    length = F.length("stem") - inside
    score = ratio * F.exp(-length) * (inside + 1) * F.pow(length.cast("double"), -F.col("n_plain").cast("double"))
    # one row of totals
    both = counts.crossJoin(F.broadcast(totals)).filter("n_dotted > 0 and _dotted < _all")
    return both.withColumn("score", score).filter(F.col("score") >= least).select("stem", "n_dotted", "n_plain", "score")


def boundary(stems: list[str]) -> str:
    """The regex of the white space between sentences: after ``.``, ``!`` or ``?`` and up to two quotes or brackets that close after it, but not right after
    the period of one of ``stems``."""
    after = rf"(?<=[.!?]|[.!?]{QUOTE}|[.!?]{QUOTE}{QUOTE})"
    listed = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in sorted(stems))
    return after + (rf"(?<!(?:^|\s|{OPENING})(?iu:{listed})\.)" if stems else "") + r"(?U:\s)+"


def split(text: Column, stems: list[str]) -> Column:
    """The sentences of a text, without white space at their ends, in the JVM. Texts without words have none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), boundary(stems), -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def learned(texts: DataFrame, column: str = "text", least: float = LEAST, most: int = 10_000) -> list[str]:
    """The abbreviations of a column of texts as a list for split(). They are a model, which comes to the driver; where more than ``most`` are learned,
    a ValueError says so, since the rest would be split wrongly: then ``least`` is too low."""
    found = [r["stem"] for r in abbreviations(texts, column, least).select("stem").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} abbreviations; raise least above {least}")
    return sorted(found)
