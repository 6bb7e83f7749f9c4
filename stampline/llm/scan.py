"""Native token scan: find given word sequences in whole texts, in one pass, with a broadcast set of n-grams.

The words of a text are exploded inside whole-stage code; each is probed against a small broadcast table of anchor words
(the longest word of each wanted n-gram), and only there the n-gram is cut out of the word array and looked up. No row
leaves the scan for words that are no anchors, and nothing is shuffled but hits and one row per document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, ascii_lower

#: What is not part of a word, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for the end of every document in the stream of words; it can't occur in a word.
END = "\x01"


def words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def grams(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(gram, n, anchor, back, ids): the distinct windows of ``size`` words of the items (an item of fewer words is one window),
    lower-cased and joined by spaces; the anchor is the first of the longest words, ``back`` words after the start."""
    ws = items.select(F.col(id_col).cast("string").alias("id"), F.explode(F.filter(F.array(words(F.col(text_col))), lambda x: F.size(x) > 0)).alias("ws"))
    wins = ws.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1))), lambda i: F.slice(F.col("ws"), i, size))).alias("win"))
    wins = wins.select("id", F.transform("win", lambda w: ascii_lower(w)).alias("win"))
    longest = F.array_max(F.transform("win", lambda w: F.octet_length(F.lower(w))))
    at = F.array_position(F.transform("win", lambda w: F.octet_length(F.lower(w))), longest).cast("int")
    return (
        wins.select("id", F.array_join("win", " ").alias("gram"), F.size("win").alias("n"), F.lower(F.element_at("win", at)).alias("anchor"), (at - 1).alias("back"))
        .groupBy("gram", "n", "anchor", "back").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )


def find(docs: DataFrame, keys: list[Column], text_col: str, wanted: DataFrame, carry: list[Column] | None = None, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Every occurrence of the ``wanted`` grams: the keys, start (word index), n, ids; and for each document one row with n = 0
    and start = its number of words. The wanted set is broadcast in blocks of about ``rows`` grams and ``size`` bytes, ids included: a
    larger set takes more passes over the texts, so what is broadcast stays bounded. An id list that is longer than a block by itself is
    broadcast in pieces. ``carry``: more columns of the row, made from ``ws``, ``pos`` and ``back``."""
    weight = 48 + 2 * F.octet_length("anchor") + F.octet_length("gram")
    # pieces of about a sixteenth of a block at most
    most = max(1, size // 16 // 24)
    wanted = wanted.withColumn("ids", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(most)), lambda i: F.slice("ids", i + 1, most))))
    count, total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight + 24 * F.size("ids") + F.octet_length(F.array_join("ids", ""))), F.lit(0))).first()
    blocks = max(1, -(-count // rows), -(-total // size))
    longest = wanted.agg(F.coalesce(F.min(F.octet_length("anchor")), F.lit(1))).first()[0]
    spark, parts = docs.sparkSession, []
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("gram", "ids"), F.lit(blocks)) == b)
        ends = spark.range(1 if b == 0 else 0)
        anchors = part.select("anchor", "n", "back").distinct().union(ends.select(F.lit(END), F.lit(0), F.lit(0)))
        # found by its own anchor only, else a window with several anchor words would be found several times
        table = part.select("gram", "back", "ids").union(ends.select(F.lit(END), F.lit(0), F.array().cast("array<string>")))
        stream = docs.select(*keys, words(F.col(text_col)).alias("ws"))
        names = [c for c in stream.columns if c != "ws"]
        stream = stream.select(*names, "ws", F.posexplode_outer(F.array_append("ws", F.lit(END))).alias("pos", "word"))
        # an upper-case letter outside ASCII may have another length in lower case, at most half as long
        stream = stream.filter((F.octet_length("word") >= F.lit(longest / 2)) | (F.col("word") == END))
        start = F.col("pos") - F.col("back")
        near = stream.join(F.broadcast(anchors), F.lower("word") == F.col("anchor")).filter((start >= 0) & (start + F.col("n") <= F.size("ws")))
        gram = F.when(F.col("n") == 0, F.lit(END)).otherwise(ascii_lower(F.array_join(F.slice("ws", F.greatest(start + 1, F.lit(1)), F.col("n")), " ")))
        near = near.select(*names, start.alias("start"), "n", "back", gram.alias("gram"), *(carry or []))
        parts.append(near.join(F.broadcast(table), ["gram", "back"]).drop("gram", "back"))
    return reduce(DataFrame.union, parts)


def covered(spans: Column) -> Column:
    """Number of positions in the union of an array of structs (start, n)."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["total"] + F.greatest(end - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("total"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["total"])
