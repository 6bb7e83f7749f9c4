"""The driver's tables as files, timed words, hypotheses and frames. Times are whole milliseconds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paced(docs: DataFrame) -> DataFrame:
    """file_id, pos, word, gap, dur: the words with the silence before and the duration of each; both follow from ids and positions."""
    each = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.filter(F.split("text", "[ \n\t\r]+"), lambda w: w != "")).alias("pos", "word"))
    gap = F.when((F.col("file_id") * 31 + F.col("pos") * 17) % 13 == 0, 700).otherwise(80)
    dur = F.when((F.col("file_id") + F.col("pos")) % 41 == 0, 6000).otherwise(200 + 50 * (F.length("word") % 4))
    return each.select("file_id", F.col("pos").cast("long").alias("pos"), "word", gap.cast("long").alias("gap"), dur.cast("long").alias("dur"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_id, pos, word, start, end of _paced() rows that lie document by document: running sums that begin anew at each position 0."""
    past = 0  # of the document that goes on from the batch before
    for b in batches:
        if not b.num_rows:
            continue
        file, pos, word, gap, dur = b.columns
        steps = gap.to_numpy() + dur.to_numpy()
        sums = np.cumsum(steps)
        first = np.maximum.accumulate(np.where(pos.to_numpy() == 0, np.arange(len(steps)), -1))
        end = sums - np.where(first < 0, -past, sums[first] - steps[first])
        past = int(end[-1])
        yield pa.RecordBatch.from_arrays([file, pos, word, pa.array(end - dur.to_numpy()), pa.array(end)], ["file_id", "pos", "word", "start", "end"])


def words(docs: DataFrame) -> DataFrame:
    """file_id, pos, word, start, end: each document as timed words. A document's words lie in one partition and in their order, as they come from one
    row. Documents are dealt before, as few tasks may read them; words aren't."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = _paced(docs.repartition(parts, "doc_id"))
    return each.mapInArrow(_ends, f"file_id {dict(each.dtypes)['file_id']}, pos long, word string, start long, end long")


def even_words(docs: DataFrame) -> DataFrame:
    """file_id, pos, word, start, end, last, at: each document as words of 350 ms, one every 400 ms. Nothing looks beyond its row, so documents may
    come as a stream; all of a document comes at one time."""
    listed = docs.select(F.col("doc_id").alias("file_id"), F.filter(F.split("text", "[ \n\t\r]+"), lambda w: w != "").alias("words"))
    each = listed.select("file_id", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    start = F.col("pos").cast("long") * 400
    return each.select("file_id", F.col("pos").cast("long").alias("pos"), "word", start.alias("start"), (start + 350).alias("end"), (F.col("pos") == F.col("n") - 1).alias("last"), F.timestamp_seconds(F.lit(1)).alias("at"))


def files(docs: DataFrame, timed: DataFrame | None = None) -> DataFrame:
    """file_id, name, is_video, duration (ms, of its words; null without any). The last word's end is the sum of all gaps and durations, which is
    aggregated without bringing the words into their order."""
    duration = _paced(docs).groupBy("file_id").agg(F.sum(F.col("gap") + F.col("dur")).alias("duration")) if timed is None else timed.groupBy("file_id").agg(F.max("end").alias("duration"))
    suffix = F.when(F.col("doc_id") % 5 == 0, ".mp4").otherwise(".wav")
    named = docs.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("name"), (F.col("doc_id") % 5 == 0).alias("is_video"))
    return named.join(duration, "file_id", "left")


def hypotheses(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """file_id, text: the recognition of a file with a label of quality 0 gave nothing."""
    bad = labels.filter("quality = 0").select(F.col("doc_id").alias("_bad")).distinct()
    both = docs.join(bad, F.col("doc_id") == F.col("_bad"), "left")
    return both.select(F.col("doc_id").alias("file_id"), F.when(F.col("_bad").isNotNull(), "").otherwise(F.col("text")).alias("text"))


def event_words(events: DataFrame) -> DataFrame:
    """file_id (the user), pos, word (the type), start = end (ms)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp")).alias("start")
    return events.select(F.col("user_id").alias("file_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("event_type").alias("word"), at, at.alias("end"))
