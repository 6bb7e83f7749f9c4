"""A stream of words that arrive in any order, twice or never, against the same words as whole files."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from stampline.operators.segment import segments
from stampline.sources import adapters
from stampline.streaming.segments import segment_stream


def _run(spark, frame, path, name, files):
    """frame, dealt into so many files by its column ``part``, one micro-batch each."""
    for i in range(files):
        frame.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = segment_stream(stream, idle_seconds=60).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_stream_equals_files(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 12").select("doc_id", "text", "source")
    words = adapters.words(docs).filter("pos < 400").cache()
    ends = words.groupBy("file_id").agg(F.max("pos").alias("most"), F.max(F.col("word").rlike(r"[.?!]$")).alias("dotted")).filter("dotted")
    words = words.join(ends, "file_id").withColumn("last", F.col("pos") == F.col("most")).drop("most", "dotted")
    want = sorted((f, n, float(s), float(e), k, t) for f, n, s, e, k, t in segments(words.drop("last"), merge=False).collect())
    sent = words.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000))).withColumn("part", F.pmod(F.xxhash64("file_id", "pos"), F.lit(3)))
    sent = sent.unionByName(sent.filter("pos % 7 = 0 and not last and part < 2").withColumn("part", F.lit(2)))
    assert len(want) > 50 and _run(spark, sent, str(tmp_path), "words_in_any_order", 3) == want


def test_idle_files_end(spark, tmp_path):
    row = lambda f, pos, word, part, at: (f, pos, word, 100 * pos, 100 * pos + 90, False, datetime.fromtimestamp(at, UTC), part)
    rows = [row(1, 0, "a", 0, 1000), row(1, 2, "c", 0, 1000), row(1, 1, None, 1, 1001), row(1, 4, "e", 1, 1001), row(2, 0, "z", 2, 9000)]
    frame = spark.createDataFrame(rows, "file_id long, pos long, word string, start long, end long, last boolean, at timestamp, part int")
    got = _run(spark, frame, str(tmp_path), "words_of_idle_files", 3)
    assert got == [(1, 0, 0.0, 490.0, 4, "a  c e")]
