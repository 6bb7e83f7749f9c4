"""Results of a batch: one row per file, totals, and the text of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, validate
from .ordinal import ordinal_join


def results(files: DataFrame, hypotheses: DataFrame, pairing: str = "key") -> DataFrame:
    """file_id, name, is_video, duration, ok, error, text, n_words of ``files`` and their ``hypotheses`` (file_id, text); a file without one has failed.

    pairing: by "key" a hypothesis is that of its file_id. By "position" they come as a list from which empty ones are missing, as where long files were
    read in chunks: the first is taken for the first file, by file_id, so texts move up to other files, whose id is in said_of, and the last files have
    none. That is what a list without keys does; it is there to tell what went wrong, and never the default.
    """
    found = hypotheses.select(F.col("file_id").alias("said_of"), F.col("text").alias("said"), F.lit(True).alias("present"))
    if pairing == "position":
        both = ordinal_join(files, found.filter("said <> ''"), ["file_id"], ["said_of"], "left")
    else:
        both = files.join(found, F.col("file_id") == F.col("said_of"), "left")
    error = validate.hypothesis_error(F.col("present").isNotNull(), F.col("said"))
    both = both.withColumn("error", error).withColumn("ok", F.col("error").isNull())
    text = F.when(F.col("ok"), F.col("said")).otherwise(validate.failure_text(F.col("error")))
    n = F.when(F.col("ok"), scalar.word_count(F.col("said"))).otherwise(F.lit(0).cast("long"))
    return both.select("file_id", "name", "is_video", "duration", "ok", "error", text.alias("text"), n.alias("n_words"), *(["said_of"] if pairing == "position" else []))


def totals(results_: DataFrame) -> DataFrame:
    """One row: files, ok, failed, videos, words of good files, and the duration of all."""
    zero = F.lit(0).cast("long")
    return results_.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.count_if("is_video").alias("n_videos"),
        F.coalesce(F.sum("n_words"), zero).alias("n_words"), F.coalesce(F.sum("duration"), zero).alias("duration"),
    )


def finished(results_: DataFrame, normalised: DataFrame, stamps: DataFrame, wanted: bool = True) -> DataFrame:
    """file_id, name, ok, error, text, n_words, n_stamps, level: results with what comes after the recognition. A good file takes its normalised text
    (file_id, text) where there is one, and its stamps (file_id, word) are counted, their level word if any has a word; a failed file has its
    failure text, no stamps and the level none."""
    said = normalised.select(F.col("file_id").alias("_n"), F.col("text").alias("_text"))
    seen = stamps.groupBy(F.col("file_id").alias("_s")).agg(F.count(F.lit(1)).alias("_stamps"), F.max(F.col("word").isNotNull()).alias("_word"))
    both = results_.join(said, F.col("file_id") == F.col("_n"), "left").join(seen, F.col("file_id") == F.col("_s"), "left")
    use = F.col("ok") & F.lit(wanted) & F.col("_stamps").isNotNull()
    text = F.when(F.col("ok"), F.coalesce("_text", "text")).otherwise(F.col("text"))
    words = F.when(F.col("ok"), scalar.word_count(text)).otherwise(F.lit(0).cast("long"))
    level = F.when(~use, "none").when(F.col("_word"), "word").otherwise("segment")
    return both.select("file_id", "name", "ok", "error", text.alias("text"), words.alias("n_words"), F.when(use, F.col("_stamps")).otherwise(F.lit(0).cast("long")).alias("n_stamps"), level.alias("level"))


def single_status(files: DataFrame, model: str, itn: bool, level: Column, wanted: Column) -> DataFrame:
    """file_id, line: the status of each file as if it were the only one; files: file_id, is_video, duration (ms), took (ms), text."""
    seconds = scalar.real_time_factor(F.coalesce("duration", F.lit(0).cast("long")) * 10, F.col("took"))  # tenths, so that nothing is rounded in binary
    tenths = F.floor(seconds + 0.5).cast("long")
    lines = [
        F.when(F.col("is_video"), F.lit("video, its audio was taken")), F.lit(f"Model: {model}"), F.concat(F.lit("Audio Duration: "), scalar.minutes_seconds(F.coalesce("duration", F.lit(0).cast("long")))),
        F.format_string("Real-Time Factor: %d.%dx", F.floor(tenths / 10).cast("long"), tenths % 10),
        F.format_string("Transcription Length: %d characters (%d words)", F.char_length(F.coalesce("text", F.lit(""))), scalar.word_count(F.col("text"))),
        scalar.itn_status(F.lit(itn)), F.concat(F.lit("Timestamps: "), scalar.timestamp_status(wanted, level)),
    ]
    return files.select("file_id", F.concat_ws("\n", *lines).alias("line"))


def status_lines(results_: DataFrame) -> DataFrame:
    """file_id, line: the statistics of each file as text."""
    kind = F.when(F.col("is_video"), "video").otherwise("audio")
    head = F.concat(F.lit("**"), F.col("file_id").cast("string"), F.lit(". "), "name", F.lit("** ("), kind, F.lit(")"))
    good = F.concat(head, F.lit(": "), scalar.minutes_seconds(F.col("duration")), F.lit(", "), F.col("n_words").cast("string"), F.lit(" words"))
    return results_.select("file_id", F.when(F.col("ok"), good).otherwise(F.concat(head, F.lit(": ❌ Failed: "), F.col("error"))).alias("line"))


def combined(results_: DataFrame) -> DataFrame:
    """file_id, block: each file's text under a banner; written in order, the blocks are the text of all files."""
    return results_.select("file_id", F.concat(F.lit("\n=== "), "name", F.lit(" ===\n\n"), "text", F.lit("\n")).alias("block"))
