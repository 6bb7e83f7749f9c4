"""Long files in overlapping chunks: the plan, membership of words, removal and shift of overlaps, and the merge of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..settings import DEFAULT, Settings


def plan(files: DataFrame, settings: Settings = DEFAULT, unit: int = 1000) -> DataFrame:
    """file_id, chunk_no, chunk_start, chunk_end, read_start, read_end, left_ctx: tiles of [0, duration), each read with ``overlap`` more on
    both sides. Files without a duration have no chunks."""
    chunk, overlap = int(settings.chunk * unit), int(settings.overlap * unit)
    n = F.ceil(F.col("duration") / chunk).cast("long")
    rows = files.filter("duration > 0").select("file_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_no"))
    start = F.col("chunk_no") * chunk
    end = F.least(start + chunk, F.col("duration"))
    read = F.greatest(start - overlap, F.lit(0))
    return rows.select("file_id", "chunk_no", start.alias("chunk_start"), end.alias("chunk_end"), read.alias("read_start"), F.least(end + overlap, F.col("duration")).alias("read_end"), (start - read).alias("left_ctx"))


def members(words: DataFrame, settings: Settings = DEFAULT, unit: int = 1000) -> DataFrame:
    """The words with each chunk_no whose read window they touch, by integer division instead of a range join; overlap is under half a
    chunk, so a word's start falls in two windows at most and its end adds those it reaches into."""
    chunk, overlap = int(settings.chunk * unit), int(settings.overlap * unit)
    first = F.greatest(F.floor((F.col("start") - overlap) / chunk), F.lit(0))
    last = F.greatest(F.floor((F.col("end") + overlap) / chunk), first)
    rows = words.select("*", F.explode(F.sequence(first, last)).alias("chunk_no"))
    begin = F.col("chunk_no") * chunk
    return rows.filter((F.col("end") > begin - overlap) & (F.col("start") < begin + chunk + overlap))


def raw_stamps(words: DataFrame, settings: Settings = DEFAULT, unit: int = 1000) -> DataFrame:
    """What a recogniser says of each chunk: the words in its read window, timed from the window's start."""
    chunk, overlap = int(settings.chunk * unit), int(settings.overlap * unit)
    read = F.greatest(F.col("chunk_no") * chunk - overlap, F.lit(0))
    return members(words, settings, unit).select(
        "file_id", "chunk_no", "pos", "word", (F.col("start") - read).alias("start"), (F.col("end") - read).alias("end"),
        (F.col("chunk_no") * chunk - read).alias("left_ctx"), (F.col("chunk_no") * chunk).alias("chunk_start"),
    )


def shift(stamps: DataFrame, settings: Settings = DEFAULT, overlap: str = "reference", unit: int = 1000) -> DataFrame:
    """Absolute times: stamps that end within the left context go, those across it are cut. overlap="dedup" drops what starts after the
    chunk's end too, so that no word is kept by two chunks; "reference" keeps it. A stamp without an end is dropped."""
    end = F.coalesce("end", F.lit(0))
    s = F.greatest(F.greatest("start", "left_ctx") - F.col("left_ctx") + F.col("chunk_start"), F.lit(0))
    e = F.greatest(s, end - F.col("left_ctx") + F.col("chunk_start"))
    out = stamps.filter(end > F.col("left_ctx")).withColumns({"start": s, "end": e})
    return out.filter(F.col("start") < F.col("chunk_start") + int(settings.chunk * unit)) if overlap == "dedup" else out


def chunk_texts(shifted: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """file_id, chunk_no, n_words, text: the surviving words of a chunk, joined in order, empty ones skipped. whole (file_id, chunk_no, text,
    ok): a chunk without stamps takes its whole text; failed and empty chunks go."""
    words = F.array_sort(F.collect_list(F.when(F.col("word") != "", F.struct("pos", "word"))))
    texts = shifted.groupBy("file_id", "chunk_no").agg(words.alias("w")).select("file_id", "chunk_no", F.size("w").cast("long").alias("n_words"), F.array_join("w.word", " ").alias("text"))
    if whole is not None:
        whole = whole.filter("ok").select("file_id", "chunk_no", F.col("text").alias("whole"))
        texts = whole.join(texts, ["file_id", "chunk_no"], "left").select("file_id", "chunk_no", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("text", "whole").alias("text"))
    return texts.filter(F.col("text") != "")


def merge_texts(chunks: DataFrame) -> DataFrame:
    """file_id, n_chunks, text: chunk texts in order, runs of spaces collapsed."""
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("chunk_no", "text")))["text"], " ")
    return chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"), joined.alias("text")).withColumn("text", scalar.collapse_spaces(F.col("text")))


def route(files: DataFrame, settings: Settings = DEFAULT, unit: int = 1000) -> DataFrame:
    """file_id, duration, is_long, batch_chunked: one long file sends the whole batch through the chunked path. The batch's flag is one
    aggregated row that is joined back, not a window over all rows."""
    limit = int(settings.threshold * unit)
    flag = files.agg(F.coalesce(F.max(F.col("duration") > limit), F.lit(False)).alias("batch_chunked"))
    return files.select("file_id", "duration", (F.coalesce("duration", F.lit(0)) > limit).alias("is_long")).crossJoin(F.broadcast(flag))


def choose_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, the successful attempt of the lowest number (attempt, ok and other columns)."""
    rest = [c for c in attempts.columns if c not in keys]
    best = attempts.filter("ok").groupBy(*keys).agg(F.min_by(F.struct(*rest), "attempt").alias("best"))
    return best.select(*keys, "best.*")
