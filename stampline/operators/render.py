"""SRT, CSV and plain-text outputs, as rows with explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.validate import is_failure
from ..settings import DEFAULT, Settings
from ..sources.outputs import write_files
from ..sources.storage import stored
from . import segment


def srt_block(no: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", no.cast("string"), F.concat(scalar.srt_time_ms(start), F.lit(" --> "), scalar.srt_time_ms(end)), text, F.lit(""))


def srt(cues: DataFrame, order: str = "seg_no") -> DataFrame:
    """file_id, cue_no, cue: numbered from 1 in each file, in their order, unless they come with a cue_no."""
    if "cue_no" not in cues.columns:
        cues = cues.withColumn("cue_no", F.row_number().over(Window.partitionBy("file_id").orderBy(order)))
    return cues.select("file_id", "cue_no", srt_block(F.col("cue_no"), F.col("start"), F.col("end"), F.col("text")).alias("cue"))


def srt_estimated(texts: DataFrame) -> DataFrame:
    """file_id, cue: one cue for a text without stamps, as long as its words take."""
    end = scalar.estimated_ms(scalar.word_count(F.col("text")))
    return texts.select("file_id", srt_block(F.lit(1), F.lit(0), end, F.col("text")).alias("cue"))


def csv_estimated(texts: DataFrame) -> DataFrame:
    """file_id, line: one row for a text without stamps, from 0 to as long as its words take."""
    end = scalar.estimated_ms(scalar.word_count(F.col("text")))
    return texts.select("file_id", csv_line(F.lit(0).cast("long"), end, F.col("text")).alias("line"))


def txt_plain(texts: DataFrame) -> DataFrame:
    """file_id, line: a text without stamps, at the time 0."""
    return texts.select("file_id", F.concat(scalar.txt_time_ms(F.lit(0).cast("long")), F.lit(" "), F.col("text")).alias("line"))


def csv_line(start: Column, end: Column, text: Column, file: Column | None = None) -> Column:
    """Times in seconds with three digits, from whole milliseconds, so that nothing is rounded."""
    sec = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000).cast("long"), (ms % 1000).cast("long"))
    return F.concat_ws(",", *([scalar.csv_text(file)] if file is not None else []), sec(start), sec(end), sec(end - start), scalar.csv_text(text))


CSV_HEADER = "start_time,end_time,duration,text"


def csv_file(stamps: DataFrame, header: str = CSV_HEADER) -> DataFrame:
    """file_id, part, pos, line: of each file with stamps (file_id, pos, start, end, text) the header row (part 0), then a row per stamp (part 1)."""
    head = stamps.select("file_id").distinct().select("file_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(header).alias("line"))
    body = stamps.select("file_id", F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"), csv_line(F.col("start"), F.col("end"), F.col("text")).alias("line"))
    return head.unionByName(body)


def stamp_cues(stamps: DataFrame) -> DataFrame:
    """file_id, cue_no, cue: stamps of a segment or a character are cues as they are, one each, in their order."""
    return srt(stamps.drop("cue_no"), "pos")


def txt_lines(cues: DataFrame) -> DataFrame:
    return cues.select("file_id", "seg_no", F.concat(scalar.txt_time_ms(F.col("start")), F.lit(" "), F.col("text")).alias("line"))


def global_numbers(rows: DataFrame, group: str, inside: list[str]) -> Column | DataFrame:
    """rows with ``no``, counting from 1 in the order of ``group`` and then ``inside``. The groups' offsets are running sums of their sizes, dealt
    by ranges of the group; no window runs over all rows in one task except over one row per range. The dealt sizes are stored, as the
    sampled ranges of a second run could differ."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(parts, group).withColumn("_p", F.spark_partition_id())
    sizes = stored(sizes)
    inner = F.sum("_n").over(Window.partitionBy("_p").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sizes = sizes.withColumn("_inner", inner)
    totals = sizes.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")
    offsets = sizes.join(F.broadcast(totals.select("_p", before.alias("_before"))), "_p").select(F.col(group).alias("_g"), (F.col("_inner") + F.col("_before")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(*inside))
    return rows.withColumn("_own", own).join(offsets, F.col(group).eqNullSafe(F.col("_g"))).withColumn("no", (F.col("_own") + F.col("_offset")).cast("long")).drop("_own", "_g", "_offset")


def _good(files: DataFrame) -> DataFrame:
    return files.filter(~F.coalesce(is_failure(F.col("text")), F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))


def _with(files: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``files`` with each of their ``rows`` (file_id and columns, which are called _column); a file without any, null among ids too, has nulls."""
    of = rows.select(F.col("file_id").alias("_of"), *(F.col(c).alias(f"_{c}") for c in columns))
    return files.join(of, F.col("file_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def _cues(good: DataFrame, cues: DataFrame) -> DataFrame:
    """file_id, cue_no, start, end, text: the cues of good files; one without any has one cue of all its text, as long as its words take."""
    both = _with(good.select("file_id", "text"), cues, "cue_no", "start", "end", "text")
    none, zero = F.col("_cue_no").isNull(), F.lit(0).cast("long")
    end = F.when(none, scalar.estimated_ms(scalar.word_count(F.col("text")))).otherwise(F.col("_end").cast("long"))
    text = F.when(none, F.col("text")).otherwise(F.col("_text"))
    return both.select("file_id", F.coalesce(F.col("_cue_no").cast("long"), zero).alias("cue_no"), F.coalesce(F.col("_start").cast("long"), zero).alias("start"), end.alias("end"), text.alias("text"))


def batch_srt(files: DataFrame, cues: DataFrame) -> DataFrame:
    """no, file_id, cue: failed files are skipped; each file has a header cue of two seconds, and numbers go on over all files. files:
    file_id, name, text; cues: file_id, cue_no, start, end, text. A good file without cues has one of its whole text."""
    good = _good(files)
    header = good.select("file_id", F.lit(-1).cast("long").alias("cue_no"), F.lit(0).cast("long").alias("start"), F.lit(2000).cast("long").alias("end"), F.concat(F.lit("[FILE: "), "name", F.lit("]")).alias("text"))
    numbered = global_numbers(header.unionByName(_cues(good, cues)), "file_id", ["cue_no"])
    return numbered.select("no", "file_id", srt_block(F.col("no"), F.col("start"), F.col("end"), F.col("text")).alias("cue"))


def batch_csv(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """file_id, pos, line: one row per stamp, or one from 0 to the duration for a good file without stamps."""
    both = _with(_good(files).select("file_id", "name", "duration", "text"), stamps, "pos", "start", "end", "text")
    none = F.col("_pos").isNull()
    start, end = F.when(none, F.lit(0)).otherwise(F.col("_start")), F.when(none, F.col("duration")).otherwise(F.col("_end"))
    # without stamps the row's duration is the file's, as its end is
    return both.select("file_id", F.coalesce("_pos", F.lit(0).cast("long")).alias("pos"), csv_line(start, end, F.when(none, F.col("text")).otherwise(F.col("_text")), F.col("name")).alias("line"))


def batch_txt(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, part, pos, line: of each file a header (part 0) and its lines (part 1); a file without lines, also a failed one, has its text."""
    rule = "=" * 60
    head = F.concat_ws("\n", F.lit(""), F.concat(F.lit("FILE "), (F.col("file_no")).cast("string"), F.lit(": "), "name"), F.concat(F.lit("Duration: "), scalar.minutes_seconds(F.col("duration"))), F.lit(rule), F.lit(""))
    zero = F.lit(0).cast("long")
    header = files.select("file_id", F.lit(0).alias("part"), zero.alias("pos"), head.alias("line"))
    body = _with(files.select("file_id", "text"), lines, "pos", "line")
    return header.unionByName(body.select("file_id", F.lit(1).alias("part"), F.coalesce(F.col("_pos").cast("long"), zero).alias("pos"), F.coalesce("_line", "text", F.lit("")).alias("line")))


def txt_header(name: str, model: str, ms: int, seconds: float, itn: bool, n_files: int | None = None) -> str:
    """The header of a text file, of one file or of a batch."""
    span = f"{ms // 60000}m {ms % 60000 // 1000}s"
    first = [f"Audio File: {name}", f"Model: {model}", f"Duration: {span}"] if n_files is None else [f"Batch Transcription - {n_files} files", f"Model: {model}", f"Total Duration: {span}"]
    rest = [f"Processing Time: {seconds:.2f}s", f"ITN Applied: {'Yes' if itn else 'No'}", "", "=" * 60]
    return "\n".join(first + rest + (["TRANSCRIPTION", "=" * 60, ""] if n_files is None else []))


def txt_headers(files: DataFrame, model: str, itn: bool) -> DataFrame:
    """file_id, header: the text header of each file (name, duration and took in ms), as txt_header() makes it for one; hundredths of a second
    are rounded half up. A file without duration counts as 0."""
    took = F.floor((F.col("took") + 5) / 10).cast("long")
    lines = [
        F.concat(F.lit("Audio File: "), "name"), F.lit(f"Model: {model}"), F.concat(F.lit("Duration: "), scalar.minutes_seconds(F.coalesce("duration", F.lit(0).cast("long")))),
        F.format_string("Processing Time: %d.%02ds", F.floor(took / 100).cast("long"), took % 100), F.lit(f"ITN Applied: {'Yes' if itn else 'No'}"), F.lit(""), F.lit("=" * 60), F.lit("TRANSCRIPTION"), F.lit("=" * 60), F.lit(""),
    ]
    return files.select("file_id", F.concat_ws("\n", *lines).alias("header"))


def output_stem(name: Column) -> Column:
    """The name of a single file's outputs: its own without what follows the last dot."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_transcription"))


def output_name(name: str | None, n_files: int) -> str:
    return f"{name.rsplit('.', 1)[0]}_transcription" if n_files == 1 and name else f"batch_transcription_{n_files}_files"


def batch_header(files: DataFrame, model: str, itn: bool, took: float) -> DataFrame:
    """One row: the header of a batch, as txt_header() makes it, from the number and the durations (ms) of ``files``; ``took`` in seconds."""
    sums = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration"), F.lit(0)).alias("ms"))
    lines = [
        F.format_string("Batch Transcription - %d files", "n"), F.lit(f"Model: {model}"), F.concat(F.lit("Total Duration: "), scalar.minutes_seconds(F.col("ms"))),
        F.lit(f"Processing Time: {took:.2f}s"), F.lit(f"ITN Applied: {'Yes' if itn else 'No'}"), F.lit(""), F.lit("=" * 60),
    ]
    return sums.select(F.concat_ws("\n", *lines).alias("header"))


def outputs(files: DataFrame, stamps: DataFrame, model: str = "fast", itn: bool = False, took: float = 0.0) -> dict[str, tuple[DataFrame, list[str], str]]:
    """The three outputs of a batch: name of the kind -> rows, their order and the column that is written. files: file_id, name, text, duration,
    file_no; stamps: file_id, pos, start, end, text."""
    cues = batch_srt(files, stamps.withColumnRenamed("pos", "cue_no"))
    head = stamps.sparkSession.createDataFrame([("file," + CSV_HEADER,)], "line string").select(F.lit(0).alias("part"), F.lit(None).cast(dict(files.dtypes)["file_id"]).alias("file_id"), F.lit(0).cast("long").alias("pos"), "line")
    table = head.unionByName(batch_csv(files, stamps).withColumn("part", F.lit(1)))
    lines = stamps.select("file_id", "pos", F.concat(scalar.txt_time_ms(F.col("start")), F.lit(" "), "text").alias("line"))
    top = batch_header(files, model, itn, took).select(F.lit(0).alias("top"), F.lit(None).cast(dict(files.dtypes)["file_id"]).alias("file_id"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("header").alias("line"))
    text = top.unionByName(batch_txt(files, lines).withColumn("top", F.lit(1)))
    return {"txt": (text, ["top", "file_id", "part", "pos"], "line"), "srt": (cues, ["no"], "cue"), "csv": (table, ["part", "file_id", "pos"], "line")}


def single_outputs(files: DataFrame, stamps: DataFrame, level: str = "segment", model: str = "fast", itn: bool = False, settings: Settings = DEFAULT) -> dict[str, tuple[DataFrame, list[str], str]]:
    """The three outputs of every file as if it were the only one, in the form of outputs(), each row with its file_id. files: file_id, name, text,
    duration, took (ms); stamps: file_id, pos, start, end and text, or word where ``level`` is word; words are grouped for SRT and TXT.

    A failed file has no outputs. A file without stamps has its text: in TXT as it is, in SRT as one cue and in CSV as one row, both as long as its
    words take."""
    good, zero = _good(files), F.lit(0).cast("long")
    if level == "word":
        words = stamps.select("file_id", "pos", "word", "start", "end")
        stamps = words.withColumnRenamed("word", "text")
        shown, told = (segment.cues(words, settings, txt).withColumnRenamed("seg_no", "pos") for txt in (False, True))
    else:
        shown = told = stamps
    shown = shown.withColumn("cue_no", F.row_number().over(Window.partitionBy("file_id").orderBy("pos")))
    srt_ = _cues(good, shown).withColumn("pos", F.greatest(F.col("cue_no"), F.lit(1)))
    srt_ = srt_.select("file_id", F.lit(1).alias("part"), "pos", srt_block(F.col("pos"), F.col("start"), F.col("end"), F.col("text")).alias("line"))

    top = _with(good.select("file_id"), txt_headers(good, model, itn), "header").select("file_id", F.lit(0).alias("part"), zero.alias("pos"), F.col("_header").alias("line"))
    lines = _with(good.select("file_id", "text"), told, "pos", "start", "text")
    said = F.when(F.col("_pos").isNull(), F.col("text")).otherwise(F.concat(scalar.txt_time_ms(F.col("_start")), F.lit(" "), "_text"))
    txt = top.unionByName(lines.select("file_id", F.lit(1).alias("part"), F.coalesce(F.col("_pos").cast("long"), zero).alias("pos"), said.alias("line")))

    head = good.select("file_id", F.lit(0).alias("part"), zero.alias("pos"), F.lit(CSV_HEADER).alias("line"))
    table = _cues(good, stamps.withColumnRenamed("pos", "cue_no"))
    csv = head.unionByName(table.select("file_id", F.lit(1).alias("part"), F.col("cue_no").alias("pos"), csv_line(F.col("start"), F.col("end"), F.col("text")).alias("line")))
    order = ["file_id", "part", "pos"]
    return {"txt": (txt, order, "line"), "srt": (srt_, order, "line"), "csv": (csv, order, "line")}


def write_outputs(files: DataFrame, stamps: DataFrame, folder: str, model: str = "fast", itn: bool = False, took: float = 0.0) -> dict[str, str]:
    """Write all three outputs of a batch, or of a single file in the layout of one, under ``folder``, and give their paths. The name is output_name()'s.
    Of a single file that failed nothing is written."""
    some = [r["name"] for r in files.select("name").limit(2).collect()]
    single = len(some) == 1
    stem = output_name(some[0] if some else None, 1 if single else files.count())
    if single and not _good(files).count():
        return {}
    made = single_outputs(files.withColumn("took", F.lit(round(took * 1000)).cast("long")), stamps, model=model, itn=itn) if single else outputs(files, stamps, model, itn, took)
    paths = {}
    for kind, (rows, order, value) in made.items():
        paths[kind] = f"{folder.rstrip('/')}/{stem}.{kind}"
        write_lines(rows, order, value, paths[kind])
    return paths


def write_each(files: DataFrame, stamps: DataFrame, folder: str, level: str = "segment", model: str = "fast", itn: bool = False) -> None:
    """Write the three outputs of every good file, in the layout of a single one, as one ordered file each under ``folder``, all in one job a kind. Names are
    output_stem()'s; files of one stem also have their id in it. For the columns see single_outputs()."""
    stems = _good(files).select("file_id", output_stem(F.col("name")).alias("stem"))
    again = stems.groupBy(F.col("stem").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    stems = stems.join(again, F.col("stem") == F.col("_again"), "left").select("file_id", F.when(F.col("_n") > 1, F.concat_ws("_", "stem", F.coalesce(F.col("file_id").cast("string"), F.lit("none")))).otherwise(F.col("stem")).alias("stem"))
    for kind, (rows, order, value) in single_outputs(files, stamps, level, model, itn).items():
        named = _with(rows, stems, "stem").withColumn("_name", F.concat("_stem", F.lit(f".{kind}")))
        write_files(named, "_name", order, value, folder)


def write_lines(rows: DataFrame, order: list[str], value: str, path: str) -> None:
    """Sorted text files under ``path``; their names keep the order of their ranges, so nothing is gathered into one task."""
    rows.orderBy(*order).select(F.col(value).alias("value")).write.mode("overwrite").text(path)
