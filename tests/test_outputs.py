"""Outputs on disk, scans of media files, fallbacks of normalisation, and the sizes that queries depend on."""

from __future__ import annotations

import wave
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from stampline.functions import scalar, validate
from stampline.operators import itn, render, segment
from stampline.plans.oracles import ORACLE_SQL
from stampline.plans.queries import QUERIES
from stampline.sources import media, storage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def read(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


FAILED = "[Transcription failed: no result]"
FILE_SCHEMA, STAMP_SCHEMA = "file_id long, name string, text string, duration long, file_no long", "file_id long, pos long, start long, end long, text string"


def test_written_batch(spark, tmp_path):
    """Files with stamps, without, failed and without an id: none loses its text."""
    files = spark.createDataFrame([(1, "a.b.wav", "one two", 3000, 1), (2, "c.mp4", FAILED, 61000, 2), (3, "d.wav", "good text no stamps", 9000, 3), (None, "e.wav", "no id", 1000, 4)], FILE_SCHEMA)
    stamps = spark.createDataFrame([(1, 0, 0, 900, 'say "one"'), (1, 1, 1000, 2000, "two"), (None, 0, 0, 500, "nameless")], STAMP_SCHEMA)
    paths = render.write_outputs(files, stamps, str(tmp_path))
    assert paths == {k: f"{tmp_path}/batch_transcription_4_files.{k}" for k in ("txt", "srt", "csv")}
    assert Counter(read(spark, paths["csv"])) == Counter(
        ["file,start_time,end_time,duration,text", '"a.b.wav",0.000,0.900,0.900,"say ""one"""', '"a.b.wav",1.000,2.000,1.000,"two"', '"d.wav",0.000,9.000,9.000,"good text no stamps"', '"e.wav",0.000,0.500,0.500,"nameless"']
    )
    cues = [r["cue"].split("\n") for r in render.batch_srt(files, stamps.withColumnRenamed("pos", "cue_no")).orderBy("no").collect()]
    assert [c[:3] for c in cues] == [
        ["1", "00:00:00,000 --> 00:00:02,000", "[FILE: e.wav]"], ["2", "00:00:00,000 --> 00:00:00,500", "nameless"], ["3", "00:00:00,000 --> 00:00:02,000", "[FILE: a.b.wav]"],
        ["4", "00:00:00,000 --> 00:00:00,900", 'say "one"'], ["5", "00:00:01,000 --> 00:00:02,000", "two"], ["6", "00:00:00,000 --> 00:00:02,000", "[FILE: d.wav]"], ["7", "00:00:00,000 --> 00:00:05,000", "good text no stamps"],
    ]
    text = "\n".join(read(spark, paths["txt"]))
    assert "Batch Transcription - 4 files" in text
    for body in ("[00:00:00] say", "[00:00:01] two", FAILED, "good text no stamps", "[00:00:00] nameless", "FILE 2: c.mp4"):
        assert body in text


@pytest.mark.parametrize("stamped", [True, False])
def test_written_single_file(spark, tmp_path, stamped):
    """One file has a layout of its own: no file column, no cue with its name, and a header with its own name."""
    files = spark.createDataFrame([(1, "a.b.wav", "one two", 3000, 1)], FILE_SCHEMA)
    stamps = spark.createDataFrame([(1, 3, 0, 900, 'say "one"'), (1, 8, 1000, 2000, "two")], STAMP_SCHEMA).filter(str(stamped))
    paths = render.write_outputs(files, stamps, str(tmp_path), took=1.234)
    assert paths == {k: f"{tmp_path}/a.b_transcription.{k}" for k in ("txt", "srt", "csv")}
    head = ["Audio File: a.b.wav", "Model: fast", "Duration: 0m 3s", "Processing Time: 1.23s", "ITN Applied: No", "", "=" * 60, "TRANSCRIPTION", "=" * 60, ""]
    ends = {
        "csv": ["start_time,end_time,duration,text", *(['0.000,0.900,0.900,"say ""one"""', '1.000,2.000,1.000,"two"'] if stamped else ['0.000,5.000,5.000,"one two"'])],
        "srt": ["1", "00:00:00,000 --> 00:00:00,900", 'say "one"', "", "2", "00:00:01,000 --> 00:00:02,000", "two", ""] if stamped else ["1", "00:00:00,000 --> 00:00:05,000", "one two", ""],
        "txt": head + (['[00:00:00] say "one"', "[00:00:01] two"] if stamped else ["one two"]),
    }
    for kind, want in ends.items():
        # parts are named by their order, and rows of one range stay in theirs
        found = [line for f in sorted(Path(paths[kind]).glob("part-*")) for line in f.read_text().split("\n")[:-1]]
        assert found == want


def test_single_file_of_words(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.wav", "x", 9000, 5000), (2, "b.wav", FAILED, 1, 1), (3, "c.wav", None, None, 1)], "file_id long, name string, text string, duration long, took long")
    words = spark.createDataFrame([(1, i, i * 300, i * 300 + 250, w) for i, w in enumerate("a b c d. e f g h i j k l m n.".split())], "file_id long, pos long, start long, end long, word string")
    got = {k: sorted((r["file_id"], r["part"], r["pos"], r["line"]) for r in rows.collect()) for k, (rows, _, _) in render.single_outputs(files, words, "word").items()}
    want = render.srt(segment.cues(words)).collect()
    assert [x[3] for x in got["srt"] if x[0] == 1] == [r["cue"] for r in sorted(want, key=lambda r: r["cue_no"])] and len(want) > 1
    assert [x[3] for x in got["txt"] if x[:2] == (1, 1)] == [r["line"] for r in render.txt_lines(segment.cues(words, txt=True)).orderBy("seg_no").collect()]
    assert [x[3] for x in got["csv"] if x[:2] == (1, 1)] == [r["line"] for r in words.orderBy("pos").select(render.csv_line(F.col("start"), F.col("end"), F.col("word")).alias("line")).collect()]
    assert {x[0] for rows in got.values() for x in rows} == {1, 3}
    assert [x[3] for x in got["srt"] if x[0] == 3] == ["1\n00:00:00,000 --> 00:00:05,000\n\n"]


def test_a_failed_single_file_writes_nothing(spark, tmp_path):
    files = spark.createDataFrame([(2, "c.mp4", FAILED, 61000, 1)], FILE_SCHEMA)
    assert render.write_outputs(files, spark.createDataFrame([], STAMP_SCHEMA), str(tmp_path)) == {} and not list(tmp_path.iterdir())


def test_scan_reads_wave_files_only(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 4000)
    (tmp_path / "b.MP4").write_bytes(b"x" * 10)
    (tmp_path / "c.wav").write_bytes(b"no wave")
    (tmp_path / "d.txt").write_bytes(b"x")
    (tmp_path / "e.wav").write_bytes(b"")
    got = {r["name"]: (r["length"], r["is_video"], r["supported"], r["duration"]) for r in media.scan_media(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (8044, False, True, 0.5), "b.MP4": (10, True, True, None), "c.wav": (7, False, True, None), "d.txt": (1, False, False, None)}


def test_estimated_times_have_no_binary_fractions(spark):
    got = [r["x"] for r in spark.range(20000).select(scalar.estimated_ms(F.col("id")).alias("x")).orderBy("x").collect()]
    assert got == sorted(max(5000, 400 * n) for n in range(20000))


@pytest.mark.parametrize("name", ["srt_estimated", "csv_estimated"])
def test_estimated_outputs_of_more_rows(spark, data, name):
    con = duckdb.connect()
    for given in ("documents", "labels"):
        con.sql(f"create view {given} as select * from '{data.replace('0.001', '0.01')}/{given}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, data.replace("0.001", "0.01"))
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())


def test_normalisation_fallbacks(spark, monkeypatch):
    def fails(text):
        raise ValueError(text)

    said = F.lit("one. two hundred")
    assert one(spark, itn.apply(said, split=lambda t: ["twenty two", "three"])) == "22 3"
    assert one(spark, itn.apply(said, split=fails)) == one(spark, itn.apply(said)) == one(spark, itn.apply(said, split=lambda t: []))
    monkeypatch.setattr(itn, "_made", [])
    assert itn.grammar_of("xx", fails) is None
    first = itn.grammar_of("en", lambda x: x.upper)
    assert first() == "EN" and itn.grammar_of("de", lambda x: x.upper) is first


def test_error_texts(spark):
    assert one(spark, scalar.error_response(F.lit("network"), F.lit("m"))) == "### ❌ Network Error\n\nm"
    assert one(spark, scalar.error_response(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "### ❌ Unexpected Error\n\n"
    assert len(scalar.ERRORS) == 10
    none = F.lit(None).cast("string")
    assert one(spark, validate.structure_error(F.lit("list"), F.lit(2), F.lit(2))) == "Index 2 out of range (result has 2 items)"
    assert one(spark, validate.structure_error(F.lit("list"), F.lit(2), F.lit(1))) is None
    assert one(spark, validate.text_error(F.lit("str"), none, F.lit("x"))) is None and one(spark, validate.text_error(F.lit("str"), none, none)) == "Transcription is empty"
    assert [one(spark, scalar.itn_status(F.lit(w), a)) for w, a in ((True, True), (True, False), (False, True))] == ["ITN: applied", "ITN: not installed", "ITN: disabled"]


def test_numbering_runs_over_all_files(spark):
    rows = spark.createDataFrame([(f, i) for f in (9, None, 3, 5) for i in range(f or 2)], "g long, i long").repartition(4)
    got = [(r["g"], r["i"], r["no"]) for r in render.global_numbers(rows, "g", ["i"]).orderBy("no").collect()]
    assert got == [(g, i, k) for k, (g, i) in enumerate(((f, i) for f in (None, 3, 5, 9) for i in range(f or 2)), 1)]


def test_durations_need_no_window(spark, data):
    plan = QUERIES["media_totals"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_checkpoints_are_never_of_one_machine():
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.stored(SimpleNamespace(sparkSession=SimpleNamespace(conf={}, sparkContext=context)))
