"""Hand-traced vectors: segmentation, formats, chunks, validations, normalisation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stampline.functions import scalar, validate
from stampline.operators import chunks, itn, render, segment
from stampline.settings import Settings
from stampline.sources import media

VECTORS = {
    "V1": ([(0, 400, "Hello"), (400, 900, "world."), (1000, 1300, "Next"), (1300, 1700, "one.")], [(0, 900, "Hello world."), (900, 1700, "Next one.")], None),
    "V2": ([(0, 400, "a"), (900, 1300, "b"), (1301, 1500, "c.")], [(0, 400, "a"), (900, 1500, "b c.")], [(0, 1500, "a b c.")]),
    "V3": ([(0, 400, "a."), (400, 600, "b"), (1600, 2000, "c."), (2000, 2300, "d"), (2300, 2600, "e.")], [(0, 400, "a."), (400, 600, "b"), (1600, 2600, "c. d e.")], None),
    "V4": ([(0, 400, "One."), (10000, 10300, "Two"), (10300, 10600, "three.")], [(0, 400, "One."), (400, 10300, "Two"), (10300, 10600, "three.")], [(0, 400, "One."), (400, 10600, "Two three.")]),
    "V6": ([(0, 300, "a"), (300, 18300, "With"), (18300, 18600, "b.")], [(0, 300, "a"), (16300, 18600, "With b.")], None),
    "V7": ([(37000, 55000, "With"), (55000, 55300, "you.")], [(37000, 55000, "With"), (55000, 55300, "you.")], [(37000, 55300, "With you.")]),
    "V8": ([(0, 1000, "a."), (500, 700, "b."), (700, 900, "c.")], [(0, 1000, "a."), (1000, 700, "b."), (700, 900, "c.")], [(0, 1000, "a."), (1000, 1000, "b."), (700, 900, "c.")]),
}
VECTORS["V5"] = ([(300 * i, 300 * i + 250, f"w{i}") for i in range(10)], [(0, 2350, "w0 w1 w2 w3 w4 w5 w6 w7"), (2350, 2950, "w8 w9")], [(0, 2950, " ".join(f"w{i}" for i in range(10)))])


def test_segments(spark):
    names = sorted(VECTORS)
    rows = [(f, p, w, s, e) for f, n in enumerate(names) for p, (s, e, w) in enumerate(VECTORS[n][0])]
    words = spark.createDataFrame(rows, "file_id long, pos long, word string, start long, end long")
    for which, frame in ((1, segment.segments(words, merge=False)), (2, segment.cues(words))):
        got = {}
        for r in frame.orderBy("file_id", "seg_no").collect():
            got.setdefault(r["file_id"], []).append((r["start"], r["end"], r["text"]))
        for f, n in enumerate(names):
            assert got[f] == (VECTORS[n][which] or VECTORS[n][1]), n
    seconds = words.select("file_id", "pos", "word", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    assert segment.segments(seconds, unit=1).count() == segment.segments(words).count()
    assert segment.segments(words.limit(0)).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_formats(spark):
    for s, want in ((0.0, "00:00:00,000"), (1.5, "00:00:01,500"), (3661.25, "01:01:01,250"), (1.001, "00:00:01,000")):
        assert one(spark, scalar.srt_time(F.lit(s))) == want
    assert one(spark, scalar.estimated_seconds(F.lit(10))) == 5.0 and one(spark, scalar.estimated_seconds(F.lit(50))) == 20.0
    assert one(spark, scalar.csv_text(F.lit('a"b'))) == '"a""b"'
    assert one(spark, scalar.cache_key(F.lit("/tmp/gradio/test_audio.wav"), F.lit("x"))) == "1ba8a4027a335dbb_x"
    assert one(spark, scalar.collapse_spaces(F.lit("  a   b\tc  "))) == "a b\tc"
    assert one(spark, scalar.word_count(F.lit("a b  c"))) == 3
    assert render.output_name("talk.a.wav", 1) == "talk.a_transcription" and render.output_name(None, 3) == "batch_transcription_3_files"


def test_chunks(spark):
    settings = Settings()
    files = spark.createDataFrame([(1, 250_000)], "file_id long, duration long")
    got = [tuple(r)[1:] for r in chunks.plan(files, settings).orderBy("chunk_no").collect()]
    assert got == [(0, 0, 120000, 0, 122000, 0), (1, 120000, 240000, 118000, 242000, 2000), (2, 240000, 250000, 238000, 250000, 2000)]
    stamps = spark.createDataFrame([(1, 1, i, "w", s, e, 2000, 120000) for i, (s, e) in enumerate([(500, 1900), (1500, 2500), (3000, 4000), (1000, 2000)])], "file_id long, chunk_no long, pos long, word string, start long, end long, left_ctx long, chunk_start long")
    assert [(r["start"], r["end"]) for r in chunks.shift(stamps, settings).orderBy("pos").collect()] == [(120000, 120500), (121000, 122000)]
    words = spark.createDataFrame([(1, 0, "w", 121000, 121400)], "file_id long, pos long, word string, start long, end long")
    raw = chunks.raw_stamps(words, settings)
    assert chunks.shift(raw, settings).count() == 2 and chunks.shift(raw, settings, "dedup").count() == 1
    files = spark.createDataFrame([(1, 100_000), (2, 151_000), (3, 150_000)], "file_id long, duration long")
    assert [(r["is_long"], r["batch_chunked"]) for r in chunks.route(files, settings).orderBy("file_id").collect()] == [(False, True), (True, True), (False, True)]


@pytest.mark.parametrize("seconds,want", [(0.0999, "too_short"), (0.1, None), (86400.0, None), (86400.1, "too_long")])
def test_durations(spark, seconds, want):
    assert one(spark, validate.duration_error(F.lit(seconds))) == want


def test_energy_and_itn(spark, tmp_path):
    assert [one(spark, validate.energy_state(F.lit(x))) for x in (0.0009, 0.001, 0.0099, 0.01)] == ["silent", "warning", "warning", "ok"]
    for said, want in (("twenty twenty two", "2022"), ("one hundred dollars", "$100"), ("five point five percent", "5.5%"), ("no one came", "no one came")):
        assert itn.normalise(said) == want
    sizes = [len(c.split()) for c in one(spark, itn.word_chunks(F.lit("w " * 120)))]
    assert sizes == [50, 50, 20] and one(spark, itn.word_chunks(F.lit(""))) == [""]
    assert one(spark, itn.sentences(F.lit("A b. C? d"))) == ["A b.", "C?", "d"]
    long = " ".join(["w"] * 49 + ["twenty", "two"])
    assert [one(spark, itn.apply_segment(F.lit(t))) for t in (" twenty two ", "", long)] == ["22", "", "w " * 49 + "20 2"]
    import wave

    with wave.open(str(tmp_path / "a.WAV"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\0\0" * 8000)
    (tmp_path / "b.mp4").write_bytes(b"x")
    got = {r["name"]: r for r in media.scan_media(spark, [str(tmp_path)]).collect()}
    assert got["a.WAV"]["duration"] == 0.5 and got["b.mp4"]["is_video"] and got["b.mp4"]["supported"]
