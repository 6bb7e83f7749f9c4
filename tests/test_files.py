"""One ordered file per output: written whole or not at all, and read back."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stampline.operators import render
from stampline.sources import outputs

FILES, STAMPS = "file_id long, name string, text string, duration long, took long", "file_id long, pos long, start long, end long, text string"


def test_files_are_whole_and_in_order(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 7).alias("f"), "id").withColumn("name", F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(".txt"))).repartition(9)
    outputs.write_files(rows, "name", ["id"], "id", f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == [f"f{i}.txt" for i in range(7)]
    for i in range(7):
        assert open(f"{tmp_path}/out/f{i}.txt").read() == "".join(f"{n}\n" for n in range(40_000) if n % 7 == i)
    outputs.write_files(rows.filter("f = 3 and id < 20"), "name", ["id"], "id", f"{tmp_path}/out")
    assert open(f"{tmp_path}/out/f3.txt").read() == "3\n10\n17\n" and len(os.listdir(f"{tmp_path}/out")) == 7


@pytest.mark.parametrize("bad", ["raise_error('lost')", "'up/down'", "cast(null as string)", "'..'"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = spark.range(1000).selectExpr("id", f"if(id = 999, {bad}, concat('f', id % 5)) as name").repartition(4)
    with pytest.raises(Exception):  # noqa: B017  whatever Spark wraps it in
        outputs.write_files(rows, "name", ["id"], "id", f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []


TEXTS = ["plain", 'say "two"\nlines', "", "a\n\nblank line", "1\nlooks like a cue", "comma, and ; Ünï \U0001f600", "ends with a break\n", "\r\n in it", "7"]


def test_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.wav", "x", 9000, 1), (2, "a.mp4", "no stamps\n\nat all", 5000, 1), (3, "b.c.wav", "[Transcription failed: no result]", 1, 1), (None, "d.wav", "y", 1, 1)], FILES)
    stamps = spark.createDataFrame([(i, k, k * 1000, k * 1000 + 250, t) for i in (1, None) for k, t in enumerate(TEXTS)], STAMPS)
    render.write_each(files, stamps, str(tmp_path))
    stems = ["a_transcription_1", "a_transcription_2", "d_transcription"]
    assert sorted(os.listdir(tmp_path)) == sorted(f"{s}.{k}" for s in stems for k in ("txt", "srt", "csv"))
    got = Counter((r["output"], r["no"], r["start"], r["end"], r["text"]) for r in outputs.read_files(spark, str(tmp_path)).collect())
    want = [(f"{s}.{k}", n, (n - 1) * 1000, (n - 1) * 1000 + 250, t) for s in (stems[0], stems[2]) for k in ("srt", "csv") for n, t in enumerate(TEXTS, 1)]
    assert got == Counter(want + [(f"{stems[1]}.{k}", 1, 0, 5000, "no stamps\n\nat all") for k in ("srt", "csv")])
    one = outputs.read_files(spark, f"{tmp_path}/{stems[0]}.srt")
    assert one.count() == len(TEXTS) and one.select("file").distinct().first()["file"] is None


def test_parsers_of_odd_files(spark, tmp_path):
    assert list(outputs.srt_cues(iter([]))) == list(outputs.srt_cues(iter(["no cue\n", "here"]))) == []
    assert list(outputs.srt_cues(iter(["\n", "4\n", "00:00:01,000 --> 00:00:02,500\n", "last without a break"]))) == [(4, 1000, 2500, "last without a break")]
    assert list(outputs.csv_rows(iter([]))) == []
    assert list(outputs.csv_rows(iter(["file,start_time,end_time,duration,text\n", '"a ""b""",0.000,1.250,1.250,"x\n', 'y"\n']))) == [('a "b"', 1, 0, 1250, "x\ny")]
    assert outputs.read_files(spark, f"{tmp_path}").count() == 0
