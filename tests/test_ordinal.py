"""Pairs by position, and scans that read only what changed."""

from __future__ import annotations

import os
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stampline.operators import batch, ordinal
from stampline.sources import incremental, storage


@pytest.mark.parametrize("sizes", [(1, 1), (50, 37), (0, 5), (5, 0), (1000, 1000)])
def test_positions(spark, sizes):
    dice = random.Random(sum(sizes))
    left = [(dice.randrange(-300, 300), i) for i in range(sizes[0])]
    right = [(None if i == 0 else dice.random(), i) for i in range(sizes[1])]
    a, b = spark.createDataFrame(left, "k int, a int").repartition(5), spark.createDataFrame(right, "r double, b int").repartition(3)
    want = list(zip(sorted(left), sorted(right, key=lambda x: (x[0] is not None, x[0] or 0)), strict=False))
    got = sorted(tuple(r) for r in ordinal.ordinal_join(a, b, ["k", "a"], ["r"]).select("no", "k", "a", "b").collect())
    assert got == [(i, *x, y[1]) for i, (x, y) in enumerate(want)]
    assert ordinal.ordinal_join(a, b, ["k"], ["r"], "full").count() == max(sizes)


def test_equal_rows_and_one_value(spark):
    rows = spark.range(5000).select(F.lit(7).alias("k"))
    got = [r["no"] for r in ordinal.numbered(rows, ["k"]).collect()]
    assert sorted(got) == list(range(5000))
    parts = ordinal.numbered(rows, ["k"]).groupBy(F.floor(F.col("no") / 1000)).count().count()
    assert parts == 5


def test_results_that_shift(spark):
    files = spark.createDataFrame([(i, f"f{i}", False, 1000) for i in range(5)], "file_id long, name string, is_video boolean, duration long")
    said = spark.createDataFrame([(0, "zero"), (1, ""), (2, "two words"), (4, "four")], "file_id long, text string")
    rows = lambda p: [tuple(r) for r in batch.results(files, said, p).orderBy("file_id").select("file_id", "ok", "text").collect()]
    fail = "[Transcription failed: {}]".format
    assert rows("key") == [(0, True, "zero"), (1, False, fail("empty text")), (2, True, "two words"), (3, False, fail("no result")), (4, True, "four")]
    assert rows("position") == [(0, True, "zero"), (1, True, "two words"), (2, True, "four"), (3, False, fail("no result")), (4, False, fail("no result"))]


def test_scans_read_what_changed(spark, tmp_path, monkeypatch):
    folder = tmp_path / "media"
    folder.mkdir()
    for name in "abcdef":
        (folder / name).write_text(name * 10)
    (folder / "empty").write_text("")
    of = lambda frame: {os.path.basename(r["path"]): (r["state"], r["sha256"]) for r in frame.collect()}
    digest = lambda t: sha256(t.encode()).hexdigest()
    first = storage.stored(incremental.scan_changes(spark, str(folder)))
    assert of(first) == {n: ("new", digest(n * 10)) for n in "abcdef"}
    old = os.stat(folder / "a")
    (folder / "b").write_text("B" * 10)  # of one length, so only the time tells
    os.utime(folder / "b", (old.st_atime + 50, old.st_mtime + 50))
    os.utime(folder / "c", (old.st_atime + 50, old.st_mtime + 50))
    (folder / "d").unlink()
    (folder / "g").write_text("a" * 10)
    (folder / "h").write_text("h")
    # what is the same isn't read: with other contents, but length and time kept, it goes unseen
    was = os.stat(folder / "e")
    (folder / "e").write_text("E" * 10)
    os.utime(folder / "e", ns=(was.st_atime_ns, was.st_mtime_ns))
    second = storage.stored(incremental.scan_changes(spark, str(folder), first.filter("state <> 'gone'")))
    assert of(second) == {
        "a": ("same", digest("a" * 10)), "b": ("changed", digest("B" * 10)), "c": ("touched", digest("c" * 10)), "d": ("gone", digest("d" * 10)), "e": ("same", digest("e" * 10)),
        "f": ("same", digest("f" * 10)), "g": ("copy", digest("a" * 10)), "h": ("new", digest("h")),
    }
    assert {s for s, _ in of(incremental.scan_changes(spark, str(folder), second.filter("state <> 'gone'"))).values()} == {"same"}
