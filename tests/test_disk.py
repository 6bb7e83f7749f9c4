"""What is shuffled and stored, so that disk stays in proportion to the input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stampline.operators import intervals, render, segment
from stampline.sources import adapters


def test_words_are_not_shuffled(spark, data):
    """Running sums over batches that end within documents, and documents without words."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.filter("doc_id < 2").selectExpr("doc_id + 1000000 as doc_id", "case when doc_id % 2 = 0 then ' ' end as text", "source"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = adapters.words(docs)
        plan = words._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and plan.index("Exchange") > plan.index("Generate")
        got = sorted(map(tuple, words.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, now, at = [], None, 0
    for file, pos, word, gap, dur in sorted(map(tuple, adapters._paced(docs).collect())):
        now, at = file, (at if file == now else 0) + gap + dur
        want.append((file, pos, word, at - dur, at))
    assert len(got) > 10_000 and got == want


def test_few_windows_visit_many_words(spark, monkeypatch):
    """Windows of many lengths: words are dealt once, not once for each length, and those that no window asks for not at all."""
    words = spark.range(20_000).selectExpr("id % 4 as k", "id * 10 as start", "id * 10 + 8 as end")
    looks = spark.range(40).selectExpr("1L as k", "id * 4000 as start", "id * 4000 + cast(pow(4, id % 6) as long) * 20 as end", "id")
    sizes, real = [], intervals._split
    monkeypatch.setattr(intervals, "_split", lambda x, y, most: sizes.append((x.count(), y.count())) or real(x, y, most))
    got = intervals.interval_join(words, looks, "k").groupBy("id").count().collect()
    a, b = words.filter("k = 1").collect(), looks.collect()
    assert {r[0]: r[1] for r in got} == {y[3]: n for y in b if (n := sum(x[1] < y[2] and y[1] < x[2] for x in a))}
    assert sum(n for n, _ in sizes) < 6_000 and sum(n for _, n in sizes) < 400


@pytest.mark.parametrize(("mine", "other", "kept"), [({}, {}, [0]), ({0: 10**6}, {0: 9, 3: 5, 5: 1}, [0]), ({0: 10**9}, {9: 1}, [0, 9]), ({0: 10, 2: 10**6}, {0: 10}, [0, 2])])
def test_levels_kept(mine, other, kept):
    assert intervals._kept(mine, other) == kept


def _rows(frame):
    return sorted((tuple(r[c] for c in ("file_id", "seg_no", "start", "end", "n_words", "text")) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("txt", [False, True])
def test_words_that_lie_together_are_folded_there(spark, data, txt):
    """As dealt words are, with no exchange but that of documents; of files longer than a block, too."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    words = adapters.words(docs)
    want = _rows(segment.segments(words, txt=txt, block=None))
    assert _rows(segment.segments(words, txt=txt, together=True)) == want == _rows(segment.segments(words, txt=txt, block=300, together=True))
    want = _rows(segment.cues(words, txt=txt, block=None))
    assert _rows(segment.cues(words, txt=txt, together=True)) == want == _rows(segment.cues(words, txt=txt, block=300, together=True))
    stored, written = segment.stored, []
    try:
        segment.stored = lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df)
        cues = render.srt(segment.cues(words, txt=txt, together=True, numbered=True))
    finally:
        segment.stored = stored
    plans = [*written, cues._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) == 2 and [p.count("Exchange") for p in plans] == [1, 0] and plans[0].index("Exchange") > plans[0].index("Generate")


def test_cue_numbers_leave_out_blank_segments(spark):
    """Of white space as Spark has it (no-break and ideographic spaces are, the separator \x1c isn't), in files of one and of several pieces."""
    said = ["　.", "\xa0", "a.", " \x85", "\x1c", "b c d.", None, "e?"]
    rows = [(f, i, said[(i * 5 + i // 8 + f) % 8], 3000 * i, 3000 * i + 200) for f in (1, 2) for i in range(200)]
    words = spark.createDataFrame(rows, "file_id long, pos long, word string, start long, end long")
    want = sorted(map(tuple, render.srt(segment.cues(words, block=None)).collect()))
    assert 200 < len(want) < 400
    for block in (None, 10, 10**9):
        assert sorted(map(tuple, render.srt(segment.cues(words, block=block, numbered=True)).collect())) == want
