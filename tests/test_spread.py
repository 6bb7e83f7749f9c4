"""Blocks that are dealt packed and folded apart, against whole files."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from stampline.operators import segment
from stampline.operators.segment import Block, Open, Rules, cues, segments
from stampline.settings import DEFAULT, Settings
from stampline.sources import adapters
from stampline.sources.packed import pack, unpack

SCHEMA = "file_id long, pos long, word string, start long, end long"


def _file(dice, n):
    """(word, start, end) of one kind: with or without ends of sentences, silences, words that overlap, long ones."""
    finals, jumps, lengths = dice.choice([0, 0.02, 0.2]), dice.choice([[0], [0, 80, 80, 80, 700], [80, 499, 500, -150], [300, 900, -400], [0, 5000, 10]]), dice.choice([[0], [50, 200, 300], [200, 1900, 2600]])
    at, out = dice.randrange(1000), []
    for _ in range(n):
        at += dice.choice(jumps)
        out.append(("x." if dice.random() < finals else dice.choice(["a", "b c", "", None]), at, at + dice.choice(lengths)))
        at = out[-1][2]
    return out


@pytest.fixture(scope="module")
def words(spark):
    dice = random.Random(3)
    rows = []
    for file in (None, *range(1, 90)):
        pos = dice.choice([0, 0, 0, -3, 40])
        for w, s, e in _file(dice, dice.choice([1, 5, 60, 60, 150])):
            rows.append((file, pos, w, s, e))
            pos += dice.choice([1, 1, 1, 9]) if file and file % 4 == 0 else 1
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "file_id").sortWithinPartitions("file_id", "pos").cache()


def _rows(frame):
    return sorted(map(tuple, frame.select("file_id", "seg_no", "start", "end", "n_words", "text").collect()), key=repr)


def test_spread_equals_files(spark, words):
    """Batches end within blocks and files, too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for settings, merge, block in ((DEFAULT, True, 16), (DEFAULT, False, 60), (Settings(silence=0.0, srt_words=2), True, 7), (Settings(max_word=0.0, srt_words=1), False, 1), (Settings(srt_seconds=0.5), True, 30)):
            got = segments(words, settings, merge=merge, block=block, together=True, spread=True)
            want = segments(words, settings, merge=merge, block=None)
            assert got.schema == want.schema and _rows(got) == _rows(want)
        want = _rows(cues(words, block=None))
        assert len(want) > 500
        for block in (20, 10**9):
            assert _rows(cues(words, block=block, together=True, spread=True)) == want
        numbered = [sorted((r["file_id"] or 0, r["cue_no"], r["start"], r["text"]) for r in cues(words, block=b, together=True, spread=b == 20, numbered=True).collect()) for b in (20, 10**9)]
        assert numbered[0] == numbered[1]
        assert cues(words.limit(0), block=16, together=True, spread=True).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_are_dealt_once_and_packed(spark, data, monkeypatch):
    """Of all exchanges only that of documents and one of a row a block have the words; what is dealt again is a small part of them."""
    from stampline.plans import queries

    plans, real, made = [], segment.stored, []

    def watched(df, *options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        made.append(real(df, *options))
        return made[-1]

    monkeypatch.setattr(segment, "stored", watched)
    got = queries.QUERIES["segments_pieces"](spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    assert plans[0].count("Exchange") == 2 and plans[0].index("MapInArrow") < plans[0].index("Exchange") and not any("Generate" in p for p in plans[1:])
    seams, n = made[0].filter("piece is null").collect(), adapters.words(docs).count()
    blocks = sum(-(-r["n"] // 500) for r in adapters.words(docs).groupBy("file_id").agg({"pos": "count"}).withColumnRenamed("count(pos)", "n").filter("n > 500").collect())
    assert len({(r["file_id"], r["block"]) for r in seams}) == blocks > 10
    assert sum(len(unpack(x)[0]) for r in seams for x in (r["head"], r["tail"]) if x is not None) < n / 5
    assert _rows(got) == _rows(cues(adapters.words(docs), block=None))


def test_sure_words_begin_segments_whatever_came_before():
    dice, known = random.Random(8), 0
    for _ in range(1500):
        rules = Rules(dice.choice([1, 3, 8]), dice.choice([500, 5000]), dice.choice([0, 500]))
        said = [(w or "", s, e, (w or "").endswith(".")) for w, s, e in _file(dice, 40)]
        for punctuated in (True, False) if not any(f for *_, f in said) else (True,):
            r = rules._replace(punctuated=punctuated)
            w, s, e, f = (list(c) for c in zip(*said, strict=True))
            cuts = Block(list(range(40)), w, s, s, e, f, r).sure()
            known += cuts is not None
            for _ in range(8 if cuts else 0):
                at = s[0] - dice.choice([0, 100, 600, 4000, -300])
                before = [("y." if punctuated and dice.random() < 0.2 else "y", at - 90 * k, at - 90 * k + 80, False) for k in range(dice.randrange(12), -1, -1)]
                open_, begins = None, set()
                for k, (word, start, end, final) in enumerate(before + said):
                    open_ = open_ or Open(start, start, [])
                    fresh = not open_.text
                    closed = open_.add(word, start, end, final or word == "y.", r)
                    if fresh:
                        begins.add((k - len(before), False, closed[0] if closed else open_.begin))
                    elif closed and open_.text:
                        begins.add((k - len(before), True, open_.begin))
                assert set(cuts) <= begins
    assert known > 500


@pytest.mark.parametrize("column", [pa.array([2**62, -(2**63), None, 5]), pa.array([2**63 - 1, -(2**63), 7]), pa.array([0.1, float("inf"), -5e-324]), pa.array(["é", "", None]), pa.array([True, None]), pa.array([], pa.int64()), pa.array([None, 3.5])])
def test_packs_lose_nothing(column):
    assert unpack(pack([column, column]))[1].equals(column) and unpack(pack([column.slice(1)]))[0].equals(column.slice(1))
