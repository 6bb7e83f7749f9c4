"""Pieces of files against whole files, and repaired folds against repair()."""

from __future__ import annotations

import random

import pytest

from stampline.operators.segment import cues, repair, segments
from stampline.settings import DEFAULT, Settings

SCHEMA = "file_id long, pos long, word string, start long, end long"


@pytest.fixture(scope="module")
def words(spark):
    """Files with and without ends of sentences, with silences, overlaps, long and null words, and gaps in their positions."""
    dice = random.Random(5)
    rows = []
    for file in (1, 2, 3, 4, None):
        at, pos = 0, 0
        for _ in range(700):
            at += dice.choice([0, 0, 80, 80, 80, 499, 500, 700, -150, 6000 if file == 2 else 80])
            end = at + dice.choice([50, 200, 300, 1900, 2500])
            word = dice.choice(["a", "b", "cc", "d.", "e?", None, "", "x"]) if file != 3 else dice.choice(["a", "b", None])
            rows.append((file, pos, word, at, end))
            at, pos = end, pos + (40 if dice.random() < 0.02 else 1)
    dice.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


def ordered(frame):
    return sorted(map(tuple, frame.select("file_id", "seg_no", "start", "end", "n_words", "text").collect()), key=repr)


@pytest.mark.parametrize("merge", [False, True])
@pytest.mark.parametrize("block", [1, 16, 100, 10**9])
def test_pieces_equal_files(words, merge, block):
    for settings in (DEFAULT, Settings(silence=0.0)):
        whole, cut = segments(words, settings, merge=merge, block=None), segments(words, settings, merge=merge, block=block)
        assert whole.schema == cut.schema and ordered(whole) == ordered(cut)


def test_repair_in_the_fold(words):
    want = ordered(repair(segments(words, block=None)))
    assert want == ordered(cues(words)) == ordered(cues(words, block=None)) == ordered(cues(words, block=16))
    assert cues(words.limit(0)).count() == cues(words.limit(0), block=16).count() == 0


def _sizes(spark, monkeypatch, rows, block):
    """Words of each piece that a file is folded in, and whether the segments are those of the whole."""
    from stampline.operators import segment

    sizes, real = [], segment._pieces

    def watched(*args):
        pieces = real(*args)
        sizes.extend(r["count"] for r in pieces.groupBy("piece").count().collect())
        return pieces

    monkeypatch.setattr(segment, "_pieces", watched)
    words = spark.createDataFrame(rows, SCHEMA)
    assert ordered(cues(words, block=block)) == ordered(cues(words, block=None))
    return sorted(sizes)


@pytest.mark.parametrize("kind", ["no end of a sentence", "one at the end", "only silences", "only too long", "a word at a time", "no time passes"])
def test_long_files_are_cut(spark, monkeypatch, kind):
    """Also where no sentence ends anywhere, which the maps of the blocks make possible."""
    step = {"only too long": 1900, "no time passes": 0}.get(kind, 300)
    gap = lambda i: 700 if kind == "a word at a time" or kind == "only silences" and i % 5 == 0 else 0
    rows, at = [], 0
    for i in range(8000):
        at += step + gap(i)
        last = kind != "no end of a sentence" and i == 7999
        rows.append((1, i, "end." if last else f"w{i % 10}", at, at + (step if kind == "only too long" else min(step, 250))))
    sizes = _sizes(spark, monkeypatch, rows, 500)
    # of words that take no time only the last one ends a segment, so there is nothing to cut
    assert sizes == [8000] if kind == "no time passes" else len(sizes) >= 15 and sizes[-1] <= 560


def test_random_files_by_maps(spark):
    """Many small files of every kind of time and word, in blocks of seven: each block is entered in many states."""
    dice = random.Random(11)
    rows = []
    for file in range(400):
        at, finals, jumps = dice.randrange(1000), dice.choice([0, 0.02, 0.2]), dice.choice([[0], [0, 80, 499, 500], [300, 900, -400], [0, 5000, 10]])
        for pos in range(dice.randrange(1, 80)):
            at += dice.choice(jumps)
            end = at + dice.choice([0, 100, 400, 1500, 2600])
            rows.append((file, pos + dice.choice([0, 50]) * (file % 3 == 0) + 2 * pos * (file % 3 == 0), "x." if dice.random() < finals else dice.choice(["a", "b c", None]), at, end))
            at = end
    rows = list({(r[0], r[1]): r for r in rows}.values())
    words = spark.createDataFrame(rows, SCHEMA).cache()
    for settings, merge in ((DEFAULT, False), (Settings(silence=0.0, srt_words=2), True), (Settings(max_word=0.0, srt_words=1), False), (Settings(srt_seconds=0.5), True)):
        assert ordered(segments(words, settings, merge=merge, block=7)) == ordered(segments(words, settings, merge=merge, block=None))
    assert ordered(cues(words, block=7)) == ordered(cues(words, block=None))


def test_cues_are_dealt_once(words):
    plan = cues(words, block=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
