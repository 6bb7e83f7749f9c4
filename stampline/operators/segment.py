"""Words into segments: an ordered fold per file, the merge of orphans, and the repair of boundaries.

A boundary depends on the boundaries before it, so running sums can't say it. The fold streams over rows that are dealt by
file and sorted by position: its state is one segment, a file may be longer than memory, and a batch may end anywhere.

A long file is folded by many tasks. Its words are dealt in blocks, and each block says what it makes of any state that it could be entered
with: either a segment is open when it begins, or none is, and whatever was open closes at one of a few words, from which on all is known.
These maps are composed in the order of the blocks, one row a block, which tells where segments begin, and there the file is cut into
pieces that are folded apart.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..settings import DEFAULT, Settings
from ..sources.packed import pack, unpack
from ..sources.storage import stored


class Rules(NamedTuple):
    words: int
    longest: float
    silence: float
    #: Whether the file has the end of a sentence anywhere; if not, words are counted.
    punctuated: bool = True


class Open:
    """The open segment of a file: where it begins, its words, the end of the last word and whether that ended a sentence."""

    __slots__ = ("begin", "last", "text", "ended")

    def __init__(self, begin: float, last: float, text: list[str], ended: bool = False) -> None:
        self.begin, self.last, self.text, self.ended = begin, last, text, ended

    def now(self) -> tuple:
        return self.begin, self.last, self.text, self.ended

    def add(self, word: str, start: float, end: float, final: bool, rules: Rules) -> tuple | None:
        """Take the next word; the segment that this closes, if any."""
        closed = None
        if self.text and rules.silence > 0 and start - self.last >= rules.silence:
            closed = self.now()
            self.begin, self.text = start, [word]  # a word that opens a segment after silence is not tested for closing
        else:
            self.text.append(word)
            if (rules.punctuated and final) or end - self.begin > rules.longest or (not rules.punctuated and len(self.text) >= rules.words):
                closed = self.begin, end, self.text, final
                self.begin, self.text = end, []
        self.last, self.ended = end, final
        return closed


#: Positions of a block; a file within the first one is folded at once.
BLOCK = 100_000
#: A block says what it makes of at most so many words at which an open segment may become too long. A state that needs more of them ends the cuts
#: of its file, and the rest is one piece.
LOOK = 512
#: The piece of what comes before a file's first cut.
FIRST = -(2**62)
#: What Spark's (?U)\S is; Python's own takes some control characters for white space.
_SAID = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _fold(rows: Iterator[tuple], words: int, longest: float, silence: float, merge: bool, repaired: bool, left: list | None = None) -> Iterator[tuple]:
    """((file, piece), prior, opened, more, word, raw start, start, end, final, any final in the file) -> (file, piece, seg_no, start, end, n_words, text, cue_no).

    prior: where the first segment of the piece begins, if not at its first word; opened: whether that word opens it after a silence; more: whether
    the file has a later piece, which the last word must say. cue_no: how many segments of the piece so far aren't blank. left: takes begin, number of words and last end of what each piece leaves open.
    """

    def segments() -> Iterator[tuple]:
        """(piece, begin, end, words, ended, begin of the piece's end): the last is where the segment after a piece begins, if there is one."""
        now, open_, goes_on = None, None, None
        for piece, prior, opened, more, word, raw, start, end, final, punctuated in rows:
            if open_ is None or piece != now:
                if open_ and open_.text:
                    yield now, *open_.now(), goes_on
                begin = raw if prior is None else prior
                now, open_, rules, goes_on = piece, Open(begin, begin, []), Rules(words, longest, silence, punctuated), more
                if opened:
                    open_.text, open_.last, open_.ended = [word], end, final
                    continue
            goes_on = more
            if closed := open_.add(word, start, end, final, rules):
                yield now, *closed, open_.begin if goes_on is not None else None
        if open_:
            if left is not None:
                left.append((open_.begin, len(open_.text), open_.last))
            if open_.text:
                yield now, *open_.now(), goes_on

    def merged() -> Iterator[tuple]:
        held = None
        for piece, begin, end, text, ended, after in segments():
            if held and held[0] == piece and len(" ".join(text).split()) <= 2 and begin - held[2] <= max(0, silence) and not held[4]:
                held = (piece, held[1], max(held[2], end), held[3] + text, ended, after)
            else:
                if held:
                    yield held
                held = (piece, begin, end, text, ended, after)
        if held:
            yield held

    def bounded() -> Iterator[tuple]:
        """Ends not before starts and not after the next segment's start."""
        held = None
        for row in chain(merged() if merge else segments(), [None]):
            if held:
                following = row[1] if row and row[0] == held[0] else held[5]
                end = max(held[1], held[2])
                yield *held[:2], end if following is None else max(held[1], min(end, following)), *held[3:]
            held = row

    now, no, cue = None, 0, 0
    for piece, begin, end, text, _, _ in bounded() if repaired else merged() if merge else segments():
        no, cue = (no + 1, cue) if piece == now else (0, 0)
        now, said = piece, " ".join(text)
        cue += _SAID.search(said) is not None
        yield *piece, no, begin, end, len(text), said, cue


class Block:
    """The words of one block of a file, and what it makes of the state that it is entered with, under one reading of the file's punctuation."""

    def __init__(self, pos: list, words: list, raw: list, start: list, end: list, final: list, rules: Rules) -> None:
        self.pos, self.raw, self.start, self.end, self.final, self.rules, self.size = pos, raw, start, end, final, rules, len(start)
        self.weight = [0, *accumulate(len(w.split()) for w in words)]
        self.most = list(accumulate(end, max))
        self.rising = self.most == end
        self.known: dict[tuple[int, bool], tuple] = {}
        # of each word the next one before which there is a silence, and the next one that ends a sentence
        self.quiet, self.ended = [self.size] * (self.size + 1), [self.size] * (self.size + 1)
        for k in range(self.size - 1, -1, -1):
            self.quiet[k] = k if k and rules.silence > 0 and start[k] - end[k - 1] >= rules.silence else self.quiet[k + 1]
            self.ended[k] = k if rules.punctuated and final[k] else self.ended[k + 1]

    def _long(self, i: int, stop: int, begin: float) -> int:
        """The first word from i on, before ``stop``, whose end is too far from ``begin``, else ``stop``."""
        if self.rising:
            k = bisect_right(self.end, begin + self.rules.longest, i, stop)
            # a sum in binary may be off where the difference isn't
            while k > i and self.end[k - 1] - begin > self.rules.longest:
                k -= 1
            while k < stop and not self.end[k] - begin > self.rules.longest:
                k += 1
            return k
        return next((k for k in range(i, stop) if self.end[k] - begin > self.rules.longest), stop)

    def _segment(self, i: int, opened: bool) -> tuple[tuple[int, bool] | None, int, float]:
        """What follows the segment that begins with word i: the first word of the next one and whether a silence opens that, or None at the block's
        end; how many words it has, and where it begins."""
        begin, tested = (self.start[i], i + 1) if opened else (self.end[i - 1], i)
        quiet = self.quiet[min(i + 1, self.size)]
        close = min(self.ended[tested], self.size if self.rules.punctuated else max(tested, i + self.rules.words - 1))
        close = self._long(tested, min(close, quiet), begin) if tested < min(close, quiet) else min(close, quiet)
        if quiet <= close:
            return ((quiet, True), quiet - i, begin) if quiet < self.size else (None, self.size - i, begin)
        return ((close + 1, False), close + 1 - i, begin) if close < self.size else (None, self.size - i, begin)

    def _after(self, at: tuple[int, bool]) -> tuple:
        """(begin and words of what is open at the block's end, the first cut) when a segment begins at ``at``. A cut is where nothing joins the segment
        before it: that ended a sentence, this one has more than two words, or a silence lies between it and every word before; of the latter
        the cut has the time that words of earlier blocks must have ended by. Ways that meet are walked once."""
        path = []
        while at not in self.known:
            if at[0] == self.size:
                self.known[at] = (self.end[-1], 0), None
                break
            following, n, begin = self._segment(*at)
            sure = not at[1] and self.final[at[0] - 1] or self.weight[at[0] + n] - self.weight[at[0]] > 2
            alone = at[1] and (not at[0] or begin - self.most[at[0] - 1] > self.rules.silence)
            cut = (self.pos[at[0]], begin, at[1], None if sure else begin - self.rules.silence) if sure or alone else None
            if following is None:
                self.known[at] = (begin, n), cut
                break
            path.append((at, cut))
            at = following
        exit_, found = self.known[at]
        for node, cut in reversed(path):
            found = cut or found
            self.known[node] = exit_, found
        return self.known[at] if not path else self.known[path[0][0]]

    def _met(self) -> tuple[int, bool] | None:
        """The first word at which a segment begins whatever state the block is entered with, and whether a silence opens it; None where there is none."""
        quiet, ended = self.quiet[0], self.ended[0]
        if self.rules.punctuated and min(quiet, ended) == self.size:
            return None  # a segment may be open all through the block
        stop = min(quiet - 1, ended, self.size - 1, *([] if self.rules.punctuated else [max(self.rules.words, 1) - 1]))
        if not self.rules.punctuated and stop == self.size - 1 < quiet:
            return None
        counted = not self.rules.punctuated
        ways = {(k + 1, False) for k in range(stop + 1) if counted or k == ended or not k or self.end[k] > self.most[k - 1]} | {(0, True)} | ({(quiet, True)} if quiet < self.size else set())
        left = list(ways)
        heapify(left)
        while True:
            at = heappop(left)
            if at[0] == self.size:
                return None
            if not left:
                return at
            following = self._segment(*at)[0]
            if following is None:
                return None
            if following not in ways:
                ways.add(following)
                heappush(left, following)

    def sure(self) -> tuple[tuple, tuple] | None:
        """(word, whether a silence opens it, begin) of the first and of the last segment that begin there whatever came before the block, and that
        nothing joins to the one before: that ended a sentence, or this one has more than two words."""
        at, cuts = self._met(), []
        while at is not None and at[0] < self.size:
            following, n, begin = self._segment(*at)
            if not at[1] and self.final[at[0] - 1] or self.weight[at[0] + n] - self.weight[at[0]] > 2:
                cuts = [*cuts[:1], (*at, begin)]
            at = following
        return (cuts[0], cuts[-1]) if cuts else None

    def summary(self) -> dict:
        """The map: where an open segment may close, and what comes of each."""
        punctuated = self.rules.punctuated
        quiet, ended = self.quiet[0], self.ended[0]
        stop, most, records, whole = min(quiet - 1, ended, self.size - 1), None, [], True
        for k in range(stop + 1):
            if most is None or self.end[k] > most:
                # of a state whose segment begins before this block no later word is asked for
                if len(records) == LOOK or records and most - self.start[0] > self.rules.longest:
                    whole = False
                    break
                most = self.end[k]
                records.append((k, most))
        closes = {k for k, _ in records} | ({ended} if ended <= stop else set()) | (set(range(min(self.rules.words, stop + 1))) if not punctuated else set())
        after = {k: self._after((k + 1, False)) for k in closes}
        return {
            "raw": self.raw[0], "start": self.start[0], "size": self.size, "last": self.end[-1], "most": self.most[-1], "quiet": quiet, "ended": ended, "records": records, "whole": whole,
            "closes": [(k, *v) for k, v in after.items()], "silence": self._after((quiet, True)) if quiet < self.size else None, "at_once": self._after((0, True)),
        }


def _enter(summary: dict, begin: float, n: int, last: float, rules: Rules) -> tuple[tuple | None, list | None]:
    """(begin and words of what a block leaves open, its first sure cut) for the state it is entered with; (None, None) where the map doesn't say."""
    if n and rules.silence > 0 and summary["start"] - last >= rules.silence:
        return summary["at_once"]
    size = summary["size"]
    long = next((k for k, end in summary["records"] if end - begin > rules.longest), size)
    count = size if rules.punctuated else max(0, rules.words - n - 1)
    close = min(long, count, summary["ended"])
    if summary["quiet"] <= close and summary["quiet"] < size:
        reached, found = summary["quiet"], summary["silence"]
    elif close < size:
        reached, found = close, next((rest for k, *rest in summary["closes"] if k == close), (None, None))
    else:
        reached, found = size, ((begin, n + size), None)
    if not summary["whole"] and long == size and reached > summary["records"][-1][0]:
        return None, None
    return found


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with their block; null positions, which come first, and negative ones are of the first."""
    return rows.withColumn("block", F.greatest(F.floor(F.coalesce("pos", F.lit(0)) / block), F.lit(0)).cast("long"))


_ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _batches(rows: Iterator[tuple], names: list[str], types: list[str]) -> Iterator[pa.RecordBatch]:
    def batch(some: list[tuple]) -> pa.RecordBatch:
        columns = zip(*some, strict=True) if some else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, types, strict=True)], names)

    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == 8192:
            yield batch(out)
            out = []
    yield batch(out)


def _list(column: pa.Array) -> list:
    """to_pylist() by way of NumPy, which takes a fraction of the time; numbers with nulls would become floats there."""
    through = pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if through else column.to_pylist()


def _schema(names: list[str], types: list[str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))


_NAMES = ["file_id", "piece", "seg_no", "start", "end", "n_words", "text", "cue_no"]


def _first_blocks(rows: DataFrame, types: list[str], rules: Rules, merge: bool, repaired: bool, block: int, together: bool) -> DataFrame:
    """Of each first block its segments, as if its file ended there, with summary null; of every block a row with its maps as summary, by whether the
    file is punctuated, and whether it has the end of a sentence as any."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(rows, block)
    if not together:
        dealt = dealt.repartition(parts, "file_id", "block").sortWithinPartitions("file_id", "block", "pos")
    names, kinds = [*_NAMES, "block", "any", "summary"], [*types, "bigint", "boolean", "string"]

    def one(file: object, number: int, columns: tuple[list, ...]) -> Iterator[tuple]:
        pos, words, raw, start, end, final = columns
        any_ = any(final)
        maps = {}
        if number == 0:
            left: list[tuple] = []
            key = file, FIRST
            given = ((key, None, False, None, *row, any_) for row in zip(words, raw, start, end, final, strict=True))
            for segment in _fold(given, rules.words, rules.longest, rules.silence, merge, repaired, left):
                yield *segment, 0, None, None
            maps[any_] = *left[0], max(end)
            if not any_:  # the file may have an end of a sentence further on
                open_ = Open(raw[0], raw[0], [])
                for row in zip(words, start, end, final, strict=True):
                    open_.add(*row, rules._replace(punctuated=True))
                maps[True] = open_.begin, len(open_.text), open_.last, max(end)
        else:
            for punctuated in (True,) if any_ else (True, False):
                maps[punctuated] = Block(pos, words, raw, start, end, final, rules._replace(punctuated=punctuated)).summary()
        yield file, None, None, None, None, None, None, None, number, any_, json.dumps({str(k): v for k, v in maps.items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, None
        for b in batches:
            files, blocks, *columns = (_list(c) for c in b.columns)
            changes = [k for k in range(1, len(files)) if files[k] != files[k - 1] or blocks[k] != blocks[k - 1]]
            for i, to in pairwise([0, *changes, len(files)]) if files else ():
                if held is None or (files[i], blocks[i]) != now:
                    if held:
                        yield from one(*now, tuple(held))
                    now, held = (files[i], blocks[i]), [[] for _ in columns]
                for h, c in zip(held, columns, strict=True):
                    h += c[i:to]
        if held:
            yield from one(*now, tuple(held))

    chosen = dealt.select("file_id", "block", "pos", "word", "raw", "start", "end", "final")
    return chosen.mapInArrow(lambda batches: _batches(each(batches), names, kinds), _schema(names, kinds))


def _cuts(maps: DataFrame, kind: str, time: str, rules: Rules) -> DataFrame:
    """file_id, block, pos, begin, opened: the cuts, of ``maps`` (file_id, block, summary, punctuated), by composing the maps of each file in order."""
    parts = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["file_id", "block", "pos", "begin", "opened"], [kind, "bigint", "bigint", time, "boolean"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state, begun = None, None, False
        for b in batches:
            for file, number, summary, punctuated in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or file != now:
                    now, begun, state = file, True, ()
                if state is None:
                    continue
                said = json.loads(summary)[str(punctuated)]
                if number == 0:
                    state = tuple(said)
                    continue
                begin, n, last, most = state or (said["raw"], 0, said["raw"], None)
                left, cut = _enter(said, begin, n, last, rules._replace(punctuated=punctuated))
                state = None if left is None else (*left, said["last"], said["most"] if most is None else max(most, said["most"]))
                # a file's first piece begins with its first word
                if cut and most is not None and (cut[3] is None or most < cut[3]):
                    yield file, number, *cut[:3]

    ordered = maps.select("file_id", "block", "summary", "punctuated").repartition(parts, "file_id").sortWithinPartitions("file_id", "block")
    return ordered.mapInArrow(lambda batches: _batches(each(batches), names, kinds), _schema(names, kinds))


def _pieces(rows: DataFrame, maps: DataFrame, cuts: DataFrame, block: int) -> DataFrame:
    """``rows`` with piece, prior, opened, more (where the next piece's first segment begins) and punctuated. What lies before a block's cut belongs to
    the piece before. Joins are by struct(file_id), so that rows without an id stay."""
    own = cuts.select(F.struct("file_id").alias("file"), "block", F.struct("block", "pos", "begin", "opened").alias("own"))
    blocks = maps.select(F.struct("file_id").alias("file"), "block", "punctuated").join(own, ["file", "block"], "left")
    order = Window.partitionBy("file").orderBy("block")
    before, following = F.last("own", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("own", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    blocks = stored(blocks.select("file", "block", "own", before.alias("before"), following.alias("next"), "punctuated"))
    dealt = _dealt(rows, block).withColumn("file", F.struct("file_id"))
    both = dealt.join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, ["file", "block"])
    later = F.coalesce(F.col("pos") >= F.col("own.pos"), F.lit(False))
    both = both.withColumn("at", F.when(later, F.col("own")).otherwise(F.col("before"))).withColumn("then", F.when(~later & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("next")))
    opened = F.coalesce(F.col("at.opened") & (F.col("pos") == F.col("at.pos")), F.lit(False))
    return both.select(*rows.columns, F.coalesce("at.block", F.lit(FIRST)).alias("piece"), F.col("at.begin").alias("prior"), opened.alias("opened"), F.col("then.begin").alias("more"), "punctuated")


def _packs(rows: DataFrame, kind: str, block: int) -> DataFrame:
    """file_id, block, whole, words: of ``rows``, which lie file by file and in order, the words of each block packed; whole: the file has no other block."""
    names, kinds = ["file_id", "block", "whole", "words"], [kind, "bigint", "boolean", "binary"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held, first = None, [], True  # a block is held until the next one says whether its file goes on

        def row(last: bool) -> tuple:
            return *now, first and last, pack([pa.concat_arrays(c) for c in zip(*held, strict=True)])

        for b in batches:
            files, blocks, *columns = b.columns
            files, blocks = _list(files), _list(blocks)
            changes = [k for k in range(1, len(files)) if files[k] != files[k - 1] or blocks[k] != blocks[k - 1]]
            for i, to in pairwise([0, *changes, len(files)]) if files else ():
                if held and (files[i], blocks[i]) != now:
                    yield row(files[i] != now[0])
                    first, held = files[i] != now[0], []
                now = files[i], blocks[i]
                held.append([c.slice(i, to - i) for c in columns])
        if held:
            yield row(True)

    # a raw start is there where the clamped one differs
    chosen = _dealt(rows, block).select("file_id", "block", "word", F.nullif("raw", "start").alias("raw"), "start", "end", "final")
    return chosen.mapInArrow(lambda batches: _batches(each(batches), names, kinds), _schema(names, kinds))


#: Whether a row holds for a file without (0) or with (1) an end of a sentence, or for any (2).
_ANY = 2


def _spread(rows: DataFrame, types: list[str], rules: Rules, merge: bool, repaired: bool, block: int) -> DataFrame:
    """_NAMES of ``rows``, which lie file by file and in order. Their blocks are dealt, packed. Each is folded between the first and the last word from which
    on all is known whatever came before (Block.sure); what lies around, some words of a block, is dealt again by file and folded as the seams between.
    A block that knows no such word is part of a seam."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seam = ["block", "head", "tail", "begin", "prior", "opened", "any", "reading"]
    names, kinds = [*_NAMES, *seam], [*types, "bigint", "binary", "binary", types[3], types[3], "boolean", "boolean", "int"]
    numbers, nothing = (rules.words, rules.longest, rules.silence, merge, repaired), (None,) * len(_NAMES[1:])

    def one(file: object, number: int, whole: bool, packed_: bytes) -> Iterator[tuple]:
        columns = unpack(packed_)
        words, raw, start, end, final = lists = [_list(c) for c in columns]
        size = len(words)
        lists[1] = raw = [s if r is None else r for r, s in zip(raw, start, strict=True)]
        any_ = any(final)

        def fold(piece: int, prior: object, opened: bool, more: object, i: int, to: int, punctuated: bool, reading: int) -> Iterator[tuple]:
            given = (((file, piece), prior, opened, more, *row, punctuated) for row in zip(*(c[i:to] for c in lists), strict=True))
            return ((*s, *(None,) * 7, reading) for s in _fold(given, *numbers))

        def packed(i: int, to: int) -> bytes:
            return pack([c.slice(i, to - i) for c in columns])

        if whole:
            yield from fold(0, None, False, None, 0, size, any_, _ANY)
            return
        for punctuated in (True,) if any_ else (True, False):
            reading = _ANY if any_ else int(punctuated)
            if cuts := Block(range(size), words, raw, start, end, final, rules._replace(punctuated=punctuated)).sure():
                (i, opened, begin), (j, quiet, prior) = cuts
                yield from fold(2 * number + 1, begin, opened, prior, i, j, punctuated, reading)
                yield file, *nothing, number, packed(0, i), packed(j, size), begin, prior, quiet, any_, reading
            else:
                yield file, *nothing, number, packed(0, size), None, None, None, False, any_, reading

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from one(*row)

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The words of the seams, for _fold."""
        now, piece, prior, opened = None, 0, None, False
        for b in batches:
            for file, number, head, tail, begin, after, quiet, punctuated in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != file:
                    now, piece, prior, opened = (file,), 0, None, False
                for packed, more in ((head, begin), (tail, None)):
                    if packed is None:
                        continue
                    words, raw, start, end, final = (_list(c) for c in unpack(packed))
                    for w, r, s, e, f in zip(words, raw, start, end, final, strict=True):
                        yield (file, piece), prior, opened, more, w, s if r is None else r, s, e, f, punctuated
                    if packed is head and tail is not None:
                        piece, prior, opened = 2 * number + 2, after, quiet

    dealt = _packs(rows, types[0], block).repartition(parts, "file_id", "block")
    made = stored(dealt.mapInArrow(lambda batches: _batches(blocks(batches), names, kinds), _schema(names, kinds)), "zstd")
    folded = made.filter("piece is not null").select(*_NAMES, "reading")
    if not made.filter("piece is null").limit(1).count():
        return folded.select(_NAMES)
    around = made.filter("piece is null").withColumn("punctuated", F.max("any").over(Window.partitionBy("file_id")))
    read = around.filter(f"reading = {_ANY} or reading = cast(punctuated as int)").sortWithinPartitions("file_id", "block").select("file_id", *seam[:6], "punctuated")
    sewn = stored(read.mapInArrow(lambda batches: _batches(_fold(seams(batches), *numbers), _NAMES, types), _schema(_NAMES, types)).withColumn("reading", F.lit(_ANY)))
    folded = folded.unionByName(sewn).withColumn("file", F.struct("file_id"))
    sizes = folded.groupBy("file", "piece", "reading").agg(F.count(F.lit(1)).alias("n"), F.max("cue_no").alias("cues"))
    spoken = made.filter("piece is null").groupBy(F.struct("file_id").alias("file")).agg(F.max("any").cast("int").alias("punctuated"))
    sizes = sizes.join(spoken, "file", "left").filter(f"reading = {_ANY} or reading = punctuated")
    order = Window.partitionBy("file").orderBy("piece")
    offsets = stored(sizes.select("file", "piece", "reading", (F.sum("n").over(order) - F.col("n")).alias("offset"), (F.sum("cues").over(order) - F.col("cues")).alias("before")))
    both = folded.join(F.broadcast(offsets) if offsets.count() <= 100_000 else offsets, ["file", "piece", "reading"])
    return both.withColumns({"seg_no": (F.col("seg_no") + F.col("offset")).cast("int"), "cue_no": (F.col("cue_no") + F.col("before")).cast("int")}).select(_NAMES)


def _numbered(folded: DataFrame) -> DataFrame:
    """Numbers that go on over the pieces of a file. The segments are stored, so that they are folded once."""
    folded = stored(folded).withColumn("file", F.struct("file_id"))
    order = Window.partitionBy("file").orderBy("piece")
    sizes = folded.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n"), F.max("cue_no").alias("cues"))
    offsets = sizes.select("file", "piece", (F.sum("n").over(order) - F.col("n")).alias("offset"), (F.sum("cues").over(order) - F.col("cues")).alias("before"))
    both = folded.join(offsets, ["file", "piece"])
    return both.withColumns({"seg_no": (F.col("seg_no") + F.col("offset")).cast("int"), "cue_no": (F.col("cue_no") + F.col("before")).cast("int")}).select(folded.drop("file").columns)


def segments(words_: DataFrame, settings: Settings = DEFAULT, txt: bool = False, merge: bool = True, unit: int = 1000, repaired: bool = False, block: int | None = BLOCK, together: bool = False, numbered: bool = False, spread: bool = False) -> DataFrame:
    """file_id, seg_no, start, end, n_words, text of ``words_`` (file_id, pos, word, start, end, with times in 1/unit seconds).

    A segment closes on a silence, on the end of a sentence, when it is too long, or (in a file without any end of a sentence)
    at a number of words. merge: pieces of up to two words after little silence join an unfinished sentence before them.
    repaired: boundaries as repair() makes them. block: a file of more positions is folded by several tasks, each of about so many; the segments
    are the same. Those of the first blocks are stored, and where all files are within theirs, that is all; the words of longer files
    are read once more. None: every file is folded in one task, which holds one segment of it at a time, and nothing is run before the result is
    asked for. Positions are unique in their file. Null words count as empty; no words give no segments. together: the words of each file lie in one
    partition and in their order, as adapters.words gives them, so with blocks nothing is shuffled but the words of longer files. spread: such words are read once and dealt packed, a row a block, and
    each block is folded apart but for its first and last words; for blocks that are many and files that few tasks read. numbered: with
    cue_no, which counts from 1 the segments of a file that aren't blank.
    """
    size, longest = (settings.txt_words, settings.txt_seconds) if txt else (settings.srt_words, settings.srt_seconds)
    rules = Rules(size, longest * unit, settings.silence * unit)
    start, end = scalar.clamp(F.col("start"), F.col("end"), F.lit(settings.max_word * unit).cast(words_.schema["start"].dataType))
    parts = int(words_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words_.select("file_id", "pos", F.coalesce("word", F.lit("")).alias("word"), F.col("start").alias("raw"), start.alias("start"), end.alias("end"), scalar.ends_sentence(F.col("word")).alias("final"))
    kind = dict(words_.dtypes)
    types = [kind["file_id"], "bigint", "int", kind["start"], kind["start"], "int", "string", "int"]

    unasked = [] if numbered else ["cue_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                file, piece, *rest = (_list(c) for c in b.columns)
                yield from zip(zip(file, piece, strict=True), *rest, strict=True)

        return _batches(_fold(each(), rules.words, rules.longest, rules.silence, merge, repaired), _NAMES, types)

    def folded(pieces: DataFrame) -> DataFrame:
        chosen = pieces.select("file_id", "piece", "prior", "opened", "more", "word", "raw", "start", "end", "final", "punctuated")
        return chosen.mapInArrow(run, _schema(_NAMES, types))

    if not block:
        rows = rows.repartition(parts, "file_id").withColumn("punctuated", F.max("final").over(Window.partitionBy("file_id"))).sortWithinPartitions("file_id", "pos")
        none = F.lit(None).cast(kind["start"])
        return folded(rows.withColumns({"piece": F.lit(FIRST), "prior": none, "opened": F.lit(False), "more": none})).drop("piece", *unasked)
    if together and spread:
        return _spread(rows, types, rules, merge, repaired, block).drop("piece", *unasked)
    made = stored(_first_blocks(rows, types, rules, merge, repaired, block, together))
    done, maps = made.filter("summary is null").select(_NAMES).drop("piece", *unasked), made.filter("summary is not null").select("file_id", "block", "any", "summary")
    if not maps.filter("block <> 0").limit(1).count():
        return done
    of_file = Window.partitionBy("file_id")
    maps = maps.withColumn("punctuated", F.max("any").over(of_file)).withColumn("long", F.max("block").over(of_file) > 0).filter("long")
    files = maps.select(F.struct("file_id").alias("_file")).distinct()
    pieces = _pieces(rows, maps, _cuts(maps, kind["file_id"], kind["start"], rules), block)
    pieces = pieces.repartition(parts, "file_id", "piece").sortWithinPartitions("file_id", "piece", "pos")
    short = done.join(files, F.struct("file_id") == F.col("_file"), "left_anti")
    return short.unionByName(_numbered(folded(pieces)).drop("piece", *unasked))


def repair(segments_: DataFrame) -> DataFrame:
    """Ends not before starts and not after the next segment's start; the next one is taken before blank ones are dropped."""
    following = F.lead("start").over(Window.partitionBy("file_id").orderBy("seg_no"))
    end = F.greatest("start", F.least(F.greatest("start", "end"), F.coalesce(following, F.greatest("start", "end"))))
    return segments_.withColumn("end", end).filter(F.col("text").rlike(r"(?U)\S"))


def cues(words_: DataFrame, settings: Settings = DEFAULT, txt: bool = False, unit: int = 1000, block: int | None = BLOCK, together: bool = False, numbered: bool = False, spread: bool = False) -> DataFrame:
    """Segments with their boundaries repaired, without blank ones; the fold looks one segment ahead, so nothing is shuffled again."""
    return segments(words_, settings, txt, True, unit, True, block, together, numbered, spread).filter(F.col("text").rlike(r"(?U)\S"))


def silence_gaps(words_: DataFrame, least: int) -> DataFrame:
    """file_id, n_words, n_gaps, longest_gap: gaps of ``least`` or more between a word's end and the next one's start."""
    gap = F.col("start") - F.lag("end").over(Window.partitionBy("file_id").orderBy("pos"))
    gaps = words_.withColumn("gap", gap)
    return gaps.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("gap") >= least).alias("n_gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))
