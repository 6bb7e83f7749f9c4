"""Segmentation of words that arrive as a stream: the same rules as for whole files, with the open segments of files as state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar
from ..operators.segment import Open, Rules, _list
from ..settings import DEFAULT, Settings
from ..sources.storage import scratch

#: The files of a share that are not over: file_id as text, next position, next seg_no, begin, last end and words of the open segment, whether its last
#: word ended a sentence, the early words by position, and the time (ms) at which the file counts as idle.
_STATE = "files string"


class _File:
    """What is known of a file that is not over."""

    __slots__ = ("next", "no", "open", "early", "expires", "over", "newest")

    def __init__(self, next_: int = 0, no: int = 0, open_: Open | None = None, early: dict[int, tuple] | None = None, expires: int = 0) -> None:
        self.next, self.no, self.open, self.early, self.expires, self.over, self.newest = next_, no, open_, early or {}, expires, False, None

    def take(self, words: Iterator[tuple], rules: Rules) -> Iterator[tuple]:
        """The segments that the next (word, raw start if that isn't start, start, end, final) close."""
        for word, raw, start, end, final in words:
            if self.open is None:
                begin = raw if raw == raw else start  # NaN says that they are the same
                self.open = Open(begin, begin, [])
            if closed := self.open.add(word, start, end, final, rules):
                yield self.no, *closed[:3]
                self.no += 1

    def arrive(self, pos: list[int], rows: list[tuple], last: list[bool], rules: Rules) -> Iterator[tuple]:
        """The segments that close as rows with such positions arrive: those that are next go on, later ones wait, earlier ones were there."""
        i, n = 0, len(pos)
        while i < n:
            if pos[i] == self.next and not self.early:
                to = i + 1
                while to < n and pos[to] == pos[to - 1] + 1:
                    to += 1
                yield from self.take(rows[i:to], rules)
                self.next, self.over = pos[to - 1] + 1, self.over or any(last[i:to])
                i = to
                continue
            if pos[i] >= self.next:
                self.early.setdefault(pos[i], (*rows[i], last[i]))
            while self.next in self.early:
                *row, ends = self.early.pop(self.next)
                yield from self.take([row], rules)
                self.next, self.over = self.next + 1, self.over or ends
            i += 1

    def end(self, rules: Rules, idle: bool) -> Iterator[tuple]:
        """The last segments; of an idle file what is held is taken in order, gaps or not."""
        if idle:
            yield from self.take([self.early[k][:-1] for k in sorted(self.early)], rules)
        if self.open and self.open.text:
            yield self.no, *self.open.now()[:3]


_WORDS = ["file", "pos", "s", "e", "word", "raw", "final", "last", "at"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """share, at, words: of each batch (share and _WORDS) one row a share, with the newest time and its rows, in their order, in Arrow's format.
    Positions and times are there as the differences of their bits, which compress well and lose nothing."""
    for b in batches:
        order = np.argsort(b.column(0).to_numpy(), kind="stable")
        share, file, *numbers, word, raw, final, last, at = b.take(pa.array(order)).columns
        share = share.to_numpy()
        starts = np.flatnonzero(np.diff(share, prepend=share[:1] - 1))
        steps = []
        for column in numbers:
            bits = column.to_numpy().view("int64")
            steps.append(np.diff(bits, prepend=0))
            steps[-1][starts] = bits[starts]
        words, newest = [], []
        for i, to in pairwise([*starts.tolist(), len(share)]):
            part = [file.slice(i, to - i).dictionary_encode(), *(pa.array(s[i:to]) for s in steps), *(c.slice(i, to - i) for c in (word, raw, final, last, at))]
            part, sink = pa.RecordBatch.from_arrays(part, _WORDS), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            words.append(sink.getvalue().to_pybytes())
            newest.append(pc.max(at.slice(i, to - i)).as_py())
        yield pa.RecordBatch.from_arrays([pa.array(share[starts], pa.int32()), pa.array(newest, at.type), pa.array(words, pa.binary())], ["share", "at", "words"])


def _unpacked(words: bytes) -> tuple[list, list[int], list[tuple], list[bool], list[int]]:
    """Files, positions, (word, raw, start, end, final), whether it is the last one, and the times of the rows (ms)."""
    file, pos, s, e, word, raw, final, last, at = pa.ipc.open_stream(words).read_next_batch().columns
    pos, s, e = (np.cumsum(c.to_numpy()) for c in (pos, s, e))
    said = zip(_list(word), _list(raw), s.view("float64").tolist(), e.view("float64").tolist(), _list(final), strict=True)
    return _list(file.dictionary_decode()), pos.tolist(), list(said), _list(last), (at.cast(pa.int64()).fill_null(0).to_numpy() // 1000).tolist()


def _saved(files: dict[str | None, _File]) -> str:
    return json.dumps([(key, f.next, f.no, f.open and f.open.now(), list(f.early.items()), f.expires) for key, f in files.items()])


def _loaded(saved: str) -> dict[str | None, _File]:
    return {key: _File(next_, no, Open(*open_) if open_ else None, {k: tuple(row) for k, row in early}, expires) for key, next_, no, open_, early, expires in json.loads(saved)}


def segment_stream(words_: DataFrame, settings: Settings = DEFAULT, txt: bool = False, punctuated: bool = True, idle_seconds: int = 600, unit: int = 1000, shares: int = 1024) -> DataFrame:
    """file_id, seg_no, start, end, n_words, text of a stream of ``words_`` (file_id, pos, word, start, end in 1/unit seconds, at: event time,
    last: whether the word is its file's last one), each segment as soon as it closes (append mode).

    Words count by ``pos`` from 0, in whatever order they arrive: one that is early is held until those before it are there, one that
    comes twice counts once. A file ends with its last word, or when the watermark has passed its newest word by ``idle_seconds``;
    then what is held is taken in order, gaps or not. Whether a file has the end of a sentence anywhere can't be known before its
    end, so it is given. Orphans are not merged, and segments equal those of ``segments(..., merge=False)``. The state of a file
    is its open segment and its early words, and goes when the file ends. Null words count as empty.

    Files are dealt into ``shares`` by their id, and those of a share lie in one state: a call of Python costs milliseconds besides its rows, so there is
    one a share and batch, not one a file. The state of a share grows with its open files only; more of them at a time ask for more shares. Words that
    lie together are dealt in one row; a late one that lies with newer ones of its share is taken with them.
    """
    size, longest = (settings.txt_words, settings.txt_seconds) if txt else (settings.srt_words, settings.srt_seconds)
    rules = Rules(size, longest * unit, settings.silence * unit, punctuated)
    start, end = scalar.clamp(F.col("start").cast("double"), F.col("end").cast("double"), F.lit(float(settings.max_word * unit)))
    raw, none = F.col("start").cast("double"), F.lit(float("nan"))
    rows = words_.filter("pos is not null").select(
        F.pmod(F.xxhash64("file_id"), F.lit(shares)).cast("int").alias("share"), F.col("file_id").cast("string").alias("file"), F.col("pos").cast("long").alias("pos"), F.coalesce(start, none).alias("s"), F.coalesce(end, none).alias("e"),
        F.coalesce("word", F.lit("")).alias("word"), F.when(raw == start, none).otherwise(F.coalesce(raw, none)).alias("raw"), scalar.ends_sentence(F.col("word")).alias("final"), F.coalesce("last", F.lit(False)).alias("last"), "at",
    )

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files = _loaded(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()

        def frame(closed: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(file, no, b, e, len(t), " ".join(t)) for file, no, b, e, t in closed], columns=["file", "seg_no", "start", "end", "n_words", "text"])

        out: list[tuple] = []
        for words in () if state.hasTimedOut else (w for f in frames for w in f["words"]):
            ids, pos, rows, last, ms = _unpacked(words)
            for i, to in pairwise([0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]):
                file = files.setdefault(ids[i], _File())
                newest = max(ms[i:to])
                file.newest = newest if file.newest is None else max(file.newest, newest)
                out += [(ids[i], *s) for s in file.arrive(pos[i:to], rows[i:to], last[i:to], rules)]
            if len(out) >= 8192:
                yield frame(out)
                out = []
        for id_, file in list(files.items()):
            if file.newest is not None:
                file.expires = max(file.newest, now) + 1000 * idle_seconds
            idle = file.newest is None and file.expires < now
            if file.over or idle:
                out += [(id_, *s) for s in file.end(rules, idle)]
                del files[id_]
        if files:
            state.update((_saved(files),))
            state.setTimeoutTimestamp(min(f.expires for f in files.values()))
        else:
            state.remove()
        if out:
            yield frame(out)

    kind = dict(words_.dtypes)["file_id"]
    watched = rows.mapInArrow(_packed, "share int, at timestamp, words binary").withWatermark("at", f"{idle_seconds} seconds").groupBy("share")
    made = watched.applyInPandasWithState(run, "file string, seg_no int, start double, end double, n_words int, text string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(F.col("file").cast(kind).alias("file_id"), "seg_no", "start", "end", "n_words", "text")


def run_once(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that its source holds now, as a table. The rows and the state lie in the folder that driver and executors share, so
    the stream goes on after a lost executor and writes each row once."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
