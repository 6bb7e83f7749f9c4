"""Substring dedup, seed and extend: winnowed anchors meet in an equality join, matches are extended both ways around them, by whole runs
of windows and at their ends by single words, what is extended is chained to maximal repeats, and every word inside a repeat of
at least 35 words is removed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

#: Words of a window, and of an anchor. Every window holds WINDOW - ANCHOR + 1 anchor candidates and chooses the least.
WINDOW, ANCHOR = 35, 10
#: Words of the texts that are hashed at once.
CHUNK = 150_000
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 3, 0xD1342543DE82EF95
_MIX = 0xBF58476D1CE4E5B9


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # cuts at x20 and x09-x0D


class _Hashes:
    """Hashes of any run of words of a list, by prefix sums of a polynomial modulo 2**64 (odd bases have inverses there)."""

    def __init__(self, words: list[bytes]) -> None:
        from xxhash import xxh64_intdigest

        n = len(words)
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
        self.sums, self.back = [], []
        for base, of in ((_BASE, h), (_BASE2, (h ^ (h >> np.uint64(29))) * np.uint64(_MIX))):
            up = np.full(n + 1, base, np.uint64)
            up[0] = 1
            down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            self.sums.append(np.r_[np.zeros(1, np.uint64), np.cumsum(of * np.cumprod(up)[:-1], dtype=np.uint64)])
            self.back.append(np.cumprod(down))

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        x = (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]
        x ^= x >> np.uint64(31)
        return x * np.uint64(_MIX)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``width`` values, by doubling."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        have += step
    return at


def _runs(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of texts: text number, start, windows, anchor hash and two hashes of the words of each run, a run being the consecutive
    windows of a text that choose one anchor."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        flat = [w for t in texts[i:j] for w in t]
        if len(flat) >= WINDOW:
            ends = np.cumsum([len(t) for t in texts[i:j]])
            hashes = _Hashes(flat)
            kg = hashes.of(np.arange(len(flat) - ANCHOR + 1), np.arange(ANCHOR, len(flat) + 1), 0)
            at = _least(kg, WINDOW - ANCHOR + 1)
            starts = np.arange(len(at))
            doc = np.searchsorted(ends, starts, "right")
            inside = starts + WINDOW <= ends[doc]
            new = np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]] & inside
            first = np.flatnonzero(new)
            if len(first):
                stop = np.r_[True, (at[1:] != at[:-1]) | ~inside[1:]]
                stop = np.r_[stop[1:], True] & inside
                last = np.flatnonzero(stop)
                begin = np.r_[0, ends[:-1]][doc[first]]
                n = last - first + 1
                # of runs of other lengths, the words differ too
                yield doc[first] + i, first - begin, n, kg[at[first]], hashes.of(first, last + WINDOW, 0), hashes.of(first, last + WINDOW, 1)
        i = j


#: What a row is known by: its id and its text, by 128 bits of hashes. Rows that are equal in both lose the same words.
_KEY = ["k", "q"]


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, text, k and q."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return keyed.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit("q"), "text", "doc_id").alias("q"))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """In small pieces, so that long texts are not unpacked all at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def occurrences(keyed: DataFrame) -> DataFrame:
    """k, q, start, n, anchor, run, run2: the runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            k, q = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for doc, start, n, *hashed in _runs([_words(t.as_py()) for t in b.column(2)]):
                of = [pa.array(k[doc]), pa.array(q[doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int8))]
                yield pa.RecordBatch.from_arrays([*of, *(pa.array(h.view(np.int64)) for h in hashed)], ["k", "q", "start", "n", "anchor", "run", "run2"])

    return keyed.select(*_KEY, "text").mapInArrow(run, "k long, q long, start int, n byte, anchor long, run long, run2 long")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, q, text, spans (start, n) -> two hashes of every window of those runs, which is its anchor with so many words to the left and the rest
    to the right."""
    for b in _batches(batches):
        for k, q, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            hashes = _Hashes(_words(text.as_py()))
            at = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans])
            x, y = (hashes.of(at, at + WINDOW, i).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(np.full(len(at), q, np.int64)), pa.array(at.astype(np.int32)), pa.array(x), pa.array(y)], [*_KEY, "start", "x", "y"])


def maximal(spans: list[dict], words: int) -> np.ndarray:
    """(start, end) in words of the maximal stretches that windows (from start on, n of them) cover."""
    mark = np.zeros(words + 1, np.int32)
    for s in spans:
        mark[s["start"]] += 1
        mark[s["start"] + s["n"] + WINDOW - 1] -= 1
    inside = np.r_[False, np.cumsum(mark[:-1]) > 0, False]
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans of repeated windows -> what is left."""
    for b in _batches(batches):
        out: list[list] = [[], [], [], [], []]
        for text, *spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            w = _words(text.as_py())
            repeats = maximal((spans[0] or []) + (spans[1] or []), len(w))
            ends = [0, *repeats.reshape(-1).tolist(), len(w)]
            kept = b" ".join(x for i in range(0, len(ends), 2) for x in w[ends[i] : ends[i + 1]])
            found = [{"start": int(s), "length": int(e - s)} for s, e in repeats]
            for o, x in zip(out, (len(w), sum(r["length"] for r in found), sha256(kept).hexdigest(), kept.decode() if with_text else None, found), strict=True):
                o.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "repeats"])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept, repeats: one row per row of ``docs``; kept is what is left, words joined by one space
    (null unless ``with_text``), repeats (start, length) the maximal stretches of words that are removed.

    A window chooses its anchor by its own words alone, so equal windows meet at equal anchors. Consecutive windows with one anchor
    are a run: its anchor, extended both ways. Where all runs around an anchor are equal, the match goes on over the whole
    run, and with the next one's anchor beyond it; equal runs are found by a pre-aggregated count. Where runs around one
    anchor differ (the ends of repeats), their anchors are extended word by word: each split of a window's words before and after
    the anchor is compared, one text standing for all that share a run. What is extended is chained to maximal stretches.
    Hot passages are thus counted before they are shuffled, a hot anchor's extensions are dealt out by their words, and the
    joins that give counts back to occurrences have one row a key on the other side, which AQE splits. Sequences and rows are
    compared by 128 bits of hashes.

    Null, empty and short texts keep all words (n_words 0 for null). Repeated rows repeat each other's windows. Null doc_id is a key like
    any other. Other columns are not read; an empty table gives no rows.
    """
    keyed = _key(docs)
    one = F.count(F.lit(1)).alias("c")
    occ = table(occurrences(keyed), "runs")
    shared = occ.groupBy("anchor").agg(one, *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("run", "run2"))).filter("c > 1")
    # written, as AQE splits a hot anchor only where both sides of the join come straight from a shuffle
    shared = table(shared.select("anchor", ((F.col("min_run") != F.col("max_run")) | (F.col("min_run2") != F.col("max_run2"))).alias("mixed")), "shared")
    met = table(occ.join(shared, "anchor"), "met")
    drop(occ, shared)
    runs = ["anchor", "run", "run2"]
    mixed = met.filter("mixed").groupBy(*runs).agg(one, F.min(F.struct(*_KEY, "start", "n")).alias("one"))
    mixed = table(mixed, "mixed")
    again = met.filter("mixed").join(mixed.filter("c > 1").select(*runs), runs)
    span = F.collect_list(F.struct("start", F.col("n").cast("int").alias("n")))
    full = met.filter("not mixed").select(*_KEY, "start", "n").union(again.select(*_KEY, "start", "n")).distinct()

    ends = mixed.select("one.*").groupBy(*_KEY).agg(span.alias("spans")).toDF("k2", "q2", "spans")
    texts = keyed.join(ends.hint("shuffle_hash"), (F.col("k") == F.col("k2")) & (F.col("q") == F.col("q2"))).select(*_KEY, "text", "spans")
    # of repeated rows, the windows count once: their runs are equal and settled above
    windows = table(texts.mapInArrow(_windows, "k long, q long, start int, x long, y long").distinct(), "windows")
    twice = windows.groupBy("x", "y").agg(one).filter("c > 1")
    found = windows.join(twice.select("x", "y"), ["x", "y"]).select(*_KEY, "start", F.lit(1).cast("byte").alias("n"), F.lit(True).alias("end"))
    marks = full.withColumn("end", F.lit(False)).union(found).groupBy(*_KEY)
    marks = marks.agg(*(F.collect_list(F.when(x, F.struct("start", F.col("n").cast("int").alias("n")))).alias(c) for c, x in (("spans", ~F.col("end")), ("more", F.col("end")))))
    marks = table(marks.toDF("k2", "q2", "spans", "more"), "marks")
    drop(met, mixed, windows)
    both = keyed.join(marks.hint("shuffle_hash"), (F.col("k") == F.col("k2")) & (F.col("q") == F.col("q2")), "left").select("doc_id", "text", "spans", "more")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start:long,length:long>>"
    return both.mapInArrow(lambda it: _kept(it, with_text), schema)
