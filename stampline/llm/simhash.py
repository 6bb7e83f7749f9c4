"""SimHash near-dedup: deletion-variant signatures, an equality join on one-wildcard segment variants, and verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, fits, table

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: DISTANCE differing bits over so many segments leave one segment with one differing bit at most.
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
#: Up to so many distinct fingerprints of a bucket are compared with each other; more look their neighbours up.
COMPARED = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of the shingles' XXH64, a bit is 1 if it is set in over half; no words: 0."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only; bytes.split() cuts at x20 and x09-x0D
    if not w:
        return 0
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        set_ += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "text_hash"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def variants(distinct: DataFrame) -> DataFrame:
    """key, fp: for each segment and each of its bits, the segment without that bit. Two fingerprints whose segment differs in
    one bit at most share a key."""
    keys = []
    for s in range(SEGMENTS):
        seg = F.shiftrightunsigned("fp", WIDTH * s).bitwiseAND((1 << WIDTH) - 1)
        keys += [seg.bitwiseAND(((1 << WIDTH) - 1) ^ (1 << j)) + F.lit((s * WIDTH + j) << WIDTH) for j in range(WIDTH)]
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def forest(fps: np.ndarray, free: list[int], distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sorted distinct fingerprints of a bucket, never all pairs. free: the bits
    in which they can differ. Few fingerprints are compared with each other; many look up each value at the distance, so the
    work is linear in their number however dense they are."""
    edges, left = [], np.ones(len(fps), bool)
    masks = None
    if len(fps) > COMPARED:
        masks = np.array([sum(1 << b for b in c) for k in range(1, distance + 1) for c in combinations(free, k)], np.uint64)
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            u = todo.pop()
            if masks is None:
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(fps[rest] ^ fps[u]) <= distance]
            else:
                want = fps[u] ^ masks
                at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
                near = np.unique(at[(fps[at] == want) & left[at]])
            left[near] = False
            todo += near.tolist()
            edges += [(int(fps[u]), int(fps[v])) for v in near]
    return edges


def links(distinct: DataFrame, name: str = "simhash") -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links of DISTANCE bits or fewer connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_k, keep_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
            edges: list[tuple[int, int]] = []
            cut = np.flatnonzero(np.diff(k)) + 1
            first, last = np.r_[0, cut], np.r_[cut, len(k)]
            size = last - first
            two = first[size == 2]
            pairs = [f[two], f[two + 1]]
            near = np.bitwise_count((pairs[0] ^ pairs[1]).view(np.uint64)) <= DISTANCE
            a, b = pairs[0][near], pairs[1][near]
            for i in np.flatnonzero(size > 2):
                bit = int(k[first[i]]) >> WIDTH
                free = [x for x in range(64) if x // WIDTH != bit // WIDTH or x == bit]
                edges += forest(np.unique(f[first[i] : last[i]].view(np.uint64)), free)
            more = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            a, b = np.r_[a, more[:, 0]], np.r_[b, more[:, 1]]
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

        for batch in batches:
            k = np.r_[keep_k, batch.column(0).to_numpy()]
            f = np.r_[keep_f, batch.column(1).to_numpy()]
            if not len(k):
                continue
            done = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if done:
                yield found(k[:done], f[:done])
            keep_k, keep_f = k[done:], f[done:]
        if len(keep_k):
            yield found(keep_k, keep_f)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes of fingerprints become many of variants, so they are dealt out before
    dealt = variants(distinct.select("fp").repartition(parts, "fp")).select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def rooted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, text_hash, root, component_id: one row per row of ``docs``; root is the same fingerprint for all of a component."""
    fps = table(fingerprints(docs, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct), "simhash")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "text_hash", "root", "component_id")


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``docs``.

    Texts with the same fingerprint are one class before anything is joined, so copies cost nothing; only distinct fingerprints get
    variants, and a bucket yields a spanning forest, not its pairs. Null and empty texts and texts without words have
    fingerprint 0 and link like any other. component_id is the smallest doc_id reachable, null only if all of them are
    null. Repeated rows stay. Other columns are not read; an empty table gives no rows.
    """
    return rooted(docs, shingle).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, of several texts of that id the one of the least hash, and of
    equal rows of id and text any one. A null doc_id comes after all others, so a component without ids keeps one row too. Null and
    empty texts are a component like any other. All columns of ``docs`` are kept, whatever their names; an empty table gives no rows.

    What is chosen is chosen by keys, without texts. The keys of rows that go, and of those that stay but are repeated, are written and
    measured: if they are few, they are broadcast and no text is shuffled but repeated ones; many are joined by a shuffle.
    """
    key = ["_none", "_id", "_hash"]
    rows = rooted(docs).select("root", F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))
    keys = table(rows.groupBy("root", *key).agg(F.count(F.lit(1)).alias("n")), "keys")
    best = keys.groupBy("root").agg(F.min(F.struct(*key)).alias("best")).select("root", "best.*", F.lit(True).alias("stays"))
    # by the whole key, as a component may have very many
    marks = keys.join(best, ["root", *key], "left").select(*key, F.coalesce("stays", F.lit(False)).alias("stays"), "n")
    marks = table(marks.filter(~F.col("stays") | (F.col("n") > 1)), "marks")
    drop(keys)
    id_ = docs["doc_id"].cast("long")
    same = (id_.isNull() == marks["_none"]) & (F.coalesce(id_, F.lit(0)) == marks["_id"]) & (F.xxhash64(docs["text"].cast("string")) == marks["_hash"])
    once = docs.join(F.broadcast(marks) if fits(marks, F.lit(40)) else marks, same, "left_anti")
    twice = marks.filter("stays")
    if not twice.limit(1).count():
        return once
    again = docs.join(F.broadcast(twice) if fits(twice, F.lit(40)) else twice, same, "left_semi")
    return once.union(again.dropDuplicates(["doc_id", "text"]))
