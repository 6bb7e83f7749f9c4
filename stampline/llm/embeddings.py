"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table

COSINE = 0.98
#: Tables; buckets of a table for each vector of the largest label, from which the number of hashes follows; its bounds.
TABLES, ROOM, FEWEST, MOST = 8, 32, 2, 5
#: Vectors of a bucket that are compared in one piece; larger buckets are cut into blocks, and each pair of blocks is a unit of its own.
BLOCK = 512
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), without the factor."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def hashes(size: int, d: int) -> int:
    """How many hashes a bucket is named by, for ``size`` vectors of length ``d`` in the largest label: as few as give ROOM buckets a vector, so that
    vectors that are not alike rarely meet however many there are. A bucket is tried in as many places (its own and the likeliest
    others), which keeps the chance to meet up while buckets get smaller."""
    axes = 2 << max(1, (d - 1).bit_length())
    return min(max(FEWEST, int(np.ceil(np.log(max(ROOM * size, 2)) / np.log(axes)))), MOST)


def buckets(unit: np.ndarray, size: int) -> np.ndarray:
    """(n, TABLES, k) bucket numbers, k = hashes(size, d): in each table the closest signed axes after pseudo-random rotations; the other probes
    exchange one of the least certain axes for the next one."""
    n, d = unit.shape
    p = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, p))
    x[:, :d] = unit
    rng = np.random.default_rng(SEED)
    count = hashes(size, d)
    out = np.zeros((n, TABLES, count), np.int64)
    for t in range(TABLES):
        first, second, margin = [], [], []
        for _ in range(count):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], p)) / np.sqrt(p)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(y), top, 1)
            swap = (size[:, 1] > size[:, 0]) | ((size[:, 1] == size[:, 0]) & (top[:, 1] < top[:, 0]))
            top[swap] = top[swap][:, ::-1]
            sign = np.take_along_axis(y, top, 1) < 0
            code = 2 * top + sign
            first.append(code[:, 0])
            second.append(code[:, 1])
            margin.append(np.abs(size[:, 0] - size[:, 1]))
        first, second = np.array(first), np.array(second)
        order = np.argsort(np.array(margin), axis=0, kind="stable")
        base = (2 * p) ** np.arange(count)
        home = (first * base[:, None]).sum(0)
        out[:, t, 0] = home
        for q in range(1, count):
            i = order[q - 1]
            out[:, t, q] = home + (second[i, np.arange(n)] - first[i, np.arange(n)]) * base[i]
        out[:, t] += t * (2 * p) ** count
    return out


def signatures(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector, keys, class, check: the last two are hashes of label and components, of 128 bits in all; keys is null for a vector
    that links with nothing."""
    size = vectors.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                rows, labels = b.column(2).to_pylist(), b.column(1).to_pylist()
                ok = [bool(v) and y is not None and None not in v and bool(np.isfinite(v).all()) and any(v) for v, y in zip(rows, labels, strict=True)]
                keys: list = [None] * len(rows)
                for d in {len(v) for v, o in zip(rows, ok, strict=True) if o}:
                    at = [k for k, o in enumerate(ok) if o and len(rows[k]) == d]
                    x = np.array([rows[k] for k in at], np.float64)
                    x /= np.abs(x).max(1, keepdims=True)  # else the squares of very small or large components are lost
                    for k, row in zip(at, buckets(x / np.linalg.norm(x, axis=1, keepdims=True), size).reshape(len(at), -1).tolist(), strict=True):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "label", "vector", "keys"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    signed = rows.mapInArrow(run, "vec_id long, label long, vector array<double>, keys array<bigint>")
    return signed.withColumns({"class": F.xxhash64("label", "vector"), "check": F.xxhash64(F.lit("check"), "vector", "label")})


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray | int) -> np.ndarray:
    """Whether ``here`` is the first bucket that the members a and b share, so that a pair in several buckets counts once."""
    x, y, none = keys[a], keys[b], np.iinfo(np.int64).max
    least = np.full(len(a), none)
    each = keys.shape[1] // TABLES
    for p in range(each):
        for q in range(each):
            mine = x[:, p::each]
            least = np.minimum(least, np.where(mine == y[:, q::each], mine, none).min(1))
    return least == here


def _unit_links(cls: np.ndarray, n: np.ndarray, x: np.ndarray, keys: np.ndarray, here: int, side: np.ndarray, cosine: float) -> tuple[list, list]:
    """Link counts of the members of a unit and a spanning forest of its links. side: 0 and 1 for two blocks that are compared with
    each other, 2 if all are compared with all."""
    counts = np.zeros(len(cls), np.int64)
    root = np.arange(len(cls))
    edges = []
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side != 2).any() else (np.arange(len(cls)),) * 2

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        a, b = rows[i], right[j]
        keep = cls[a] != cls[b]
        if left is right:
            keep &= a < b
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        mine = _first_shared(keys, a, b, here)
        a, b = a[mine], b[mine]
        np.add.at(counts, a, n[b])
        np.add.at(counts, b, n[a])
        if len(a):  # one edge for each pair of trees at most
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(u), find(v)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((int(cls[u]), int(cls[v])))
    some = np.flatnonzero(counts)
    return list(zip(cls[some].tolist(), counts[some].tolist(), strict=True)), edges


def _units(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit -> (a, b, n): link counts n of class a (b null), and edges a, b (n null)."""
    kept = None
    for last, b in _ahead(batches):
        t = pa.Table.from_batches([b])
        t = t if kept is None else pa.concat_tables([kept, t])
        unit = np.column_stack([t.column(c).to_numpy() for c in ("label", "key", "bi", "bj")])
        done = len(unit) if last else int(np.r_[0, np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1][-1])
        kept = t.slice(done)
        t, unit = t.slice(0, done).combine_chunks(), unit[:done]
        sums, edges = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        length = pc.list_value_length(t.column("vector")).to_numpy()
        for d in np.unique(length):
            at = np.flatnonzero(length == d)
            some = t.take(pa.array(at)) if len(at) < len(unit) else t
            x, keys = (pc.list_flatten(some.column(c)).to_numpy().reshape(len(at), -1) for c in ("vector", "keys"))
            found = _compare(unit[at], x, keys, *(some.column(c).to_numpy() for c in ("class", "n", "side")), cosine)
            sums.append(found[0])
            edges.append(found[1])
        s, e = np.concatenate(sums), np.concatenate(edges)
        none = lambda rows: pa.nulls(len(rows), pa.int64())
        to, count = pa.concat_arrays([none(s), pa.array(e[:, 1])]), pa.concat_arrays([pa.array(s[:, 1]), none(e)])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[s[:, 0], e[:, 0]]), to, count], ["a", "b", "n"])


def _compare(unit: np.ndarray, x: np.ndarray, keys: np.ndarray, cls: np.ndarray, n: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(class, count) and (class, class) of all units of vectors of one length. Units of two, which most are, are compared all at once."""
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cut = np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1
    first, end = np.r_[0, cut], np.r_[cut, len(unit)]
    a = first[end - first == 2]
    a = a[((side[a] == 2) | (side[a] != side[a + 1])) & (cls[a] != cls[a + 1])]
    a = a[np.einsum("ij,ij->i", x[a], x[a + 1]) >= cosine]
    a = a[_first_shared(keys, a, a + 1, unit[a, 1])] if len(a) else a
    sums = [np.column_stack((np.r_[cls[a], cls[a + 1]], np.r_[n[a + 1], n[a]]))]
    edges = [np.column_stack((cls[a], cls[a + 1]))]
    for i in np.flatnonzero(end - first > 2):
        u = slice(first[i], end[i])
        some, pairs = _unit_links(cls[u], n[u], x[u], keys[u], int(unit[first[i], 1]), side[u], cosine)
        if some:
            sums.append(np.array(some, np.int64))
            edges.append(np.array(pairs, np.int64).reshape(-1, 2))
    return np.concatenate(sums).astype(np.int64), np.concatenate(edges).astype(np.int64)


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Each batch with rows, and whether it is the last."""
    held = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield False, held
            held = b
    if held is not None:
        yield True, held


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label, by 128 bits of hashes, are one class before anything is compared. Classes meet in the buckets of TABLES
    tables, whose number grows with the largest label; a bucket that is larger than BLOCK is cut into blocks whose pairs are dealt
    out as units, so that no task gets a whole hot bucket. A unit computes cosines in double precision and yields link counts and a
    spanning forest, never its pairs; a pair that meets in several buckets counts in the first one only.

    Vectors that are null, zero, of null label, or hold null or non-finite components have no links and are their own component.
    Vectors of different length don't link. Null vec_id: links as any other, component_id is the least id that is not
    null. Repeated rows are equal vectors. Other columns are not read; an empty table gives no rows.
    """
    signed = table(signatures(vectors), "signatures")
    members = signed.filter("keys is not null").groupBy("class", "check").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), *(F.first(c).alias(c) for c in ("label", "vector", "keys")))
    members = table(members.select(F.col("class").alias("_class"), F.col("check").alias("_check"), F.monotonically_increasing_id().alias("class"), "n", "least", "label", "vector", "keys"), "classes")
    placed = members.select("label", "class", F.explode(F.array_distinct("keys")).alias("key"))
    large = placed.groupBy("label", "key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    large = large.select("label", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(large, ["label", "key"]).withColumn("block", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("label", "key", "class", "block", other)
    placed = placed.select(
        "label", "key", "class", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(members.select("class", "n", "vector", "keys"), "class").repartition(parts, "label", "key", "bi", "bj").sortWithinPartitions("label", "key", "bi", "bj", "class")
    found = table(dealt.select("label", "key", "bi", "bj", "class", "n", "vector", "keys", "side").mapInArrow(lambda it: _units(it, cosine), "a long, b long, n long"), "links")
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("more"))
    roots = components(found.filter("b is not null").select("a", "b"), "embeddings")
    named = members.join(counts, F.col("class") == F.col("a"), "left").join(roots, F.col("class") == F.col("node"), "left")
    named = named.select("_class", "_check", "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("_class", "_check", "n_links", "component_id")
    rows = signed.select("vec_id", F.when(F.col("keys").isNotNull(), F.col("class")).alias("class"), "check")
    rows = rows.join(named, (F.col("class") == F.col("_class")) & (F.col("check") == F.col("_check")), "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
