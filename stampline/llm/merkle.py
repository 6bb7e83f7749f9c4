"""A Merkle manifest of a table: one tree per source, one tree over the sources' roots, and a proof for every document.

The rows of a source are numbered in order without bringing a source together: they are dealt by ranges, and counts of the ranges give
offsets. ``fanout ** levels`` neighbours are a superblock; each is collapsed by up to ``levels`` levels in one call, and its root is a node of
the next, smaller round. Proofs come back down: a node's proof is that of its superblock's inside, then that of the superblock.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fits, table

#: Neighbours that become one node, and levels of a superblock: 3 ** 8 = 6561 nodes of 32 bytes.
FANOUT, LEVELS = 3, 8


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as UTF-8, a colon and the value, so that no two rows look alike."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of a document, as lowercase hex."""
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def _placed(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with tree (of each value of ``group`` a number, ascending with it, null first), node (from 0 in the group's order) and nodes (rows of
    the group). Equal rows are dealt by where they were read, so nothing is gathered however often a value is there; a window sees one row
    of each range. Also the tables that this is read from."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_read"]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the numbers are those of the sorted ranges, and they are written with the rows
    known = table(dealt.drop("_read").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    whole = Window.partitionBy("_group")
    ranges = known.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_group", "_part", (before - F.col("_low")).alias("_shift"), F.sum("_n").over(whole).alias("nodes"), F.min("_low").over(whole).alias("tree"))
    used = [known, ranges := table(ranges, f"{name}-ranges")]
    if fits(ranges, F.coalesce(F.octet_length("_group"), F.lit(0)) + 48):
        ranges = F.broadcast(ranges)
    both = known.join(ranges, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return both.withColumn("node", F.col("_at") + F.col("_shift")).drop("_group", "_part", "_shift", "_at"), used


def _depth(nodes: int, fanout: int) -> int:
    levels = 0
    while nodes > 1:
        nodes = -(-nodes // fanout)
        levels += 1
    return levels


def _collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Collapses superblocks, of which a call may have several: each node gets its proof inside and its superblock's root."""
    block = fanout**levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        tree, number, of = pdf["tree"].to_numpy(), pdf["node"].to_numpy() // block, pdf["nodes"].to_numpy()
        digests = [bytes(d) for d in pdf["digest"]]
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (number[1:] != number[:-1])) + 1
        siblings, steps, top = [], [], []
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)], strict=True):
            now, at = digests[low:high], range(high - low)
            proofs, places = [b""] * len(now), [b""] * len(now)
            for _ in range(min(levels, _depth(int(of[low]), fanout))):
                runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
                others = [b"".join(r[:i] + r[i + 1 :]) for r in runs for i in range(len(r))]
                step = [bytes((i, len(r))) for r in runs for i in range(len(r))]
                proofs = [p + others[i] for p, i in zip(proofs, at, strict=True)]
                places = [p + step[i] for p, i in zip(places, at, strict=True)]
                now, at = [sha256("".join(d.hex() for d in r).encode()).digest() for r in runs], [i // fanout for i in at]
            siblings += proofs
            steps += places
            top += now * len(proofs)
        return pdf.assign(siblings=siblings, steps=steps, top=top).drop(columns="unit")

    return run


def _forest(nodes: DataFrame, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """The rounds: ``nodes`` (tree, node, nodes, digest, others) with siblings and steps inside their superblock and its root as top, then the roots of
    superblocks as nodes of the next round, until each tree is one superblock. One number a round comes to the driver."""
    block = fanout**levels
    rounds, now = [], nodes
    while True:
        most, small = now.agg(F.max("nodes"), F.count_if(F.col("nodes") <= block)).first()
        # whole trees share a call, so that many small sources are no more calls than one large one
        packs = max(1, -(-small // block))
        unit = F.when(F.col("nodes") > block, F.xxhash64("tree", F.floor(F.col("node") / block).cast("long"))).otherwise(F.pmod(F.xxhash64("tree"), F.lit(packs)))
        kinds = ", ".join(f"`{n}` {t}" for n, t in now.dtypes)
        rounds.append(table(now.withColumn("unit", unit).groupBy("unit").applyInPandas(_collapse(fanout, levels), kinds + ", siblings binary, steps binary, top binary"), name))
        if (most or 0) <= block:
            return rounds
        number, ceiling = F.floor(F.col("node") / block).cast("long"), F.floor((F.col("nodes") + block - 1) / block).cast("long")
        now = rounds[-1].filter(F.col("node") % block == 0).select("tree", number.alias("node"), ceiling.alias("nodes"), F.col("top").alias("digest"))


def _descend(rounds: list[DataFrame], block: int, over: DataFrame | None = None) -> DataFrame:
    """The first round's rows with whole proofs and the root of all as top. over: tree, siblings, steps and top of what is above the trees. A
    node is joined by its superblock and a tree by its last superblock, so no key has more rows than a superblock."""
    upper = rounds[-1]
    if over is not None:
        upper = _joined(upper, over.select("tree", *(F.col(c).alias(f"_{c}") for c in ("siblings", "steps", "top"))), ["tree"], "subroot")
    for lower in reversed(rounds[:-1]):
        held = upper.select("tree", F.col("node").alias("_number"), *(F.col(c).alias(f"_{c}") for c in ("siblings", "steps", "top")), *(F.col(c) for c in upper.columns if c == "subroot"))
        upper = _joined(lower.withColumn("_number", F.floor(F.col("node") / block).cast("long")), held, ["tree", "_number"])
    return upper


def _joined(lower: DataFrame, upper: DataFrame, keys: list[str], kept: str | None = None) -> DataFrame:
    if fits(upper, F.octet_length("_siblings") + F.octet_length("_steps") + 112):
        upper = F.broadcast(upper)
    both = lower.join(upper, keys)
    if kept:
        both = both.withColumn(kept, F.col("top"))
    whole = both.withColumn("siblings", F.concat("siblings", "_siblings")).withColumn("steps", F.concat("steps", "_steps")).withColumn("top", F.col("_top"))
    return whole.drop("_number", "_siblings", "_steps", "_top")


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root (lowercase hex), siblings and steps (binary) of every row of ``leaves`` (doc_id, source, leaf), and its other columns,
    which must be strings or binary; none may be called tree, node, nodes, digest, unit, top or by a name above.

    Leaves of a source ascend by doc_id (null first), those of one id by their hash; equal ones are alike in any order. While a tree has several
    nodes, every ``fanout`` consecutive ones become their hash, also a single one that is left; one leaf is its own root. The
    sources' roots, by source (null first, bytewise), make one more tree. siblings are the digests beside a leaf's path, level by level and
    left to right; steps hold two bytes a level, the place in the run and the run's length. An empty table gives no rows. At most 255 nodes
    make a run.
    """
    extra = [c for c in leaves.columns if c not in ("doc_id", "source", "leaf")]
    kind = dict(leaves.dtypes)["doc_id"]
    block = fanout**levels
    rows = leaves.select("doc_id", F.col("source").cast("string").alias("source"), F.unhex("leaf").alias("digest"), *extra)
    # an id passes the groups as a string, since pandas would turn whole numbers beside nulls into fractions
    placed, used = _placed(rows, "source", ["doc_id", "digest"], "leaves")
    trees = _forest(placed.select("tree", "node", "nodes", "digest", F.col("doc_id").cast("string").alias("doc_id"), *extra), fanout, levels, "superblocks")
    drop(*used)
    roots = trees[-1].filter("node = 0").select(F.col("tree").alias("of"), F.col("top").alias("digest"), F.lit("").alias("all"))
    placed, used = _placed(roots, "all", ["of"], "subroots")
    above = _forest(placed.select("tree", "node", "nodes", "digest", "of"), fanout, levels, "sources")
    drop(*used)
    over = _descend(above, block).select(F.col("of").alias("tree"), "siblings", "steps", "top")
    found = _descend(trees, block, over)
    hexed = lambda c: F.lower(F.hex(c))
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("top").alias("root"), "siblings", "steps", *extra)


def fold(leaf_: Column, siblings: Column, steps: Column) -> Column:
    """The root that a leaf (lowercase hex) and a proof give, in the JVM."""
    beside, path = F.lower(F.hex(siblings)), F.hex(steps)
    byte = lambda i: F.conv(F.substring(path, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    hexes = lambda at, n: F.substring(beside, at * 64 + 1, n * 64)

    def step(state: Column, i: Column) -> Column:
        at, place, run = state["at"], byte(i * 2), byte(i * 2 + 1)
        return F.struct(F.sha2(F.concat(hexes(at, place), state["now"], hexes(at + place, run - place - 1)), 256).alias("now"), (at + run - 1).alias("at"))

    levels = F.floor(F.octet_length(steps) / 2).cast("int")
    each = F.when(levels > 0, F.sequence(F.lit(0), levels - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, F.struct(leaf_.alias("now"), F.lit(0).alias("at")), step)["now"]


def verify(proofs: DataFrame, root: str) -> DataFrame:
    """``proofs`` (leaf, siblings, steps) with verified: whether the leaf and its proof give ``root``. A null leaf or proof does not."""
    return proofs.withColumn("verified", F.coalesce(fold(F.col("leaf"), F.col("siblings"), F.col("steps")) == root, F.lit(False)))
