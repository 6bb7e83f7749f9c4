"""Joins of intervals of any length, as equality joins on bins.

Every interval has a level: the width of its level's bins is at least its length, so it touches two of them at most. Two intervals meet at the
greater of their levels. There the longer one stands in its own bins, and the shorter one visits those that it touches, for the levels that the
other side has; what only visits never meets what only visits. A bin with very many rows is split. A level whose intervals are few is dissolved:
they stand in all bins of a lower level that they touch, where that makes fewer rows than the visits to theirs.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Each level's bins are so many times as wide as those of the level below.
STEP = 4
#: Rows of one side that a bin takes before it is split.
MOST = 10_000
#: Bins of a lower level that one interval may stand in.
SPREAD = 1024
#: Split bins that are broadcast; more are joined.
SPLIT = 100_000


def overlaps(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Whether two intervals share time. They are half open; one without length is the moment of its start, which an interval shares that begins
    there, but not one that ends there."""
    inside = lambda at, s, e: (s <= at) & ((at < e) | ((at == s) & (s == e)))
    return F.when(start >= start2, inside(start, start2, end2)).otherwise(inside(start2, start, end))


def _levels(side: DataFrame, base: float) -> dict[int, int]:
    """The rows at each level."""
    return {r["level"]: r["count"] for r in side.groupBy(_level(base).alias("level")).count().collect()}


def _kept(mine: dict[int, int], other: dict[int, int]) -> list[int]:
    """The levels at which intervals stand. From the lowest one up, a level is dissolved into the kept one below unless its own intervals, in all
    bins there, are more rows than the other side's shorter ones that would visit it."""
    kept: list[int] = []
    for level in sorted({*mine, *other}):
        visits = sum((n for side, there in ((mine, other), (other, mine)) if level in side for k, n in there.items() if k < level), 0)
        if not kept or STEP ** (level - kept[-1]) > SPREAD or (mine.get(level, 0) + other.get(level, 0)) * (STEP ** (level - kept[-1]) + 1) > visits:
            kept.append(level)
    return kept or [0]


def _level(base: float) -> Column:
    length = (F.col("_end") - F.col("_start")).cast("double")
    above = F.ceil(F.log(length / base) / log(STEP)).cast("int")
    # a logarithm in binary may be off by one
    level = F.greatest(F.lit(0), F.when(length > base, above).otherwise(0))
    return F.when(length > F.pow(F.lit(float(STEP)), level) * base, level + 1).otherwise(level)


def _bins(side: DataFrame, base: float, levels: list[int], kept: list[int] | None = None) -> DataFrame:
    """``side`` in the bins that it touches, at its own level (own) and at the greater ones among ``levels``. kept: an interval's own level is the
    greatest of these that isn't above it; else all are kept."""
    own = _level(base) if kept is None else F.array_max(F.filter(F.array(*[F.lit(x) for x in kept]), lambda x: x <= _level(base)))
    placed = side.withColumn("_home", own)
    wanted = F.array_distinct(F.concat(F.array("_home"), F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("_home"))))
    placed = placed.withColumn("_at", F.explode(wanted)).withColumn("_own", F.col("_at") == F.col("_home")).drop("_home")
    width = F.pow(F.lit(float(STEP)), F.col("_at")) * base
    number = lambda c: F.floor(F.col(c) / width).cast("long")
    return placed.withColumn("_bin", F.explode(F.sequence(number("_start"), number("_end"))))


def _split(left: DataFrame, right: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _part: a bin of more than ``most`` rows on the left is dealt into parts, and the right side's rows are in each."""
    keys = ["_key", "_at", "_bin"]
    many = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    few = many.limit(SPLIT + 1).count()
    if not few:
        return left.withColumn("_part", F.lit(0)), right.withColumn("_part", F.lit(0))
    many = F.broadcast(many) if few <= SPLIT else many
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(many, keys, "left").withColumn("_part", F.pmod(F.xxhash64("_start", "_end", F.monotonically_increasing_id()), parts).cast("int")).drop("_parts")
    return dealt, right.join(many, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")


def interval_join(left: DataFrame, right: DataFrame, key: str, base: float | None = None, most: int = MOST) -> DataFrame:
    """Every pair of rows of ``left`` and ``right`` (key, start, end, other columns) of one key that overlap: key, the columns of the left side and those of
    the right; columns of one name get _right on the right.

    base: the width of the narrowest bins, else the greater one of both sides' mean lengths, which is measured. Rows of null key, start or end, or
    that end before they start, meet nothing. Repeated rows make as many pairs. Equality joins on (key, level, bin, part) only; each pair is
    found in the one bin that holds the later of its starts.
    """

    def side(rows: DataFrame) -> DataFrame:
        held = rows.filter((F.col(key).isNotNull()) & (F.col("end") >= F.col("start")))
        rest = [c for c in rows.columns if c not in (key, "start", "end")]
        return held.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"), *(F.col(c).alias(f"_of_{c}") for c in rest))

    # each side is read for its lengths, its levels and its joins; of the left one only rows of keys that the right one has
    b = stored(side(right))
    a = stored(side(left).join(b.select("_key").distinct(), "_key", "left_semi"))
    if base is None:
        mean = lambda s: s.agg(F.avg((F.col("_end") - F.col("_start")).cast("double"))).first()[0] or 0.0
        base = max(mean(a), mean(b)) or 1.0
    of_a, of_b = _levels(a, base), _levels(b, base)
    kept = _kept(of_a, of_b)
    homes = lambda levels: sorted({max(k for k in kept if k <= level) for level in levels})
    mine, other = _bins(a, base, homes(of_b), kept), _bins(b, base, homes(of_a), kept)
    both = []
    # the left side at home with whatever is there, and the left side visiting what is at home
    parts = [(mine.filter("_own"), other)]
    if of_a and of_b and homes(of_a)[0] < homes(of_b)[-1]:
        parts.append((mine.filter("not _own"), other.filter("_own")))
    for x, y in parts:
        x, y = _split(x.drop("_own"), y.drop("_own"), most)
        y = y.withColumnsRenamed({c: f"{c}2" for c in y.columns if c in ("_start", "_end") or c.startswith("_of_")})
        width = F.pow(F.lit(float(STEP)), F.col("_at")) * base
        met = x.join(y, ["_key", "_at", "_bin", "_part"])
        met = met.filter(overlaps(F.col("_start"), F.col("_end"), F.col("_start2"), F.col("_end2")) & (F.col("_bin") == F.floor(F.greatest("_start", "_start2") / width).cast("long")))
        value = lambda c, n="": F.col(f"_{c}{n}" if c in ("start", "end") else f"_of_{c}{n}")
        names = [c for c in left.columns if c != key]
        second = [value(c, "2").alias(f"{c}_right" if c in names else c) for c in right.columns if c != key]
        both.append(met.select(F.col("_key").alias(key), *(value(c).alias(c) for c in names), *second))
    return reduce(DataFrame.unionByName, both)
