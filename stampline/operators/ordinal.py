"""Tables paired by position: the first row of one with the first of the other, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def numbered(rows: DataFrame, order: list[str], name: str = "no") -> DataFrame:
    """``rows`` with ``name``, from 0 in the order of ``order``, nulls first; ties go by where they were read. Rows are dealt by ranges, each range numbers
    its own, and the numbers before it are sums over one row a range, so no task has all rows. Rows are stored, as ranges are sampled."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_read"]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_read")
    known = stored(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    sizes = known.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", (before - F.col("_low")).alias("_shift"))
    # one row a range
    return known.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def ordinal_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """no and the columns of both sides, whose names must differ, of the rows that have one position. Of sides of unequal length the shorter one decides, as
    with zip, unless ``how`` is left, right or full. Positions are an equality join, on both sides dealt by ranges of their own order."""
    return numbered(left, left_order).join(numbered(right, right_order), "no", how)
