"""Helpers that the operators share: the shared folder, written tables, size-checked broadcasts, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows and bytes; each caller has another way beyond it.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

#: What lies in the shared folder: the frames that table() gave, by identity, or the path of a folder, each with its session and path.
_made: dict[int | str, tuple[SparkSession, str, DataFrame | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir. Where that is unset, a temporary folder of our own serves
    a local master, as in tests; on a cluster it would be another folder on each machine, so a RuntimeError is raised."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="stampline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut, lost executors cost nothing but their
    running tasks. The files go when the driver's process ends, or with drop()."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del _made[path]
    _made[id(out)] = (spark, path, out)
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own name under the shared one, which goes when the driver's process ends. It is not made."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made[path] = (spark, path, None)
    return path


def drop(*tables: DataFrame) -> None:
    """Delete tables made by table(), once all that was made of them has been written."""
    for t in tables:
        _delete(t.sparkSession, _made.pop(id(t))[1])


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path, _ in _made.values():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone when the interpreter ends
            return


def fits(df: DataFrame, weight: Column | None = None, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a side before it is broadcast: whether it stays under the bounds on rows and bytes."""
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight if weight is not None else F.lit(16)), F.lit(0))).first()
    return n <= rows and b <= size


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text is divisible by 5. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b of type long) by alternating large-star and small-star steps.

    Returns (node, root) for every node that has an edge to another node; root is the smallest node of its component.
    Each step is a partially aggregated minimum and an equality join, so a node with very many edges is pre-aggregated
    and its join partition can be split by AQE; nothing but two numbers comes to the driver per round. Self edges and
    repeated edges are ignored; no edges give no rows.
    """
    now = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    for _ in range(rounds):
        # large-star: every larger neighbour of u points to the least of u and its neighbours
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its smaller neighbours point to the least of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = table(small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), name)
        last, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b"), F.col("b")).distinct())
