"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, made known to the session. Where that is unset, a temporary folder serves a local master, as in tests; on a
    cluster a RuntimeError is raised."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="stampline-")
        spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


#: Paths in the shared folder that go when the driver's process ends, each with its session.
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes, with what is there then, when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the gateway may be gone when the interpreter ends
            return


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df``, computed once, written to the shared folder as a table and read back, so that a lost executor can't change it and readers take only
    the columns that they need. compression: None is the session's."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
