"""Scans that read again only what has changed: a manifest knows each file by path, length and time, and its content by its hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .media import normalise_inputs

MANIFEST = "path string, length long, modified timestamp, sha256 string"


def listing(spark: SparkSession, inputs: object) -> DataFrame:
    """path, length, modified of the files under the inputs; nothing of them is read. Files without a byte are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(normalise_inputs(inputs))
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _hashed(files: DataFrame) -> DataFrame:
    """path, length, modified, sha256: contents are hashed piece by piece; a file that has gone since has none."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(path: str) -> str | None:
        store, at = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)
        digest = hashlib.sha256()
        try:
            with store.open_input_stream(at) as f:
                while piece := f.read(1 << 20):
                    digest.update(piece)
        except FileNotFoundError:
            return None
        return digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [one(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], ["path", "length", "modified", "sha256"])

    return files.select("path", "length", "modified").repartition(parts, "path").mapInArrow(run, MANIFEST)


def scan_changes(spark: SparkSession, inputs: object, manifest: DataFrame | None = None) -> DataFrame:
    """path, length, modified, sha256, state of every file under the inputs and every file of ``manifest`` (path, length, modified, sha256).

    state: same (its path, length and time are as in the manifest, so it is not read and its hash is taken from there), changed (they are not, and
    neither is its content), touched (they are not, but its content is), copy (its path is new, its content known), new, and gone (it is no longer
    there; the rest is what was). Rows that are not gone are the next manifest. Store the result before it is used twice, as each use reads the files
    that are not the same.
    """
    known = (manifest if manifest is not None else spark.createDataFrame([], MANIFEST)).select(*(F.col(c).alias(f"_{c}") for c in ("path", "length", "modified", "sha256")))
    both = listing(spark, inputs).join(known, F.col("path") == F.col("_path"), "left")
    unchanged = F.coalesce((F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified")) & F.col("_sha256").isNotNull(), F.lit(False))
    same = both.filter(unchanged).select("path", "length", "modified", F.col("_sha256").alias("sha256"), F.lit("same").alias("state"))
    read = _hashed(both.filter(~unchanged))
    contents = known.filter("_sha256 is not null").select(F.col("_sha256").alias("_content")).distinct()
    told = read.join(known, F.col("path") == F.col("_path"), "left").join(contents, F.col("sha256") == F.col("_content"), "left")
    state = F.when(F.col("_path").isNull(), F.when(F.col("_content").isNotNull(), "copy").otherwise("new")).when(F.col("sha256") == F.col("_sha256"), "touched").otherwise("changed")
    told = told.select("path", "length", "modified", "sha256", state.alias("state"))
    gone = known.join(listing(spark, inputs), F.col("path") == F.col("_path"), "left_anti")
    gone = gone.select(F.col("_path").alias("path"), F.col("_length").alias("length"), F.col("_modified").alias("modified"), F.col("_sha256").alias("sha256"), F.lit("gone").alias("state"))
    return same.unionByName(told).unionByName(gone)
