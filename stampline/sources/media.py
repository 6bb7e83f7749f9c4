"""Scans of media files and of catalogs of models."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

# Extensions that are accepted.
AUDIO = ("wav", "mp3", "flac", "m4a", "ogg", "aac", "wma")


def normalise_inputs(inputs: object) -> list[str]:
    """None, a path, an object with a name, or a list of these, as a flat list of paths."""
    if inputs is None:
        return []
    if isinstance(inputs, list | tuple):
        return [p for x in inputs for p in normalise_inputs(x)]
    return [inputs if isinstance(inputs, str) else str(getattr(inputs, "name", inputs))]


def scan_media(spark: SparkSession, inputs: object) -> DataFrame:
    """path, name, length, is_video, supported, duration (seconds, from the header of a WAV file; null for others). Only the contents of WAV files are
    read; of all others the listing is enough. Files without a byte are left out, as the reader of files does."""

    def seconds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import io
        import wave

        def one(b: bytes) -> float | None:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    return w.getnframes() / w.getframerate()
            except (wave.Error, EOFError, ZeroDivisionError):
                return None

        for s in parts:
            yield s.map(one).astype("float64")

    probe = F.pandas_udf(seconds, "double")
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = files().load(normalise_inputs(inputs))
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    columns = ("path", name.alias("name"), "length", scalar.is_video(name).alias("is_video"), extension.isin(*AUDIO, *scalar.VIDEO).alias("supported"))
    # by the pattern, as a filter would come after the bytes of all files
    waves = files().option("pathGlobFilter", "*.[wW][aA][vV]").load(normalise_inputs(inputs)).filter(extension == "wav").select(*columns, probe("content").alias("duration"))
    return waves.unionByName(found.filter(extension != "wav").select(*columns, F.lit(None).cast("double").alias("duration")))


def catalog_status(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Each model of the catalog (filename, min_size_gb, ...) with what is on disk (filename, size_gb): exists, size_gb, valid."""
    there = listing.select("filename", F.col("size_gb").cast("double").alias("size_gb"), F.lit(True).alias("there"))
    out = catalog.join(F.broadcast(there) if there.count() <= 10_000 else there, "filename", "left")
    size = F.coalesce("size_gb", F.lit(0.0))
    return out.select(*catalog.columns, F.coalesce("there", F.lit(False)).alias("exists"), size.alias("size_gb"), (size >= F.col("min_size_gb")).alias("valid"))


def catalog_totals(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if("exists").alias("downloaded"), F.coalesce(F.sum("size_gb"), F.lit(0.0)).alias("total_gb"))


def download_totals(tries: DataFrame) -> DataFrame:
    """One row: models, and how many of them were downloaded, of tries (model, ok). A model with several tries counts once, as downloaded if one went
    well."""
    each = tries.groupBy("model").agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok"))
    return each.agg(F.count(F.lit(1)).alias("models"), F.count_if("ok").alias("downloaded"))


def load_decision(status: DataFrame) -> DataFrame:
    return status.withColumn("load_from", F.when(F.col("exists"), "local").otherwise("hub"))


def health(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Failures of a health check: expected paths that are not there."""
    return expected.join(actual.distinct(), "path", "left_anti").agg(F.count(F.lit(1)).alias("failures"))


def import_failures(modules: list[str]) -> list[str]:
    """Those of the modules that the driver can't import."""
    from importlib import import_module

    failed = []
    for name in modules:
        try:
            import_module(name)
        except Exception:  # noqa: BLE001  whatever goes wrong in it, the module can't be used
            failed.append(name)
    return failed


def full_health(expected: DataFrame, actual: DataFrame, modules: list[str]) -> DataFrame:
    """missing (paths), unusable (modules), failures (both)."""
    bad = F.lit(len(import_failures(modules))).cast("long")
    return health(expected, actual).select(F.col("failures").alias("missing"), bad.alias("unusable"), (F.col("failures") + bad).alias("failures"))
