"""Predicates and validations. A failing row gets an error column; it never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds in seconds and of the energy.
SHORTEST, LONGEST, SILENT, QUIET = 0.1, 86400.0, 0.001, 0.01
FAILED = "[Transcription failed: "


def duration_error(seconds: Column) -> Column:
    """null if valid; both bounds are valid."""
    return F.when(seconds < SHORTEST, F.lit("too_short")).when(seconds > LONGEST, F.lit("too_long"))


def energy_state(rms: Column) -> Column:
    return F.when(rms < SILENT, F.lit("silent")).when(rms < QUIET, F.lit("warning")).otherwise(F.lit("ok"))


def load_error_kind(message: Column) -> Column:
    """Failed loads and unsupported formats, in that order of tests."""
    failed = F.contains(message, F.lit("Audio file")) | F.contains(message, F.lit("NoBackendError"))
    unsupported = F.contains(message, F.lit("Format")) | F.contains(message, F.lit("codec"))
    return F.when(failed, F.lit("load_failed")).when(unsupported, F.lit("unsupported_format")).otherwise(F.lit("load_failed"))


def is_file_lock(message: Column) -> Column:
    return F.contains(message, F.lit("WinError 32")) | F.contains(message, F.lit("being used by another process"))


def hypothesis_error(present: Column, text: Column) -> Column:
    """null if the hypothesis can be used."""
    return F.when(~present, F.lit("no result")).when(text.isNull() | (text == ""), F.lit("empty text"))


def structure_error(kind: Column, size: Column, index: Column) -> Column:
    """What is wrong with a result as a whole, null if nothing: ``kind`` is its type (null: there is none), ``size`` the length of a list, and ``index`` the
    item that is asked for. The tests come in this order."""
    listed = F.when(kind != "list", F.concat(F.lit("Result is "), kind, F.lit(", expected list")))
    empty = F.when(size == 0, F.lit("Result is an empty list"))
    beyond = F.when(index >= size, F.concat(F.lit("Index "), index.cast("string"), F.lit(" out of range (result has "), size.cast("string"), F.lit(" items)")))
    return F.coalesce(F.when(kind.isNull(), F.lit("Result is None")), listed, empty, beyond)


def text_error(kind: Column, attribute: Column, text: Column) -> Column:
    """What is wrong with a hypothesis, null if its text can be used. It is a string itself (``kind`` str) or has a text attribute, of the type
    ``attribute`` (null: it has none)."""
    missing = F.when((kind != "str") & attribute.isNull(), F.concat(F.lit("Hypothesis has no .text attribute (type: "), kind, F.lit(")")))
    wrong = F.when((kind != "str") & (attribute != "str"), F.concat(F.lit(".text is "), attribute, F.lit(", expected string")))
    return F.coalesce(missing, wrong, F.when(F.coalesce(text, F.lit("")) == "", F.lit("Transcription is empty")))


def lenient_text(attribute: Column, plain: Column, shown: Column) -> Column:
    """The text of a hypothesis without any test: its text attribute, else the string itself, else how it is shown."""
    return F.coalesce(attribute, plain, shown)


def failure_text(error: Column) -> Column:
    return F.concat(F.lit(FAILED), error, F.lit("]"))


def is_failure(text: Column) -> Column:
    return F.startswith(text, F.lit(FAILED))


def audio_errors(duration: Column, energy: Column) -> Column:
    """Both validations of a decoded file: the error, else null."""
    return F.coalesce(duration_error(duration), F.when(energy < SILENT, F.lit("silent")))
