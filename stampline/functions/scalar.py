"""Column functions of single values: times, texts, labels. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of video files, and characters that end a sentence.
VIDEO = ("mp4", "avi", "mov", "mkv", "webm", "flv", "m4v")
SENTENCE_END = r"[.?!。？！]\s*$"


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds in binary64; every part is cut off, not rounded."""
    s = seconds.cast("double")
    part = lambda c: F.floor(c).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", part(s / 3600), part((s % 3600) / 60), part(s % 60), part((s % 1) * 1000))


def srt_time_ms(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    m = ms.cast("long")
    part = lambda c: F.floor(c).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", part(m / 3600000), part(m % 3600000 / 60000), part(m % 60000 / 1000), m % 1000)


def txt_time_ms(ms: Column) -> Column:
    m = ms.cast("long")
    part = lambda c: F.floor(c).cast("long")
    return F.format_string("[%02d:%02d:%02d]", part(m / 3600000), part(m % 3600000 / 60000), part(m % 60000 / 1000))


def minutes_seconds(ms: Column) -> Column:
    m = ms.cast("long")
    return F.format_string("%dm %ds", F.floor(m / 60000).cast("long"), F.floor(m % 60000 / 1000).cast("long"))


def stamp_text(*keys: Column) -> Column:
    """Text of a stamp: the first key that is there, else empty. The order of the keys is the caller's."""
    return F.coalesce(*keys, F.lit(""))


def clamp(start: Column, end: Column, most: Column | float) -> tuple[Column, Column]:
    """A word's times: the end not before the start, and no longer than ``most`` (0 or less: no limit), kept at its end."""
    most = F.lit(most) if not isinstance(most, Column) else most
    e = F.greatest(start, end)
    long = (most > 0) & (e - start > most)
    s2 = F.when(long, F.greatest(start, e - most)).otherwise(start)
    return s2, F.when(long, F.least(e, s2 + most)).otherwise(e)


def ends_sentence(text: Column) -> Column:
    return F.coalesce(text.rlike(SENTENCE_END), F.lit(False))


def word_list(text: Column) -> Column:
    """Words between white space of any script; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces become one; white space at both ends goes. Tabs and newlines inside stay."""
    return F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r"(?U)^\s+|\s+$", "")


def csv_text(text: Column) -> Column:
    """Always in quotes, quotes doubled, nothing else escaped."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def cache_key(path: Column, name: Column) -> Column:
    return F.concat(F.substring(F.sha2(path.cast("binary"), 256), 1, 16), F.lit("_"), name)


def estimated_seconds(words: Column) -> Column:
    return F.greatest(F.lit(5.0), words / F.lit(2.5))


def estimated_ms(words: Column) -> Column:
    """estimated_seconds() in whole milliseconds, without binary fractions."""
    return F.greatest(F.lit(5000).cast("long"), words.cast("long") * 400)


def real_time_factor(duration: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, duration / seconds).otherwise(F.lit(0.0))


def is_video(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*VIDEO)


def first_match(text: Column, choices: list[tuple[str, str]], default: str) -> Column:
    """The value of the first key that the text contains, in the order given."""
    out = F
    for key, value in choices:
        out = out.when(F.contains(text, F.lit(key)), F.lit(value))
    return out.otherwise(F.lit(default)) if choices else F.lit(default)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a key in a small fixed table, ``default`` for others and null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def rms(samples: Column) -> Column:
    """Root mean square of an array of samples; null for an empty one."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples)))


def itn_status(wanted: Column, available: Column | bool = True) -> Column:
    """The label of inverse text normalisation."""
    available = F.lit(available) if isinstance(available, bool) else available
    state = F.when(wanted & available, F.lit("applied")).when(wanted, F.lit("not installed")).otherwise(F.lit("disabled"))
    return F.concat(F.lit("ITN: "), state)


# Titles of error responses by their kind; others are generic.
ERRORS = {
    "permission": "Permission Error", "permission_file_lock": "Model Loading Failed: File Lock", "network": "Network Error", "file_not_found": "File Not Found",
    "filesystem": "File System Error", "runtime": "Runtime Error", "validation": "Output Validation Failed", "transcription_file_lock": "Transcription Failed: File Lock",
    "transcription": "Transcription Error", "generic": "Unexpected Error",
}
#: Kinds whose message is a technical detail, shown as a block of its own.
DETAILED = ("transcription", "transcription_file_lock")


def error_response(kind: Column, message: Column) -> Column:
    """The text that a failed request is answered with: the title of its kind, an unknown or null kind being generic, and the message."""
    title = F.concat(F.lit("### ❌ "), lookup(kind, ERRORS, ERRORS["generic"]))
    said = F.coalesce(message, F.lit(""))
    detail = F.when(F.coalesce(kind.isin(*DETAILED), F.lit(False)), F.concat(F.lit("```\n"), said, F.lit("\n```"))).otherwise(said)
    return F.concat_ws("\n\n", title, detail)


def load_error(title: Column, path: Column, name: Column, problem: Column, solution: Column, original: Column) -> Column:
    """The text of a model that could not be loaded; the line of the original error only where there is one. Other null parts are left out too."""
    labelled = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("❌ "), title), labelled("File path", path), labelled("Model", name), labelled("Original error", original), problem, solution)


def timestamp_status(wanted: Column, level: Column) -> Column:
    return F.when(~wanted, F.lit("disabled")).when(level == "none", F.lit("requested, not available")).otherwise(F.concat(level, F.lit("-level")))
