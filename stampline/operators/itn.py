"""Inverse text normalisation: the splits and fallbacks, and a small English grammar (cardinals, years, dollars, decimals, percent)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar

# Number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}


def word_chunks(text: Column, size: int = 50) -> Column:
    """Groups of ``size`` words; a text without words is one chunk, itself."""
    # the words are bound to a name, as each group would split the text again
    groups = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size)), lambda i: F.array_join(F.slice(w, i, size), " "))
    chunks = F.transform(F.array(scalar.word_list(text)), lambda w: F.when(F.size(w) > 0, groups(w)).otherwise(F.array(text)))
    return F.element_at(chunks, 1)


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+", -1), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def modes(mode: Column, checked: Column) -> dict[str, Column]:
    """Where normalisation happens under a mode (per_chunk, final_pass, both, disabled) and a check box."""
    return {
        "long_chunk": mode.isin("per_chunk", "both"),
        "single_final": mode.isin("final_pass", "both"),
        "short_batch": (mode != "disabled") & checked,
        "long_batch_final": F.lit(False),
        "header": checked,
    }


def _number(words: list[str]) -> tuple[int, int] | None:
    """(value, words used) of the longest cardinal or year at the start."""
    total = part = used = 0
    kind = ""  # of the last word
    for i, w in enumerate(words):
        if w in UNITS and kind in ("", "hundred", "scale") or w in UNITS and kind == "tens" and 0 < UNITS[w] < 10:
            part, kind = part + UNITS[w], "unit"
        elif w in TENS and kind in ("", "hundred", "scale"):
            part, kind = part + TENS[w], "tens"
        elif w in TENS and kind in ("tens", "unit") and i and not total and 10 <= part <= 99:  # a year: twenty twenty two
            rest = _number(words[i:])
            if rest and rest[0] < 100:
                return part * 100 + rest[0], i + rest[1]
            break
        elif w == "hundred" and kind == "unit" and 0 < part < 100:
            part, kind = part * 100, "hundred"
        elif w in SCALES and part:
            total, part, kind = total + part * SCALES[w], 0, "scale"
        else:
            break
        used = i + 1
    return (total + part, used) if used else None


def normalise(text: str) -> str:
    """Number words as digits; other words stay."""
    words = text.split()
    plain = [re.sub(r"[.,;:!?]+$", "", w).lower() for w in words]
    out: list[str] = []
    i = 0
    while i < len(words):
        got = _number(plain[i:])
        if got is None or (got[1] == 1 and plain[i] in ("one",)):
            out.append(words[i])
            i += 1
            continue
        value, end = str(got[0]), i + got[1]
        if plain[end : end + 1] == ["point"]:
            digits = []
            k = end + 1
            while k < len(plain) and plain[k] in UNITS and UNITS[plain[k]] < 10:
                digits.append(str(UNITS[plain[k]]))
                k += 1
            if digits:
                value, end = f"{value}.{''.join(digits)}", k
        tail = re.search(r"[.,;:!?]*$", words[end - 1])[0]
        unit = plain[end] if end < len(plain) and not tail else ""
        if unit in ("dollar", "dollars", "percent"):
            tail = re.search(r"[.,;:!?]*$", words[end])[0]
            value, end = (value + "%", end + 1) if unit == "percent" else ("$" + value, end + 1)
        out.append(value + tail)
        i = end
    return " ".join(out)


def with_fallback(one: Callable[[str], str], chunks: list[str]) -> list[str]:
    """Each chunk normalised; one that fails stays as it is."""
    out = []
    for c in chunks:
        try:
            out.append(one(c))
        except Exception:  # noqa: BLE001  the text itself is the fallback
            out.append(c)
    return out


_made: list = []


def grammar_of(language: str, make: Callable[[str], Callable[[str], str]]) -> Callable[[str], str] | None:
    """The grammar of this process: made for the language that is asked for first, which every later one gets too; None, and made anew the next
    time, if that fails."""
    if not _made:
        try:
            _made.append(make(language))
        except Exception:  # noqa: BLE001  without a grammar, texts stay as they are
            return None
    return _made[0]


def apply(
    text: Column, grammar: Callable[[str], str] = normalise, split: Callable[[str], list[str]] | None = None, units: Column | None = None,
    language: str = "en", make: Callable[[str], Callable[[str], str]] | None = None,
) -> Column:
    """The text normalised in an Arrow-batched function: by its sentences, as ``units`` (an array column) or else ``split`` gives them, if there are any and
    split works; else by sentences if there are several, else by 50-word chunks; blank text stays. make: gives the grammar of a language, once in
    a process, as grammar_of() does; without one, texts stay as they are."""

    def run(s: pd.Series, given: pd.Series | None = None) -> pd.Series:
        mine = grammar_of(language, make) if make else grammar
        if mine is None:
            return s

        def one(t: str | None, own: list[str] | None) -> str | None:
            if t is None or not t.strip():
                return t
            try:
                own = split(t) if split and own is None else [] if own is None else list(own)
            except Exception:  # noqa: BLE001  the next way is taken
                own = []
            if own:
                return " ".join(with_fallback(mine, own))
            parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", t.strip()) if p.strip()]
            if len(parts) < 2:
                w = t.split()
                parts = [" ".join(w[k : k + 50]) for k in range(0, len(w), 50)]
            return " ".join(with_fallback(mine, parts))

        return pd.Series([one(t, u) for t, u in zip(s, [None] * len(s) if given is None else given, strict=True)], dtype=object)

    if units is None:

        def alone(s: pd.Series) -> pd.Series:
            return run(s)

        return F.pandas_udf(alone, "string")(text)

    def both(s: pd.Series, given: pd.Series) -> pd.Series:
        return run(s, given)

    return F.pandas_udf(both, "string")(text, units)


def english(language: str) -> Callable[[str], str]:
    """The grammar of a language, of which there is the one."""
    if language != "en":
        raise ValueError(f"no grammar of {language}")
    return normalise


def apply_segment(text: Column, size: int = 50, grammar: Callable[[str], str] = normalise) -> Column:
    """A segment normalised in an Arrow-batched function: up to ``size`` words as they are, without white space at the ends; more in chunks of
    so many words, each by itself. What can't be normalised stays; so does blank text, and null."""

    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            words = (t or "").split()
            if not words:
                return t
            if len(words) <= size:
                return with_fallback(grammar, [t.strip()])[0]
            return " ".join(with_fallback(grammar, [" ".join(words[k : k + size]) for k in range(0, len(words), size)]))

        return s.map(one)

    return F.pandas_udf(run, "string")(text)
