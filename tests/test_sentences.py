"""Learned abbreviations and the sentences they leave, against plain Python."""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log

import pytest
from pyspark.sql import functions as F

from stampline.operators import itn, sentences

OPEN, CLOSE, QUOTE = set("\"'([{«“‘"), set("\"')]}»”’,;:"), set("\"')]}»”’")
PROSE = [
    "Dr. Smith met Mr. Jones at 5 p.m. on Monday. They spoke (e.g. about tea). \"It was fine.\" He left!",
    "Mr. Brown came. Dr. White went? Then Mr. Green saw Dr. Black... and it ended.", "We eat, e.g. apples. They ran. We sat. She wrote it, e.g. here.", None, "", " \n ", "no end of it",
    "The meeting was at 9 p.m. and the next at 10 p.m. too. All of them came. The end.", "She said «no.» Then she left. (Mr. Gray stayed.) Fine", "one  two.\nthree\tfour! five",
] * 3


def bare(word):
    word = word.lower()
    while word and word[0] in OPEN:
        word = word[1:]
    while word and word[-1] in CLOSE:
        word = word[:-1]
    return word


def expected(texts, least=sentences.LEAST):
    dotted, plain = Counter(), Counter()
    for t in texts:
        for w in map(bare, (t or "").split()):
            if any(c.isalpha() for c in w) and not w.endswith(".."):
                (dotted if w.endswith(".") else plain)[w.removesuffix(".")] += 1
    chance = sum(dotted.values()) / (sum(dotted.values()) + sum(plain.values()))
    out = {}
    for w, k in dotted.items():
        n = plain[w]
        inside = w.count(".")
        length = len(w) - inside
        score = 2 * (k * log(0.99 / chance) + n * log(0.01 / (1 - chance))) * exp(-length) * (inside + 1) * length**-n
        if score >= least:
            out[w] = (k, n, round(score, 9))
    return out


def parted(text, stems):
    out, now = [], ""
    for w, gap in re.findall(r"(\S+)(\s*)", (text or "").strip()):
        now += w
        core = w
        for _ in range(2):
            core = core[:-1] if core[-1:] in QUOTE and not core.endswith((".", "!", "?")) else core
        ends = core[-1:] in (".", "!", "?") and core
        short = w.endswith(".") and any(w.lower() == s + "." or w.lower().endswith(s + ".") and w[-len(s) - 2] in OPEN for s in stems)
        if ends and not short and gap:
            out.append(now)
            now = ""
        else:
            now += gap
    return out + [now] if now else out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_abbreviations(spark):
    docs = frame(spark, PROSE)
    got = {r["stem"]: (r["n_dotted"], r["n_plain"], round(r["score"], 9)) for r in sentences.abbreviations(docs).collect()}
    assert got == expected(PROSE) and {"dr", "mr", "p.m", "e.g"} <= set(got) and not {"monday", "tea", "fine", "left"} & set(got)
    assert sentences.learned(docs) == sorted(got)
    assert sentences.learned(docs.limit(0)) == sentences.learned(frame(spark, [None, "no period here"])) == sentences.learned(frame(spark, ["all. of. them."])) == []
    with pytest.raises(ValueError, match="raise least"):
        sentences.learned(docs, most=2)


@pytest.mark.parametrize("stems", [[], ["dr", "mr", "p.m", "e.g"]])
def test_split(spark, stems):
    got = {r["id"]: r["s"] for r in frame(spark, PROSE).select("id", sentences.split(F.col("text"), stems).alias("s")).collect()}
    assert got == {i: parted(t, stems) for i, t in enumerate(PROSE)}
    if stems:
        assert got[0] == ["Dr. Smith met Mr. Jones at 5 p.m. on Monday.", "They spoke (e.g. about tea).", '"It was fine."', "He left!"]


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stems = sentences.learned(docs)
    assert stems == sorted(expected(texts.values()))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", sentences.split(F.col("text"), stems).alias("s")).collect()}
    assert got == {i: parted(t, stems) for i, t in texts.items()}


def test_normalised_by_learned_sentences(spark, monkeypatch):
    """A number does not run over the end of a sentence, and it does over an abbreviation; grammars are made once, and without one texts stay."""
    texts = ["No. twenty two. Five dollars", "twenty. Two", None, " "]
    rows = frame(spark, texts).select(itn.apply(F.col("text"), units=sentences.split(F.col("text"), ["no"]), make=itn.english).alias("x")).collect()
    assert [r["x"] for r in rows] == ["No. 22. $5", "20. 2", None, " "]
    assert [r["x"] for r in frame(spark, texts).select(itn.apply(F.col("text"), language="xx", make=lambda language: itn.english(language)).alias("x")).collect()] in (texts, ["No. 22. $5", "20. 2", None, " "])
    with pytest.raises(ValueError, match="no grammar"):
        itn.english("xx")

