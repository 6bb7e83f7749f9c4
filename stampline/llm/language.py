"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader
and elastic-net penalties, then calibrated by a temperature."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fits, held_out, table
from .ngrams import BUCKETS, counts

#: Most rows of a language that the model is fitted on, those with the least hash of id and text; one in CALIBRATED sets the temperature.
TRAINED, CALIBRATED = 1_000, 5
#: FTRL: learning rate, its offset, L1 and L2 penalties, passes.
RATE, OFFSET, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.05, 3
UNKNOWN = "und"
#: Letters, and signs such as fractions, which has_letter() tells from them.
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of a Unicode category of letters."""
    return text is not None and any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all training texts each bucket's n-grams occur, and the number of texts. Each task sums its rows before they are
    shuffled; what comes to the driver has one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for t in b.slice(i, 256).column(0):
                    if (text := t.as_py()) is not None:
                        df += counts(text.lower()) > 0
                        n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, BUCKETS].astype(np.int32)), pa.array(np.r_[df[at], n])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in got:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def least_hashed(rows: DataFrame, most: int) -> DataFrame:
    """doc_id, lang, text_hash: of each language the ``most`` distinct ones of these with the least hash of id and text.

    A histogram of the hashes with logarithmic bins, of some 4000 bins a language at most, tells up to which bin they lie; only
    rows up to there are made distinct and ranked, however large and hot a language is, and copies fall together before
    they are shuffled. Where copies leave fewer than ``most``, the bound is raised fourfold, until there are enough or no rows are
    left out; one number a language comes to the driver each time.
    """
    keyed = rows.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash"), 1)
    hashed = keyed.withColumn("h", h).withColumn("bin", F.floor(F.log2(F.col("h") + 1.0) * 64).cast("int"))
    bins = table(hashed.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    last = F.max("bin").over(Window.partitionBy("lang"))
    upto = most
    while True:
        cut = bins.withColumns({"before": before, "last": last}).filter(F.col("before") < upto).groupBy(F.col("lang").alias("of"), "last").agg(F.max("bin").alias("cut"))
        cut = table(cut, "cuts")
        near = hashed.join(F.broadcast(cut) if fits(cut) else cut, F.col("lang") == F.col("of")).filter(F.col("bin") <= F.col("cut"))
        near = table(near.select("doc_id", "lang", "text_hash", "h").distinct(), "least")
        have = near.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        few = cut.filter("cut < last").join(have, F.col("lang") == F.col("of"), "left").filter(F.coalesce("n", F.lit(0)) < most)
        enough = not few.count()
        drop(cut)
        if enough:
            break
        drop(near)
        upto *= 4
    drop(bins)
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text_hash")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("doc_id", "lang", "text_hash")


class Model:
    """names: the languages; idf; w (buckets, languages), mostly zeros; bias; temperature."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> None:
        self.names = sorted(set(langs))
        self.idf, self.temperature = idf, 1.0
        y = np.array([self.names.index(x) for x in langs], int)
        aside = np.arange(len(y)) % CALIBRATED == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        scaled = [self._scale(at, n) for at, n in rows]
        self._train([(at, v, c) for (at, v), c, a in zip(scaled, y, aside, strict=True) if not a])
        if aside.any() and len(self.names) > 1:
            z = np.array([self.w[at].T @ v + self.bias for (at, v), a in zip(scaled, aside, strict=True) if a])
            self._calibrate(z, y[aside])

    def _scale(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(n)) * self.idf[at]
        return at, v / max(float(np.sqrt(v @ v)), 1e-12)

    def _train(self, data: list) -> None:
        k = len(self.names)
        z, s = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
        rng = np.random.default_rng(11)

        def weights(at: np.ndarray) -> np.ndarray:
            zz = z[at]
            return np.where(np.abs(zz) <= L1, 0.0, (np.sign(zz) * L1 - zz) / ((OFFSET + np.sqrt(s[at])) / RATE + L2))

        for _ in range(PASSES):
            for i in rng.permutation(len(data)):
                at, v, c = data[i]
                at, v = np.r_[at, BUCKETS], np.r_[v, 1.0]
                w = weights(at)
                p = v @ w
                p = np.exp(p - p.max())
                p /= p.sum()
                p[c] -= 1
                g = v[:, None] * p
                g2 = g * g
                z[at] += g - (np.sqrt(s[at] + g2) - np.sqrt(s[at])) / RATE * w
                s[at] += g2
        w = weights(np.arange(BUCKETS + 1))
        self.w, self.bias = w[:-1].astype(np.float32), w[-1]

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss, by golden-section search on its logarithm."""

        def loss(t: float) -> float:
            u = z / np.exp(t)
            u = u - u.max(1, keepdims=True)
            return float((np.log(np.exp(u).sum(1)) - u[np.arange(len(y)), y]).mean())

        lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        n = counts(text.lower())
        at = np.flatnonzero(n > 0)
        at, v = self._scale(at, n[at])
        u = (v @ self.w[at] + self.bias) / self.temperature
        p = np.exp(u - u.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.names[best], float(p[best])


def fit(docs: DataFrame, trained: int = TRAINED) -> Model:
    """From the rows that have a language and are not held out: document frequencies of all of them, weights of at most ``trained`` of each
    language, those of the least hash of id and text; equal rows of id, language and text count as one of them. Rows of null id, text or
    language teach nothing. The model has a column a language, so their number must be one that a driver can hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    df, n = document_frequency(rows)
    chosen = least_hashed(rows, trained).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "text_hash")
    side = F.broadcast(chosen) if fits(chosen, F.octet_length("of") + 32) else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                rows = []
                for t in c.column(2):
                    m = counts(t.as_py().lower())
                    at = np.flatnonzero(m > 0)
                    rows.append(np.c_[at, m[at]].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(rows, pa.binary())], ["id", "lang", "row"])

    same = (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")) & (F.xxhash64("text") == F.col("text_hash"))
    sample = rows.join(side, same).select("id", "lang", "text_hash", "text").dropDuplicates(["id", "lang", "text_hash"])
    sample = sample.select("id", "lang", "text").mapInArrow(run, "id long, lang string, row binary")
    got = sorted((r["id"], r["lang"], bytes(r["row"])) for r in sample.toLocalIterator())
    got = [got[i] for i in np.random.default_rng(5).permutation(len(got))]
    features = [(m[:, 0].astype(np.int64), m[:, 1].astype(float)) for m in (np.frombuffer(r[2], "<u4").reshape(-1, 2) for r in got)]
    return Model((np.log((1 + n) / (1 + df)) + 1).astype(np.float32), features, [r[1] for r in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``; score is the calibrated probability of the language.

    Null texts and texts without a letter: ``und`` with score 0; so all texts if nothing could be learned. Null doc_id is passed on, not held
    out. Repeated rows get equal results. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                got = [model.predict(t.as_py()) for t in c.column(2)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more; all columns are kept, whatever their names. Where it
    isn't given, it is 1.5 times what chance gives, a half at most: a short text says little of any language, which is no reason to reject it.
    Where no language could be learned, none can be told from another, and every text with a letter is kept."""
    least = min(0.5, 1.5 / max(len(model.names), 1)) if least is None else least
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                texts = [t.as_py() for t in c.column(at)]
                if model.names:
                    keep = [g[0] != UNKNOWN and g[1] >= least for g in map(model.predict, texts)]
                else:
                    keep = [has_letter(t) for t in texts]
                yield c.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
