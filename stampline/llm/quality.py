"""Quality classifier: naive Bayes support vectors. Indicators of n-grams, of characters and of repeated words, are scaled by the
classes' log-count ratios, then a linear hinge-loss model is fitted by dual coordinate descent; a logistic curve on set-aside rows
turns margins into scores."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fits, held_out, table
from .ngrams import BUCKETS, counts

#: Most labelled rows that the model is fitted on; of them one in CALIBRATED sets the curve.
TRAINED, CALIBRATED = 8_000, 5
#: Smoothing of counts, cost of the hinge loss, passes of coordinate descent.
ALPHA, COST, PASSES = 1.0, 1.0, 12
THRESHOLD = 0.3


#: Longest n-gram over the repeats of a text: of consecutive words, which equal the word before them.
REPEATS = 4
FEATURES = BUCKETS + (2 << REPEATS)


def repeats(text: str) -> np.ndarray:
    """Numbers of the n-grams that occur in the text's stream of repeats (a word equals the one before it or not, in either case), a leading 1
    bit before the bits of each. Character n-grams can't say that a word is said again."""
    words = text.lower().split()
    again = np.fromiter(map(eq, words, words[1:]), np.int64, max(len(words) - 1, 0))
    found = []
    for k in range(1, min(REPEATS, len(again)) + 1):
        code = np.ones(len(again) - k + 1, np.int64)
        for p in range(k):
            code = 2 * code + again[p : p + len(code)]
        found.append(np.flatnonzero(np.bincount(code)))
    return np.concatenate(found or [np.zeros(0, np.int64)])


def indicator(text: str | None) -> np.ndarray:
    """Sorted numbers of the features that occur in the whole text: buckets of character n-grams, then n-grams over its repeats."""
    text = text or ""
    return np.r_[np.flatnonzero(counts(text) > 0), BUCKETS + repeats(text)]


def log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (class 1's share of each n-gram / class 0's)."""
    of = []
    for c in (1, 0):
        n = np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y == c)] or [np.zeros(0, int)]), minlength=FEATURES) + ALPHA
        of.append(np.log(n / n.sum()))
    return of[0] - of[1]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised linear hinge-loss model. rows and values: the sparse rows; sign: +1 or -1; cost: of each row,
    the upper bound of its dual variable, 0 the lower."""
    w, bias, a = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    norm = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                a[i] = new
    return w, bias


class Model:
    """ratio and w over the features, bias, and the curve's slope and offset."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        y = np.asarray(y)
        aside = np.arange(len(y)) % CALIBRATED == 0
        if len(y) < 50 or len(np.unique(y[~aside])) < 2 or len(np.unique(y[aside])) < 2:
            aside = np.zeros(len(y), bool)
        fit = np.flatnonzero(~aside)
        self.ratio, self.bias, self.slope, self.offset = np.zeros(FEATURES), 0.0, 0.0, 0.0
        self.w = np.zeros(FEATURES)
        ones = float(y.mean()) if len(y) else 0.5
        if not len(y) or ones in (0.0, 1.0):  # one class only: its share is the score
            self.offset = float(np.log((ones + 1e-3) / (1 - ones + 1e-3)))
            return
        self.ratio = log_ratio([rows[i] for i in fit], y[fit])
        sign = np.where(y[fit] == 1, 1.0, -1.0)
        cost = COST * np.where(sign > 0, 0.5 / max((sign > 0).mean(), 1e-9), 0.5 / max((sign < 0).mean(), 1e-9))
        self.w, self.bias = dual_coordinate_descent([rows[i] for i in fit], [self.scaled(rows[i]) for i in fit], sign, cost)
        at = np.flatnonzero(aside) if aside.any() else fit
        self._curve(np.array([self.margin(rows[i]) for i in at]), y[at])

    def scaled(self, row: np.ndarray) -> np.ndarray:
        v = self.ratio[row]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def margin(self, row: np.ndarray) -> float:
        return float(self.w[row] @ self.scaled(row)) + self.bias

    def _curve(self, m: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the margin, with smoothed targets, by Newton steps."""
        n1, n0 = y.sum(), (1 - y).sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        s, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(s * m + b, -30, 30)))
            d, h = t - p, p * (1 - p) + 1e-9
            g = np.array([(d * m).sum() - 1e-3 * s, d.sum()])
            hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(hess, g), -5, 5)
            s, b = s + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.offset = float(s), float(b)

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, trained: int = TRAINED) -> Model:
    """From at most ``trained`` labelled rows that are not held out: of the ``trained`` ids with the least hash, the rows with the least hash of
    id and text. Rows of null id or label teach nothing; of several labels of an id the least counts, and equal rows of id and text are one."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    named = named.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    ids = table(named.orderBy(F.xxhash64("id"), "id").limit(trained), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    side = F.broadcast(ids) if fits(ids) else ids
    pairs = texts.select("doc_id", "hash").join(side, F.col("doc_id") == F.col("id")).select("id", "y", F.col("hash").alias("of")).distinct()
    pairs = table(pairs.orderBy(F.xxhash64("id", "of"), "id", "of").limit(trained), "chosen")
    chosen = F.broadcast(pairs) if fits(pairs) else pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                rows = [indicator(t.as_py()).astype("<u2").tobytes() for t in c.column(2)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(rows, pa.binary())], ["id", "y", "row"])

    rows = texts.join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("hash") == F.col("of"))).dropDuplicates(["id", "of"])
    rows = rows.select("id", "y", "text").mapInArrow(run, "id long, y int, row binary")
    got = sorted((r["id"], r["y"], bytes(r["row"])) for r in rows.toLocalIterator())
    drop(ids, pairs)
    rng = np.random.default_rng(3).permutation(len(got))
    return Model([np.frombuffer(got[i][2], "<u2").astype(np.int64) for i in rng], np.array([got[i][1] for i in rng], int))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; score is the probability of label 1.

    Null and empty texts have no features and get the score of the bias. Null doc_id is passed on, not held out. Repeated rows get equal
    scores. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                s = np.array([model.score(indicator(t.as_py())) for t in c.column(2)])
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
