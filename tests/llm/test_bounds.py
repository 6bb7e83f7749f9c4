"""Bounds on what is fitted on, letters, the hinge loss, buckets, and the shared folder."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from stampline.llm import common, embeddings, language, quality

SAME = [(7, "one text many times", "en")] * 300
OTHER = [(7, f"text number {i} of a hot id", "en") for i in range(300)] + [(i, f"texte {i} de tous", "fr") for i in range(20, 60)]


@pytest.mark.parametrize("rows", [SAME, OTHER, SAME + OTHER])
def test_fits_are_bounded_in_rows(spark, monkeypatch, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(7, 1), (7, 1)] + [(i, 0) for i in range(20, 60)], "doc_id long, quality int")
    fitted = {}
    monkeypatch.setattr(language, "Model", lambda idf, got, langs: fitted.update(language=langs))
    monkeypatch.setattr(quality, "Model", lambda got, y: fitted.update(quality=list(y)))
    for most in (10, 1000):
        language.fit(frame, most)
        quality.fit(frame, labels, most)
        learned = {r for r in rows if not _held_out(r[0])}
        for lang in {r[2] for r in learned}:
            assert fitted["language"].count(lang) == min(most, sum(r[2] == lang for r in learned))
        assert len(fitted["quality"]) <= most and (most < 1000 or len(fitted["quality"]) == len(learned))


def _held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_letters():
    assert [language.has_letter(t) for t in ("½ ²", "①", "٣", "ª", "É", "12 x", "漢", "_", "", None)] == [False, False, False, True, True, True, True, False, False, False]
    model = language.Model(np.zeros(1 << 14, np.float32), [], [])
    model.names = ["en"]
    assert model.predict("½ ²") == ("und", 0.0)


def test_hinge_loss_is_linear():
    """The duality gap closes: the primal value of the linear hinge loss at w equals the dual value of 0 <= a <= cost."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(120)]
    values = [rng.normal(size=8) for _ in rows]
    sign = np.where(np.array([v.sum() for v in values]) + rng.normal(size=120) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 0.3, 0.8)
    w, bias = quality.dual_coordinate_descent(rows, values, sign, cost, 400)
    x = np.zeros((120, 41))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r], x[i, 40] = v, 1.0
    at = np.r_[w[:40], bias]
    primal = at @ at / 2 + (cost * np.maximum(1 - sign * (x @ at), 0)).sum()
    # w is the sum of a * sign * x, so its dual variables follow by least squares with their bounds
    a = np.clip(np.linalg.lstsq((x * sign[:, None]).T, at, rcond=None)[0], 0, cost)
    best = primal
    for _ in range(20000):
        v = (x * sign[:, None]).T @ a
        a = np.clip(a + 0.01 * (1 - sign * (x @ v)), 0, cost)
    v = (x * sign[:, None]).T @ a
    dual = a.sum() - v @ v / 2
    assert dual <= best + 1e-6 and best - dual < 1e-2 * best


def test_buckets_grow_with_the_largest_label():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.normal(size=x.shape)
    w -= (w * x).sum(1, keepdims=True) * x
    near = 0.98 * x + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    pairs = []
    for size in (100, 2_000, 40_000, 1_000_000, 100_000_000):
        a, b = embeddings.buckets(x, size), embeddings.buckets(near, size)
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.999
    for size in (2_000, 8_000, 32_000):
        z = rng.normal(size=(size, 64))
        _, n = np.unique(embeddings.buckets(z / np.linalg.norm(z, axis=1, keepdims=True), size), return_counts=True)
        pairs.append((n * (n - 1) // 2).sum() / size)
    assert max(pairs) < 4, pairs


def test_shared_folder_is_never_of_one_machine(monkeypatch):
    monkeypatch.delattr(common.shared_dir, "own", raising=False)
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
