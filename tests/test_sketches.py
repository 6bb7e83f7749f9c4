"""Merged sketches against exact statistics, whatever the order of the merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stampline.operators import sketches


def test_merges_keep_their_bounds(spark):
    rng = np.random.default_rng(3)
    texts = [(i, i % 7, " ".join("x" * int(n) + str(int(v)) for n, v in zip(rng.geometric(0.15, 900), rng.integers(0, 30_000, 900), strict=True))) for i in range(60)]
    texts += [(100, 0, None), (101, 1, " \n"), (102, 2, texts[2][2]), (103, None, "lone word")]
    held = sketches.text_sketches(spark.createDataFrame(texts, "k long, g int, text string").repartition(6), "k")
    groups = spark.createDataFrame([(k, g) for k, g, _ in texts], "k long, g int")
    by_group = sketches.merged(held.join(groups, "k"), "g")
    ways = {"at once": sketches.merged(held), "by groups": sketches.merged(by_group), "again": sketches.merged(sketches.merged(by_group))}
    words = [w for _, _, t in texts for w in (t or "").split()]
    lengths = np.sort([len(w) for w in words])
    for name, frame in ways.items():
        got = frame.select("n_words", "shortest", "longest", sketches.distinct_words(F.col("distinct")).alias("d"), *(sketches.length_at(F.col("lengths"), q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95))).first()
        assert (got["n_words"], got["shortest"], got["longest"]) == (len(words), lengths[0], lengths[-1]), name
        assert abs(got["d"] - len(set(words))) <= len(set(words)) * sketches.DISTINCT_ERROR, name
        for q in (0.05, 0.5, 0.95):
            at = got[f"q{int(q * 100)}"]
            assert np.searchsorted(lengths, at, "left") / len(lengths) - sketches.RANK_ERROR <= q <= np.searchsorted(lengths, at, "right") / len(lengths) + sketches.RANK_ERROR, (name, q)
    assert {r["k"] for r in held.select("k").collect()} == {k for k, _, t in texts if (t or "").split()}
    assert by_group.filter("g is null").first()["n_words"] == 2
    assert sketches.text_sketches(spark.createDataFrame([], "k long, text string"), "k").count() == 0
