"""Files of a stream that share states, of which Python is called once a share and batch."""

from __future__ import annotations

import math
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stampline.operators.segment import segments
from stampline.streaming import segments as stream

SCHEMA = "file_id long, pos long, word string, start long, end long, last boolean, at timestamp, part int"


def _run(spark, frame, path, name, parts, shares):
    for i in range(parts):
        frame.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    words = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    made = stream.segment_stream(words, idle_seconds=60, shares=shares)
    query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsUpdated"] + p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress]
    return sorted(map(tuple, spark.table(name).collect()), key=repr), states


def test_many_files_in_few_states(spark, tmp_path):
    """Words in any order over three batches, some twice, of files of which one has no id; a call for each share, not for each file."""
    rows = [(f if f else None, pos, "end." if pos == 29 or pos % 7 == 6 else f"w{pos}", 300 * pos + f, 300 * pos + f + 2500 * (pos % 11 == 0) + 200, pos == 29, datetime.fromtimestamp(1000, UTC), 0) for f in range(120) for pos in range(30)]
    words = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((f, n, float(s), float(e), k, t) for f, n, s, e, k, t in segments(words.drop("last", "at", "part"), merge=False).collect()), key=repr)
    sent = words.withColumn("part", F.pmod(F.xxhash64("file_id", "pos"), F.lit(3)).cast("int"))
    sent = sent.unionByName(sent.filter("pos % 5 = 0 and not last and part < 2").withColumn("part", F.lit(2))).orderBy(F.rand(3))
    got, states = _run(spark, sent, str(tmp_path), "files_of_few_states", 3, 4)
    assert len(want) > 500 and got == want and max(states) <= 4


def test_idle_files_leave_their_state(spark, tmp_path):
    """Of three files of one state one is idle when words of another come, and one ends later; the last stays open."""
    row = lambda f, pos, at, part: (f, pos, f"w{pos}", 100 * pos, 100 * pos + 90, False, datetime.fromtimestamp(at, UTC), part)
    rows = [row(1, 0, 1000, 0), row(1, 2, 1000, 0), row(2, 0, 5000, 0), row(3, 0, 5000, 1), row(2, 1, 5000, 1), row(3, 1, 9000, 2)]
    got, _ = _run(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path), "files_of_one_state", 3, 1)
    assert got == [(1, 0, 0.0, 290.0, 2, "w0 w2"), (2, 0, 0.0, 190.0, 2, "w0 w1")]


@pytest.mark.parametrize("dealt", [1, 3])
def test_packed_words_lose_nothing(dealt):
    times = [0.1, -5e-324, math.inf, -1e308, 3.5, math.nan, 2.0**60, 0.0]
    n = len(times)
    columns = [[k % dealt for k in range(n)], ["7", "7", None, "", "8", "7", None, None], [0, 2**62, -(2**63), 2**63 - 1, 5, 6, 7, 8], times, times[::-1], [f"é{k}" for k in range(n)], [math.nan] * n, [k % 2 == 0 for k in range(n)], [False] * n, [None, *range(1, n)]]
    types = [pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.timestamp("us", "UTC")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["share", *stream._WORDS])
    made = [r for b in stream._packed(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [r["share"] for r in made] == list(range(dealt)) and made[-1]["at"] is not None
    got = [(f, p, *said) for r in made for f, p, said in zip(*stream._unpacked(r["words"])[:3], strict=True)]
    want = [(columns[1][k], columns[2][k], columns[5][k], math.nan, times[k], times[::-1][k], k % 2 == 0) for share in range(dealt) for k in range(share, n, dealt)]
    assert repr(got) == repr(want)
