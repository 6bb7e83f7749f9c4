"""Token ids as flat files that can be memory-mapped: a file of unsigned integers and a file of 64-bit document offsets for each shard.

Documents are dealt by ranges of their id, so a shard holds consecutive documents and writes them as they come. What a shard knows are its
own offsets; where it begins in the whole follows from prefix sums over the shards' sizes, one row a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folder, table
from .packing import encoder

# The index file is a head, n + 1 offsets in ids (unsigned, 64 bits), n document ids (signed, 64 bits) and n bytes that are 1
# where the id is not null; all little-endian. The other file is ids and nothing else.
MAGIC, VERSION = b"STAMPIDS", 1
HEAD = np.dtype([("magic", "S8"), ("version", "<u4"), ("width", "<u4"), ("docs", "<u8"), ("ids", "<u8")])
#: Documents that one row of the reader's plan covers, and bytes of ids in one batch of its result.
UNIT, BATCH = 4096, 16 << 20

_SHARD = "shard int, path string, width int, n_docs long, n_ids long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that the cluster gives it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


class Mapped:
    """One shard: ``path``.bin and ``path``.idx, mapped into memory from a local or mounted folder, read by ranges from another store."""

    def __init__(self, path: str) -> None:
        self.store, self.path = _store(path)
        self.head = self._get(".idx", 0, 1, HEAD)[0]
        if self.head["magic"] != MAGIC or self.head["version"] != VERSION:
            raise ValueError(f"{path}.idx is not an index of this version")
        self.kind = np.dtype(f"<u{self.head['width']}")

    def _get(self, suffix: str, at: int, n: int, kind: np.dtype) -> np.ndarray:
        if not n:
            return np.empty(0, kind)
        if isinstance(self.store, fs.LocalFileSystem):
            return np.memmap(self.path + suffix, kind, "r", at, (n,))
        with self.store.open_input_file(self.path + suffix) as f:
            return np.frombuffer(f.read_at(n * kind.itemsize, at), kind)

    def __len__(self) -> int:
        return int(self.head["docs"])

    def offsets(self, low: int, high: int) -> np.ndarray:
        """Where documents ``low`` to ``high`` begin; that of the last one is where the one before it ends."""
        return self._get(".idx", HEAD.itemsize + 8 * low, high - low + 1, np.dtype("<u8"))

    def doc_ids(self, low: int, high: int) -> list[int | None]:
        first = HEAD.itemsize + 8 * (len(self) + 1)
        numbers = self._get(".idx", first + 8 * low, high - low, np.dtype("<i8"))
        known = self._get(".idx", first + 8 * len(self) + low, high - low, np.dtype("u1"))
        return [n if k else None for n, k in zip(numbers.tolist(), known.tolist(), strict=True)]

    def ids(self, low: int, high: int) -> np.ndarray:
        return self._get(".bin", low * self.kind.itemsize, high - low, self.kind)


def _width(file: str, end: int) -> int:
    """Bytes of an id: two where the vocabulary and ``end`` allow it, else four."""
    from tokenizers import Tokenizer

    most = max([end, *Tokenizer.from_file(file).get_vocab(with_added_tokens=True).values()])
    return 2 if most < 1 << 16 else 4


def write(docs: DataFrame, file: str, end: int = 1, where: str | None = None) -> DataFrame:
    """Write the ids of every row of ``docs`` (doc_id, text), each text's ids and then ``end``, and give the shards: shard, path, width, n_docs, n_ids, base
    (ids of all shards before).

    Documents ascend by doc_id, null first; those of one id by the XXH64 of their text, then by where they were read, and they are dealt so,
    too: neither an id that is there very often nor equal rows are gathered. Null text counts as empty. where: a folder that all executors share, or a
    store that pyarrow knows; else one under the shared folder, which goes when the driver ends. Each attempt of a task writes files of its own
    name, and those of the attempt that Spark commits are the shards. An empty table gives none; other columns are not read.

    Texts are encoded after they are dealt, straight into the files: dealing by ranges reads its input twice, which is cheap for texts.
    """
    spark = docs.sparkSession
    width = _width(file, end)
    last = np.array([end], "<u4").tobytes()
    target = _qualified(spark, where or folder(spark, "tokens")).rstrip("/")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "_hash", "_read"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = texts.withColumn("_hash", F.xxhash64("text")).withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(target)
        known = encoder(file)
        out, name, shard, sizes, numbers, valid = None, "", None, [], [], []
        for whole in batches:
            if whole.num_rows and out is None:
                shard = whole.column(2)[0].as_py()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}.bin")
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                ids = [x + last for x in known.encode(b.column(1).to_pylist())]
                out.write(np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes())
                sizes.append(np.array([len(x) // 4 for x in ids], "<u8"))
                numbers.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                valid.append(b.column(0).is_valid().to_numpy(zero_copy_only=False).astype("u1"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(sizes), dtype="<u8")])
        head = np.array([(MAGIC, VERSION, width, len(offsets) - 1, offsets[-1])], HEAD)
        with store.open_output_stream(f"{top}/{name}.idx") as index:
            for part in (head, offsets, *numbers, *valid):
                index.write(part.tobytes())
        row = {"shard": [shard], "path": [f"{target}/{name}"], "width": [width], "n_docs": [len(offsets) - 1], "n_ids": [int(offsets[-1])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    shards = table(dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(run, _SHARD), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_ids, ids (little-endian unsigned 32-bit) of every document in ``shards``, as write() gives them, from the files alone. start
    counts the ids of all documents before. The work is dealt by documents, so a large shard is read by many tasks."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low: Column = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(UNIT).cast("long")))
    units = shards.filter("n_docs > 0").select("path", "base", low.alias("low"), "n_docs").withColumn("high", F.least(F.col("low") + UNIT, "n_docs"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.to_pylist():
                shard = Mapped(unit["path"])
                offsets, numbers = shard.offsets(unit["low"], unit["high"]).astype(np.int64), shard.doc_ids(unit["low"], unit["high"])
                at = 0
                while at < len(numbers):
                    # as many documents as a batch holds, and at least one
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH // 4, "right")) - 1)
                    ids = shard.ids(int(offsets[at]), int(offsets[to])).astype("<u4").tobytes()
                    first = int(offsets[at])
                    said = [ids[4 * (i - first) : 4 * (j - first)] for i, j in zip(offsets[at:to].tolist(), offsets[at + 1 : to + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at:to], pa.int64()), pa.array(offsets[at:to] + unit["base"]), pa.array(np.diff(offsets[at : to + 1])), pa.array(said, pa.binary())], schema=schema)
                    at = to

    return units.repartition(parts, "path", "low").select("path", "base", "low", "high").mapInArrow(run, "doc_id long, start long, n_ids long, ids binary")
