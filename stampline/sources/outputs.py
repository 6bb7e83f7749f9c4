"""Outputs as one ordered file each: a data source that writes lines to named files, all or none, and one that reads cues and rows back."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files that one task of the reader takes.
TOGETHER = 64
_TIME = re.compile(r"(\d+):(\d\d):(\d\d),(\d{3}) --> (\d+):(\d\d):(\d\d),(\d{3})\s*\Z")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local or mounted one."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    #: (name while it is written, name when it is done)
    files: list[tuple[str, str]]


class OrderedWriter(DataSourceWriter):
    """All attempts write into one hidden folder of this write, which the driver makes; the commit moves what committed attempts have, one rename a file. After
    it, and after a failure, the folder goes with all that is in it, also what tasks left that were killed or are still running: they make no folder, so
    nothing of theirs can come after that."""

    def __init__(self, path: str) -> None:
        self.path, self.stage = path.rstrip("/"), f".{uuid.uuid4().hex}.part"
        store, top = _store(self.path)
        store.create_dir(f"{top}/{self.stage}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        store, top = _store(self.path)
        files: list[tuple[str, str]] = []
        now, out = None, None
        try:
            for name, value in rows:
                if name != now:
                    if not name or "/" in name or name in (".", ".."):
                        raise ValueError(f"no name of a file: {name!r}")
                    if out:
                        out.close()
                    now, begun = name, f"{top}/{self.stage}/{uuid.uuid4().hex}"
                    files.append((begun, f"{top}/{name}"))
                    out = store.open_output_stream(begun)
                out.write(((value or "") + "\n").encode("utf-8", "surrogatepass"))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for begun, done in message.files if message else []:
                store.move(begun, done)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, top = _store(self.path)
        try:
            store.delete_dir(f"{top}/{self.stage}")
        except OSError:  # a task may put a file there while the rest is deleted
            store.delete_dir(f"{top}/{self.stage}")


class OrderedFiles(DataSource):
    """Writes (name, value): the values of a name, in the order in which its task has them, are the lines of the file of that name under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(self.options["path"])


def srt_cues(lines: Iterator[str]) -> Iterator[tuple[int, int, int, str]]:
    """(number, start, end, text) of the cues in the lines of an SRT file, times in ms. A cue begins with a number and a line of times; its text may have
    several lines, also blank ones, and ends before the blank line that the next cue follows."""
    held: str | None = None
    cue: list | None = None
    text: list[str] = []

    def done() -> tuple:
        return (*cue, "\n".join(text[:-1] if len(text) > 1 and not text[-1] else text))

    for line in lines:
        line = line.removesuffix("\n")
        found = _TIME.match(line) if held is not None and held.isdecimal() else None
        if found:
            if cue:
                yield done()
            h, m, s, ms, h2, m2, s2, ms2 = map(int, found.groups())
            cue, text, held = [int(held), ((h * 60 + m) * 60 + s) * 1000 + ms, ((h2 * 60 + m2) * 60 + s2) * 1000 + ms2], [], None
            continue
        if held is not None:
            text.append(held)
        held = line
    if held is not None:
        text.append(held)
    if cue:
        yield done()


def csv_rows(lines: Iterator[str]) -> Iterator[tuple[str | None, int, int, int, str]]:
    """(file, number, start, end, text) of the rows of a CSV file, of one file or of a batch, times in ms."""
    rows = csv.reader(lines)
    head = next(rows, [])
    at = {c: i for i, c in enumerate(head)}
    ms = lambda t: int(t.replace(".", ""))  # noqa: E731  three digits are always written
    for no, row in enumerate(rows, 1):
        yield row[at["file"]] if "file" in at else None, no, ms(row[at["start_time"]]), ms(row[at["end_time"]]), row[at["text"]]


@dataclass
class _Some(InputPartition):
    paths: list[str]


class CueReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[_Some]:
        store, top = _store(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".srt", ".csv")) and not f.base_name.startswith((".", "_")))
        return [_Some(paths[i : i + TOGETHER]) for i in range(0, len(paths), TOGETHER)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            # lines are split at \n alone, as they are written
            with io.TextIOWrapper(store.open_input_file(path), "utf-8", "surrogatepass", newline="\n") as lines:
                if path.endswith(".srt"):
                    for no, start, end, text in srt_cues(lines):
                        yield name, None, no, start, end, text
                else:
                    for file, no, start, end, text in csv_rows(lines):
                        yield name, file, no, start, end, text


class CueFiles(DataSource):
    """Reads the SRT and CSV files under ``path``: output (name of the file), file (its column, where it has one), no, start, end (ms), text. Several files
    share a task, one is never split, and is read line by line."""

    @classmethod
    def name(cls) -> str:
        return "cue_files"

    def schema(self) -> str:
        return "output string, file string, no int, start long, end long, text string"

    def reader(self, schema: StructType) -> CueReader:
        return CueReader(self.options["path"])


def write_files(rows: DataFrame, name: str, order: list[str], value: str, path: str) -> None:
    """Write ``rows`` as one file for each value of the column ``name`` under ``path``, its lines by ``order``. Files of those names are replaced, others stay. A
    file is written by one task, row by row, so only its length bounds how long that takes; rows without a name raise."""
    spark = rows.sparkSession
    spark.dataSource.register(OrderedFiles)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), name).sortWithinPartitions(name, *order)
    dealt.select(F.col(name).alias("name"), F.col(value).cast("string").alias("value")).write.format("ordered_files").mode("append").option("path", path).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CueFiles)
    return spark.read.format("cue_files").option("path", path).load()
