"""Best-fit packing with certified partitions: dual-feasible functions bound the sequences of each partition from below; partitions
above their bound exchange documents and run best-fit decreasing again."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable, Iterator
from string import punctuation
from struct import pack
from types import ModuleType
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tokens of a sequence; pieces that a partition packs by itself; rounds of exchange.
LENGTH, PIECES, ROUNDS = 2048, 20_000, 4
#: Entries of a worker's memory of encoded words.
REMEMBERED = 700_000


# The form of a tokenizer whose chunks between white space can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_FORM = (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}, None)


def letters(word: str) -> str | None:
    """The normalised word if it is one pre-token of letters, else None. It is judged by what is left of it: a capital may become a letter and a
    mark. Only letters below U+0530 count, on which all versions of Unicode that are in use agree."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    word = normalize("NFC", word)
    # lower() looks around a final sigma, the tokenizer doesn't
    word = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)
    return word if word.isalpha() and max(word) < "\u0530" else None


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes. A tokenizer of the form above never joins characters across white space, so the
    white-space-separated chunks of a text are encoded one by one and remembered; the ids equal those of the whole text. With a
    tokenizer of another form, whole texts are encoded."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        form = json.loads(self.tokenizer.to_str())
        special = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in form["added_tokens"])
        self.by_chunk = special and (form["normalizer"], form["pre_tokenizer"], form["truncation"]) == _FORM
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token of letters, normalised, straight through the merges."""
        if word in self:
            return self[word]
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))]
        self[word] = ids = pack(f"<{len(ids)}I", *ids)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a chunk that is not known. Words of letters take the short way; with ASCII punctuation after them they are two pre-tokens."""
        if (word := letters(chunk)) is not None:
            ids = self._word(word)
        else:
            stem = chunk.rstrip(punctuation)
            word = letters(stem) if stem and stem != chunk else None
            ids = self._word(word) + self[chunk[len(stem) :]] if word else self._ids([chunk])[0]
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._ids(texts)
        if len(self) > REMEMBERED:
            self.clear()
        # x1C to x1F are white space for str.split() and not for the tokenizer
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        # the special tokens' own strings are found before lower-casing
        chunks = [[] if o else t.lower().split() if t.isascii() and "<|" not in t else t.split() for t, o in zip(texts, odd, strict=True)]
        return [self._ids([t])[0] if o else b"".join(map(self.__getitem__, c)) for t, c, o in zip(texts, chunks, odd, strict=True)]


def encoder(file: str) -> Encoder:
    """The encoder of this process, so that what one task of a worker has learned serves the next ones. It is held by a module of the
    interpreter, as functions that travel by value bring new globals with each task."""
    held = sys.modules.setdefault("_stampline_encoders", ModuleType("_stampline_encoders")).__dict__
    if file not in held:
        held[file] = Encoder(file)
    return held[file]


def pieces(docs: DataFrame, file: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id 0, cut into pieces of ``length`` only if longer.
    Null text counts as empty and is one piece, the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(file)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(b.column(0).to_pylist(), known.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        for o, x in zip(out, (doc_id, k, at // 4, len(part) // 4, crc32(part)), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, kind) for o, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size. The open bins are kept by their free space, and an integer's bits tell which spaces there are."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = there >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                there &= ~(1 << space)
        else:
            space, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - space
        if space > s:
            free[space - s].append(b)
            there |= 1 << (space - s)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int = LENGTH) -> int:
    """The largest of the bounds that dual-feasible functions give: the sizes themselves, the threshold functions (sizes over
    capacity - a count as the whole capacity, sizes under a as nothing), and the rounding functions u_k."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    total = int((n * x).sum())
    best = -(-total // capacity)
    upto_n, upto_s = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * x)]
    a = np.arange(0, capacity // 2 + 1)
    large = upto_n[-1] - upto_n[capacity - a + 1]
    middle = upto_s[capacity - a + 1] - upto_s[a]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max()))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        u = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # k times u_k
        best = max(best, int(-(-(n * u).sum() // (k * capacity))))
    return best


def _packer(capacity: int, r: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one partition of round r; what is open goes to the next round, and nothing is in the last."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        open_ = np.zeros(len(used), bool)
        if not last:
            if len(used) > lower_bound(sizes, capacity):
                open_ = used < capacity
            elif used.min() < capacity:
                open_[used.argmin()] = True
        part = int(pdf["part"].iloc[0])
        return pdf.drop(columns="part").assign(sequence_id=(np.int64(r) << 58) + (np.int64(part) << 24) + bins, offset=offsets, open=open_[bins])

    return run


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def pack_pieces(pieces_: DataFrame, capacity: int = LENGTH, per_partition: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces are dealt by a hash into partitions of about ``per_partition``; each runs best-fit
    decreasing and compares its sequences with its lower bound. A certified partition releases only its emptiest
    sequence, one with a gap all sequences that are not full; what is released is dealt anew among fewer partitions and
    packed again, at most ``rounds`` times. No partition holds more than its share, whatever the sizes or the ids."""
    todo = pieces_
    done = []
    for r in range(rounds):
        n = todo.count()
        if not n and r:
            break
        parts = max(1, -(-n // per_partition))
        last = r == rounds - 1 or parts == 1 and r > 0

        part = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(r)), F.lit(parts)).alias("part")
        dealt = todo.select("doc_id", "piece", "start", "length", "ids_crc32", part)
        packed = table(dealt.groupBy("part").applyInPandas(_packer(capacity, r, last), _SCHEMA), "packed")
        done.append(packed.filter("not open").drop("open"))
        todo = packed.filter("open").select("doc_id", "piece", "start", "length", "ids_crc32")
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def pack_documents(docs: DataFrame, file: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``.

    file: a tokenizer's JSON file, of any kind. Null and empty texts are one piece of the end id. Null doc_id and repeated rows are packed like any other. Ties are broken by
    id and piece. Other columns are not read; an empty table gives no rows.
    """
    return pack_pieces(table(pieces(docs, file, length), "pieces"), length)
