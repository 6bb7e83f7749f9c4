"""Columns of words that lie together as one value, in Arrow's format, so that a shuffle deals few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(columns: list[pa.Array]) -> bytes:
    """Numbers of 64 bits without nulls are there as the differences of their bits, which compress well and lose nothing."""
    names, arrays = [], []
    for k, c in enumerate(columns):
        steps = c.type in (pa.int64(), pa.float64()) and not c.null_count
        names.append(f"{k} {c.type}" if steps else str(k))
        arrays.append(pa.array(np.diff(c.to_numpy().view("int64"), prepend=0)) if steps else c)
    batch, sink = pa.RecordBatch.from_arrays(arrays, names), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> list[pa.Array]:
    batch = pa.ipc.open_stream(packed).read_next_batch()
    back = {"double": "float64", "int64": "int64"}
    return [pa.array(np.cumsum(c.to_numpy()).view(back[name.split()[1]])) if " " in name else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
