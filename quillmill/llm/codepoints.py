"""Arrow text as flat numpy code-point arrays, and back, without a call per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points handled in one go; bounds the memory of a Python worker.
SLICE = 2_000_000


def _utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 byte offsets of its rows; nulls are empty."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def to_codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row (uint32) and the n+1 offsets of the rows."""
    raw, offsets = _utf8(arr)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) == len(raw):
        return codes, offsets
    if len(raw) and not ((raw & 0xC0) != 0x80).sum() == len(codes):  # bytes that aren't UTF-8: row by row
        rows = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, starts[offsets]


def to_arrow(codes: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The string array of flat code points; ``null`` marks rows that are null."""
    codes = np.ascontiguousarray(codes, np.uint32)
    data = codes.tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))
    if null is not None and null.any():
        out = pc.if_else(pa.array(~null), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def slices(lengths: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` in total; a longer row stands alone."""
    start, total = 0, np.concatenate([[0], np.cumsum(lengths)])
    while start < len(lengths):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield start, end
        start = end


def batches(it: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text in ``column`` stays within ``limit`` bytes where rows allow."""
    for batch in it:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, b in slices(size, limit):
            yield batch.slice(a, b - a)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For every flat position the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
