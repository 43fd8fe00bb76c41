"""Arrow string arrays as flat numpy arrays of code points, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def plain(column: pa.Array) -> pa.Array:
    """The column as a string array with 32-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): row i holds bytes[bounds[i]:bounds[i+1]]. Null rows are empty."""
    column = plain(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    low, high = int(bounds[0]), int(bounds[-1])
    values = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return values, bounds - low


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds). Bytes that are no UTF-8 become U+FFFD."""
    values, bounds = byte_view(column)
    raw = values.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) == len(values):
        return points, bounds
    starts = np.concatenate([[0], np.cumsum((values & 0xC0) != 0x80)])
    return points, starts[bounds]


def to_strings(points: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    """The string array whose row i holds points[bounds[i]:bounds[i+1]], null where `null` is true."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(width)])[bounds].astype(np.int32)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data), valid)


def nulls(column: pa.Array) -> np.ndarray:
    """Which rows are null."""
    return column.is_null().to_numpy(zero_copy_only=False)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s+n) over all (s, n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return first + np.arange(total)


def take_rows(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, new bounds) of the elements of the chosen rows."""
    lengths = bounds[rows + 1] - bounds[rows]
    return ranges(bounds[rows], lengths), np.concatenate([[0], np.cumsum(lengths)])
