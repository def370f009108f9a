"""Whole-batch text primitives: Arrow string buffers as numpy code-point arrays.

Every helper works on one array for a whole slice of rows (``cp``: code points of all rows one after
another, ``off``: ``n + 1`` row offsets), so the cost per row is a few vector operations and no Python
string is built per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Rows of one slice together hold about so many bytes of text; bounds a worker's memory.
SLICE_BYTES = 1_500_000

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

#: White space that ends a line.
LINE_ENDS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)


def as_text(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without view or dictionary types."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    return col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string array; null rows are empty."""
    col = as_text(col)
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each row; empty rows give 0."""
    n = len(off) - 1
    out = np.zeros(n, np.int64)
    filled = off[1:] > off[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(values, off[:-1][filled], dtype=np.int64)
    return out


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return off


def decode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and row offsets of a string array; null rows are empty."""
    data, boff = byte_view(col)
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    off = offsets_of(segment_sums((data & 0xC0) != 0x80, boff))
    if off[-1] != len(cp):  # malformed bytes: row by row
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(boff[:-1], boff[1:])]
        cp = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        off = offsets_of(np.array([len(r) for r in rows], np.int64))
    return cp, off


def to_str(cp: np.ndarray) -> str:
    return cp.astype("<u4", copy=False).tobytes().decode("utf-32-le", "replace")


def utf8_widths(cp: np.ndarray) -> np.ndarray:
    return (1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.uint8)


def encode(cp: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string array of rows of code points; rows that aren't ``valid`` are null."""
    cp = np.where((cp >= 0xD800) & (cp < 0xE000), np.uint32(0xFFFD), cp) if len(cp) else cp
    data = to_str(cp).encode("utf-8")
    boff = offsets_of(segment_sums(utf8_widths(cp), off))
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    arr = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(boff.tobytes()), pa.py_buffer(data), mask)
    return arr.cast(pa.string())


def slices(batch: pa.RecordBatch, text_columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``limit`` bytes of text (a longer row stands alone)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.zeros(n, np.int64)
    for c in text_columns:
        sizes += np.diff(byte_view(batch.column(batch.schema.get_field_index(c)))[1])
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def valid_mask(col: pa.Array) -> np.ndarray:
    return np.asarray(col.is_valid().to_numpy(zero_copy_only=False), bool)


@lru_cache(maxsize=None)
def flag_table(code_points: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[list(code_points)] = True
    return table


def is_space(cp: np.ndarray) -> np.ndarray:
    return flag_table(WHITE_SPACE)[cp]


def row_starts(off: np.ndarray, size: int) -> np.ndarray:
    """True at the first element of each row."""
    first = np.zeros(size + 1, bool)
    first[off[:-1]] = True
    return first[:size]


def word_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True where a run of non-space begins within its row."""
    black = ~is_space(cp)
    before = np.empty_like(black)
    if len(black):
        before[0] = False
        before[1:] = black[:-1]
    return black & (~before | row_starts(off, len(cp)))


@lru_cache(maxsize=None)
def classes_of_marks() -> np.ndarray:
    """True for combining marks, joiners and other code points that must not begin a piece of text."""
    import unicodedata

    table = np.zeros(0x110000, bool)
    for cp in (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)):
        if unicodedata.category(chr(cp)) in ("Mn", "Mc", "Me", "Cf"):
            table[cp] = True
    return table
