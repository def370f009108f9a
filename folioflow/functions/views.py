"""The text views over whole Arrow batches: code points in, code points out, a few table look-ups a batch.

The steps and their order are those of ``normalize``; only texts that canonical composition may change are touched
one by one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from folioflow.functions import arrowtext as at

# What each step of the views treats, as code points.
SPACES = (0xA0, 0x2007, 0x202F)
CONTROLS = (*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0))
FORMATS = (0xAD, 0x61C, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFEFF)
BLANKS = (0x09, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITES = (*BLANKS, 0x0A)
MARKS = (*range(0x64B, 0x653), *range(0x656, 0x660), 0x670, *range(0x6D6, 0x6EE))
HEH_YEH, HEH, HAMZA = 0x6C0, 0x647, 0x654
TATWEEL, ZWNJ, ZWJ = 0x640, 0x200C, 0x200D
LETTERS = {0x64A: 0x6CC, 0x649: 0x6CC, 0x643: 0x6A9}
FOLDED = {0x623: 0x627, 0x625: 0x627, 0x671: 0x627, 0x629: 0x647}
MADDA = {0x622: 0x627}

Rows = tuple[np.ndarray, np.ndarray]


@lru_cache(maxsize=None)
def composing() -> np.ndarray:
    """True for code points that canonical composition may change, move or join with their neighbour."""
    table = np.zeros(0x110000, bool)
    table[0x1160:0x1200] = True  # conjoining letters
    for cp in range(0xC0, 0x110000):
        if 0xAC00 <= cp < 0xE000:
            continue
        c = chr(cp)
        if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c):
            table[cp] = True
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":  # the second of a pair may join the letter before it
            for p in parts.split()[1:]:
                table[int(p, 16)] = True
    return table


@lru_cache(maxsize=None)
def letters(*pairs: tuple[int, int]) -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for a, b in pairs:
        table[a] = b
    return table


def kept(cp: np.ndarray, off: np.ndarray, keep: np.ndarray) -> Rows:
    return (cp, off) if keep.all() else (cp[keep], at.offsets_of(at.segment_sums(keep, off)))


def composed(cp: np.ndarray, off: np.ndarray) -> Rows:
    """Canonical composition of every row."""
    risky = composing()[cp]
    if not risky.any():
        return cp, off
    rows = np.flatnonzero(at.segment_sums(risky, off))
    pieces, sizes, last = [], np.diff(off), 0
    for r in rows:
        text = at.to_str(cp[off[r] : off[r + 1]])
        new = unicodedata.normalize("NFC", text)
        if new != text:
            pieces.append(cp[off[last] : off[r]])
            pieces.append(np.frombuffer(new.encode("utf-32-le", "surrogatepass"), np.uint32))
            sizes[r] = len(new)
            last = r + 1
    if not pieces:
        return cp, off
    pieces.append(cp[off[last] :])
    return np.concatenate(pieces), at.offsets_of(sizes)


def stripped(cp: np.ndarray, off: np.ndarray, blank: np.ndarray, begin: np.ndarray) -> Rows:
    """Drops blank runs at both ends of every stretch; ``begin`` is True at the first element of each."""
    n = len(cp)
    if not n or not blank.any():
        return cp, off
    first = np.flatnonzero(begin)
    stretch = np.cumsum(begin) - 1
    place = np.arange(n)
    head = np.minimum.reduceat(np.where(blank, n, place), first)
    tail = np.maximum.reduceat(np.where(blank, -1, place), first)
    return kept(cp, off, ~blank | (place > head[stretch]) & (place < tail[stretch]))


def trimmed(cp: np.ndarray, off: np.ndarray) -> Rows:
    return stripped(cp, off, at.flag_table(WHITES)[cp], at.row_starts(off, len(cp)))


def squeezed(cp: np.ndarray, off: np.ndarray) -> Rows:
    """White runs become a single space; none stays at the ends."""
    white = at.flag_table(WHITES)[cp]
    if not white.any():
        return cp, off
    again = np.concatenate(([False], white[:-1])) & ~at.row_starts(off, len(cp))
    return trimmed(*kept(np.where(white, np.uint32(0x20), cp), off, ~(white & again)))


def display(cp: np.ndarray, off: np.ndarray) -> Rows:
    """Composition, line ends, spaces and invisible characters; see normalize.normalize_display."""
    if len(cp):
        returns = cp == 0x0D
        if returns.any():
            starts = at.row_starts(off, len(cp))
            pair = returns & np.concatenate((cp[1:] == 0x0A, [False])) & ~np.concatenate((starts[1:], [True]))
            cp, off = kept(np.where(returns, np.uint32(0x0A), cp), off, ~pair)
    cp, off = composed(cp, off)
    if (cp == HEH_YEH).any():
        twice = 1 + (cp == HEH_YEH)
        sizes = at.segment_sums(twice, off)
        cp = np.repeat(cp, twice)
        at_ = np.flatnonzero(cp == HEH_YEH)
        cp[at_[::2]], cp[at_[1::2]] = HEH, HAMZA
        off = at.offsets_of(sizes)
    cp = np.where(at.flag_table(SPACES)[cp], np.uint32(0x20), cp)
    cp, off = kept(cp, off, ~at.flag_table((*CONTROLS, *FORMATS))[cp])
    flat = (cp == 0x20) | (cp == 0x09)
    again = np.concatenate(([False], flat[:-1])) & ~at.row_starts(off, len(cp)) if len(cp) else flat
    cp, off = kept(np.where(flat, np.uint32(0x20), cp), off, ~(flat & again))
    begin = at.row_starts(off, len(cp))
    if len(cp):
        begin = begin | np.concatenate(([False], cp[:-1] == 0x0A)) | (cp == 0x0A)
    return trimmed(*stripped(cp, off, at.flag_table(BLANKS)[cp], begin))


def retrieval(cp: np.ndarray, off: np.ndarray) -> Rows:
    """From the display view; see normalize.retrieval_from_display."""
    digits = ((0x660 + k, 0x30 + k) for k in range(10)), ((0x6F0 + k, 0x30 + k) for k in range(10))
    cp = letters(*LETTERS.items(), *digits[0], *digits[1])[cp]
    cp, off = kept(cp, off, ~at.flag_table((*MARKS, TATWEEL))[cp])
    cp = np.where(cp == ZWNJ, np.uint32(0x20), cp)
    return squeezed(*kept(cp, off, cp != ZWJ))


def alias(cp: np.ndarray, off: np.ndarray, fold_madda: bool = False) -> Rows:
    """From the retrieval view; see normalize.alias_from_retrieval."""
    cp = letters(*FOLDED.items())[cp]
    if len(cp):
        starts = at.row_starts(off, len(cp))
        hamza = (cp == HAMZA) & np.concatenate(([False], cp[:-1] == HEH)) & ~starts
        cp, off = kept(cp, off, ~hamza)
    if fold_madda:
        cp = letters(*MADDA.items())[cp]
    return squeezed(cp, off)


def over(column: pa.Array, *steps) -> pa.Array:
    """The steps one after another over every text of a column, in slices of bounded size; nulls stay null."""
    column = at.as_text(column)
    batch = pa.RecordBatch.from_arrays([column], names=["t"])
    out = []
    for part in at.slices(batch, ["t"]):
        cp, off = at.decode(part.column(0))
        for step in steps:
            cp, off = step(cp, off)
        out.append(at.encode(cp, off, at.valid_mask(part.column(0))))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())
