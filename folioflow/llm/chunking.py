"""Splitting oversized items at natural boundaries.

Method: content-defined chunking. A hash rolling over the last code points marks landmarks; within the minimum
and maximum size a piece ends at the natural boundary nearest to its first landmark. Since landmarks depend on
the text around them only, an edit changes the pieces next to it and the later cuts fall into place again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at


@dataclass(frozen=True)
class ChunkConfig:
    """Limits of a piece and how consecutive pieces overlap."""

    max_words: int = 300
    max_chars: int = 2000
    overlap_words: int = 20
    overlap_chars: int = 100
    min_share: float = 0.4  # a piece that isn't the last reaches this share of the limit it ends at
    window: int = 24  # code points under the rolling hash
    landmark_bits: int = 5  # one cut in 2**bits is a landmark

    def __post_init__(self) -> None:
        if min(self.max_words, self.max_chars, self.window) < 1 or not 0 <= self.min_share < 1:
            raise ValueError("limits must be positive and min_share in [0, 1)")
        if not 0 <= 2 * self.overlap_words < self.max_words or not 0 <= 2 * self.overlap_chars < self.max_chars:
            raise ValueError("an overlap must be less than half its limit")


#: Marks that end a sentence or a clause, and marks that may close after them.
SENTENCE_MARKS = tuple(map(ord, ".!?؟۔؛।॥。！？．｡…"))
CLAUSE_MARKS = tuple(map(ord, ",;:،、，；："))
CLOSERS = tuple(map(ord, "\"'”’»)]}」』）】"))

INSIDE, PLAIN, CLAUSE, LINE, SENTENCE, BLANK = 0, 1, 2, 3, 4, 5


def rolling_hash(cp: np.ndarray, window: int) -> np.ndarray:
    """A hash of the ``window`` code points before each position (position k: those before code point k)."""
    mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(cp) + 1, np.uint64)
    power = np.uint64(1)
    for k in range(window):
        out[k + 1 :] += mixed[: len(cp) - k] * power
        power = np.uint64((int(power) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    out ^= out >> np.uint64(32)
    return (out * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(16)


def boundaries(cp: np.ndarray, max_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the text may be cut (before that code point), rising, and the rank of each.

    A cut lies before a word, or inside a run without spaces that is itself near the limit.
    """
    n = len(cp)
    white = at.is_space(cp)
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    ends = np.flatnonzero(~white & np.concatenate((white[1:], [True]))) + 1
    rank = np.full(n + 1, -1, np.int8)
    if len(starts) > 1:
        line = at.flag_table(at.LINE_ENDS)[cp]
        line &= ~np.concatenate(([False], (cp[:-1] == 13) & (cp[1:] == 10)))  # CR LF is one line end
        seen = np.concatenate(([0], np.cumsum(line)))
        breaks = seen[starts[1:]] - seen[ends[:-1]]
        last = cp[ends[:-1] - 1]
        before = cp[np.maximum(ends[:-1] - 2, 0)]
        closed = at.flag_table(CLOSERS)[last]
        mark = np.where(closed, before, last)
        kind = np.full(len(last), PLAIN, np.int8)
        kind[at.flag_table(CLAUSE_MARKS)[mark]] = CLAUSE
        kind[breaks == 1] = LINE
        kind[at.flag_table(SENTENCE_MARKS)[mark]] = SENTENCE
        kind[breaks > 1] = BLANK
        rank[starts[1:]] = kind
    for a, b in zip(starts[ends - starts > max_chars // 4], ends[ends - starts > max_chars // 4]):
        inner = np.full(b - a - 1, INSIDE, np.int8)
        left = cp[a : b - 1]
        closed = at.flag_table(CLOSERS)[left]
        mark = np.where(closed, np.concatenate((left[:1], left[:-1])), left)
        inner[at.flag_table(CLAUSE_MARKS)[mark]] = CLAUSE
        inner[at.flag_table(SENTENCE_MARKS)[mark]] = SENTENCE
        following = cp[a + 1 : b]
        inner[at.flag_table(CLOSERS)[following]] = INSIDE
        inner[at.classes_of_marks()[following]] = -1
        rank[a + 1 : b] = inner
    where = np.flatnonzero(rank >= 0)
    return where, rank[where]


def pieces_of(cp: np.ndarray, config: ChunkConfig) -> list[tuple[int, int, int, int]]:
    """(start, core start, end, words) of each piece of one text, in order. Cores tile the text."""
    n = len(cp)
    white = at.is_space(cp)
    word_start = ~white & np.concatenate(([True], white[:-1]))
    words = np.concatenate(([0], np.cumsum(word_start)))  # words that begin before a position
    begin = np.flatnonzero(word_start)
    if words[n] <= config.max_words and n <= config.max_chars:
        return [(0, 0, n, int(words[n]))]
    cuts, ranks = boundaries(cp, config.max_chars)
    hashes = rolling_hash(cp, config.window)
    landmark = (hashes[cuts] & np.uint64((1 << config.landmark_bits) - 1)) == 0
    out = []
    start = core = 0
    while True:
        inside = bool(start and not word_start[start] and not white[start])
        spent = int(words[start]) - inside  # a piece that begins inside a word counts that word
        if words[n] - spent <= config.max_words and n - start <= config.max_chars:
            out.append((start, core, n, int(words[n] - spent)))
            return out
        # The last cut for which the piece keeps within both limits.
        by_words = int(begin[spent + config.max_words]) if spent + config.max_words < len(begin) else n
        limit = min(by_words, start + config.max_chars)
        hi = int(np.searchsorted(cuts, limit, "right"))
        lo = int(np.searchsorted(cuts, core, "right"))
        size = limit - core
        least = int(np.searchsorted(cuts, core + max(1, int(size * config.min_share)), "left"))
        lo = least if least < hi else lo
        if lo >= hi:  # one run of marks longer than a piece
            cut = limit
        else:
            cut = int(cuts[_choose(cuts[lo:hi], ranks[lo:hi], hashes, landmark[lo:hi]) + lo])
        out.append((start, core, cut, int(words[cut] - spent)))
        core = cut
        start = _overlap_start(begin, words, cut, start, config)


def _choose(cuts: np.ndarray, ranks: np.ndarray, hashes: np.ndarray, landmark: np.ndarray) -> int:
    natural = np.flatnonzero(ranks >= LINE)
    if not len(natural):
        best = ranks.max()
        natural = np.flatnonzero(ranks == best)
    marks = np.flatnonzero(landmark)
    if len(marks):
        return int(natural[np.argmin(np.abs(cuts[natural] - cuts[marks[0]]))])
    return int(natural[np.argmin(hashes[cuts[natural]])])


def _overlap_start(begin: np.ndarray, words: np.ndarray, cut: int, start: int, config: ChunkConfig) -> int:
    """Where the next piece begins, so that it shares ``overlap_words`` words with the piece that ends at ``cut``,
    or ``overlap_chars`` code points where these words are too long (text without spaces)."""
    known = int(words[cut])
    if known >= config.overlap_words:
        at_word = int(begin[known - config.overlap_words]) if config.overlap_words else cut
        if at_word > start and cut - at_word <= config.max_chars // 2:
            return at_word
    return max(start + 1, cut - config.overlap_chars)


def chunk(
    df: DataFrame, key: str, text: str, config: ChunkConfig = ChunkConfig(), with_text: bool = True
) -> DataFrame:
    """The pieces of each row's ``text``: key, piece_no (from 0), n_pieces, char_start, core_start, char_end,
    n_words, n_chars and, if asked for, piece_text.

    A text within the limits is one piece; null and empty texts are one piece of no words. Texts are cut whole,
    however long; ``core_start .. char_end`` of all pieces tile the text. The text decides, not stored counts.
    Rows with the same key are cut each by itself; other columns are not read.
    """
    fields = [
        df.schema[key],
        *(T.StructField(c, T.IntegerType(), False) for c in ("piece_no", "n_pieces")),
        *(T.StructField(c, T.LongType(), False) for c in ("char_start", "core_start", "char_end")),
        *(T.StructField(c, T.IntegerType(), False) for c in ("n_words", "n_chars")),
    ]
    schema = T.StructType([*fields, *([T.StructField("piece_text", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, [text]):
                cp, off = at.decode(part.column(1))
                lens = np.diff(off)
                n_words = at.segment_sums(at.word_starts(cp, off), off)
                large = np.flatnonzero((n_words > config.max_words) | (lens > config.max_chars))
                cut = {int(k): pieces_of(cp[off[k] : off[k + 1]], config) for k in large}
                count = np.ones(len(lens), np.int64)
                for k, ps in cut.items():
                    count[k] = len(ps)
                row = np.repeat(np.arange(len(lens)), count)
                first = at.offsets_of(count)
                start, core = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                end, words = lens[row].copy(), n_words[row].copy()
                for k, ps in cut.items():
                    place = slice(first[k], first[k + 1])
                    start[place], core[place], end[place], words[place] = np.array(ps, np.int64).T
                arrays = [
                    part.column(0).take(pa.array(row)),
                    pa.array((np.arange(len(row)) - first[row]).astype(np.int32)),
                    pa.array(count[row].astype(np.int32)),
                    pa.array(start), pa.array(core), pa.array(end),
                    pa.array(words.astype(np.int32)), pa.array((end - start).astype(np.int32)),
                ]
                if with_text:
                    length = end - start
                    new = at.offsets_of(length)
                    index = np.repeat(off[row] + start - new[:-1], length) + np.arange(new[-1])
                    valid = at.valid_mask(part.column(1))[row]
                    arrays.append(at.encode(cp[index], new, valid))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def oversized(df: DataFrame, key: str, text: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Keys of the rows that had to be cut."""
    return chunk(df, key, text, config, with_text=False).where("piece_no = 0 AND n_pieces > 1").select(key).distinct()
