"""Evaluation texts leaking into training text.

Method: q-gram lemma filtering. Documents and held-out items are folded to streams of letters and digits; q-grams
that a document shares with an item are counted in overlapping bands of diagonals (document position less item
position). A run of half of an item's words with at most k edits shares at least L - q + 1 - kq of its q-grams
within one band, L being the length of the shortest such run; only bands that reach this are aligned. The alignment
starts from every exact run of q letters and is led on to both sides over the diagonals of the band, letter by letter
equal but for k edits (exchanged, missing or surplus letters); what it covers is measured in whole words. The longest
run without an edit is measured beside it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.functions import arrowtext as at
from folioflow.llm import canonical


@dataclass(frozen=True)
class LeakConfig:
    q: int = 16  # letters of a q-gram
    edits: int = 2  # edit budget of a run
    band: int = 8  # diagonals of a band; bands overlap by half
    share: float = 0.5  # of an item's words in one unbroken run
    hits_at_once: int = 2_000_000  # shared q-grams that are spelled out together
    max_items: int = 100_000  # the held-out set goes to every worker; a larger one is refused


@lru_cache(maxsize=None)
def fold_table() -> canonical.Gather:
    """The consistent form, lower case, without marks; all but letters and digits vanish."""
    import unicodedata

    unite = canonical.settled_unite()
    rules: dict[int, tuple[int, ...]] = {}
    for cp in range(canonical.TABLE_END):
        if 0xD800 <= cp < 0xE000:
            continue
        n = unite.length[cp]
        seq = (int(unite.single[cp]),) if n == 1 else tuple(int(x) for x in unite.data[unite.start[cp] : unite.start[cp] + n]) if n else ()
        out: list[int] = []
        for x in seq:
            for ch in unicodedata.normalize("NFD", chr(x).casefold()):
                kind = unicodedata.category(ch)
                if kind[0] in "LN" or kind == "Mc":
                    out.append(ord("آ") if ch == "آ" else ord(ch))
        if tuple(out) != (cp,):
            rules[cp] = tuple(out)
    return canonical.Gather(rules)


#: Page and milestone markers, which stand within the running text.
MARKERS = re.compile(r"PageV\d+P\d+|(?<![^\W_])ms\d+(?![^\W_])", re.I)


def fold(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of every row in folded form, without inline markers."""
    gone = None
    for m in MARKERS.finditer(at.to_str(cp)) if (cp == ord("m")).any() or (cp == ord("P")).any() else ():
        a, b = m.span()
        if np.searchsorted(off, a, "right") == np.searchsorted(off, b - 1, "right"):  # within one row
            gone = np.ones(len(cp), bool) if gone is None else gone
            gone[a:b] = False
    if gone is not None:
        cp, off = cp[gone], at.offsets_of(at.segment_sums(gone, off))
    return fold_table()(cp, off)


def gram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points from each position on; ``len(cp) - q + 1`` values."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: the hash of 2w code points from that of w.
    h = (cp.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    size, power = 1, 0xD6E8FEB86659FD93
    out, done = None, 0
    while size <= q:
        if q & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += size
        if size * 2 <= q:
            h = h[: len(h) - size] * np.uint64(power) + h[size:]
        power = (power * power + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF | 1
        size *= 2
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xFF51AFD7ED558CCD)


@dataclass
class Items:
    """Folded held-out items: streams, word of every letter, needs, and an index of their q-grams."""

    q: int
    ids: list
    cp: np.ndarray
    off: np.ndarray
    word: np.ndarray  # number of the word of every letter, within its item
    n_words: np.ndarray
    need: np.ndarray  # words of a run that counts
    least: np.ndarray  # q-grams that a band must share
    edits: np.ndarray  # edits that this bound allows for
    grams: np.ndarray  # sorted hashes
    place: np.ndarray  # letter at which each begins
    table: np.ndarray  # bits of hashes that occur

    BITS = 22


def prepare(rows: list[tuple], config: LeakConfig) -> list[Items]:
    """rows: (id, text). Items without a letter are left out; items of which a run that counts may be shorter than q
    letters are indexed by shorter q-grams, as a group of their own."""
    groups: dict[int, list[tuple]] = {}
    for item, text in rows:
        parts = (text or "").split()
        cp, off = fold(*at.decode(pa.array(parts, pa.string())))
        size = np.diff(off)
        split = []  # a letter of a script without spaces is a word of its own
        count = 0
        for k in range(len(parts)):
            if size[k] == 0:
                continue
            one = cp[off[k] : off[k + 1]]
            if ((one >= 0x3040) & (one < 0xA000)).any():
                split.append(count + np.arange(size[k]))
                count += int(size[k])
            else:
                split.append(np.full(size[k], count))
                count += 1
        if count:
            word = np.concatenate(split)
            need = math.ceil(config.share * count - 1e-9)
            total = np.concatenate(([0], np.cumsum(np.bincount(word))))
            shortest = int((total[need:] - total[: len(total) - need]).min())
            q = config.q
            while q > max(1, shortest):
                q //= 2
            groups.setdefault(q, []).append((item, cp, word, need, shortest))
    return [_indexed(q, members, config) for q, members in sorted(groups.items())]


def _indexed(q: int, members: list[tuple], config: LeakConfig) -> Items:
    kept = [m[0] for m in members]
    streams = [m[1] for m in members]
    words = [m[2] for m in members]
    off = at.offsets_of(np.array([len(s) for s in streams], np.int64))
    n_words = np.array([int(w[-1]) + 1 for w in words], np.int64)
    need = np.array([m[3] for m in members], np.int64)
    least, allowed = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
    hashes, place = [], []
    for k, stream in enumerate(streams):
        grams = members[k][4] - q + 1  # q-grams of the shortest run that counts
        edits = max(0, min(config.edits, (grams - 1) // q))
        least[k] = max(1, grams - edits * q)
        allowed[k] = edits
        h = gram_hashes(stream, q)
        hashes.append(h)
        place.append(off[k] + np.arange(len(h)))
    grams, where = np.concatenate(hashes), np.concatenate(place)
    order = np.argsort(grams, kind="stable")
    table = np.zeros(1 << Items.BITS, bool)
    table[(grams >> np.uint64(64 - Items.BITS)).astype(np.int64)] = True
    return Items(q, kept, np.concatenate(streams), off, np.concatenate(words), n_words, need, least, allowed, grams[order], where[order], table)


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def hits(cp: np.ndarray, off: np.ndarray, items: Items, limit: int) -> Iterator[Hits]:
    """(document position, item position, document) of every shared q-gram; q-grams don't cross documents.

    A q-gram that many items hold meets them all, so what is spelled out at a time is bounded: whole documents of
    together about ``limit`` hits.
    """
    h = gram_hashes(cp, items.q)
    if not len(h) or not len(items.grams):
        return
    maybe = np.flatnonzero(items.table[(h >> np.uint64(64 - Items.BITS)).astype(np.int64)])
    lo = np.searchsorted(items.grams, h[maybe], "left")
    hi = np.searchsorted(items.grams, h[maybe], "right")
    doc = np.searchsorted(off, maybe, "right") - 1
    real = (hi > lo) & (maybe + items.q <= off[doc + 1])
    maybe, lo, count, doc = maybe[real], lo[real], (hi - lo)[real], doc[real]
    total = np.cumsum(count)
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else np.zeros(0, np.int64)
    a = 0
    while a < len(doc):
        within = ends[(ends > a) & (total[ends - 1] <= (total[a - 1] if a else 0) + limit)]
        b = int(within[-1]) if len(within) else int(ends[np.searchsorted(ends, a, "right")])
        n = count[a:b]
        pick = np.repeat(lo[a:b] - at.offsets_of(n)[:-1], n) + np.arange(n.sum())
        yield np.repeat(maybe[a:b], n), items.place[pick], np.repeat(doc[a:b], n)
        a = b


def bands(pos: np.ndarray, place: np.ndarray, doc: np.ndarray, items: Items, config: LeakConfig) -> list[tuple[int, int, int, int, int]]:
    """(document, item, lowest diagonal, first and last document position) of the bands that reach their item's bound.

    Every diagonal is in two bands, so a run with few edits is whole in one of them.
    """
    if not len(pos):
        return []
    item = np.searchsorted(items.off, place, "right") - 1
    diagonal = pos - place
    half = max(1, config.band // 2)
    keys = []
    for shift in (0, half):
        keys.append(np.stack([doc, item, (diagonal + shift) // config.band * config.band - shift], 1))
    key = np.concatenate(keys)
    both = np.concatenate((pos, pos))
    order = np.lexsort((both, key[:, 2], key[:, 1], key[:, 0]))
    key, both = key[order], both[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
    last = np.append(first[1:], len(key)) - 1
    enough = last - first + 1 >= items.least[key[first, 1]]
    return [(*map(int, key[a]), int(both[a]), int(both[b])) for a, b in zip(first[enough], last[enough])]


@dataclass(frozen=True)
class Aligned:
    exact: int  # words of the longest run without an edit
    words: int  # words that the best alignment covers
    edits: int  # and its edits


def _whole_words(word: np.ndarray, a: int, b: int) -> int:
    """Words that lie wholly within letters a to b of an item."""
    if b <= a:
        return 0
    first = word[a] + (a > 0 and word[a - 1] == word[a])
    last = word[b - 1] - (b < len(word) and word[b] == word[b - 1])
    return max(0, int(last - first) + 1)


def banded_alignment(cp: np.ndarray, begin: int, end: int, item: int, low: int, items: Items, config: LeakConfig) -> Aligned:
    """The best alignment of an item with the document positions from ``begin`` to ``end`` within a band of diagonals."""
    a, b = items.off[item], items.off[item + 1]
    text, word, k = items.cp[a:b], items.word[a:b], int(items.edits[item])
    n, width = len(text), config.band
    at_ = np.arange(n)[None, :] + (np.arange(low, low + width) + a)[:, None]  # document position of each item letter
    inside = (at_ >= begin) & (at_ < end)
    same = inside & (cp[np.clip(at_, 0, len(cp) - 1)] == text[None, :])
    # Equal letters from each place on to the right and to the left.
    place = np.arange(n)[None, :]
    stop = np.minimum.accumulate(np.where(same, n, place)[:, ::-1], axis=1)[:, ::-1]
    right = np.concatenate((stop - place, np.zeros((width, 1), np.int64)), 1)
    stop = np.maximum.accumulate(np.where(same, -1, place), axis=1)
    left = np.concatenate((np.zeros((width, 1), np.int64), place - stop), 1)  # of the letters before each place
    starts = same & np.concatenate((np.ones((width, 1), bool), ~same[:, :-1]), 1) & (right[:, :-1] >= items.q)
    best = Aligned(0, 0, 0)
    for d, s in zip(*map(np.ndarray.tolist, np.nonzero(starts))):
        e = s + int(right[d, s])
        exact = _whole_words(word, s, e)
        ends, begins = _reach(d, e, 1, right, n, width, k), _reach(d, s, -1, left, n, width, k)
        found = max((_whole_words(word, begins[j], ends[i]), -i - j) for j in range(k + 1) for i in range(k + 1 - j))
        best = Aligned(max(best.exact, exact), *max((best.words, -best.edits), found))
        best = Aligned(best.exact, best.words, abs(best.edits))
    return best


def _reach(diagonal: int, start: int, step: int, run: np.ndarray, n: int, width: int, edits: int) -> list[int]:
    """The furthest letter of the item that is reached from a place with 0, 1, ... edits, going right or left."""
    front = {diagonal: start}
    out = [start]
    for _ in range(edits):
        following: dict[int, int] = {}
        for d, i in front.items():
            # A letter exchanged, a surplus letter of the document, a letter of the item missing.
            for d2, i2 in ((d, i + step), (d + step, i), (d - step, i + step)):
                if 0 <= d2 < width and 0 <= i2 <= n:
                    i2 += step * int(run[d2, i2])
                    if d2 not in following or step * i2 > step * following[d2]:
                        following[d2] = i2
        front = following
        out.append(max(front.values(), default=out[-1]) if step > 0 else min(front.values(), default=out[-1]))
    return out


def leaks(
    documents: DataFrame, key: str, text: str, held_out: DataFrame, item: str, item_text: str, config: LeakConfig = LeakConfig()
) -> DataFrame:
    """item, key, words (of the longest unbroken run), aligned_words (with at most ``edits`` edits), n_edits and
    item_words for every item of which a document holds a run of at least ``share`` of the words, edits allowed for.

    Case, punctuation, marks, line breaks, spaces, vowel signs, letter variants and invisible differences don't count.
    The held-out set is a stated query set of at most ``max_items`` texts (checked) and goes to every worker; all
    documents are read whole. Null and empty texts match nothing; repeated rows give repeated results.
    """
    rows = held_out.select(item, item_text).distinct().limit(config.max_items + 1).collect()
    if len(rows) > config.max_items:
        raise ValueError(f"more than {config.max_items} held-out items")
    held = prepare(sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[1] or "")), config)
    shared = documents.sparkSession.sparkContext.broadcast(held)
    kind = held_out.schema[item].dataType
    schema = T.StructType([T.StructField(item, kind), documents.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("words", "aligned_words", "n_edits", "item_words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, [text]):
                cp, off = fold(*at.decode(part.column(1)))
                for items in shared.value:
                    found: dict[tuple[int, int], Aligned] = {}
                    for chunk in hits(cp, off, items, config.hits_at_once):
                        for doc, k, low, first, last in bands(*chunk, items, config):
                            slack = config.edits + config.band + items.q * 40
                            begin, end = max(int(off[doc]), first - slack), min(int(off[doc + 1]), last + items.q + slack)
                            n = banded_alignment(cp, begin, end, k, low, items, config)
                            if n.words >= items.need[k]:
                                have = found.get((doc, k), n)
                                better = max(have, n, key=lambda x: (x.words, -x.edits))
                                found[doc, k] = Aligned(max(have.exact, n.exact), better.words, better.edits)
                    if found:
                        docs, ks = np.array(list(found)).T
                        columns = [[getattr(x, c) for x in found.values()] for c in ("exact", "words", "edits")]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([items.ids[k] for k in ks], to_arrow_type(kind)), part.column(0).take(pa.array(docs)),
                                *(pa.array(c, pa.int32()) for c in columns), pa.array(items.n_words[ks].astype(np.int32)),
                            ],
                            names=schema.names,
                        )

    return documents.select(key, text).mapInArrow(run, schema)
