"""Visually identical text with different characters: one consistent form for every text column.

Method: Arrow text is copied into numpy code-point arrays; a table gather replaces every code point by its
unified sequence (expansion offsets where one becomes several, none where it is invisible); combining marks
are put in canonical order and composed with their letters by vector lookups. No call is made per row.

The consistent form disregards width and presentation forms, composition, invisible characters, the kind of
space, look-alike letters, and the letter and digit variants which the engine's retrieval and search-alias
views unite. Case, vowel signs, punctuation and line breaks are kept: these can be seen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at
from folioflow.functions.lineage import settle

SPACE, NEWLINE = 0x20, 0x0A
#: Code points from here on are only looked at for the invisible tags and variation selectors of plane 14.
TABLE_END = 0x30000

#: Compatibility tags of the Unicode character database whose members differ in form only.
FORM_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<compat>", "<font>")

#: Default-ignorable code points outside the general category Cf.
IGNORABLE = (
    0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10),
)

#: Format characters that are drawn.
DRAWN_FORMAT = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)

#: Letters of other scripts that look like the Latin letter below them.
LOOK_ALIKE = (
    ("АВСЕНІЈКМОРЅТХУ", "ABCEHIJKMOPSTXY"),
    ("асеһіјорԛѕԝхуѵԁ", "acehijopqswxyvd"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("νορϲϳ", "vopcj"),
    ("ՕՍօոսհ", "OUonuh"),
    ("ᎪᏴᏟᎬᎻᎫᏦᎷᏢᏚᎢᏙ", "ABCEHJKMPSTV"),
)

#: Letter variants united by the retrieval and search-alias views, and look-alikes among Arabic letters.
ARABIC_VARIANTS = (("يىۍې", "یییی"), ("كڪ", "کک"), ("ەہۀ", "ههه"), ("أإٱ", "ااا"), ("ة", "ه"))

HAMZA_ABOVE, HEH, FARSI_YEH, YEH_HAMZA = 0x0654, 0x0647, 0x06CC, 0x0626


def _form(ch: str) -> str:
    """Full decomposition of a character, as far as it changes its form only."""
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch
    rule = unicodedata.decomposition(ch)
    if not rule:
        return ch
    parts = rule.split()
    if parts[0][0] == "<":
        if parts[0] not in FORM_TAGS:
            return ch
        parts = parts[1:]
    out = "".join(_form(chr(int(x, 16))) for x in parts)
    return " " if out.strip() == "" and not any(unicodedata.combining(c) for c in out) else out


def _invisible(cp: int) -> bool:
    ch = chr(cp)
    return (unicodedata.category(ch) == "Cf" and cp not in DRAWN_FORMAT) or cp in IGNORABLE


class Gather:
    """A table from code points to sequences of code points, applied to whole arrays."""

    def __init__(self, rules: dict[int, tuple[int, ...]]) -> None:
        self.single = np.arange(0x110000, dtype=np.uint32)
        self.length = np.ones(0x110000, np.uint8)
        self.start = np.zeros(0x110000, np.int32)
        data: list[int] = []
        for cp, seq in rules.items():
            self.length[cp] = len(seq)
            if len(seq) == 1:
                self.single[cp] = seq[0]
            elif seq:
                self.start[cp] = len(data)
                data += seq
        self.data = np.array(data or [0], np.uint32)

    def __call__(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.length[cp]
        out = self.single[cp]
        if not len(cp) or lens.min() == 1 == lens.max():
            return out, off
        new_off = at.offsets_of(at.segment_sums(lens, off))
        if lens.max() == 1:
            return out[lens == 1], new_off
        ends = np.cumsum(lens, dtype=np.int64)
        source = np.repeat(np.arange(len(cp)), lens)
        res = out[source]
        wide = lens[source] > 1
        at_wide = source[wide]
        inner = np.flatnonzero(wide) - (ends[at_wide] - lens[at_wide])
        res[wide] = self.data[self.start[cp[at_wide]] + inner]
        return res, new_off


@lru_cache(maxsize=None)
def form_table() -> Gather:
    """Width, presentation forms, decomposition, invisible characters and kinds of space."""
    rules: dict[int, tuple[int, ...]] = {}
    for cp in range(TABLE_END):
        if 0xD800 <= cp < 0xE000:
            continue
        if _invisible(cp):
            rules[cp] = ()
        else:
            form = _form(chr(cp))
            seq = tuple(ord(c) for c in form if not _invisible(ord(c)))
            if seq != (cp,):
                rules[cp] = seq
    for cp in at.WHITE_SPACE:
        rules[cp] = (SPACE,)
    for cp in at.LINE_ENDS:
        rules[cp] = (NEWLINE,)
    for cp in range(0x20):
        if cp not in at.WHITE_SPACE:
            rules[cp] = ()
    for cp in range(0x7F, 0xA0):
        if cp not in at.WHITE_SPACE:
            rules[cp] = ()
    for cp in range(0xE0000, 0xE1000):
        rules[cp] = ()
    rules.pop(NEWLINE, None)
    rules.pop(SPACE, None)
    return Gather(rules)


@lru_cache(maxsize=None)
def look_alike_table() -> Gather:
    return Gather({ord(a): (ord(b),) for xs, ys in LOOK_ALIKE for a, b in zip(xs, ys, strict=True)})


@lru_cache(maxsize=None)
def variant_table(tatweel: bool = False) -> Gather:
    """Letter and digit variants; the tatweel, which the retrieval view drops, vanishes unless it is to stay."""
    rules = {ord(a): (ord(b),) for xs, ys in ARABIC_VARIANTS for a, b in zip(xs, ys, strict=True)}
    for zero in (0x0660, 0x06F0):
        rules |= {zero + k: (0x30 + k,) for k in range(10)}
    if not tatweel:
        rules[0x0640] = ()
    return Gather(rules)


@lru_cache(maxsize=None)
def classes() -> np.ndarray:
    """Canonical combining class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x300, TABLE_END):
        if not 0xD800 <= cp < 0xE000 and (c := unicodedata.combining(chr(cp))):
            table[cp] = c
    return table


@lru_cache(maxsize=None)
def pairs() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first << 21 | second) of canonical compositions, and what they compose to."""
    found = {}
    for cp in range(0xC0, TABLE_END):
        if 0xAC00 <= cp < 0xE000:
            continue
        rule = unicodedata.decomposition(chr(cp)).split()
        if len(rule) == 2 and rule[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            found[int(rule[0], 16) << 21 | int(rule[1], 16)] = cp
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([found[int(k)] for k in keys], np.uint32)


def composed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What each pair composes to, 0 if nothing."""
    keys, values = pairs()
    key = first.astype(np.uint64) << np.uint64(21) | second.astype(np.uint64)
    at_ = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out = np.where(keys[at_] == key, values[at_], np.uint32(0))
    lead, vowel = first.astype(np.int64) - 0x1100, second.astype(np.int64) - 0x1161
    lv = (lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21)
    syllable, tail = first.astype(np.int64) - 0xAC00, second.astype(np.int64) - 0x11A7
    lvt = (syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28)
    out = np.where(lv, 0xAC00 + (lead * 21 + vowel) * 28, out)
    return np.where(lvt, first + tail, out).astype(np.uint32)


def compose(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders marks by combining class and composes them with their letters, all rows at once."""
    n = len(cp)
    if n == 0:
        return cp, off
    ccc = classes()[cp]
    marked = ccc > 0
    starts = at.row_starts(off, n)
    keep = np.ones(n, bool)
    if marked.any():
        # Marks in canonical order: stable sort within each run of marks.
        unordered = marked[1:] & marked[:-1] & (ccc[1:] < ccc[:-1]) & ~starts[1:]
        if unordered.any():
            run = np.cumsum(~marked | starts)
            where = np.flatnonzero(marked)
            order = np.lexsort((np.arange(len(where)), ccc[where], run[where]))
            cp, ccc = cp.copy(), ccc.copy()
            cp[where], ccc[where] = cp[where][order], ccc[where][order]
        else:
            cp = cp.copy()
        index = np.arange(n)
        anchor = np.maximum.accumulate(np.where(~marked | starts, index, 0))
        rank = index - anchor
        last = np.zeros(n, np.uint8)  # class of the last mark that stayed, by anchor
        for r in range(1, int(rank.max()) + 1):
            here = np.flatnonzero(rank == r)
            to = anchor[here]
            out = composed(cp[to], cp[here])
            joins = (out > 0) & (last[to] < ccc[here]) & ~marked[to]
            cp[to[joins]] = out[joins]
            keep[here[joins]] = False
            stays = here[~joins]
            last[anchor[stays]] = ccc[stays]
    # Two letters that compose (some Indic vowels, Hangul) when they are next to each other.
    for _ in range(2):
        left = np.flatnonzero(keep)
        if len(left) < 2:
            break
        a, b = left[:-1], left[1:]
        second = cp[b]
        possible = (classes()[second] == 0) & (second >= 0x0900) & (second < 0x3100) & (row_of(off, b) == row_of(off, a))
        if not possible.any():
            break
        a, b = a[possible], b[possible]
        out = composed(cp[a], cp[b])
        hit = out > 0
        if not hit.any():
            break
        cp = cp.copy()
        cp[a[hit]] = out[hit]
        keep[b[hit]] = False
    if keep.all():
        return cp, off
    return cp[keep], at.offsets_of(at.segment_sums(keep, off))


def row_of(off: np.ndarray, index: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, index, "right")


def squeeze(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of white space become a space, a line break or a blank line; none stays at the ends of a row."""
    n = len(cp)
    if n == 0:
        return cp, off
    breaks = cp == NEWLINE
    white = breaks | (cp == SPACE)
    starts = at.row_starts(off, n)
    loose = white & np.concatenate(([True], white[:-1]))
    blank = breaks[1:] & breaks[:-1] & np.concatenate(([True], ~white[:-2] | starts[1:-1]))
    loose[1:] &= ~blank
    filled = off[1:] > off[:-1]
    ends = np.zeros(n, bool)
    ends[off[1:][filled] - 1] = True
    return by_rows(rows_with(loose | white & (starts | ends), off), cp, off, _squeeze, lambda c, o: (c, o))


def _squeeze(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(cp)
    white = (cp == SPACE) | (cp == NEWLINE)
    starts = at.row_starts(off, n)
    opens = white & (np.concatenate(([True], ~white[:-1])) | starts)
    first = np.flatnonzero(opens)
    if not len(first):
        return cp, off
    where = np.flatnonzero(white)
    run = np.cumsum(opens[where]) - 1
    lines = np.bincount(run, weights=cp[where] == NEWLINE, minlength=len(first)).astype(np.int64)
    size = np.bincount(run, minlength=len(first))
    ends = np.isin(first + size, off[1:])
    keep = ~white
    cp = cp.copy()
    inner = ~(starts[first] | ends)
    kept, lines = first[inner], lines[inner]
    cp[kept] = np.where(lines > 0, NEWLINE, SPACE)
    keep[kept] = True
    second = kept[lines > 1] + 1
    cp[second] = NEWLINE
    keep[second] = True
    return cp[keep], at.offsets_of(at.segment_sums(keep, off))


@lru_cache(maxsize=None)
def marked_table() -> np.ndarray:
    """True for code points whose form, once composed, still holds a combining mark or a conjoining letter."""
    table = classes() > 0
    table[0x1100:0x1200] = True
    form = form_table()
    for cp in np.flatnonzero(form.length[:TABLE_END] > 1):
        seq = form.data[form.start[cp] : form.start[cp] + form.length[cp]]
        table[cp] = any(unicodedata.combining(c) for c in unicodedata.normalize("NFC", at.to_str(seq)))
    return table


def _settled(*tables: Gather) -> Gather:
    """The given tables one after another and composition, for code points that nothing else can compose with."""
    rules = {}
    known = np.arange(0x110000, dtype=np.uint32)
    changed = np.flatnonzero(np.any([(t.length != 1) | (t.single != known) for t in tables], axis=0))
    for cp in changed:
        one, off = np.array([cp], np.uint32), np.array([0, 1], np.int64)
        for table in tables[:-1] if len(tables) > 1 else tables:
            one, off = table(one, off)
        one = np.array([ord(c) for c in unicodedata.normalize("NFC", at.to_str(one))], np.uint32)
        if len(tables) > 1:
            one, off = tables[-1](one, np.array([0, len(one)], np.int64))
        rules[int(cp)] = tuple(int(x) for x in one)
    return Gather(rules)


@lru_cache(maxsize=None)
def settled_form() -> Gather:
    return _settled(form_table())


@lru_cache(maxsize=None)
def settled_unite(tatweel: bool = False) -> Gather:
    return _settled(form_table(), look_alike_table(), variant_table(tatweel))


def by_rows(chosen: np.ndarray, cp: np.ndarray, off: np.ndarray, then, otherwise) -> tuple[np.ndarray, np.ndarray]:
    """Applies one function to the chosen rows and another to the rest, keeping the order of rows."""
    if not chosen.any():
        return otherwise(cp, off)
    if chosen.all():
        return then(cp, off)
    lens = np.diff(off)
    element = np.repeat(chosen, lens)
    a, a_off = then(cp[element], at.offsets_of(lens[chosen]))
    b, b_off = otherwise(cp[~element], at.offsets_of(lens[~chosen]))
    new = np.empty(len(chosen), np.int64)
    new[chosen], new[~chosen] = np.diff(a_off), np.diff(b_off)
    element = np.repeat(chosen, new)
    out = np.empty(len(element), np.uint32)
    out[element], out[~element] = a, b
    return out, at.offsets_of(new)


def rows_with(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return at.segment_sums(flags, off) > 0 if flags.any() else np.zeros(len(off) - 1, bool)


def visible_form(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width, presentation, composition, invisible characters and spaces unified; letters stay as they are."""
    marked = rows_with(marked_table()[cp], off)
    return by_rows(marked, cp, off, lambda c, o: compose(*form_table()(c, o)), settled_form())


def _unite_marked(cp: np.ndarray, off: np.ndarray, tatweel: bool) -> tuple[np.ndarray, np.ndarray]:
    cp, off = compose(*look_alike_table()(*form_table()(cp, off)))
    if len(cp):
        ends = np.concatenate((at.row_starts(off, len(cp))[1:], [True]))
        follows = np.concatenate((cp[1:] == HAMZA_ABOVE, [False])) & ~ends
        yeh = follows & ((cp == FARSI_YEH) | (cp == 0x0649))
        seat = yeh | follows & ((cp == HEH) | (cp == 0x06D5) | (cp == 0x06C1))
        if seat.any():
            cp = cp.copy()
            cp[yeh] = YEH_HAMZA
            gone = np.concatenate(([False], seat[:-1]))
            cp, off = cp[~gone], at.offsets_of(at.segment_sums(~gone, off))
    return variant_table(tatweel)(cp, off)


def unite(cp: np.ndarray, off: np.ndarray, spaces: bool = True, tatweel: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form. spaces: white space is squeezed as well. tatweel: it is kept."""
    marked = rows_with(marked_table()[cp], off)
    cp, off = by_rows(marked, cp, off, lambda c, o: _unite_marked(c, o, tatweel), settled_unite(tatweel))
    return squeeze(cp, off) if spaces else (cp, off)


def unite_column(col: pa.Array) -> pa.Array:
    """The consistent form of every text of an Arrow column; nulls stay null."""
    cp, off = unite(*at.decode(col))
    return at.encode(cp, off, at.valid_mask(col))


def unify_text(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_unified") -> DataFrame:
    """``keys`` and, for each of ``columns``, its consistent form as ``column + suffix``.

    Nulls stay null; empty and blank texts become empty; other columns of ``df`` are not read; repeated rows
    stay repeated.
    """
    kept = [*keys, *dict.fromkeys(columns)]
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, *(T.StructField(c + suffix, T.StringType()) for c in dict.fromkeys(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, kept[len(keys) :]):
                arrays = [part.column(k) for k in range(len(keys))]
                arrays += [unite_column(part.column(k)) for k in range(len(keys), len(kept))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def digest(*columns: Column) -> Column:
    """128-bit digest in which null differs from every text."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("\x1e"), c), F.lit("\x1d")) for c in columns)))


def look_classes(df: DataFrame, key: str, shown: str, fields: list[str]) -> DataFrame:
    """One row per row of ``df`` with a text in ``shown``: key, look_id (equal for texts that look the same) and
    form_id (equal where all of ``fields`` agree in code points). Only digests leave the scan."""
    raw = df.where(F.col(shown).isNotNull()).select(F.col(key), F.col(shown), digest(*(F.col(c) for c in fields)).alias("form_id"))
    return unify_text(raw, [key, "form_id"], [shown]).select(
        key, F.md5(F.col(f"{shown}_unified")).alias("look_id"), "form_id"
    )


def form_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (look_id, form_a, form_b) of different forms of a look, of the rows of ``look_classes``."""
    forms = rows.select("look_id", "form_id").distinct()
    several = forms.groupBy("look_id").agg(F.count("*").alias("n")).where("n > 1").select("look_id")
    forms = forms.join(several, "look_id", "left_semi")
    a = forms.select("look_id", F.col("form_id").alias("form_a"))
    b = forms.select("look_id", F.col("form_id").alias("form_b"))
    return a.join(b, "look_id").where("form_a < form_b")


def look_alike_pairs(df: DataFrame, key: str, shown: str, fields: list[str]) -> DataFrame:
    """Pairs (``key_a`` < ``key_b``) of rows whose ``shown`` looks the same while ``fields`` differ in code points.

    Forms are paired first, one row for all rows that agree in every field; their members are attached to the pairs
    afterwards, so copies of a form never meet each other. Null texts make no pair, null fields differ from every
    text; a key paired with itself and repeated rows are dropped.
    """
    rows = settle(look_classes(df, key, shown, fields))
    pairs = form_pairs(rows)
    a = rows.select("look_id", F.col("form_id").alias("form_a"), F.col(key).alias("x"))
    b = rows.select("look_id", F.col("form_id").alias("form_b"), F.col(key).alias("y"))
    joined = pairs.join(a, ["look_id", "form_a"]).join(b, ["look_id", "form_b"]).where("x <> y")
    return joined.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def look_links(df: DataFrame, key: str, shown: str, fields: list[str]) -> DataFrame:
    """One row per row with a text: key, look_id, form_id, n_forms (of its look), n_links (rows of other forms of its
    look). Nothing is paired, so copies cost nothing."""
    rows = look_classes(df, key, shown, fields)
    forms = rows.groupBy("look_id", "form_id").agg(F.count("*").alias("same"))
    looks = forms.groupBy("look_id").agg(F.count("*").alias("n_forms"), F.sum("same").alias("all_rows"))
    sized = forms.join(looks, "look_id").select("look_id", "form_id", "n_forms", (F.col("all_rows") - F.col("same")).alias("n_links"))
    return rows.join(sized, ["look_id", "form_id"]).select(key, "look_id", "form_id", "n_forms", "n_links")
