"""Language of documents and of their segments, with a confidence.

Method: a byte convolutional network (byte embedding, filters of several widths, max pooling, softmax), trained
in numpy on labelled text and applied to batches of fixed-length byte windows. Documents are cut into sentences,
verse lines and half-lines; each is read in as many windows as it needs, and the windows of a document are
decoded together, a change of language being cheap between sentences and dear within one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at
from folioflow.llm import canonical

#: Language codes and the other codes that name the same language.
CODES = {
    "per": ("fas", "fa"), "ara": ("ar",), "urd": ("ur",), "tur": ("tr",), "eng": ("en",),
    "fre": ("fra", "fr"), "ger": ("deu", "de"), "chi": ("zho", "zh"), "hin": ("hi",),
}
LANGUAGES = tuple(CODES)

#: Marks at which a sentence, line or half-line may end.
UNIT_MARKS = tuple(map(ord, ".!?؟۔।॥。！？．｡؛"))  # in verse | too

#: Abbreviations that a full stop follows within a sentence; single letters and words before a number, too.
ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st rev hon sir jr sr cf vgl vol fol fols ed eds etc chap ch art no nr pp bd hrsg hg usw ca bzw "
    "abb mme mlle mm éd av ap apr bkz hz yy vb vd doç yrd öğr çev haz fig sec viz ibid op cit".split()
)


#: Common words that tell Persian from Arabic in a sentence too short for the network, and the article.
PERSIAN_WORDS = frozenset(w.encode() for w in "را به از در که بر هر با این آن است بود شد نه".split())
ARABIC_WORDS = frozenset(w.encode() for w in "في فی من على علی إلى الى ما لا هذا هذه هو هي عن كل كان ليس قال أن إن لم".split())
ARTICLES = tuple(w.encode() for w in "ال وال بال فال كال لل".split())


@dataclass(frozen=True)
class LanguageConfig:
    """Shape of the network, bounds of the training sample and decoding costs."""

    window: int = 64  # bytes of a window
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 20  # of each width
    texts_per_language: int = 160  # bound of the training sample: labelled texts of a language ...
    windows_per_language: int = 2000  # ... windows of a language ...
    chars_per_text: int = 3000  # ... and code points of a text
    epochs: int = 6
    batch: int = 64
    rate: float = 0.004
    seed: int = 7
    least_bytes: int = 2  # a unit of a single byte bears no language of its own
    title_words: int = 8  # of a heading or running header at most, which has no end mark
    switch_between: float = -2.5  # log cost of another language in the next unit
    switch_within: float = -9.0  # log cost of another language within a unit
    unlike_rest: float = 0.8  # confidence asked of a segment in another language than most of the document


@dataclass(frozen=True)
class Network:
    """Weights of a trained network."""

    window: int
    widths: tuple[int, ...]
    embed: np.ndarray  # (256, e)
    kernels: tuple[np.ndarray, ...]  # (width * e, filters)
    biases: tuple[np.ndarray, ...]
    dense: np.ndarray  # (all filters, languages)
    offset: np.ndarray

    def pooled(self, x: np.ndarray, want_at: bool = False):
        """Maximum of every filter over each window of bytes; with want_at also where it is reached."""
        e = self.embed.shape[1]
        seq = self.embed[x]  # (n, window, e)
        flat = seq.reshape(len(x), -1)
        best, where = [], []
        for width, kernel, bias in zip(self.widths, self.kernels, self.biases):
            steps = self.window - width + 1
            view = np.lib.stride_tricks.as_strided(
                flat, (len(x), steps, width * e), (flat.strides[0], e * flat.strides[1], flat.strides[1]), writeable=False
            )
            out = (np.ascontiguousarray(view).reshape(-1, width * e) @ kernel).reshape(len(x), steps, -1)
            if want_at:
                where.append(out.argmax(1))
            best.append(np.maximum(out.max(1) + bias, 0))
        return (np.concatenate(best, 1), where, flat) if want_at else np.concatenate(best, 1)

    def log_probabilities(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        out = np.empty((len(x), self.dense.shape[1]), np.float32)
        for k in range(0, len(x), batch):
            z = self.pooled(x[k : k + batch]) @ self.dense + self.offset
            z -= z.max(1, keepdims=True)
            out[k : k + batch] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def train(x: np.ndarray, y: np.ndarray, config: LanguageConfig) -> Network:
    """Fits the network to windows ``x`` (n, window) of labels ``y`` by Adam; deterministic for given rows."""
    rng = np.random.default_rng(config.seed)
    e, f, k = config.embedding, config.filters, len(LANGUAGES)
    p = [rng.normal(0, 0.3, (256, e)).astype(np.float32)]
    p += [rng.normal(0, (2 / (w * e)) ** 0.5, (w * e, f)).astype(np.float32) for w in config.widths]
    p += [np.zeros(f, np.float32) for _ in config.widths]
    p += [rng.normal(0, 0.1, (f * len(config.widths), k)).astype(np.float32), np.zeros(k, np.float32)]
    n_w = len(config.widths)

    def network() -> Network:
        return Network(config.window, config.widths, p[0], tuple(p[1 : 1 + n_w]), tuple(p[1 + n_w : 1 + 2 * n_w]), p[-2], p[-1])

    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    rows = np.arange(config.batch)[:, None]
    for epoch in range(config.epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), config.batch):
            take = order[s : s + config.batch]
            xb, yb = x[take], y[take]
            m = len(take)
            net = network()
            hidden, where, flat = net.pooled(xb, True)
            z = hidden @ net.dense + net.offset
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(m), yb] -= 1
            prob /= m
            grads: list[np.ndarray] = [np.zeros_like(net.embed)]
            dense = hidden.T @ prob
            back = (prob @ net.dense.T) * (hidden > 0)
            kernel_grads, bias_grads = [], []
            for q, width in enumerate(config.widths):
                d = back[:, q * f : (q + 1) * f]  # (m, f)
                at_ = where[q]
                index = (at_ * e)[:, :, None] + np.arange(width * e)
                patch = flat[rows[:m, :, None], index]  # (m, f, width * e)
                kernel_grads.append(np.einsum("mf,mfe->ef", d, patch))
                bias_grads.append(d.sum(0))
                to_patch = (d[:, :, None] * net.kernels[q].T[None]).reshape(m * f * width, e)
                byte = xb[rows[:m, :, None], at_[:, :, None] + np.arange(width)].reshape(-1)
                for c in range(e):
                    grads[0][:, c] += np.bincount(byte, weights=to_patch[:, c], minlength=256).astype(np.float32)
            grads += kernel_grads + bias_grads + [dense, prob.sum(0)]
            step += 1
            rate = config.rate * (1 - epoch / (config.epochs + 1))
            for a, g, m1, m2 in zip(p, grads, first, second):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                a -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
    return network()


@lru_cache(maxsize=None)
def letter_table() -> np.ndarray:
    """True for letters and vowel signs; all else is read as a space."""
    import unicodedata

    table = np.zeros(0x110000, bool)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        kind = unicodedata.category(chr(cp))
        table[cp] = kind in ("Lu", "Ll", "Lt", "Lo") or kind in ("Mn", "Mc") and not 0x300 <= cp < 0x0660
    table[0x27] = True
    return table


@lru_cache(maxsize=None)
def lower_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x41, 0x2000):
        low = chr(cp).lower()
        if len(low) == 1:
            table[cp] = ord(low)
    return table


@dataclass
class Units:
    """Units of a slice of rows: row, first and end code point (within the row's visible form), and its letters as bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    off: np.ndarray
    words: np.ndarray
    title: np.ndarray  # ends without an end mark, as headings and running headers do


def inner_stops(cp: np.ndarray, row_of: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Places of full stops that end no sentence: in numbers, abbreviations, initials and ellipses.

    Where the script changes after it a full stop counts as an end.
    """
    n = len(cp)
    at_ = np.flatnonzero(cp == ord("."))
    if not len(at_):
        return at_
    place = np.arange(n)
    row = row_of[at_]

    def kind(k: np.ndarray, table: np.ndarray) -> np.ndarray:
        inside = (k >= 0) & (k < n)
        q = np.clip(k, 0, n - 1)
        return inside & (row_of[q] == row) & table[q]

    digit = at.flag_table((*range(0x30, 0x3A), *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)))[cp]
    dot = cp == ord(".")
    white = (cp == canonical.NEWLINE) | (cp == canonical.SPACE)
    ahead = np.minimum.accumulate(np.where(white, n, place)[::-1])[::-1]  # the next place that isn't white
    following = np.append(ahead, n)[at_ + 1]
    later = np.append(np.minimum.accumulate(np.where(letter, place, n)[::-1])[::-1], n)[at_ + 1]  # the next letter
    behind = np.maximum.accumulate(np.where(letter, -1, place))  # the last place that is no letter
    size = np.where(at_ > 0, at_ - 1 - behind[np.maximum(at_ - 1, 0)], 0)
    size = np.minimum(size, at_ - (np.searchsorted(row_of, row)))
    lower = lower_table()
    inner = kind(at_ - 1, digit) & kind(at_ + 1, digit)
    inner |= kind(at_ - 1, dot) | kind(at_ + 1, dot)
    inner |= (size == 1) & ~kind(at_ - 1, cp >= 0x3000)
    inner |= (size > 1) & (size <= 3) & kind(at_ - 1, (cp >= 0x900) & (cp < 0x980))  # Hindi sentences end in another mark
    inner |= (size > 0) & (size <= 5) & kind(following, digit) & kind(at_ - 1, cp < 0x250)
    for q in np.flatnonzero(~inner & (size > 1) & (size <= 5) & kind(at_ - 1, cp < 0x250)):
        word = cp[at_[q] - size[q] : at_[q]]
        inner[q] = "".join(map(chr, lower[word].tolist())) in ABBREVIATIONS
    script = np.searchsorted(np.array([0x250, 0x590, 0x900, 0x980, 0x3000]), cp, side="right")
    last = np.maximum.accumulate(np.where(letter, place, -1))[at_]
    known = (last >= 0) & (later < n)
    other = known & (row_of[np.maximum(last, 0)] == row) & (row_of[np.minimum(later, n - 1)] == row)
    other &= script[np.maximum(last, 0)] != script[np.minimum(later, n - 1)]
    blank = np.zeros(len(at_), bool)  # a blank line ends any sentence
    for step in (1, 2, 3):
        blank |= kind(at_ + step, cp == canonical.NEWLINE) & kind(at_ + step + 1, cp == canonical.NEWLINE)
    numeral = kind(at_ - 1, digit) & kind(at_ + 1, digit)
    return at_[inner & (numeral | ~(other | blank))]


def units_of(cp: np.ndarray, off: np.ndarray, verse: np.ndarray) -> Units:
    """Cuts rows (in visible form) at sentence marks and blank lines, rows of verse also at line ends and wide gaps.

    Only letters go on: digits, punctuation and noise become single spaces.
    """
    n = len(cp)
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    breaks = cp == canonical.NEWLINE
    white = breaks | (cp == canonical.SPACE)
    letter = letter_table()[cp]
    mark = at.flag_table(UNIT_MARKS)[cp]
    mark[inner_stops(cp, row_of, letter)] = False
    cut = mark.copy()
    pair = np.zeros(n, bool)
    if n > 2:
        pair[1:] = breaks[1:] & breaks[:-1]
        in_verse = verse[row_of]
        gap = np.zeros(n, bool)
        gap[2:] = white[2:] & white[1:-1] & white[:-2]
        pair |= in_verse & (breaks | gap | (cp == ord("/")) | (cp == ord("|")))
        pair[1:] |= in_verse[1:] & (cp[1:] == ord("%")) & (cp[:-1] == ord("~"))
    cut |= pair
    starts = at.row_starts(off, n)
    begin = starts.copy()
    begin[1:] |= cut[:-1]
    unit = np.cumsum(begin) - 1
    n_units = int(unit[-1]) + 1 if n else 0
    first = np.flatnonzero(begin)
    keep = letter.copy()
    if n:
        spaced = ~letter & np.concatenate(([False], letter[:-1])) & ~begin
        keep |= spaced
    text = np.where(letter, lower_table()[cp], np.uint32(0x20))[keep]
    count = np.bincount(unit[keep], minlength=n_units)
    unit_off = at.offsets_of(count)
    widths = at.utf8_widths(text)
    data = np.frombuffer(at.to_str(text).encode("utf-8", "replace"), np.uint8)
    boff = at.offsets_of(at.segment_sums(widths, unit_off))
    row = row_of[first] if n else np.zeros(0, np.int64)
    end = np.append(first[1:], n) if n else first
    words = at.segment_sums(at.word_starts(text, unit_off), unit_off)
    words += at.segment_sums((data >= 0xE3) & (data <= 0xE9), boff) // 2
    title = (at.segment_sums(mark, np.append(first, n)) == 0) & ~verse[row]
    return Units(row, first - off[row], end - off[row], data, boff, words, title)


def windows_of(units: Units, config: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """Windows (m, window) of the units that are long enough, spread evenly over each, and the unit of each window."""
    size = np.diff(units.off)
    use = np.flatnonzero(size >= config.least_bytes)
    count = -(-size[use] // config.window)
    unit = np.repeat(use, count)
    first = at.offsets_of(count)
    k = np.arange(len(unit)) - first[np.repeat(np.arange(len(use)), count)]
    span = np.maximum(size[unit] - config.window, 0)
    steps = np.maximum(np.repeat(count, count) - 1, 1)
    start = units.off[unit] + span * k // steps
    limit = units.off[unit + 1]
    index = start[:, None] + np.arange(config.window)
    inside = index < limit[:, None]
    padded = units.data if len(units.data) else np.zeros(1, np.uint8)
    x = np.where(inside, padded[np.minimum(index, len(padded) - 1)], np.uint8(0x20))
    return x, unit


def prefer_persian(logp: np.ndarray, units: Units, unit: np.ndarray, config: LanguageConfig) -> None:
    """Exchanges Arabic and Persian (in place) where a unit of one window that looks Arabic holds only Persian words."""
    ara, per = LANGUAGES.index("ara"), LANGUAGES.index("per")
    size = np.diff(units.off)[unit]
    for q in np.flatnonzero((logp.argmax(1) == ara) & (size <= config.window)) if len(logp) else ():
        words = units.data[units.off[unit[q]] : units.off[unit[q] + 1]].tobytes().split()
        if not PERSIAN_WORDS.isdisjoint(words) and ARABIC_WORDS.isdisjoint(words) and not any(w.startswith(ARTICLES) for w in words):
            logp[q, [ara, per]] = logp[q, [per, ara]]


def decode_rows(logp: np.ndarray, row: np.ndarray, unit: np.ndarray, config: LanguageConfig) -> np.ndarray:
    """The most likely languages of the windows of each row, all rows side by side (Viterbi)."""
    out = np.zeros(len(row), np.int64)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.append(first, len(row)))
    k = logp.shape[1]
    by_size = np.argsort(size, kind="stable")
    for s in range(0, len(by_size), 256):
        group = by_size[s : s + 256]
        steps = int(size[group].max())
        at_ = first[group]
        score = logp[at_].astype(np.float64)
        back = np.zeros((steps, len(group), k), np.int8)
        last = np.zeros(len(group), np.int64)
        final = score.copy()
        for t in range(1, steps):
            live = size[group] > t
            here = np.where(live, at_ + t, at_)
            same = unit[here] == unit[np.where(live, here - 1, here)]
            cost = np.where(same, config.switch_within, config.switch_between)
            best = score.argmax(1)
            moved = score.max(1) + cost
            stay = score >= moved[:, None]
            back[t] = np.where(stay, np.arange(k), best[:, None])
            score = np.where(stay, score, moved[:, None]) + logp[here]
            final[live] = score[live]
            last[live] = t
        state = final.argmax(1)
        for t in range(steps - 1, -1, -1):
            live = size[group] > t
            out[at_[live] + t] = state[live]
            state = np.where(live, back[t, np.arange(len(group)), state], state)
    return out


@dataclass
class Segments:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    language: np.ndarray
    confidence: np.ndarray
    whole: np.ndarray  # holds at least one whole unit
    words: np.ndarray


def segments_of(cp: np.ndarray, off: np.ndarray, verse: np.ndarray, network: Network, config: LanguageConfig) -> Segments:
    """Segments of one language of every row, in order; offsets count code points of the visible form."""
    units = units_of(cp, off, verse)
    units.title &= units.words <= config.title_words
    x, unit = windows_of(units, config)
    logp = network.log_probabilities(x) if len(x) else np.zeros((0, len(LANGUAGES)), np.float32)
    prefer_persian(logp, units, unit, config)
    row = units.row[unit]
    state = decode_rows(logp, row, unit, config)
    if not len(row):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, np.zeros(0), np.zeros(0, bool), none)
    begin = np.concatenate(([True], (row[1:] != row[:-1]) | (state[1:] != state[:-1])))
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(row)) - 1
    chosen = np.exp(logp[np.arange(len(row)), state].astype(np.float64))
    total = np.add.reduceat(chosen, first)
    # A segment covers whole units unless its first or last unit is shared with its neighbour.
    shares_left = np.concatenate(([False], unit[1:] == unit[:-1]))[first]
    shares_right = np.concatenate((unit[1:] == unit[:-1], [False]))[last]
    whole = ~(shares_left | shares_right) | (unit[last] - unit[first] >= 2) | (last - first >= 2)
    start = units.start[unit[first]].copy()
    end = units.end[unit[last]].copy()
    if shares_left.any():  # within a unit the change lies halfway between its windows
        for q in np.flatnonzero(shares_left):
            u = unit[first[q]]
            inside = np.flatnonzero(unit == u)
            share = (first[q] - inside[0]) / len(inside)
            start[q] = units.start[u] + int(share * (units.end[u] - units.start[u]))
            end[q - 1] = start[q]
    seen = np.concatenate(([0], np.cumsum(units.words)))
    words = seen[unit[last] + 1] - seen[unit[first]]
    read = np.zeros(len(units.row), bool)
    read[unit] = True
    # Headings and running headers are no whole units.
    told = np.concatenate(([0], np.cumsum(~units.title & read)))
    whole &= told[unit[last] + 1] > told[unit[first]]
    return Segments(row[first], start, end, state[first], total / (last - first + 1), whole, words)


def label_languages(label: Column) -> Column:
    """Languages that a label names: codes of any style and case, with a region, several joined by , or +."""
    names = F.create_map(*(F.lit(x) for code, others in CODES.items() for c in (code, *others) for x in (c, code)))
    parts = F.transform(F.split(F.lower(label), "[,+]"), lambda p: F.split(F.trim(p), "[-_]")[0])
    return F.coalesce(F.filter(F.array_distinct(F.transform(parts, lambda p: names[p])), lambda c: c.isNotNull()), F.array().cast("array<string>"))


def latest_labels(labels: DataFrame, key: str = "passage_id") -> DataFrame:
    """The row with the latest labelled_at of each key, as ``languages``; of equal times the greatest label counts."""
    best = labels.groupBy(key).agg(F.max(F.struct("labelled_at", "lang")).alias("latest"))
    return best.select(key, label_languages(F.col("latest.lang")).alias("languages"))


def training_windows(rows: list[tuple[str, str, bool]], config: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """Windows and languages of labelled texts (text, language, verse), at most ``windows_per_language`` of each."""
    xs, ys = [], []
    rng = np.random.default_rng(config.seed)
    for k, language in enumerate(LANGUAGES):
        mine = [(t, v) for t, lang, v in rows if lang == language]
        if not mine:
            continue
        cp, off = canonical.visible_form(*at.decode(pa.array([t for t, _ in mine])))
        units = units_of(cp, off, np.array([v for _, v in mine]))
        x, unit = windows_of(units, config)
        x = x[~(units.title & (units.words <= config.title_words))[unit]]
        x = x[rng.permutation(len(x))[: config.windows_per_language]]
        xs.append(x)
        ys.append(np.full(len(x), k))
    if not xs:
        return np.zeros((0, config.window), np.uint8), np.zeros(0, np.int64)
    return np.concatenate(xs), np.concatenate(ys)


def fit(rows: list[tuple[str, str, bool]], config: LanguageConfig) -> Network | None:
    """Trains twice: windows that the first network finds unlike their label are left out of the second. Without
    labelled text there is no network, and no language is told."""
    x, y = training_windows(rows, config)
    if not len(x):
        return None
    network = train(x, y, config)
    good = network.log_probabilities(x)[np.arange(len(x)), y] > np.log(0.05)
    return network if good.all() else train(x[good], y[good], config)


def labelled_sample(passages: DataFrame, labels: DataFrame, config: LanguageConfig) -> list[tuple[str, str, bool]]:
    """A bounded sample of texts whose latest label names one language, the one which the version id names too.

    At most ``texts_per_language`` texts of each language: ids are drawn by hash from the ids alone, the texts are
    then read for these. Only this sample is collected.
    """
    named = F.regexp_extract("version_id", r"-([a-z]{3})\d*$", 1)
    single = latest_labels(labels).where(F.size("languages") == 1).select("passage_id", F.col("languages")[0].alias("language"))
    ids = passages.select("passage_id", named.alias("named")).join(single, "passage_id").where("named = language")
    order = Window.partitionBy("language").orderBy(F.xxhash64("passage_id"), "passage_id")
    chosen = ids.select("passage_id", "language").distinct().withColumn("at", F.row_number().over(order))
    chosen = chosen.where(F.col("at") <= config.texts_per_language).select("passage_id", "language")
    texts = passages.select("passage_id", "display_text", F.col("kind").isin("diwan", "mathnawi").alias("verse"))
    sample = texts.where("display_text IS NOT NULL").join(F.broadcast(chosen), "passage_id")
    rows = sample.select("passage_id", F.substring("display_text", 1, config.chars_per_text).alias("text"), "language", "verse").collect()
    return [(r.text, r.language, bool(r.verse)) for r in sorted(rows, key=lambda r: (r.passage_id, r.text))]


SEGMENT_TYPE = "seg_no int, char_start long, char_end long, lang string, confidence double, whole boolean, words long"


def language_segments(
    df: DataFrame, key: str, text: str, verse: Column, network: Network | None, config: LanguageConfig = LanguageConfig()
) -> DataFrame:
    """One row per stretch of a language: key, seg_no, char_start, char_end, lang, confidence, whole, words.

    Offsets count code points of the text in its visible form (see canonical). Texts without a stretch long enough
    to tell (null, empty, digits only) give no row. Rows are read one by one: repeated keys stay apart only by text.
    """
    schema = T.StructType([df.schema[key], *T._parse_datatype_string(SEGMENT_TYPE).fields])

    if network is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(LANGUAGES)
        for batch in batches:
            for part in at.slices(batch, [text]):
                cp, off = canonical.visible_form(*at.decode(part.column(1)))
                flags = np.asarray(part.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
                s = segments_of(cp, off, flags, network, config)
                first = np.concatenate(([True], s.row[1:] != s.row[:-1])) if len(s.row) else np.zeros(0, bool)
                number = np.arange(len(s.row)) - np.maximum.accumulate(np.where(first, np.arange(len(s.row)), 0))
                arrays = [
                    part.column(0).take(pa.array(s.row)), pa.array(number.astype(np.int32)),
                    pa.array(s.start.astype(np.int64)), pa.array(s.end.astype(np.int64)),
                    pa.array(names[s.language].astype(object), pa.string()), pa.array(s.confidence), pa.array(s.whole), pa.array(s.words.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(key, text, verse.alias("__verse")).mapInArrow(run, schema)


def languages_present(segments: DataFrame, key: str, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Languages of each key with a whole sentence, line or half-line: key, lang, confidence, chars, is_main."""
    sure = F.col("confidence") >= config.unlike_rest
    per = segments.where("whole").groupBy(key, "lang").agg(
        F.max("confidence").alias("confidence"),
        F.sum(F.col("char_end") - F.col("char_start")).alias("chars"),
        F.max(sure).alias("sure"),
    )
    order = Window.partitionBy(key).orderBy(F.desc("chars"), "lang")
    ranked = per.withColumn("is_main", F.row_number().over(order) == 1)
    return ranked.where("is_main OR sure").drop("sure")


def unlabelled_languages(passages: DataFrame, labels: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """passage_id and lang of every language that a passage holds and its latest label doesn't name."""
    network = fit(labelled_sample(passages, labels, config), config)
    verse = F.col("kind").isin("diwan", "mathnawi")
    texts = passages.where("display_text IS NOT NULL")
    held = languages_present(language_segments(texts, "passage_id", "display_text", verse, network, config), "passage_id", config)
    named = latest_labels(labels)
    joined = held.select("passage_id", "lang").join(named, "passage_id", "left")
    return joined.where(~F.coalesce(F.array_contains("languages", F.col("lang")), F.lit(False))).select("passage_id", "lang").distinct()
