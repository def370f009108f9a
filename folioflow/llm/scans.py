"""Noise in text from scanned pages: words broken over lines, misread characters, running headers, page numbers.

Method: a noisy channel. What the scanner does to characters (confusion probabilities) is learned from rare words
that one confusion turns into frequent ones; what was written is judged by the n-gram likelihood of the corpus; the
words of a line are decoded by Viterbi over candidate words. Running headers are short lines that recur in their
version, or stand where no line of the running text would end, at times with a page number; they and page numbers are
set aside before the text is joined and decoded.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at
from folioflow.functions.lineage import settle
from folioflow.llm import canonical

NOISES = ("hyphen", "misread", "header", "pageno")


@dataclass(frozen=True)
class ScanConfig:
    profiles: tuple[str, ...] = ("mixed_prose_ocr", "raw_ocr_reference")
    least_count: int = 4  # a word is known from so many occurrences ...
    least_share: float = 1e-6  # ... and this share of all words, so at most 1 / least_share words are kept
    header_words: int = 6  # of a running header at most ...
    header_chars: int = 60  # ... and characters, its page number included
    header_edits: int = 2  # by which a misread header may differ from one that recurs ...
    header_letters: int = 8  # ... or one for so many letters, where that is more
    header_count: int = 2  # a header recurs so often in its version
    header_most: int = 1_000_000  # headers of all versions (checked)
    header_slack: int = 3  # characters that misreading may have added to the longest line
    strong_ratio: int = 20  # confusions are learned from words so much rarer than the word they resemble
    rounds: int = 2  # of learning confusions again with those learned before
    least_types: int = 3  # different words that must show a confusion
    least_rate: float = 1.5e-5  # of the occurrences of what was written
    typical_ratio: float = 0.2  # of the rate of typical confusions
    bigram_share: float = 1e-6  # of all word pairs, so at most 1 / bigram_share pairs are kept
    certain: float = 0.85  # posterior from which a word counts as misread
    sign_options: int = 6  # likeliest words for one with a sign in it that are weighed against the line
    misread_rate: float = 0.003  # share of words taken to be misread before any is seen


#: Hyphens at a line end, words before a page number, marks that a header doesn't hold.
HYPHENS = "-‐‑¬=ـ"
PAGE_WORDS = "p|pp|page|pg|s|seite|sayfa|ص|صفحه|पृ|पृष्ठ|第|頁|页"
ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
NUMBER = rf"(?:\d{{1,4}}|{ROMAN})"
PAGE_LINE = re.compile(rf"^[^\w]*(?:(?:{PAGE_WORDS})[\s.:]*)?{NUMBER}[\s.]*(?:页|頁)?[^\w]*$", re.I)
EDGE_NUMBER = re.compile(rf"^\s*({NUMBER})[\s|\-—–.:]+(?=\D)|(?<=\D)[\s|\-—–:]+({NUMBER})\s*$", re.I)
SET_OFF = re.compile(rf"^\s*{NUMBER}\s*[|—–]|[|—–]\s*{NUMBER}\s*$", re.I)
SENTENCE = re.compile(r"[.!?؟۔؛،,;:।。！？，；：«»“”\"「」]")
LETTER = re.compile(r"[^\W\d_]")
OPENERS = "\"'“”„«‘’‹「『([{（"
CLOSERS = "\"'“”»’›」』)]}）.,;:!?؟،؛۔।…。！？、，；："
#: Signs that scanners put for or between letters.
SIGN = re.compile(r"[\d*^~_=¦|■•¢§¤°©®¬<>\\@#$%&+\[\]{}«»!?]")
UNWRITTEN = dict.fromkeys((0x0640, *range(0x064B, 0x0653)))
ARABIC = re.compile("[\u0600-\u06FF]")
WIDE = re.compile("[\u3040-\u9FFF]")
WIDE_SIGN = re.compile(r"[*^~_=¦■•¢]")


@dataclass
class Line:
    text: str
    kind: str  # text, blank, pageno, header, heading


def shown(col: pa.Array) -> list[str]:
    """Texts with invisible differences united, line breaks and tatweel kept."""
    return at.encode(*canonical.unite(*at.decode(col), tatweel=True)).to_pylist()


def header_key(line: str, config: ScanConfig) -> tuple[str, bool] | None:
    """Letters of a line that may be a running header, and whether a page number stands at its edge."""
    if len(line) > config.header_chars or line.count(" ") > config.header_words + 3 or SENTENCE.search(line):
        return None
    body = EDGE_NUMBER.sub(" ", line)
    numbered = body != line
    words = [w for w in re.split(r"[\W_]+", body.replace("ـ", "")) if w]
    if not words or len(words) > config.header_words or any(w.isdigit() for w in words):
        return None
    return " ".join(words).lower().replace("ı", "i").replace("i̇", "i"), numbered


def neighbours(lines: list[Line], k: int) -> tuple[str | None, str | None]:
    """The lines before and after line ``k``, page numbers left out; None at the edges of the text."""
    before = next((x.text for x in reversed(lines[:k]) if x.kind != "pageno"), None)
    after = next((x.text for x in lines[k + 1 :] if x.kind != "pageno"), None)
    return before, after


def width_of(lines: list[Line], config: ScanConfig) -> int:
    """Characters that a line of the running text surely has room for."""
    return max((len(x.text.rstrip()) for x in lines if x.kind == "text"), default=0) - config.header_slack


def stands_apart(line: str, after: str | None, width: int) -> bool:
    """The next word would have had room in the line, so the running text wasn't broken there."""
    words = after.split(maxsplit=1) if after else []
    return bool(words) and len(line.strip()) + 1 + len(words[0]) <= width


class Headers:
    """Running headers of a version, with indexes by their ends: a header is sought among those that share its first or
    last three letters, or its last two words."""

    def __init__(self, keys: Iterable[str] = ()) -> None:
        self.keys = frozenset(keys)
        self.by_end: dict[tuple[str, int], list[str]] = {}
        self.titles = {tuple(t) for h in self.keys if len(t := h.split(" ")[-2:]) == 2}
        for h in sorted(self.keys):
            if len(h) >= 8:
                for end in {("<" + h[:3], len(h)), (">" + h[-3:], len(h))}:
                    self.by_end.setdefault(end, []).append(h)

    def near(self, key: str, edits: int) -> bool:
        """A header of about the same length is at most ``edits`` characters away (headers are misread, too)."""
        tried = set()
        for n in range(len(key) - edits, len(key) + edits + 1):
            for end in ("<" + key[:3], ">" + key[-3:]):
                for h in self.by_end.get((end, n), ()):
                    if h not in tried and _distance(key, h, edits) <= edits:
                        return True
                    tried.add(h)
        return False

    def shares_title(self, key: str) -> bool:
        """Ends with the same two words as a header (titles stand after their author or the word for chapter)."""
        title = tuple(key.split(" ")[-2:])
        return len(title) == 2 and title in self.titles


def classify(text: str, headers: Headers | None, config: ScanConfig) -> list[Line]:
    """Kinds of the lines of a text. headers: the version's running headers; None while they aren't known."""
    lines = [Line(x, "text") for x in text.split("\n")]
    for line in lines:
        bare = line.text.strip()
        if not bare:
            line.kind = "blank"
        elif len(bare) <= 24 and PAGE_LINE.match(bare):
            line.kind = "pageno"
    if len(lines) > 1 and headers is not None:
        width = width_of(lines, config)
        for k, line in enumerate(lines):
            if line.kind != "text" or not (found := header_key(line.text.strip(), config)):
                continue
            key, numbered = found
            if key in headers.keys or (numbered or len(key) > 9) and headers.near(key, max(config.header_edits, len(key) // config.header_letters)):
                line.kind = "header"
                continue
            after = neighbours(lines, k)[1]
            apart = stands_apart(line.text, after, width)
            # Seen once: with a number where the running text wasn't broken, or with the title of another header.
            alone = numbered and (apart or after is None and SET_OFF.search(line.text))
            if alone or (apart or numbered and after is None) and headers.shares_title(key):
                line.kind = "header"
    if len(lines) > 1 and lines[0].kind == "text" and lines[1].kind == "blank" and not SENTENCE.search(lines[0].text) and len(lines[0].text.split()) <= 8:
        lines[0].kind = "heading"
    return lines


def _distance(a: str, b: str, limit: int) -> int:
    """Edit distance, or more than ``limit`` where it is more; a band of the table is enough for that."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    far = limit + 1
    row = [j if j <= limit else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - limit), min(len(b), i + limit)
        last, row[low - 1] = row[low - 1], i if low == 1 else far
        for j in range(low, high + 1):
            up = row[j] if j < i + limit else far
            last, row[j] = row[j], min(up + 1, row[j - 1] + 1, last + (x != b[j - 1]), far)
        if min(row[low - 1 : high + 1]) > limit:
            return far
    return row[-1]


def word_core(token: str) -> str:
    """A token without marks at its edges, tatweel and vowel signs, lower case."""
    bare = token.lstrip(OPENERS).rstrip(CLOSERS)
    if bare[:1] == "»" and bare[1:2] < "ɐ":  # opens a quotation in German
        bare = bare[1:].lstrip(OPENERS)
    return bare.translate(UNWRITTEN).lower()


def join_lines(lines: list[Line]) -> tuple[list[list[str]], int]:
    """Words of the running text by line, words broken over line ends joined, and how many were broken."""
    out: list[list[str]] = []
    broken = 0
    carry = ""
    for line in lines:
        if line.kind != "text":
            if line.kind == "blank" and not carry:
                out.append([])
            continue
        words = line.text.split()
        if carry:
            if LETTER.match(words[0]):
                broken += 1
                words[0] = carry + words[0]
            else:
                words.insert(0, carry + "-")
            carry = ""
        if words[-1][-1] in HYPHENS and words[-1][-2:-1].isalpha():
            carry = words.pop().rstrip(HYPHENS)
        out.append(words)
    if carry:
        out.append([carry + "-"])
    return out, broken


#: Of a short line in its version: occurrences, those with a number, those that stand apart, those that do or end the
#: text, least and greatest hash of the line before and of the line after.
SHORT = ("n", "n_numbered", "n_apart", "n_placed", "before_min", "before_max", "after_min", "after_max")


def merge_short(a: list[int] | None, b: list[int]) -> list[int]:
    if a is None:
        return b
    ends = [f(x, y) for f, x, y in zip((min, max, min, max), a[4:], b[4:])]
    return [x + y for x, y in zip(a[:4], b[:4])] + ends


def count_batch(texts: list[str], versions: list[str], config: ScanConfig) -> tuple[Counter, dict[tuple[str, str], list[int]]]:
    """Words of running text, and the short lines of each version (see SHORT)."""
    words: Counter = Counter()
    shorts: dict[tuple[str, str], list[int]] = {}
    for text, version in zip(texts, versions):
        if not text:
            continue
        lines = classify(text, None, config)
        several = len(lines) > 1
        width = width_of(lines, config)
        for k, line in enumerate(lines):
            if line.kind == "text" and several and (found := header_key(line.text.strip(), config)):
                before, after = neighbours(lines, k)
                apart = stands_apart(line.text, after, width)
                # At an edge of the text the other neighbour tells copies of a text from another place.
                left, right = (zlib.crc32((x or f"\0{y}").encode("utf-8", "replace")) for x, y in ((before, after), (after, before)))
                key = version or "", found[0]
                shorts[key] = merge_short(shorts.get(key), [1, int(found[1]), int(apart), int(apart or after is None), left, left, right, right])
        joined, _ = join_lines(lines)
        for ws in joined:
            words.update(ws)
    return words, shorts


def statistics(df: DataFrame, text: str, version: str, config: ScanConfig) -> DataFrame:
    """kind (w or h), version, key and the counts of SHORT over all rows; partial sums leave each batch."""
    schema = "kind string, version string, key string, " + ", ".join(f"{x} long" for x in SHORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        shorts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for part in at.slices(batch, [text]):
                w, s = count_batch(shown(part.column(0)), part.column(1).to_pylist(), config)
                words.update(w)
                for key, counts in s.items():
                    shorts[key] = merge_short(shorts.get(key), counts)
                if len(words) + len(shorts) > 300_000:
                    yield emit(words, shorts)
                    words, shorts = Counter(), {}
        yield emit(words, shorts)

    def emit(words: Counter, shorts: dict) -> pa.RecordBatch:
        cores: Counter = Counter()
        for w, n in words.items():
            if c := word_core(w):
                cores[c] += n
        rows = [("w", "", c, n, *[0] * 7) for c, n in cores.items()] + [("h", v, k, *counts) for (v, k), counts in shorts.items()]
        cols = list(zip(*rows)) if rows else [()] * (3 + len(SHORT))
        types = (*[pa.string()] * 3, *[pa.int64()] * len(SHORT))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "version", "key", *SHORT])

    counted = df.select(text, version).mapInArrow(run, schema)
    merged = [(F.min if x.endswith("min") else F.max if x.endswith("max") else F.sum)(x).alias(x) for x in SHORT]
    return counted.groupBy("kind", "version", "key").agg(*merged)


def recurring_headers(stats: DataFrame, config: ScanConfig) -> dict[str, dict[str, int]]:
    """version -> running headers: short lines that recur, with page numbers or in different places where the running
    text wasn't broken."""
    numbered = (F.col("n_numbered") > 0) & (F.col("n_numbered") * 5 >= F.col("n"))
    elsewhere = (F.col("before_min") < F.col("before_max")) & (F.col("after_min") < F.col("after_max"))
    placed = (F.col("n_apart") > 0) & (F.col("n_placed") >= config.header_count) & (F.col("n_placed") * 2 > F.col("n")) & elsewhere
    found = stats.where((F.col("kind") == "h") & (F.col("n") >= config.header_count) & (numbered | placed)).select("version", "key", "n")
    rows = found.limit(config.header_most + 1).collect()
    if len(rows) > config.header_most:
        raise ValueError(f"more than {config.header_most} running headers")
    headers: dict[str, dict[str, int]] = {}
    for r in rows:
        headers.setdefault(r.version, {})[r.key] = r.n
    return headers


def _holes(word: str, sizes: tuple[int, ...]) -> str:
    """SQL for all ways to leave one or two characters out of a word: where (key), which (gone), and how many."""
    one = (
        "transform(sequence(1, length({w}) - {z}), i -> struct(concat(substring({w}, 1, i - 1), '\\0', substring({w}, i + {s})) AS key, "
        "substring({w}, i, {s}) AS gone, {s} AS size, i > 1 AND i + {s} <= length({w}) AS within))"
    )
    parts = [f"IF(length({word}) >= {z}, {one.format(w=word, s=z, z=z - 1)}, array())" for z in sizes]
    return f"concat({', '.join(parts)})"


def resemblances(words: DataFrame, config: ScanConfig) -> DataFrame:
    """word, n and likes: the frequent words that one confusion turns into a rare one, each with (n, read, written, within
    the word).

    Words meet by what is left of them when one or two characters are left out, so neither vocabulary goes to all
    workers; this is done once, and the rounds of learning read the result.
    """
    strong = words.where((F.col("n") >= config.strong_ratio) & (F.length("key") >= 3) & F.rlike("key", F.lit(r"^[\p{L}']+$")))
    rare = words.where(F.length("key").between(3, 30)).select("key", "n")
    left = strong.select(F.col("key").alias("w"), F.col("n").alias("wn"))
    right = rare.select(F.col("key").alias("r"), F.col("n").alias("rn"))
    a = left.select("w", "wn", F.explode(F.expr(_holes("w", (1, 2)))).alias("h")).select(F.col("h.key").alias("key"), "w", "wn", F.col("h.gone").alias("written"), F.col("h.size").alias("size"))
    b = right.select("r", "rn", F.explode(F.expr(_holes("r", (1, 2)))).alias("h")).select(F.col("h.key").alias("key"), "r", "rn", F.col("h.gone").alias("read"), F.col("h.size").alias("read_size"), "h.within")
    met = a.join(b, "key").where("wn >= rn * " + str(config.strong_ratio) + " AND size + read_size < 4 AND read <> written")
    met = met.select("r", "rn", "w", "wn", "read", "written", "within")
    # A sign that stands between the letters, nothing being lost.
    extra = right.select("r", "rn", F.explode(F.expr(_holes("r", (1,)))).alias("h")).where(~F.rlike("h.gone", F.lit(r"^\p{L}$")))
    extra = extra.select("r", "rn", F.replace("h.key", F.lit("\0"), F.lit("")).alias("w"), F.col("h.gone").alias("read")).distinct()
    extra = extra.join(left, "w").where("wn >= rn * " + str(config.strong_ratio))
    met = met.unionByName(extra.select("r", "rn", "w", "wn", "read", F.lit("").alias("written"), F.lit(True).alias("within")))
    likes = F.collect_list(F.struct("wn", "read", "written", "within"))  # as many as letters can be put for others
    return met.groupBy(F.col("r").alias("word"), F.col("rn").alias("n")).agg(likes.alias("likes"))


def learn_confusions(
    found: DataFrame, strong: dict[str, int], config: ScanConfig, known: dict[tuple[str, str], float] | None = None
) -> dict[tuple[str, str], float]:
    """(read, written) -> probability that the written characters are read so, from all rare words (``resemblances``).

    Of several explanations of a rare word the one counts that is likeliest under the ``known`` probabilities (at
    first: that comes from the most frequent word). Collected are sums by pairs of characters, of which only those that several words show are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for n, likes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                likely = [x["wn"] * (known.get((x["read"], x["written"]), 1e-9) if known else 1.0) for x in likes]
                best = max(likely)
                for x, p in zip(likes, likely):
                    if p == best:  # prefixes and endings of a language show at the edges of words only
                        have = total.setdefault((x["read"], x["written"]), [0, 0])
                        have[0] += n
                        have[1] += x["within"]
        cols = [[k[0] for k in total], [k[1] for k in total], [v[0] for v in total.values()], [v[1] for v in total.values()]]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["o", "c", "n", "types"])

    seen = found.select("n", "likes").mapInArrow(run, "o string, c string, n long, types long").groupBy("o", "c")
    rows = seen.agg(F.sum("n").alias("n"), F.sum("types").alias("types")).where(F.col("types") >= config.least_types).collect()
    written: Counter = Counter()
    for w, n in strong.items():
        for i in range(len(w)):
            written[w[i]] += n
            written[w[i : i + 2]] += n
    letters = sum(n for c, n in written.items() if len(c) == 1)
    rates = {(r.o, r.c): r.n / max(1, written[r.c] if r.c else letters) for r in rows}
    # Scanners confuse alike characters at about the same rate; what is far rarer is chance.
    pure = sorted((p for (o, c), p in rates.items() if c and not SIGN.search(o)), reverse=True)[:15]
    typical = pure[len(pure) // 2] if pure else 0.0
    return {k: p for k, p in rates.items() if p >= config.least_rate and (SIGN.search(k[0]) or p >= config.typical_ratio * typical)}


@dataclass
class Channel:
    """Everything that decodes a line."""

    words: dict[str, int]  # known words and their counts
    total: int
    confusions: dict[str, list[tuple[str, float]]]  # read -> (written, probability)
    pairs: np.ndarray  # sorted keys of frequent word pairs
    pair_counts: np.ndarray
    letters: dict[str, int]  # counts of letter trigrams over word types, for unknown words
    contexts: dict[str, int]
    unknown: float  # share of words that aren't known
    headers: dict[str, dict[str, int]]
    config: ScanConfig

    def __post_init__(self) -> None:
        self.ids = {w: k for k, w in enumerate(self.words)}
        self.size = len(self.ids) + 1
        self.alphabet = max(30, len({g[-1] for g in self.letters}))
        self.memory: dict[tuple[str, bool], list[tuple[str, float, bool]]] = {}
        self.by_version: dict[str, Headers] = {}
        self.following: dict[str, list[str]] = {}
        for g in self.letters:
            if g[-1] != "$":
                self.following.setdefault(g[:2], []).append(g[-1])
        self.sign_rate = max(self.config.misread_rate, sum(p for o, cs in self.confusions.items() if SIGN.search(o) for _, p in cs))
        self.tokens: dict[str, tuple[str, bool, bool]] = {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def spelled(self, word: str) -> float:
        """Log probability of an unknown word by its letters."""
        out = 0.0
        padded = f"^^{word}$"
        for i in range(2, len(padded)):
            out += math.log((self.letters.get(padded[i - 2 : i + 1], 0) + 0.02) / (self.contexts.get(padded[i - 2 : i], 0) + 0.02 * self.alphabet))
        return out

    def token(self, w: str) -> tuple[str, bool, bool]:
        """Core of a token, whether it holds a sign, and whether nothing about it is in doubt."""
        if len(self.tokens) > 300_000:
            self.tokens.clear()
        core = word_core(w)
        sign = has_sign(w)
        found = self.tokens[w] = core, sign, not sign and (not core or core in self.words)
        return found

    def headers_of(self, version: str) -> Headers:
        if version not in self.by_version:
            self.by_version[version] = Headers(self.headers.get(version, ()))
        return self.by_version[version]

    def candidates(self, word: str, sign: bool = False) -> list[tuple[str, float, bool]]:
        """(word, log probability of reading it so and of the word by itself, misread) of what may have been written.
        sign: a sign stands within the word, so it may have been read for or between its letters."""
        known = self.memory.get((word, sign))
        if known is not None:
            return known
        if len(self.memory) > 300_000:
            self.memory.clear()
        n = self.words.get(word, 0)
        keep = math.log(n / self.total) if n else math.log(self.unknown) + self.spelled(word)
        out = [(word, keep + math.log(1 - self.config.misread_rate), False)]
        if not n and sum(map(str.isalpha, word)) > 1:
            out += [(w, math.log(self.words[w] / self.total) + math.log(p), True) for w, p in self.written(word).items()]
        if sign and (bare := SIGN.sub("", word)) and bare != word:
            # The sign was read between two letters, or for a letter that is known to follow the two before it.
            k = SIGN.search(word).start()
            head, tail = word[:k], SIGN.sub("", word[k:])
            options = {bare, *(head + c + tail for c in self.following.get(f"^^{head}"[-2:], ()))}
            rate = math.log(min(0.5, self.sign_rate) / len(options))
            for w in options:
                n = self.words.get(w, 0)
                out.append((w, (math.log(n / self.total) if n else math.log(self.unknown) + self.spelled(w)) + rate, True))
            out[1:] = sorted(out[1:], key=lambda x: (-x[1], x[0]))[: self.config.sign_options]
        self.memory[word, sign] = out
        return out

    def written(self, word: str) -> dict[str, float]:
        found: dict[str, float] = {}
        for i in range(len(word)):
            for size in (1, 2):
                o = word[i : i + size]
                if len(o) < size:
                    continue
                for c, p in self.confusions.get(o, ()):
                    w = word[:i] + c + word[i + size :]
                    if w in self.words and p > found.get(w, 0):
                        found[w] = p
        return found

    def pair(self, a: str, b: str) -> float:
        """Log of how much likelier ``b`` is after ``a`` than by itself."""
        i, j = self.ids.get(a, -1), self.ids.get(b, -1)
        if i < 0 or j < 0 or not len(self.pairs):
            return 0.0
        key = i * self.size + j
        k = int(np.searchsorted(self.pairs, key))
        n = int(self.pair_counts[k]) if k < len(self.pairs) and self.pairs[k] == key else 0
        expected = self.words[a] * self.words[b] / self.total
        return math.log((n + 1.0) / (expected + 1.0)) if n or expected > 4 else 0.0

    def decode(self, words: list[str], signs: list[bool]) -> list[tuple[str, bool]]:
        """What was most likely written for each word of a line, and whether it was misread (Viterbi). signs: whether a
        sign stands within the word."""
        options = [self.candidates(w, sign) for w, sign in zip(words, signs)]
        if all(len(o) == 1 for o in options):
            return [(o[0][0], False) for o in options]
        score = [s for _, s, _ in options[0]]
        back: list[list[int]] = []
        for k in range(1, len(options)):
            now, via = [], []
            for w, s, _ in options[k]:
                best, arg = max((score[q] + self.pair(v[0], w), -q) for q, v in enumerate(options[k - 1]))
                now.append(best + s)
                via.append(-arg)
            score = now
            back.append(via)
        at_ = max(range(len(score)), key=score.__getitem__)
        path = [at_]
        for via in reversed(back):
            path.append(via[path[-1]])
        path.reverse()
        out = []
        for o, q in zip(options, path):
            w, s, misread = o[q]
            sure = misread and 1 / (1 + math.exp(min(50, o[0][1] - s))) >= self.config.certain
            out.append((w, True) if sure else (o[0][0], False))
        return out


def has_sign(token: str) -> bool:
    """A sign or digit stands within or at the edge of a word's letters, where no punctuation belongs."""
    if not SIGN.search(token) or not LETTER.search(token):
        return False
    if WIDE.search(token):  # words aren't set apart, numbers and quotation marks stand among them
        return bool(WIDE_SIGN.search(token))
    bare = token.lstrip(OPENERS).rstrip(CLOSERS)
    if not ARABIC.search(bare):
        bare = bare.strip("«»").lstrip(OPENERS).rstrip(CLOSERS)
    if not SIGN.search(bare) or sum(map(str.isalpha, bare)) < 2:
        return False
    bare = re.sub(r"(?<=[^\W\d_])[!?](?=[^\W\d_]{4,})", " ", bare) if "." not in bare else bare  # two words run together
    return bool(SIGN.search(bare))


SURE = itemgetter(2)


def _mended(token: str, core: str, written: str) -> str:
    """The token with its core as it was written."""
    k = token.lower().find(core)
    return token[:k] + written + token[k + len(core) :] if k >= 0 else written


def inspect(text: str, version: str | None, channel: Channel) -> tuple[dict[str, int], str]:
    """How often each noise occurs in a text, and the text repaired into paragraphs."""
    lines = classify(text, channel.headers_of(version or ""), channel.config)
    counts = {"pageno": sum(x.kind == "pageno" for x in lines), "header": sum(x.kind == "header" for x in lines)}
    joined, counts["hyphen"] = join_lines(lines)
    misread = 0
    paragraphs: list[list[str]] = [[]]
    if lines and lines[0].kind == "heading":
        paragraphs = [[lines[0].text.strip()], []]
    for words in joined:
        if not words:
            paragraphs.append([])
            continue
        tokens = [channel.tokens.get(w) or channel.token(w) for w in words]
        if not all(map(SURE, tokens)):
            cores = [t[0] for t in tokens]
            signs = [t[1] for t in tokens]
            decided = any(signs) or any(c and c not in channel.words for c in cores)
            for k, (c, (best, bad)) in enumerate(zip(cores, channel.decode(cores, signs) if decided else [(c, False) for c in cores])):
                if bad:
                    misread += 1
                    words[k] = _mended(words[k], c, best)
        paragraphs[-1] += words
    counts["misread"] = misread
    return counts, "\n\n".join(" ".join(p) for p in paragraphs if p)


def word_pairs(df: DataFrame, text: str, words: dict[str, int], config: ScanConfig) -> DataFrame:
    """pair (first id * (size + 1) + second id) and n of neighbouring known words over all rows."""
    ids = {w: k for k, w in enumerate(words)}
    shared = df.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        size = len(ids) + 1
        keys, held = [], 0
        cores: dict[str, int] = {}
        for batch in batches:
            for part in at.slices(batch, [text]):
                for value in shown(part.column(0)):
                    if not value:
                        continue
                    line = []
                    for w in value.split():
                        k = cores.get(w)
                        if k is None:
                            if len(cores) > 300_000:
                                cores.clear()
                            k = cores[w] = ids.get(word_core(w), -1)
                        line.append(k)
                    a = np.array(line, np.int64)
                    both = (a[:-1] >= 0) & (a[1:] >= 0)
                    keys.append((a[:-1] * size + a[1:])[both])
                    held += len(keys[-1])
                if held > 2_000_000:
                    yield emit(keys)
                    keys, held = [], 0
        yield emit(keys)

    def emit(keys: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return df.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str, version: str, config: ScanConfig = ScanConfig()) -> Channel:
    """Counts over all rows of scanned profiles. Collected are at most 1 / least_share words, 1 / bigram_share pairs,
    header_most headers and the confusions."""
    stats = settle(statistics(df, text, version, config))
    words = stats.where("kind = 'w'")
    total = words.agg(F.sum("n")).collect()[0][0] or 1
    floor = max(config.least_count, math.ceil(config.least_share * total))
    known = {r.key: r.n for r in words.where(F.col("n") >= floor).select("key", "n").collect()}
    known = {w: known[w] for w in sorted(known) if not SIGN.search(w) or w.isdigit()}
    strong = {w: n for w, n in known.items() if n >= config.strong_ratio and len(w) >= 3 and all(map(str.isalpha, w.replace("'", "")))}
    found = settle(resemblances(words, config))
    rates = learn_confusions(found, strong, config)
    for _ in range(config.rounds):
        rates = learn_confusions(found, strong, config, rates)
    confusions: dict[str, list[tuple[str, float]]] = {}
    for (o, c), p in rates.items():
        confusions.setdefault(o, []).append((c, p))
    channel = Channel(known, total, confusions, np.zeros(0, np.int64), np.zeros(0, np.int64), {}, {}, 0.01, {}, config)
    # A known word that a confusion of a far more frequent word accounts for isn't one.
    for w in list(known):
        explained = sum(p * known[v] for v, p in channel.written(w).items() if known.get(v, 0) >= config.strong_ratio * known[w])
        if explained * 3 + 1 >= known[w]:
            del channel.words[w]
    letters: Counter = Counter()
    contexts: Counter = Counter()
    for w in channel.words:
        padded = f"^^{w}$"
        for i in range(2, len(padded)):
            letters[padded[i - 2 : i + 1]] += 1
            contexts[padded[i - 2 : i]] += 1
    pairs = word_pairs(df, text, channel.words, config)
    least = max(2, math.ceil(config.bigram_share * total))
    kept = pairs.where(F.col("n") >= least).toArrow()
    order = np.argsort(kept["pair"].to_numpy(), kind="stable")
    headers = recurring_headers(stats, config)
    unknown = max(1e-4, 1 - sum(channel.words.values()) / total)
    return Channel(channel.words, total, confusions, kept["pair"].to_numpy()[order], kept["n"].to_numpy()[order], dict(letters), dict(contexts), unknown, headers, config)


def repaired(df: DataFrame, key: str, text: str, version: str, channel: Channel, with_text: bool = True) -> DataFrame:
    """key, n_hyphen, n_misread, n_header, n_pageno and, if asked for, repaired_text of each row.

    Null texts give no noise and a null repair; texts are read whole; other columns are not read; repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(channel)
    fields = [df.schema[key], *(T.StructField(f"n_{x}", T.IntegerType()) for x in NOISES)]
    schema = T.StructType([*fields, *([T.StructField("repaired_text", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in at.slices(batch, [text]):
                counts, texts = [], []
                for value, v in zip(shown(part.column(1)), part.column(2).to_pylist()):
                    n, fixed = inspect(value, v, model) if value else (dict.fromkeys(NOISES, 0), value)
                    counts.append([n[x] for x in NOISES])
                    texts.append(fixed)
                array = np.array(counts, np.int32).reshape(-1, len(NOISES))
                out = [part.column(0), *(pa.array(array[:, k]) for k in range(len(NOISES)))]
                if with_text:
                    valid = part.column(1).is_valid().to_pylist()
                    out.append(pa.array([t if ok else None for t, ok in zip(texts, valid)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.select(key, text, version).mapInArrow(run, schema)


def noises(df: DataFrame, key: str, text: str, version: str, profile: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """key and noise for each kind of noise in the rows of scanned profiles."""
    scanned = df.where(F.col(profile).isin(*config.profiles) & F.col(text).isNotNull())
    found = repaired(scanned, key, text, version, fit(scanned, text, version, config), with_text=False)
    kinds = F.array(*(F.when(F.col(f"n_{x}") > 0, F.lit(x)) for x in NOISES))
    return found.select(key, F.explode(F.array_compact(kinds)).alias("noise")).distinct()
