"""Sentence boundaries across languages and scripts.

Method: every end mark is a candidate boundary, classified by a maximum-entropy model over its surroundings:
the tokens before and after, their case, length, digits and script, and how they behave over the whole corpus.
The model is trained on boundaries that are reliable by themselves: marks at the end of a paragraph are
sentence ends; marks within numbers and after tokens that never end a paragraph aren't.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at
from folioflow.functions.lineage import settle
from folioflow.llm import canonical

#: End marks, of which the full stop is ambiguous, and quotation marks with those that may close them.
MARKS = ".!?؟۔।॥。！？．｡؛"
WIDE_MARKS = "。！？．｡"
ELLIPSIS = "…"
QUOTES = {"«": "»", "“": "”", "„": "“”", "‘": "’", "「": "」", "『": "』", '"': '"', "»": "«", "‹": "›"}
BRACKETS = ")]}）】"
EDGES = "\"'“”„«»‘’‹›「」『』()[]{}.,;:!?؟،؛۔।…。！？、，；：|"
#: Characters without a picture.
BLANK = "".join(map(chr, (0xAD, 0x200B, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, 0x061C)))

PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
SPECIAL = re.compile("[" + re.escape(MARKS + ELLIPSIS + "".join(QUOTES) + "".join(QUOTES.values())) + "]")
NUMBER = re.compile(r"\d[\d.,٫٬/]*")
BLANKS = re.compile(f"[{BLANK}]")


@dataclass(frozen=True)
class SentenceConfig:
    """Bounds and fixed rates of the model."""

    texts: int = 2000  # bound of the training sample
    chars_per_text: int = 6000
    least_count: int = 3  # corpus statistics of a token are used from so many occurrences before or after a stop ...
    least_share: float = 4e-6  # ... and this share of all stops, so at most 2 / least_share tokens are kept
    never_rate: float = 0.002  # how often a token that can't end (begin) a sentence is seen to do so
    size: int = 4096  # hashed features
    epochs: int = 12
    l2: float = 1e-4
    seed: int = 11


def core(token: str) -> str:
    """A token without marks at its edges, invisible characters and case of form; numbers are one class."""
    token = token.strip(EDGES)
    if not token.isascii():
        token = BLANKS.sub("", token)
    return "#" if NUMBER.fullmatch(token) else token


def count_tokens(texts: list[str]) -> dict[str, list[int]]:
    """token -> occurrences, before a full stop, before one that ends a paragraph, at a paragraph's start, after a stop."""
    every, stop, stop_end, begin, after = Counter(), Counter(), Counter(), Counter(), Counter()
    for text in texts:
        for part in PARAGRAPH.split(text):
            words = part.split()
            if not words:
                continue
            every.update(words)
            stop.update(w for w in words if "." in w[-2:])
            begin[words[0]] += 1
            stop_end[words[-1]] += 1
            after.update(b for a, b in zip(words, words[1:]) if a[-1] in ".…" or "." in a[-2:])
    out: dict[str, list[int]] = {}
    for k, counter in enumerate((every, stop, stop_end, begin, after)):
        for word, n in counter.items():
            if k in (1, 2):
                bare = word.rstrip(EDGES.replace(".", ""))
                if not bare.endswith(".") or bare.endswith(".."):
                    continue
            token = core(word)
            if token:
                out.setdefault(token, [0] * 5)[k] += n
    return out


COUNTS = ("n_all", "n_stop", "n_stop_end", "n_begin", "n_after")


def token_statistics(df: DataFrame, text: str) -> DataFrame:
    """Counts of every token over all rows (see count_tokens); partial sums leave each batch."""
    schema = "token string, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for part in at.slices(batch, [text]):
                shown = at.encode(*canonical.visible_form(*at.decode(part.column(0))))
                for token, counts in count_tokens(shown.to_pylist()).items():
                    have = total.setdefault(token, [0] * 5)
                    for k in range(5):
                        have[k] += counts[k]
                if len(total) > 200_000:
                    yield emit(total)
                    total = {}
        if total:
            yield emit(total)

    def emit(total: dict[str, list[int]]) -> pa.RecordBatch:
        counts = np.array(list(total.values()), np.int64).reshape(-1, 5)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), *(pa.array(counts[:, k]) for k in range(5))], names=["token", *COUNTS]
        )

    counted = df.select(text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
    return counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in COUNTS))


@dataclass
class Boundaries:
    """Corpus statistics and weights that classify a candidate boundary."""

    tokens: dict[str, tuple[int, ...]]
    end_rate: float
    begin_rate: float
    weights: np.ndarray
    config: SentenceConfig
    cache: dict[str, tuple] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _ratio(self, hits: int, n: int, rate: float) -> float:
        never = self.config.never_rate
        return hits * math.log(rate / never) + (n - hits) * math.log((1 - rate) / (1 - never))

    def before(self, token: str) -> tuple[float, str]:
        """How much more likely the token ends sentences than not, and how often it is seen with a full stop."""
        n_all, n_stop, n_end, _, _ = self.tokens.get(token, (0,) * 5)
        share = "rare" if n_all < 4 else str(min(3, int(3.4 * n_stop / n_all)))
        return self._ratio(min(n_end, n_stop), n_stop, self.end_rate), share

    def after(self, token: str) -> float:
        _, _, _, n_begin, n_after = self.tokens.get(token, (0,) * 5)
        return self._ratio(n_begin, n_begin + n_after, self.begin_rate)

    def features(self, mark: str, left: str, right: str, spaced: bool) -> list[int]:
        a, b = core(left), core(right)
        end, share = self.before(a)
        begin = self.after(b) if b else 0.0
        lead = right.strip(BLANK)[:1]
        case = "up" if lead.isupper() else "low" if lead.islower() else "num" if lead.isdigit() else "quote" if lead and lead in QUOTES else "letter" if lead.isalpha() else "other" if lead else "none"
        size = "num" if a == "#" else str(min(5, len(a)))
        inner = "in" if "." in a else ""
        script = "L" if a[:1] < "ɐ" else "A" if "؀" <= a[:1] < "ހ" else "o"
        e, s = max(-6, min(6, round(end))), max(-6, min(6, round(begin)))
        kind = "." if mark == "." else "wide" if mark in WIDE_MARKS else mark
        names = (
            "bias", f"m{kind}", f"g{kind}{spaced}", f"e{kind}{e}", f"r{kind}{share}", f"s{kind}{s}", f"c{kind}{case}", f"z{kind}{size}{inner}",
            f"p{kind}{script}{size}", f"ec{e}{case}", f"rz{share}{size}{inner}", f"es{e // 3}{s // 3}", f"n{a == '#'}{s}", f"u{kind}{a.isupper()}{len(a) == 1}{case}",
        )
        return [hash_of(x, self.config.size) for x in names]

    def is_end(self, mark: str, left: str, right: str, spaced: bool) -> bool:
        return float(self.weights[self.features(mark, left, right, spaced)].sum()) > 0


def hash_of(name: str, size: int) -> int:
    value = 2166136261
    for ch in name:
        value = ((value ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return (value ^ value >> 15) % size


@dataclass
class Candidate:
    end: int  # after the mark and what closes after it
    mark: str
    left: str
    right: str
    spaced: bool
    last: bool  # nothing but space follows in the paragraph


def candidates(part: str) -> Iterator[Candidate]:
    """Candidate boundaries of one paragraph. Marks within a quotation are none; the mark before its end is."""
    n = len(part)
    at_, closer, opened = 0, "", -1
    while m := SPECIAL.search(part, at_):
        k, ch = m.start(), m.group()
        at_ = k + 1
        if closer:
            if ch in closer and not (ch == "’" and part[k + 1 : k + 2].isalpha()):
                closer = ""
                inner = part[opened + 1 : k].rstrip().rstrip(BLANK)
                if inner and inner[-1] in MARKS and not inner.endswith(".."):
                    end = k + 1
                    follow = part[end:].lstrip(BLANK)[:1]
                    if not follow or follow not in MARKS + ELLIPSIS:
                        yield _candidate(part, end, inner[-1], inner[:-1])
            continue
        if ch in QUOTES and _opens(part, k, ch):
            closer, opened = QUOTES[ch], k
            continue
        if ch not in MARKS:
            continue
        run = k + 1
        while run < n and part[run] in MARKS + ELLIPSIS + BLANK:
            run += 1
        marks = part[k:run].rstrip(BLANK)
        end = k + len(marks)
        at_ = run
        if "…" in marks or ".." in marks or part[max(0, k - 1) : k] == "…":
            continue
        while end < n and (part[end] in BRACKETS or part[end] in "\"”’»“" and not _opens(part, end, part[end])):
            end += 1
        at_ = max(at_, end)
        yield _candidate(part, end, marks[-1] if marks[-1] != "." else marks[0], part[:k])


def _opens(part: str, k: int, ch: str) -> bool:
    if ch not in QUOTES:
        return False
    before, after = part[k - 1 : k], part[k + 1 : k + 2]
    if ch in "»“'" and (before and not before.isspace() and before not in ":：(" or ch == "»" and not after.strip()):
        if not (ch == "“" and before in MARKS + "，,、"):
            return False
    if ch == "»" and after.isspace():
        return False
    if ch == '"' and before and (before in MARKS) and (not after or after.isspace()):
        return False
    return any(c in part[k + 1 :] for c in QUOTES[ch])


def _candidate(part: str, end: int, mark: str, before: str) -> Candidate:
    tail = before[-60:].rstrip(EDGES.replace(".", "") + BLANK)
    left = tail.split()[-1] if tail.split() else ""
    rest = part[end:]
    bare = rest.lstrip(BLANK)
    right = bare[:80].split(None, 1)[0] if bare.strip() else ""
    return Candidate(end, mark, left, right, not bare or bare[0].isspace(), not bare.strip())


def sentence_ends(text: str, verse: bool, model: Boundaries) -> list[int]:
    """Code points from the start of the text through the last character of each sentence."""
    out: list[int] = []
    if not text.strip():
        return out
    if verse:
        at_ = 0
        for line in text.split("\n"):
            size = len(line.rstrip())
            if size:
                out.append(at_ + size)
            at_ += len(line) + 1
    else:
        at_ = 0
        for part in [*PARAGRAPH.finditer(text), None]:
            stop = part.start() if part else len(text)
            piece = text[at_:stop]
            size = len(piece.rstrip())
            if size:
                out += [at_ + c.end for c in candidates(piece[:size]) if not c.last and model.is_end(c.mark, c.left, c.right, c.spaced)]
                out.append(at_ + size)
            at_ = part.end() if part else stop
    out[-1] = len(text)
    return out


def reliable(texts: list[str], model: Boundaries) -> tuple[list[list[int]], list[int]]:
    """Features and labels of the candidates whose kind is plain without a model."""
    xs, ys = [], []
    for text in texts:
        parts = PARAGRAPH.split(text)
        for k, part in enumerate(parts):
            part = part.strip()
            follow = parts[k + 1].split(None, 1)[0] if k + 1 < len(parts) and parts[k + 1].strip() else ""
            for c in candidates(part):
                a, b = core(c.left), core(c.right)
                end, share = model.before(a)
                n_all, n_stop, n_end, _, _ = model.tokens.get(a, (0,) * 5)
                label = None
                if c.last:
                    label, right, spaced = 1, follow, True
                else:
                    right, spaced = c.right, c.spaced
                    wide = c.mark in WIDE_MARKS
                    if not spaced and not wide and c.right[:1].isalnum():
                        label = 0
                    elif c.mark != ".":
                        label = 1
                    elif c.right[:1].islower() and end < 1 or end < -4 or share == "3" and n_stop >= 8 and not n_end:
                        label = 0
                    elif a == "#" and model.after(b) < -3:
                        label = 0
                    elif n_end and share == "0" and (model.after(b) > 1 or c.right[:1].isupper() and model.after(b) > -2):
                        label = 1
                if label is not None:
                    xs.append(model.features(c.mark, c.left, right, spaced))
                    ys.append(label)
    return xs, ys


def fit(statistics: list[tuple], texts: list[str], config: SentenceConfig) -> Boundaries:
    """Trains the maximum-entropy model on the reliable boundaries of ``texts`` by averaged gradient steps."""
    tokens = {row[0]: tuple(row[1:6]) for row in statistics}
    total = np.array(list(tokens.values()), np.float64).reshape(-1, 5).sum(0)
    rate = lambda hits, n: min(0.5, max(0.02, hits / n if n else 0.1))
    model = Boundaries(tokens, rate(total[2], total[1]), rate(total[3], total[3] + total[4]), np.zeros(config.size), config)
    xs, ys = reliable(texts, model)
    if not xs:
        model.weights[hash_of("bias", config.size)] = 1.0
        return model
    x, y = np.array(xs), np.array(ys, np.float64)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    rng = np.random.default_rng(config.seed)
    w, squares = np.zeros(config.size), np.full(config.size, 1e-6)
    for _ in range(config.epochs):
        for take in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            p = 1 / (1 + np.exp(-np.clip(w[x[take]].sum(1), -30, 30)))
            g = np.zeros(config.size)
            np.add.at(g, x[take].ravel(), np.repeat((p - y[take]) * weight[take] / len(take), x.shape[1]))
            g += config.l2 * w
            squares += g * g
            w -= 0.3 * g / np.sqrt(squares)
    model.weights = w
    return model


def boundary_model(df: DataFrame, key: str, text: str, prose: Column, config: SentenceConfig = SentenceConfig()) -> Boundaries:
    """Statistics over all prose rows, weights from a bounded sample of them drawn by hash of the key.

    Collected are at most ``2 / least_share`` token counts and ``texts`` texts.
    """
    rows = df.where(prose & F.col(text).isNotNull())
    counted = token_statistics(rows, text)
    counted = settle(counted)
    stops = counted.agg(F.sum("n_stop")).collect()[0][0] or 0
    least = max(config.least_count, math.ceil(stops * config.least_share))
    kept = counted.where((F.col("n_stop") >= least) | (F.col("n_after") >= least))
    statistics = [tuple(r) for r in kept.select("token", *COUNTS).collect()]
    n = rows.count()
    share = min(1.0, 3.0 * config.texts / max(1, n))
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = rows.where(drawn).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.substring(text, 1, config.chars_per_text).alias("t"))
    texts = [r.t for r in sample.orderBy("h", "k", "t").limit(config.texts).collect()]
    return fit(statistics, texts, config)


def sentences(df: DataFrame, key: str, text: str, verse: Column, model: Boundaries, with_text: bool = False) -> DataFrame:
    """One row per sentence: key, sent_no (from 0), start_char, end_char and, if asked for, sentence.

    ``verse`` rows have one sentence a line. Null, empty and blank texts have none; other columns are not read;
    rows with the same key are cut each by itself. Offsets count code points of the text as it is.
    """
    fields = [df.schema[key], T.StructField("sent_no", T.IntegerType(), False)]
    fields += [T.StructField(c, T.LongType(), False) for c in ("start_char", "end_char")]
    schema = T.StructType([*fields, *([T.StructField("sentence", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, [text]):
                row, number, start, end, cut = [], [], [], [], []
                flags = part.column(2).to_pylist()
                for k, value in enumerate(part.column(1).to_pylist()):
                    last = 0
                    for q, stop in enumerate(sentence_ends(value or "", bool(flags[k]), model)):
                        while last < stop and value[last].isspace():
                            last += 1
                        row.append(k)
                        number.append(q)
                        start.append(last)
                        end.append(stop)
                        if with_text:
                            cut.append(value[last:stop])
                        last = stop
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cut, pa.string())] if with_text else []), names=schema.names)

    return df.select(key, text, verse.alias("__verse")).mapInArrow(run, schema)

