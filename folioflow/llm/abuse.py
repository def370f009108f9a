"""Abusive, hateful or sexual content: a score of every document and category, and rates per source.

Method: the lexicon is a trie; its intersection with Levenshtein automata is walked letter by letter and made
deterministic as it is used, so misspelled, starred and stretched terms are found at the price of a table look-up.
A term alone decides nothing: within a window of a clause, terms and the words that direct them at someone add up,
and words that define, report or condemn take away; what remains above a threshold is abuse rather than quotation.

The lexicon is learned. A short general word list stands for what is known beforehand; terms, context words and all
weights come from a bounded sample of reviewed documents. A review tells a document, not the clause, so the clauses
that bear the label are chosen and the weights fitted in turn; reviews that no clause supports are set aside.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at
from folioflow.llm import canonical

CATEGORIES = ("abuse", "hate", "sexual")

# General words known beforehand, in consistent form, lower case. They only say where fitting starts.
SEEDS = {
    "abuse": "idiot moron imbecile bastard asshole bitch scum stupid worthless احمق ابله حرامزاده نفهم کثافت غبی سافل حقیر aptal salak şerefsiz "
    "idiotin arschloch dummkopf schwachkopf connard imbécile salaud abruti حرامی کمینه بیوقوف मूर्ख कमीना हरामी 白痴 混蛋",
    "hate": "vermin subhuman subhumans untermenschen ungeziefer vermine haşere حشرات موش نجس انجاس حیوان کیڑے नीच 害虫",
    "sexual": "fuck fucking penis orgasm naked nude breasts porn sex شهوت سکس برهنه orgasmus nackt nackte nu nue seins çıplak ننگا नंगा 裸体",
}
DENIALS = "dictionary glossary insult slander condemns lexique wörterbuch sözlük دشنام تهمت گالی"

LEET = str.maketrans("0134579@$", "oieastgas")
TOKEN = re.compile(r"[\w*@$]+")
CLAUSE = re.compile(r"[.!?؟۔।。！？؛|]+|\n\s*\n|%~%")
STRETCH = re.compile(r"(.)\1{2,}")
DOUBLE = re.compile(r"(.)\1+")
WIDE = re.compile("[぀-鿿]")
SPELLED = re.compile(r"(?<![\w*])\w(?:([ ._\-])\w)(?:\1\w)+(?![\w*])")


class Memory(dict):
    """word -> what ``look_up`` finds for it, at most ``size`` words at a time."""

    def __init__(self, look_up, size: int) -> None:
        super().__init__()
        self.look_up, self.size = look_up, size

    def __missing__(self, word: str):
        if len(self) >= self.size:
            self.clear()
        found = self[word] = self.look_up(word)
        return found


@dataclass(frozen=True)
class AbuseConfig:
    threshold: float = 0.0  # log odds from which a window counts
    shown_from: float = -1.0  # log odds from which a score is shown at all
    window: int = 12  # words within which evidence adds up
    reach: int = 6  # words around it in which context may deny it
    fuzzy_from: int = 5  # letters from which a term may be misspelled by one edit
    fuzzy_weight: float = 0.8  # weight from which a word is a term, which may be misspelled; others are context
    plain_count: int = 3  # a word seen so often in clean reviewed documents is itself, not a misspelling
    cache: int = 400_000  # words a worker remembers
    # Bounds of the reviewed sample and settings of fitting
    labelled: int = 1500  # reviewed documents of each category ...
    clean: int = 8000  # ... those reviewed as clean ...
    unread: int = 4000  # ... those not reviewed ...
    chars_per_text: int = 20_000  # ... and code points of each
    least_documents: int = 2  # reviewed documents of a category that must hold a new word
    least_odds: float = 1.2  # log of how much more often than in the corpus they must hold it ...
    least_surprise: float = 4.0  # ... and how surprising (log likelihood ratio) that must be
    shared_rate: float = 0.8  # of the share of documents in the category that holds a word most
    seed_weight: float = 1.5
    denial_weight: float = -1.5
    bias: float = -3.0
    unread_weight: float = 0.5  # of a clause that nobody read, taken as clean
    spread: float = 1.0  # standard deviation of weights around where they start
    passes: int = 2  # the later ones with unread documents that are beyond doubt
    beyond_doubt: float = 1.5  # log odds above the threshold
    plateau: float = 0.004  # thresholds of so nearly the best quality are equally good; their middle is taken
    false_cost: float = 2.0  # of a clean document taken for abusive, against one missed
    rounds: int = 3  # of choosing clauses and fitting weights
    steps: int = 60  # of gradient descent in each
    kept: float = 0.1  # weights nearer to 0 are dropped


class TermAutomaton:
    """Trie of terms intersected with Levenshtein automata, determinized lazily."""

    def __init__(self, terms: dict[str, int]) -> None:
        """terms: word -> edits it may have."""
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.allowed = [0]
        for word, edits in terms.items():
            node = 0
            path = [0]
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.allowed.append(0)
                node = self.children[node][ch]
                path.append(node)
            self.word[node] = word
            for p in path:
                self.allowed[p] = max(self.allowed[p], edits)
        self.edits = terms
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.first = self._state({0: 0})

    def _state(self, costs: dict[int, int]) -> int:
        todo = list(costs.items())
        while todo:  # a letter of the term may be missing
            node, cost = todo.pop()
            if cost != costs[node]:
                continue
            for child in self.children[node].values():
                if cost + 1 <= self.allowed[child] and cost + 1 < costs.get(child, 9):
                    costs[child] = cost + 1
                    todo.append((child, cost + 1))
        key = tuple(sorted(costs.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.known[key]

    def _step(self, state: int, ch: str) -> int:
        costs: dict[int, int] = {}

        def put(node: int, cost: int) -> None:
            if cost <= self.allowed[node] and cost < costs.get(node, 9):
                costs[node] = cost

        for node, cost in self.states[state]:
            put(node, cost + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, cost if letter == ch or ch == "*" else cost + 1)
        return self._state(costs) if costs else -1

    def match(self, word: str) -> list[str]:
        """Terms within their edits of the word; ``*`` stands for any letter."""
        state = self.first
        for ch in word:
            steps = self.steps[state]
            following = steps.get(ch)
            if following is None:
                following = steps[ch] = self._step(state, ch)
            if following < 0:
                return []
            state = following
        found = [(cost, self.word[node]) for node, cost in self.states[state] if self.word[node] and cost <= self.edits[self.word[node]]]
        if not found:
            return []
        best = min(c for c, _ in found)
        return [w for c, w in found if c == best]


@dataclass(frozen=True)
class Lexicon:
    """What decides: weights of words by category, the odds that evidence must overcome, words that are no misspelling."""

    weights: dict[str, dict[str, float]]
    bias: dict[str, float]
    plain: frozenset[str] = frozenset()


def seed_lexicon(config: AbuseConfig = AbuseConfig()) -> Lexicon:
    denials = dict.fromkeys(DENIALS.split(), config.denial_weight)
    return Lexicon({c: {**denials, **dict.fromkeys(SEEDS[c].split(), config.seed_weight)} for c in CATEGORIES}, dict.fromkeys(CATEGORIES, config.bias))


def split_words(clause: str) -> list[str]:
    """Words of a clause; a run of a script without spaces gives its pairs of letters."""
    if not WIDE.search(clause):
        return TOKEN.findall(clause)
    out = []
    for w in TOKEN.findall(clause):
        if len(w) > 2 and WIDE.search(w):
            out += [w[k : k + 2] for k in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def joined(text: str) -> str:
    """The text with spelled-out words joined."""
    return SPELLED.sub(lambda m: m[0].replace(m[1], ""), text)


def clauses(text: str) -> list[list[str]]:
    """Words of every clause of a text in consistent form and lower case, spelled-out words joined first."""
    return [words for c in CLAUSE.split(joined(text)) if (words := split_words(c))]


class Scorer:
    """Lexicon, automaton and a memory of words already looked up."""

    def __init__(self, config: AbuseConfig = AbuseConfig(), lexicon: Lexicon | None = None) -> None:
        self.config = config
        self.lexicon = lexicon or seed_lexicon(config)
        self.weights: dict[str, list[tuple[int, float]]] = {}
        edits: dict[str, int] = {}
        for k, name in enumerate(CATEGORIES):
            for word, w in self.lexicon.weights.get(name, {}).items():
                self.weights.setdefault(word, []).append((k, w))
                term = w >= config.fuzzy_weight and len(word) >= config.fuzzy_from and not WIDE.search(word)
                edits[word] = max(edits.get(word, 0), int(term))
        self.bias = [self.lexicon.bias.get(c, config.bias) for c in CATEGORIES]
        self.automaton = TermAutomaton(edits)
        self.memory = Memory(self._terms, config.cache)

    def __reduce__(self):
        return Scorer, (self.config, self.lexicon)

    def _terms(self, word: str) -> tuple[str, ...]:
        """Lexicon words that a token stands for."""
        if word in self.weights:
            return (word,)
        if word in self.lexicon.plain or WIDE.search(word):
            return ()
        stars = word.count("*")
        if stars and (len(word) < 4 or stars > len(word) - 2 or word[0] == "*"):
            return ()
        found = self.automaton.match(word)
        if not found and any(c.isdigit() or c in "@$" for c in word) and not word.isdigit():
            found = self.automaton.match(word.translate(LEET))
        if not found and STRETCH.search(word):
            found = self.automaton.match(STRETCH.sub(r"\1", word)) or self.automaton.match(STRETCH.sub(r"\1\1", word))
        if not found and DOUBLE.search(word) and len(word) > 3:
            found = [t for t in self.automaton.match(DOUBLE.sub(r"\1", word)) if DOUBLE.sub(r"\1", t) == DOUBLE.sub(r"\1", word)]
        if not found and len(word) >= self.config.fuzzy_from:  # two letters exchanged
            swapped = (word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1))
            found = [t for t in swapped if self.automaton.edits.get(t)]
        return tuple(found)

    def document(self, text: str) -> dict[int, float]:
        """Best log odds of each category over the clauses of a text, where they reach ``shown_from``.

        No clause can reach more than all distinct words of the text together, so most texts need no second look.
        """
        text = joined(text)
        terms = {t for ts in filter(None, map(self.memory.__getitem__, set(split_words(text)))) for t in ts}
        most = list(self.bias)
        for t in terms:
            for k, w in self.weights[t]:
                if w > 0:
                    most[k] += w
        least = self.config.shown_from
        if max(most) < least:
            return {}
        best: dict[int, float] = {}
        for part in CLAUSE.split(text):
            for k, score in self.clause(split_words(part)).items():
                if score >= least and score > best.get(k, -99.0):
                    best[k] = score
        return best

    def clause(self, words: list[str]) -> dict[int, float]:
        plus: dict[int, list[tuple[int, str, float]]] = {}
        minus: dict[int, list[tuple[int, str, float]]] = {}
        for at_, word in enumerate(words):
            told: dict[int, tuple[float, str]] = {}  # a word that may stand for several terms is one of them
            for t in self.memory[word]:
                for k, w in self.weights[t]:
                    told[k] = max(told.get(k, (-99.0, "")), (w, t))
            for k, (w, t) in told.items():
                (plus if w > 0 else minus).setdefault(k, []).append((at_, t, w))
        out = {}
        for k, marks in plus.items():
            for q, (start, _, _) in enumerate(marks):
                inside = [m for m in marks[q:] if m[0] - start <= self.config.window]
                end = inside[-1][0]
                near = [m for m in minus.get(k, ()) if start - self.config.reach <= m[0] <= end + self.config.reach]
                each = {t: w for _, t, w in inside} | {t: w for _, t, w in near}
                score = self.bias[k] + sum(each.values())
                if score > out.get(k, -99.0):
                    out[k] = score
        return out


@dataclass(frozen=True)
class Background:
    """Documents of the whole corpus and, of the words asked for, how many of them hold each."""

    size: int
    holding: dict[str, int]


def words_asked(reviews: list[tuple[str, str]], config: AbuseConfig = AbuseConfig()) -> set[str]:
    """Words that enough reviewed documents of a category hold: those that may become terms."""
    seen: dict[str, Counter] = {c: Counter() for c in CATEGORIES}
    for text, label in reviews:
        if label in seen:
            seen[label].update({w for words in clauses(text) for w in words})
    return {w for counts in seen.values() for w, n in counts.items() if n >= config.least_documents and not w.isdigit()}


class Sample:
    """Reviewed documents as clauses of numbered words: small in memory, and most clauses are passed over by a few array
    operations."""

    def __init__(self, reviews: list[tuple[str, str]]) -> None:
        self.label = np.array([label for _, label in reviews], object)
        ids: dict[str, int] = {}
        flat, size, owner = array("i"), array("i"), array("i")
        for d, (text, _) in enumerate(reviews):
            for words in clauses(text):
                flat.extend([ids.setdefault(w, len(ids)) for w in words])
                size.append(len(words))
                owner.append(d)
        self.names = list(ids)
        self.owner, self.flat = np.array(owner, np.int64), np.array(flat, np.int64)
        self.off = np.concatenate(([0], np.cumsum(np.array(size, np.int64))))
        self.n_clauses = len(self.owner)
        self.row = np.repeat(np.arange(self.n_clauses), np.diff(self.off))
        held = np.unique(self.owner[self.row] * (len(ids) + 1) + self.flat) if len(self.flat) else np.zeros(0, np.int64)
        self.doc_of, self.word_of = held // (len(ids) + 1), held % (len(ids) + 1)  # distinct words of documents

    def words(self, clause: int) -> list[str]:
        return [self.names[k] for k in self.flat[self.off[clause] : self.off[clause + 1]].tolist()]

    def holding(self, docs: np.ndarray) -> np.ndarray:
        """How many of the documents (a mask) hold each word."""
        return np.bincount(self.word_of[docs[self.doc_of]], minlength=len(self.names))

    def speaking(self, weights: np.ndarray, docs: np.ndarray, least: float) -> np.ndarray:
        """Clauses of the documents whose words have at least this weight together."""
        total = np.bincount(self.row, weights[self.flat], self.n_clauses)
        return np.flatnonzero((total >= least) & docs[self.owner])

    def best(self, scorer: "Scorer", category: str, docs: np.ndarray, least: float) -> np.ndarray:
        """Best log odds of each document's clauses; documents where none reaches ``least`` have -99."""
        k = CATEGORIES.index(category)
        gain = np.array([max((w for t in scorer.memory[n] for j, w in scorer.weights[t] if j == k and w > 0), default=0.0) for n in self.names])
        out = np.full(len(self.label), -99.0)
        for c in self.speaking(gain, docs, least - scorer.bias[k]).tolist():
            z = scorer.clause(self.words(c)).get(k, -99.0)
            out[self.owner[c]] = max(out[self.owner[c]], z)
        return np.where(out >= least, out, -99.0)


def fit(reviews: list[tuple[str, str]], everywhere: Background, config: AbuseConfig = AbuseConfig()) -> Lexicon:
    """A lexicon from reviewed documents: (text in consistent form and lower case; category, 'ok' or 'unread').

    A word becomes a candidate if documents of a category hold it far more often than the corpus does, and no other
    category's do. The odds that evidence must overcome are set on documents that took no part in fitting (two halves
    in turn). Unread documents that are then beyond doubt join the category, and all is fitted again.
    """
    sample = Sample(reviews)
    others = ~np.isin(sample.label, CATEGORIES)
    counts = np.bincount(sample.flat[others[sample.owner[sample.row]]], minlength=len(sample.names)) if len(sample.flat) else np.zeros(0)
    plain = frozenset(n for n, k in zip(sample.names, counts) if k >= config.plain_count)
    # Documents of the corpus that hold each word; of words that weren't counted there, as the sample has it.
    guess = sample.holding(others) * everywhere.size / max(1, others.sum())
    known = np.array([everywhere.holding.get(n, g) for n, g in zip(sample.names, guess)])
    # A document reviewed as one category may hold another, too: a word speaks for the category whose reviewed
    # documents hold it most often, and for others only where they hold it nearly as often.
    rates = np.stack([(sample.holding(sample.label == c) + 0.5) / ((sample.label == c).sum() + 1) for c in CATEGORIES])
    rates = np.where(np.stack([sample.holding(sample.label == c) > 0 for c in CATEGORIES]), rates, 0.0)
    weights, bias = {}, {}
    for k, c in enumerate(CATEGORIES):
        mine, rest = sample.label == c, others.copy()
        own = rates[k] >= config.shared_rate * rates.max(0)
        for turn in range(config.passes):
            weights[c], bias[c] = _fitted(c, sample, mine, rest, known, own, plain, everywhere.size, config)
            if turn + 1 < config.passes:
                scorer = Scorer(config, Lexicon({c: weights[c]}, {c: bias[c]}, plain))
                unread = rest & (sample.label == "unread")
                sure = unread & (sample.best(scorer, c, unread, config.beyond_doubt) >= config.beyond_doubt)
                mine, rest = mine | sure, rest & ~sure
    return Lexicon(weights, bias, plain - {w for c in CATEGORIES for w, x in weights[c].items() if x >= config.fuzzy_weight})


def _fitted(
    category: str, sample: Sample, mine: np.ndarray, rest: np.ndarray, known: np.ndarray, own: np.ndarray, plain: frozenset[str], size: int, config: AbuseConfig
) -> tuple[dict[str, float], float]:
    """Weights of a category and the bias at which documents that took no part in fitting are told apart best."""
    start = seed_lexicon(config).weights[category]

    def told(docs: np.ndarray) -> dict[str, float]:
        k = sample.holding(docs)
        expected = docs.sum() * (np.maximum(known, k) + 0.5) / (size + 1)
        odds = np.log(np.maximum(k, 1) / np.maximum(expected, 1e-9))
        good = (k >= config.least_documents) & own & (odds >= config.least_odds) & (k * odds - (k - expected) >= config.least_surprise)
        return {sample.names[w]: min(3.0, float(odds[w])) for w in np.flatnonzero(good) if not sample.names[w].isdigit()}

    if not mine.any() or not rest.any():
        return dict(start), config.bias
    weights, bias = _fit_category(sample, mine, rest, told(mine), start, plain, config)
    good, bad = [], []
    at_ = np.arange(len(mine))
    for half in (0, 1):
        side = np.zeros(len(mine), bool)
        side[at_[mine][half::2]] = side[at_[rest][half::2]] = True
        w, b = _fit_category(sample, mine & side, rest & side, told(mine & side), start, plain, config)
        scorer = Scorer(config, Lexicon({category: w}, {category: b}, plain))
        z = sample.best(scorer, category, ~side & (mine | rest), 0.2 + b) - b
        good.append(z[mine & ~side])
        bad.append(z[rest & ~side & (sample.label == "ok")])
    good, bad = np.sort(np.concatenate(good)), np.sort(np.concatenate(bad))
    cuts = np.unique(np.concatenate((good, bad)))
    cuts = cuts[cuts > 0.2]
    if not len(cuts):
        return weights, bias
    hit, false = len(good) - np.searchsorted(good, cuts), len(bad) - np.searchsorted(bad, cuts)
    quality = hit / (hit + false * config.false_cost + (len(good) - hit) + 1e-9)
    near = np.flatnonzero(quality >= quality.max() - config.plateau)
    lowest = cuts[near[0] - 1] if near[0] else cuts[0] * 0.8
    return weights, round(float(-(lowest + cuts[near[-1]]) / 2), 3)


def _fit_category(
    sample: Sample, mine: np.ndarray, others: np.ndarray, told: dict[str, float], start: dict[str, float], plain: frozenset[str], config: AbuseConfig
) -> tuple[dict[str, float], float]:
    """Weights and bias of a category by penalized logistic regression on clauses, alternating with the choice of the
    clauses that bear the label. Only candidates and general words may speak for it; all other words may deny."""
    if not mine.any() or not others.any():
        return dict(start), config.bias
    # Misspelled words of the sample stand for the terms they resemble, as when scoring.
    terms_of = Scorer(config, Lexicon({"abuse": {**dict.fromkeys(told, 1.0), **{w: abs(x) for w, x in start.items()}}}, {}, plain)).memory
    terms = [terms_of[n] for n in sample.names]
    chosen = sample.speaking(np.array([float(bool(t)) for t in terms]), mine | others, 1.0)  # else nothing in it speaks for the category
    if not len(chosen):
        return dict(start), config.bias
    terms_by_name = dict(zip(sample.names, terms))
    ids: dict[str, int] = {}
    rows: list[list[int]] = []  # words of each clause
    for c in chosen.tolist():
        words = sample.words(c)
        rows.append([ids.setdefault(w, len(ids)) for w in {t for w in words for t in terms_by_name[w]}.union(words) if not w.isdigit()])
    doc = sample.owner[chosen]
    flat, row = np.array([x for r in rows for x in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names = list(ids)
    free = np.array([n in told or start.get(n, 0.0) > 0 for n in names])
    # A word of which little is seen stays where it started.
    prior = np.array([start[n] if n in start else min(1.0, told.get(n, 0.0) / 2) for n in names])
    w, b = prior.copy(), config.bias
    positive, unread = mine[doc], (sample.label[doc] == "unread") & ~mine[doc]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    begins, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    for turn in range(config.rounds):
        z = np.bincount(row, w[flat], len(rows)) + b
        best = np.maximum.reduceat(z, begins)[of]
        # The best clause of a labelled document bears the label, and every other that is convincing by itself.
        label = positive & ((z >= best - 1e-9) | (z > 0))
        use = (~positive | label).astype(float)
        use[unread] *= config.unread_weight
        if turn > 0:  # reviews that nothing supports, and clean ones that hold a convincing clause, are set aside
            use[positive & (best < -1.5)] = 0
            use[~positive & (z > 2.0)] = 0
            use[unread & (z > 0)] = 0
        y = label.astype(float)
        weight = use / max(1.0, use.sum())
        pull = 1.0 / (config.spread**2 * max(1.0, use.sum()))
        s_w, s_b = np.zeros(len(w)), 0.0
        for step in range(config.steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(rows)) + b, -30, 30)))
            err = (p - y) * weight
            g_w = np.bincount(flat, err[row], len(w)) + pull * (w - prior)
            g_b = err.sum() + pull * (b - config.bias)
            s_w, s_b = 0.9 * s_w + 0.1 * g_w**2, 0.9 * s_b + 0.1 * g_b**2
            rate = 0.12 * (1 - step / config.steps) + 0.002
            w = w - rate * g_w / (np.sqrt(s_w) + 1e-9)
            b = b - rate * g_b / (math.sqrt(s_b) + 1e-9)
            w = np.where(free, w, np.minimum(w, 0.0))
    found = {n: round(float(x), 3) for n, x in zip(names, w) if abs(x) >= config.kept}
    return {**{n: x for n, x in start.items() if n not in ids}, **found}, round(float(b), 3)


def reviewed_sample(df: DataFrame, key: str, text: str, reviews: DataFrame, config: AbuseConfig = AbuseConfig()) -> list[tuple[str, str]]:
    """At most ``labelled`` documents of each category, ``clean`` clean and ``unread`` unread ones, drawn by hash: (text
    in consistent form, label).

    A document counts as reviewed if all its reviews that say anything agree, as unread if it has none. Only this
    sample is collected.
    """
    told = reviews.where(F.col("label").isin("ok", *CATEGORIES)).groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    texts = df.where(F.col(text).isNotNull()).select(key, F.substring(text, 1, config.chars_per_text).alias("t"))
    unread = df.where(F.col(text).isNotNull()).select(key).join(reviews.select(key), key, "left_anti")
    unread = unread.orderBy(F.xxhash64(key), key).limit(config.unread).select(key, F.lit("unread").alias("label"))
    # Documents are drawn by hash: first those below a bound that leaves about twice as many as are wanted, so that only so
    # few of a label, however frequent it is, are put in order.
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    sizes = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    wanted = {label: config.clean if label == "ok" else config.labelled for label in sizes}
    near = F.lit(False)
    for label, n in sizes.items():
        near |= (F.col("label") == label) & (place < int(min(1.0, (2 * wanted[label] + 100) / n) * (1 << 30)) + 1)
    order = Window.partitionBy("label").orderBy(place, key)
    drawn = told.where(near).withColumn("at", F.row_number().over(order))
    drawn = drawn.where(F.col("at") <= F.when(F.col("label") == "ok", config.clean).otherwise(config.labelled))
    rows = texts.join(F.broadcast(drawn.select(key, "label").unionByName(unread)), key).dropDuplicates([key]).select(key, "t", "label").collect()
    rows.sort(key=lambda r: (r[0], r.label))
    shown = (t for s in range(0, len(rows), 200) for t in plain(pa.array([r.t for r in rows[s : s + 200]], pa.string())))
    return [(t, r.label) for t, r in zip(shown, rows)]


def background(df: DataFrame, text: str, words: set[str]) -> Background:
    """How many documents of the whole corpus hold each of the words; sums leave every task."""
    asked = sorted(words)
    shared = df.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(asked)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        asked_words = set(ids)
        total = [0] * (len(ids) + 1)
        for batch in batches:
            for part in at.slices(batch, [text]):
                for value in plain(part.column(0)):
                    total[len(ids)] += 1
                    for w in asked_words.intersection(split_words(joined(value))) if value else ():
                        total[ids[w]] += 1
        held = [k for k, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([total[k] for k in held], pa.int64())], names=["at", "n"])

    sums = {r["at"]: r["n"] for r in df.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return Background(sums.pop(len(asked), 0), {asked[k]: n for k, n in sums.items()})


def learned_lexicon(df: DataFrame, key: str, text: str, reviews: DataFrame, config: AbuseConfig = AbuseConfig()) -> Lexicon:
    sample = reviewed_sample(df, key, text, reviews, config)
    return fit(sample, background(df, text, words_asked(sample, config)), config)


def held_out_quality(sample: list[tuple[str, str]], everywhere: Background, config: AbuseConfig = AbuseConfig()) -> dict[str, tuple[float, float, int]]:
    """category -> recall, precision and documents on every second reviewed document, learned from the others. Reviews
    may be wrong and name one category of several, so neither can reach 1."""
    scorer = Scorer(config, fit(sample[::2], everywhere, config))
    told = [(label, {k for k, z in scorer.document(t).items() if z >= config.threshold}) for t, label in sample[1::2] if label != "unread"]
    out = {}
    for k, c in enumerate(CATEGORIES):
        mine = [k in found for label, found in told if label == c]
        wrong = sum(k in found for label, found in told if label == "ok")
        out[c] = (round(sum(mine) / max(1, len(mine)), 4), round(sum(mine) / max(1, sum(mine) + wrong), 4), len(mine))
    return out


def plain(col: pa.Array) -> list[str]:
    """Texts in consistent form, lower case, without vowel signs."""
    cp, off = canonical.unite(*at.decode(col))
    drop = (cp >= 0x064B) & (cp <= 0x065F)
    if drop.any():
        cp, off = cp[~drop], at.offsets_of(at.segment_sums(~drop, off))
    whole = at.to_str(cp)
    low = whole.lower()
    if len(low) != len(whole):
        low = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, whole))
    return [low[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def abuse_scores(df: DataFrame, key: str, text: str, lexicon: Lexicon | None = None, config: AbuseConfig = AbuseConfig()) -> DataFrame:
    """key, category, score (a probability) and flagged for every category whose log odds reach ``shown_from``.

    Null, empty and clean texts give no row; texts are read whole; repeated rows give repeated rows; other columns
    are not read. Without a lexicon the general words decide.
    """
    shared = df.sparkSession.sparkContext.broadcast(Scorer(config, lexicon))
    schema = T.StructType(
        [df.schema[key], T.StructField("category", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for part in at.slices(batch, [text]):
                row, kind, odds = [], [], []
                for k, value in enumerate(plain(part.column(1))):
                    if value:
                        for c, z in scorer.document(value).items():
                            row.append(k)
                            kind.append(CATEGORIES[c])
                            odds.append(z)
                z = np.array(odds, np.float64)
                score = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(score), pa.array(z >= config.threshold)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def flagged(df: DataFrame, key: str, text: str, lexicon: Lexicon | None = None, config: AbuseConfig = AbuseConfig()) -> DataFrame:
    return abuse_scores(df, key, text, lexicon, replace(config, shown_from=config.threshold)).where("flagged").select(key, "category").distinct()


def source_rates(df: DataFrame, key: str, text: str, source: str, lexicon: Lexicon | None = None, config: AbuseConfig = AbuseConfig()) -> DataFrame:
    """Per source (trimmed, lower case; 'unknown' where null or blank) and category: documents, flagged ones, rate."""
    name = F.lower(F.trim(F.col(source)))
    named = df.select(key, text, F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name).alias("__source"))
    totals = named.groupBy("__source").agg(F.countDistinct(key).alias("n_docs"))
    kinds = totals.select("__source", "n_docs", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    hit = flagged(named, key, text, lexicon, config).join(named.select(key, "__source").distinct(), key)
    counts = hit.groupBy("__source", "category").agg(F.count("*").alias("n_flagged"))
    out = kinds.join(counts, ["__source", "category"], "left").withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))
    return out.select(F.col("__source").alias("source"), "category", "n_docs", "n_flagged", F.round(F.col("n_flagged") / F.col("n_docs"), 6).alias("rate"))
