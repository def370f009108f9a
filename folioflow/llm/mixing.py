"""Mixing sources to target weights.

Method: min-cost flow. Texts that occur in several sources can fill the quota of any of them, so texts are grouped by
their membership pattern (which sources hold the text); further copies within a source are a pattern of that source.
Token capacity flows from the patterns to the sources' quotas; using a pattern's texts again costs more than the time
before, so repetition is spread as thin as the quotas allow. The network has one node per pattern and source, whatever
the number of texts, copies and repeats. Texts are then chosen by a seeded order: each route gets a stretch of its
pattern's line of uses.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at
from folioflow.functions.lineage import settle


@dataclass(frozen=True)
class MixConfig:
    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # a public vocabulary as ranks; see ``encoder``
    seed: int = 17
    rows_per_block: int = 50_000  # texts whose running sums one task takes
    max_patterns: int = 100_000  # membership patterns that the driver routes; more are refused
    cache: int = 500_000  # words of which a worker remembers the number of tokens


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of the vocabulary at ``path`` and its pattern of words.

    The file is read where it lies on the worker, or, where it isn't there, among the files shipped with
    SparkContext.addFile. The pattern is that of the package public_tokenizers, which workers must be able to import.
    """
    if path not in _encoders:
        import public_tokenizers
        import regex
        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = (encoding, regex.compile(public_tokenizers.PATTERN))
    return _encoders[path]


class TokenCounts(dict):
    """word of the tokenizer's pattern -> its number of tokens, at most ``size`` at a time."""

    def __init__(self, encoding, size: int) -> None:
        super().__init__()
        self.encoding, self.size = encoding, size

    def __missing__(self, word: str) -> int:
        if len(self) >= self.size:
            self.clear()
        n = self[word] = len(self.encoding.encode_ordinary(word))
        return n


def token_counts(df: DataFrame, keep: list[str], text: str, config: MixConfig) -> DataFrame:
    """``keep`` and n_tokens of ``text`` (0 where null or empty). The vocabulary splits a text into words before
    merging bytes, so counts of words add up to those of the text."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pattern = encoder(config.tokenizer)
        counts = TokenCounts(encoding, config.cache)
        for batch in batches:
            for part in at.slices(batch, ["__text"]):
                n = [sum(map(counts.__getitem__, pattern.findall(t))) if t else 0 for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64())], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


class Flow:
    """Maximum flow by blocking flows (whole numbers)."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def _levels(self, s: int, t: int) -> list[int] | None:
        level = [-1] * len(self.out)
        level[s] = 0
        ring = [s]
        while ring and level[t] < 0:
            following = []
            for x in ring:
                for e in self.out[x]:
                    y = self.to[e]
                    if self.left[e] > 0 and level[y] < 0:
                        level[y] = level[x] + 1
                        following.append(y)
            ring = following
        return level if level[t] >= 0 else None

    def augment(self, s: int, t: int) -> int:
        """Raises the flow as far as the capacities of now allow."""
        total = 0
        while level := self._levels(s, t):
            pointer = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    amount = min(self.left[e] for e in path)
                    total += amount
                    for e in path:
                        self.left[e] -= amount
                        self.left[e ^ 1] += amount
                    cut = next(k for k, e in enumerate(path) if not self.left[e])
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                arcs = self.out[x]
                while pointer[x] < len(arcs):
                    e = arcs[pointer[x]]
                    if self.left[e] > 0 and level[self.to[e]] == level[x] + 1:
                        break
                    pointer[x] += 1
                else:
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
                    pointer[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return total


def turn_levels(turns: int) -> list[int]:
    """How many turns have the same cost: the first, the second, the third and fourth, the next four, and so on."""
    out, size = [], 1
    while turns > 0:
        out.append(min(size, turns))
        turns -= out[-1]
        size = sum(out)
    return out


def route(patterns: list[tuple[tuple[str, ...], int, int]], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[int, str], int]:
    """Tokens that flow from each pattern to each source, at the least cost of repetition.

    patterns: sources, the tokens of one use of all its units, and the cost class of their first use. Each source may
    use a unit ``repeats`` times. Turn after turn costs more (classes of ``turn_levels``, so arcs grow with the
    logarithm of the turns). Costs stand at the arcs that leave the origin alone, so opening the classes one after
    another and raising the flow each time is the cheapest greatest flow.
    """
    sources = sorted(quotas)
    first = {s: 1 + len(patterns) + k for k, s in enumerate(sources)}
    end = 1 + len(patterns) + len(sources)
    flow = Flow(end + 1)
    arcs, costs = {}, {}
    for p, (members, tokens, base) in enumerate(patterns):
        uses = {s: repeats[s] for s in members if s in quotas and repeats[s] > 0}
        if tokens <= 0 or not uses:
            continue
        for k, turns in enumerate(turn_levels(sum(uses.values()))):
            costs.setdefault(base + k, []).append((p, tokens * turns))
        for s, n in uses.items():
            arcs[p, s] = (flow.arc(1 + p, first[s], n * tokens), n * tokens)
    for s in sources:
        flow.arc(first[s], end, quotas[s])
    for cost in sorted(costs):
        for p, capacity in costs[cost]:
            flow.arc(0, 1 + p, capacity)
        flow.augment(0, end)
    return {key: cap - flow.left[e] for key, (e, cap) in arcs.items() if cap > flow.left[e]}


def normal_source(source: Column) -> Column:
    """Trimmed, lower case; null where blank."""
    name = F.lower(F.trim(source))
    return F.when(name != "", name)


@dataclass(frozen=True)
class Mix:
    selection: DataFrame  # key, source, uses, n_tokens
    report: DataFrame


def mix(
    documents: DataFrame, key: str, text: str, source: str, targets: DataFrame, config: MixConfig = MixConfig()
) -> Mix:
    """Chooses documents so that each target source gets ``target_share`` of all tokens of ``text``.

    targets: source, target_share, max_repeats; a source named twice counts once, with its greatest share. No
    document is used more than max_repeats times. A source that cannot reach its share, with no or too few documents,
    gets what it has; shares reached are in the report. Documents of null, blank or other sources, without a key, and
    null or empty texts, count in the total and are never chosen. Source names are compared trimmed and in lower case.
    More than ``max_patterns`` target sources or membership patterns are refused.
    """
    named = documents.select(
        key, F.col(text).alias("__t"), F.coalesce(normal_source(F.col(source)), F.lit("")).alias("source"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_id")
    )
    counted = settle(token_counts(named, [key, "source", "text_id"], "__t", config).distinct())
    total = counted.agg(F.sum("n_tokens")).collect()[0][0] or 0
    rows = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source")
    listed = rows.agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(config.max_patterns + 1).collect()
    if len(listed) > config.max_patterns:
        raise ValueError(f"more than {config.max_patterns} target sources")
    wanted = {r.source: r for r in listed}
    quotas = {s: int(max(0.0, float(r.target_share or 0)) * total) for s, r in wanted.items()}
    repeats = {s: max(0, int(r.max_repeats or 0)) for s, r in wanted.items()}
    spark = documents.sparkSession
    aims = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))
    usable = counted.join(aims, "source").where((F.col("n_tokens") > 0) & F.col(key).isNotNull())
    # A unit is a text with one copy in each source that holds it; every further copy is a unit of its source alone,
    # whose use counts as repetition. Copies are told apart by their keys, so a text that a third of all documents
    # repeat gathers nowhere.
    firsts = settle(usable.groupBy("text_id", "source").agg(F.min(key).alias(key), F.first("n_tokens").alias("n_tokens")))
    shared = firsts.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("source", F.col(key).alias("key")))).alias("held"), F.first("n_tokens").alias("n_tokens"))
    shared = shared.select(F.col("text_id").alias("unit"), F.array_join(F.transform("held", lambda h: h["source"]), "\x1e").alias("pattern"), "held", "n_tokens")
    further = usable.join(firsts.select(key, "text_id", "source"), [key, "text_id", "source"], "left_anti")
    alone = F.array(F.struct("source", F.col(key).alias("key")))
    further = further.select(F.concat("text_id", F.lit(" "), F.col(key).cast("string")).alias("unit"), F.concat(F.lit("\x1d"), "source").alias("pattern"), alone.alias("held"), "n_tokens")
    units = settle(shared.unionByName(further))
    found = units.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(config.max_patterns + 1).collect()
    if len(found) > config.max_patterns:
        raise ValueError(f"more than {config.max_patterns} membership patterns")
    found.sort(key=lambda r: r.pattern)
    patterns = [(tuple(r.pattern.lstrip("\x1d").split("\x1e")), int(r.tokens), int(r.pattern[:1] == "\x1d")) for r in found]
    flows = route(patterns, quotas, repeats)
    # The line of uses of a pattern: its units one after another, once per turn. Each source gets a stretch of it.
    stretches = []
    for p, r in enumerate(found):
        at_ = 0
        for s in patterns[p][0]:
            if (p, s) in flows:
                stretches.append((r.pattern, s, at_, at_ + flows[p, s], int(r.tokens)))
                at_ += flows[p, s]
    routes = spark.createDataFrame(stretches, "pattern string, source string, low long, high long, line long")
    placed = _running(units, max(1, max((r.n for r in found), default=1)), config)
    use = placed.join(F.broadcast(routes), "pattern")
    # Uses of a unit by a source: turns k of the line at which its place lies within the source's stretch.
    turns = F.expr("(high - place + line - 1) DIV line - (low - place + line - 1) DIV line").cast("int")
    own = F.element_at(F.filter("held", lambda h: h["source"] == F.col("source")), 1)["key"]
    selection = settle(use.select(own.alias(key), "source", turns.alias("uses"), "n_tokens").where("uses > 0"))
    got = selection.groupBy("source").agg(
        F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("n_tokens").alias("distinct_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses")
    )
    quota = spark.createDataFrame(
        [(s, float(wanted[s].target_share or 0), repeats[s], quotas[s]) for s in sorted(wanted)], "source string, target_share double, max_repeats int, quota_tokens long"
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("mixed_tokens", "distinct_tokens", "n_documents", "most_uses")}
    report = quota.join(F.broadcast(got), "source", "left").withColumns(zero)
    report = report.withColumn("share_of_corpus", F.round(F.col("mixed_tokens") / F.lit(float(max(1, total))), 6))
    mixed = F.sum("mixed_tokens").over(Window.partitionBy())
    report = report.withColumn("share_of_mix", F.round(F.col("mixed_tokens") / F.when(mixed > 0, mixed).otherwise(1), 6))
    return Mix(selection, report)


def _running(units: DataFrame, largest: int, config: MixConfig) -> DataFrame:
    """units with ``place``: tokens of the units of its pattern before it in seeded order. Sums run within blocks of
    the order, then over the blocks, so no pattern is a single task."""
    blocks = max(1, -(-largest // config.rows_per_block))
    seeded = units.withColumn("h", F.xxhash64(F.lit(config.seed), "unit"))
    seeded = seeded.withColumn("block", F.floor((F.shiftrightunsigned("h", 33)) / F.lit((1 << 31) / blocks)).cast("int"))
    sums = seeded.groupBy("pattern", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    earlier = Window.partitionBy("pattern").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pattern", "block", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("pattern", "block").orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, -1)
    seeded = seeded.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return seeded.join(sums, ["pattern", "block"]).select("pattern", "held", "n_tokens", (F.col("ahead") + F.col("inner")).alias("place"))
