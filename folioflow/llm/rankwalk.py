"""One ranking from several differently-scaled scores.

Method: a Markov chain over the items of a group. From an item the walk picks one of the scores, each with the same
chance, and jumps uniformly to the items that this score ranks strictly higher. With damping it restarts anywhere;
items are ordered by their stationary probability. Only the order of a score's values counts, so no score dominates by
its range. A step is a prefix sum over each sorted score.

Two walks differ in how often they jump. ``jump="higher"`` always jumps to a higher-ranked item where there is one; it
is held by every item that tops one score, however bad it is in the others. ``jump="draw"``, the default, draws any
item of the group and jumps only if it ranks higher, so the better an item is, the longer it stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.lineage import settle


@dataclass(frozen=True)
class RankWalkConfig:
    damping: float = 0.85
    jump: str = "draw"  # or "higher"
    steps: int = 200  # at most; the walk ends when no item's share changes any more
    tolerance: float = 1e-12  # of a share, relative to that of an average item
    group_limit: int = 200_000  # a larger group is walked by the whole cluster
    blocks: int = 256  # of the values of all such groups, per score
    checkpoint_every: int = 8

    def __post_init__(self) -> None:
        if self.jump not in ("draw", "higher"):
            raise ValueError("jump is draw or higher")


def stationary(values: np.ndarray, off: np.ndarray, config: RankWalkConfig = RankWalkConfig()) -> tuple[np.ndarray, np.ndarray]:
    """Stationary probabilities of the items of all groups at once, and of each item the number of strictly better
    items, summed over the scores.

    values: (items, scores), larger is better, NaN is worst. off: offsets of the groups.
    """
    n, s = values.shape
    size = np.diff(off)
    group = np.repeat(np.arange(len(size)), size)
    ahead = np.zeros(n, np.int64)
    if n == 0:
        return np.zeros(0), ahead
    of = size[group].astype(np.float64)
    start = 1.0 / of
    plans = []
    for k in range(s):
        v = np.where(np.isnan(values[:, k]), -np.inf, values[:, k])
        order = np.lexsort((np.arange(n), -v, group))  # best first within each group
        sv, sg = v[order], group[order]
        tied = np.concatenate(([False], (sv[1:] == sv[:-1]) & (sg[1:] == sg[:-1])))
        first = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))  # place of the first of equal items
        better = first - off[sg]
        ahead[order] += better
        runs = np.flatnonzero(~tied)
        after = np.append(runs[1:], n)[np.cumsum(~tied) - 1]  # place after the last of equal items
        if config.jump == "draw":
            leaves, stays = 1 / of[order], 1 - better / of[order]
        else:
            leaves, stays = np.where(better > 0, 1 / np.maximum(better, 1), 0.0), (better == 0).astype(np.float64)
        plans.append((order, leaves, stays, after, off[1:][sg]))
    p = start.copy()
    for _ in range(config.steps):
        flow = np.zeros(n)
        for order, leaves, stays, after, end in plans:
            mass = p[order]
            total = np.concatenate(([0.0], np.cumsum(mass * leaves)))
            flow[order] += total[end] - total[after] + mass * stays
        new = (1 - config.damping) * start + config.damping * flow / s
        change = np.abs(new - p) * of
        p = new
        if change.max() < config.tolerance:
            break
    return p, ahead


#: Of an item: its stationary probability, better items summed over the scores, items of its group.
STATE = [T.StructField("stationarity", T.DoubleType()), T.StructField("ahead", T.LongType()), T.StructField("size", T.LongType())]


def _walk_groups(rows: DataFrame, keys: list[str], scores: int, config: RankWalkConfig) -> DataFrame:
    """rows: group keys, item, s0 .. sN sorted by group within each partition; groups of at most group_limit items."""
    schema = T.StructType([*rows.schema.fields[: len(keys) + 1], *STATE])
    width = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < 20_000:
                continue
            cut = int(_starts(rest)[-1])  # the last group may go on in the next batch
            if cut:
                yield from walk(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from walk(rest)

    def _starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in range(len(keys)):
            col = table.column(k).combine_chunks()
            codes = col.dictionary_encode(null_encoding="encode")
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            index = codes.indices.to_numpy(zero_copy_only=False)
            change[1:] |= index[1:] != index[:-1]
        return np.flatnonzero(change)

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        off = np.append(_starts(table), table.num_rows)
        values = np.stack([table.column(width + k).to_numpy().astype(np.float64) for k in range(scores)], 1)
        p, ahead = stationary(values, off, config)
        size = np.repeat(np.diff(off), np.diff(off))
        arrays = [table.column(k).combine_chunks() for k in range(width)]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        yield from pa.Table.from_arrays([*arrays, pa.array(p), pa.array(ahead), pa.array(size)], names=schema.names).to_batches()

    return rows.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _blocks(values: DataFrame, order: list[Column], config: RankWalkConfig) -> DataFrame:
    """``values`` with ``block``: ascending stretches of about equal size of the given order over all groups."""
    return settle(values.repartitionByRange(config.blocks, *order).withColumn("block", F.spark_partition_id()))


def _before(rows: DataFrame, keys: list[str], amount: str, order: list[Column]) -> DataFrame:
    """``rows`` (with block) and ``before``: the sum of ``amount`` over the rows of the same keys before each. Sums run
    within the blocks, then over the blocks, of which there are few."""
    within = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "block").agg(F.sum(amount).alias("__sum"))
    sums = sums.select(*keys, "block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    inner = rows.withColumn("__inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inner.join(F.broadcast(sums), [*keys, "block"]).withColumn("before", F.col("__earlier") + F.col("__inner")).drop("__inner", "__earlier")


def _walk_large(rows: DataFrame, scores: int, config: RankWalkConfig) -> DataFrame:
    """The same walk for groups that don't fit one task (rows: gid, item, s0 .. sN), over the distinct values of a score,
    which lie in range-partitioned blocks: a value that a third of all items share is one row there."""
    worst = F.lit(float("-inf"))
    base = rows.select("gid", "item", *(F.coalesce(f"s{k}", worst).alias(f"s{k}") for k in range(scores)))
    base = settle(base.join(base.groupBy("gid").agg(F.count("*").alias("size")), "gid"))
    places = None
    for k in range(scores):
        c = f"s{k}"
        order = [F.desc(c)]
        values = _blocks(base.groupBy("gid", c).agg(F.count("*").alias("same")), [F.col("gid"), *order], config)
        placed = _before(values, ["gid"], "same", order).select("gid", c, "block", F.col("before").alias("better"))
        one = base.join(placed, ["gid", c]).select("gid", "item", "size", F.lit(k).alias("score"), "block", "better")
        places = one if places is None else places.unionByName(one)
    places = settle(places)
    better, size, p = F.col("better"), F.col("size"), F.col("p")
    if config.jump == "draw":
        leaves, stays = p / size, p * (1 - better / size)
    else:
        leaves, stays = F.when(better > 0, p / better).otherwise(0.0), F.when(better == 0, p).otherwise(0.0)
    state = base.select("gid", "item", "size", (1 / size).alias("p"))
    known = state
    for step in range(config.steps):
        here = places.join(state.drop("size"), ["gid", "item"]).withColumn("leaves", leaves)
        values = here.groupBy("gid", "score", "block", "better").agg(F.sum("leaves").alias("leaves"))
        total = values.groupBy("gid", "score").agg(F.sum("leaves").alias("total"))
        behind = _before(values, ["gid", "score"], "leaves", [F.col("better")]).join(F.broadcast(total), ["gid", "score"])
        behind = behind.select("gid", "score", "better", (F.col("total") - F.col("before") - F.col("leaves")).alias("behind"))
        moved = here.join(behind, ["gid", "score", "better"]).select("gid", "item", "size", (F.col("behind") + stays).alias("gain"))
        state = moved.groupBy("gid", "item", "size").agg(F.sum("gain").alias("gain"))
        state = state.select("gid", "item", "size", ((1 - config.damping) / size + config.damping / scores * F.col("gain")).alias("p"))
        if (step + 1) % config.checkpoint_every == 0 or step + 1 == config.steps:
            state = settle(state)
            change = state.join(known.select("gid", "item", F.col("p").alias("q")), ["gid", "item"]).agg(F.max(F.abs(p - F.col("q")) * size)).collect()[0][0]
            if change is None or change < config.tolerance:
                break
            known = state
    ahead = places.groupBy("gid", "item").agg(F.sum("better").alias("ahead"))
    return state.join(ahead, ["gid", "item"]).select("gid", "item", F.col("p").alias("stationarity"), "ahead", F.col("size").cast("long").alias("size"))


def rank_walk(
    df: DataFrame, group: str, item: str, scores: list[tuple[str, bool]], config: RankWalkConfig = RankWalkConfig()
) -> DataFrame:
    """Every item of every group with its stationarity, mean_rank and walk_rank (both from 1).

    scores: (column, larger is better). A missing or NaN value is the worst of its group; equal values are equally
    good. Exact duplicate rows count once; of several rows of an item, the best value of each score counts. Items are
    ordered by stationarity (times the size of the group, to nine digits), then by mean rank, then by item. Null groups
    form one group; null items are dropped.
    """
    best = []
    for k, (c, larger) in enumerate(scores):
        v = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
        best.append(F.max(v if larger else -v).alias(f"s{k}"))
    rows = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(*best)
    sizes = df.groupBy(group).agg(F.count("*").alias("rows"))
    large = [r[0] for r in sizes.where(F.col("rows") > config.group_limit).select(group).collect()]  # < all rows / group_limit
    order = [F.desc(F.round(F.col("stationarity") * F.col("size"), 9)), F.col("ahead")]
    shown = [group, item, "stationarity", (1 + F.col("ahead") / len(scores)).alias("mean_rank"), "walk_rank"]

    def numbered(walked: DataFrame) -> DataFrame:
        return walked.withColumn("walk_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order, item))).select(*shown)

    if not large:
        return numbered(_walk_groups(rows, [group], len(scores), config))
    kind = T.StructType([T.StructField("gid", T.LongType()), T.StructField("g", df.schema[group].dataType)])
    hot = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(large)), kind))
    same = rows[group].eqNullSafe(hot["g"])
    big = rows.join(hot, same).select("gid", rows[item].alias("item"), *(f"s{k}" for k in range(len(scores))))
    # Ranks of a large group count the items before each in range-partitioned blocks of the whole order.
    walked = _walk_large(big, len(scores), config).withColumn("one", F.lit(1))
    placed = _before(_blocks(walked, [F.col("gid"), *order, F.col("item")], config), ["gid"], "one", [*order, F.col("item")])
    placed = placed.join(hot, "gid").withColumn("walk_rank", (F.col("before") + 1).cast("int"))
    placed = placed.select(F.col("g").alias(group), F.col("item").alias(item), "stationarity", "ahead", "size", "walk_rank").select(*shown)
    return numbered(_walk_groups(rows.join(hot, same, "left_anti"), [group], len(scores), config)).unionByName(placed)


def first_places(df: DataFrame, group: str, item: str, scores: list[tuple[str, bool]], config: RankWalkConfig = RankWalkConfig()) -> DataFrame:
    """The first item of each group."""
    return rank_walk(df, group, item, scores, config).where("walk_rank = 1").select(group, item)
