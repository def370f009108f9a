"""Passage building: runs, verse windows, prose packing, oversized splits, links and roll-ups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.config import PassageConfig
from folioflow.functions import ordered
from folioflow.functions.normalize import word_count

#: Fixed value: where a long paragraph is cut.
SENTENCE_END = "(?U)(?<=[.!?؟؛])\\s+"


def runs(units: DataFrame, key: str, order: str, same: list[str], breaks: str | None = None) -> DataFrame:
    """Adds run_id: maximal stretches of units in order with equal ``same`` columns; ``breaks`` rows (a boolean
    column) stand alone between runs and have none."""
    stop = F.coalesce(F.col(breaks), F.lit(False)) if breaks else F.lit(False)
    rows = ordered.blocked(units.withColumn("__stop", stop), [key], [order])
    rows = ordered.neighbours(rows, [*same, "__stop"], before="__before")
    changed = F.col("__before").isNull() | F.col("__stop") | F.col("__before.__stop")
    for c in same:
        changed |= ~F.col("__before").getField(c).eqNullSafe(F.col(c))
    rows = ordered.running_sum(rows.withColumn("__new", changed.cast("long")), "__new", "run_id", inclusive=True)
    return ordered.plain(rows.withColumn("run_id", F.when(~F.col("__stop"), F.col("run_id"))).drop("__stop", "__before", "__new"))


def verse_windows(verses: DataFrame, run: list[str], order: str, tail: str, config: PassageConfig = PassageConfig()) -> DataFrame:
    """run columns, window_no (from 1), first_verse, last_verse (1-based within the run), size.

    Windows of verse_window verses overlap by verse_overlap; the first that reaches the end is the last, and if it has
    fewer than the kind's least tail (column ``tail``) it is replaced by the run's last verses.
    """
    size, step = config.verse_window, config.verse_window - config.verse_overlap
    sizes = verses.groupBy(*run).agg(F.count(F.col(order)).alias("n"), F.max(tail).alias("least"))
    last = F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / step) * step).cast("long")
    starts = sizes.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))))
    short = (F.col("s") + size > F.col("n")) & (F.col("n") - F.col("s") < F.col("least")) & (F.col("n") > size)
    moved = starts.withColumn("first_verse", F.when(short, F.greatest(F.col("n") - size, F.lit(0))).otherwise(F.col("s")) + 1)
    w = moved.withColumn("last_verse", F.least(F.col("first_verse") + size - 1, F.col("n")))
    w = w.select(*run, "first_verse", "last_verse").distinct()
    number = F.row_number().over(Window.partitionBy(*run).orderBy("first_verse"))
    return w.select(*run, number.alias("window_no"), "first_verse", "last_verse", (F.col("last_verse") - F.col("first_verse") + 1).alias("size"))


def cut_points(total: np.ndarray, target: int, hard: int) -> list[int]:
    """Where a row of texts is cut, by the running totals of their words (``total[0]`` is 0): each piece ends where it
    first reaches the target, but before the hard limit would be passed."""
    n = len(total) - 1
    cuts = [0]
    while cuts[-1] < n:
        start = cuts[-1]
        reached = int(np.searchsorted(total, total[start] + target, "left"))
        allowed = int(np.searchsorted(total, total[start] + hard, "right")) - 1
        cuts.append(min(max(reached, start + 1), allowed, n))
    return cuts


def packed(sizes: list[int] | np.ndarray, config: PassageConfig = PassageConfig()) -> list[int]:
    """Cuts (from 0 to the number of paragraphs) that pack paragraphs into passages near the target, none above the hard
    limit, the tail evened out: its cut goes back to where the tail reaches the soft least, as far as the piece before
    keeps it, too; a tail still short is joined to that piece if both fit."""
    if len(sizes) and max(sizes) > config.prose_hard_max:
        raise ValueError("a paragraph above the hard limit must be split first")
    total = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
    cuts = cut_points(total, config.prose_target, config.prose_hard_max)
    if len(cuts) < 3:
        return cuts
    before, cut, end = cuts[-3], cuts[-2], int(total[-1])
    wanted = int(np.searchsorted(total, end - config.prose_soft_min, "right")) - 1
    keeps = int(np.searchsorted(total, total[before] + config.prose_soft_min, "left"))
    fits = int(np.searchsorted(total, end - config.prose_hard_max, "left"))
    cut = min(cut, max(wanted, keeps, fits, before + 1))
    short = end - total[cut] < config.prose_soft_min
    if short and end - total[before] <= config.prose_hard_max:
        return [*cuts[:-2], cuts[-1]]
    return [*cuts[:-2], cut, cuts[-1]]


def pack_prose(paragraphs: DataFrame, run: list[str], order: str, words: str, config: PassageConfig = PassageConfig()) -> DataFrame:
    """run columns, order column and passage_no (from 1 within the run) of each paragraph.

    Where a passage ends depends on all before it in its run, so a run (a chapter of one version) goes through one task
    as a stream in order, of which only the numbers of words are held. Runs and orders aren't null.
    """
    rows = paragraphs.select(*run, order, F.coalesce(F.col(words), F.lit(0)).cast("long").alias("__words"))
    schema = T.StructType([*(paragraphs.schema[c] for c in run), paragraphs.schema[order], T.StructField("passage_no", T.IntegerType())])
    width = len(run)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            first = _changes(table, width)
            if held and not _same_run(held[-1], table, width):
                yield from number(held)
                held = []
            if len(first) > 1:  # all but the last run of the batch are complete
                yield from number([*held, table.slice(0, first[-1])])
                held = []
            held.append(table.slice(first[-1]))
        if held:
            yield from number(held)

    def number(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        sizes = table.column(width + 1).to_numpy()
        out = np.zeros(len(sizes), np.int32)
        starts = [*_changes(table, width), len(sizes)]
        for a, b in zip(starts, starts[1:]):
            cuts = packed(sizes[a:b], config)
            out[a:b] = np.repeat(np.arange(1, len(cuts)), np.diff(cuts))
        yield from pa.Table.from_arrays([*table.columns[: width + 1], pa.array(out)], names=schema.names).to_batches()

    return rows.repartition(*(F.col(c) for c in run)).sortWithinPartitions(*run, order).mapInArrow(fold, schema)


def _changes(table: pa.Table, width: int) -> list[int]:
    """Rows at which another run begins, the first row included."""
    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for k in range(width):
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        index = codes.indices.to_numpy(zero_copy_only=False)
        changed[1:] |= index[1:] != index[:-1]
    return np.flatnonzero(changed).tolist()


def _same_run(a: pa.Table, b: pa.Table, width: int) -> bool:
    return all(a.column(k)[-1].as_py() == b.column(k)[0].as_py() for k in range(width))


def split_paragraph(text: str, config: PassageConfig = PassageConfig()) -> tuple[list[str], bool]:
    """Pieces of a paragraph above the hard limit: whole sentences up to the target, a longer sentence in runs of so
    many words; and whether words had to be cut apart."""
    parts = [p for x in re.split(r"(?<=[.!?؟؛])\s+", text) if (p := x.strip())]
    sizes = np.array([len(p.split()) for p in parts], np.int64)
    out: list[str] = []
    apart = len(parts) < 2
    long_ = [*np.flatnonzero(sizes > config.prose_hard_max).tolist(), len(parts)]
    at_ = 0
    for k in long_:  # stretches of sentences that fit, and a sentence that doesn't after each
        cuts = cut_points(np.concatenate(([0], np.cumsum(sizes[at_:k]))), config.prose_target, config.prose_hard_max)
        out += [" ".join(parts[at_ + a : at_ + b]) for a, b in zip(cuts, cuts[1:])]
        if k < len(parts):
            words = parts[k].split()
            out += [" ".join(words[s : s + config.prose_target]) for s in range(0, len(words), config.prose_target)]
            apart = True
        at_ = k + 1
    return out, apart


def sentence_split(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, part_no (from 0) and part: the text cut after its sentence marks."""
    return df.select(key, F.posexplode(F.filter(F.split(text, SENTENCE_END), lambda x: x != "")).alias("part_no", "part"))


def word_chunks(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, chunk_no (from 0), n_words and chunk: fixed runs of ``n`` words."""
    words = F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")
    rows = df.select(key, words.alias("w")).where("size(w) > 0")
    parts = F.expr(f"transform(sequence(0, size(w) - 1, {n}), i -> slice(w, i + 1, {n}))")
    out = rows.select(key, F.posexplode(parts).alias("chunk_no", "p"))
    return out.select(key, "chunk_no", F.size("p").alias("n_words"), F.array_join("p", " ").alias("chunk"))


def neighbor_links(passages: DataFrame, run: list[str], order: str, passage: str) -> DataFrame:
    """passage, its previous and next passage within the run."""
    rows = ordered.neighbours(ordered.blocked(passages.select(*run, order, passage), run, [order]), [passage], "__p", "__n")
    return rows.select(passage, F.col("__p").getField(passage).alias("previous_id"), F.col("__n").getField(passage).alias("next_id"))


def passage_id(version: str, ordinal: str):
    return F.format_string("%s:passage_%06d", F.col(version), F.col(ordinal))


def roll_up(passages: DataFrame) -> DataFrame:
    """Passages, words and longest passage per version and kind, per version, and in all (nulls stand for all)."""
    words = word_count("retrieval_text")
    rows = passages.select("version_id", "kind", words.alias("w"))
    return rows.rollup("version_id", "kind").agg(
        F.count("*").alias("n_passages"), F.sum("w").cast("long").alias("n_words"), F.max("w").cast("long").alias("most_words"), F.grouping_id().cast("long").alias("level")
    )
