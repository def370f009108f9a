"""Best hits of queries: every task keeps its own in bounded memory and hands on one row per query, tasks are joined by blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS_A_BLOCK = 1_000_000  # hits that a task joins at once


def _order(ids: pa.Array) -> np.ndarray:
    """The place of each id among all; equal ids have one place."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def _first(query: np.ndarray, order: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the ``limit`` best of their query, by query and rank, and where each query begins (with the end)."""
    at = np.lexsort((order, np.round(score, 9), query))
    q = query[at]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(q)])
    kept = at[np.arange(len(q)) - np.repeat(begin, size) < limit]
    return kept, np.r_[0, np.cumsum(np.minimum(size, limit))]


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


class Best:
    """The ``limit`` best hits of each query among the documents that a task has seen: smaller scores (at nine decimals)
    are better, ties go by id. Queries come by their numbers in blocks, of which one is touched at a time."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.ids: pa.Array | None = None
        self.order = np.zeros(0, np.int32)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def documents(self, ids: pa.Array) -> int:
        """Takes more documents; their hits count from the number given back."""
        base = 0 if self.ids is None else len(self.ids)
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        self.order = _order(self.ids).astype(np.int32)
        return base

    def add(self, block: int, query: np.ndarray, document: np.ndarray, score: np.ndarray) -> None:
        query, document = query.astype(np.int32), document.astype(np.int32)
        if block in self.held:
            q, d, s, _ = self.held[block]
            query, document, score = np.r_[q, query], np.r_[d, document], np.r_[s, score]
        kept, off = _first(query, self.order[document], score, self.limit)
        self.held[block] = query[kept], document[kept], score[kept], off

    def worst(self, block: int, queries: np.ndarray) -> np.ndarray:
        """The score that a hit of each query must reach to be kept; infinite for queries with fewer hits than the limit."""
        out = np.full(len(queries), np.inf)
        if block in self.held:
            query, _, score, off = self.held[block]
            full = np.flatnonzero(np.diff(off) == self.limit)
            out[query[off[full]] - queries[0]] = score[off[full + 1] - 1]
        return out

    def rows(self, names: pa.Array) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        """Query numbers of each block and its columns: query, ids and scores in order."""
        while self.held:
            query, document, score, off = self.held.pop(next(iter(self.held)))
            if len(query):
                own = query[off[:-1]]
                off = pa.array(off.astype(np.int32))
                yield own, [names.take(pa.array(own)), pa.ListArray.from_arrays(off, self.ids.take(pa.array(document))), pa.ListArray.from_arrays(off, pa.array(score))]


def packed_schema(query: T.StructField, document: T.DataType) -> T.StructType:
    return T.StructType([query, T.StructField("ids", T.ArrayType(document)), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def joined(packed: DataFrame, query: str, n_queries: int, tasks: int, limit: int) -> DataFrame:
    """One row per query (query, ids, scores in order) of rows that several tasks handed on."""
    names = [query, "ids", "scores"]
    blocks = max(1, math.ceil(n_queries * tasks * limit / HITS_A_BLOCK))

    def run(found: pa.Table) -> pa.Table:
        coded = _one(found.column(query)).dictionary_encode()
        ids, scores = _one(found.column("ids")), _one(found.column("scores"))
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        at = np.repeat(number, pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        ids, score = ids.flatten(), scores.flatten().to_numpy(zero_copy_only=False)
        kept, off = _first(at, _order(ids), score, limit)
        off_ = pa.array(off.astype(np.int32))
        columns = [coded.dictionary.take(pa.array(at[kept][off[:-1]])), pa.ListArray.from_arrays(off_, ids.take(pa.array(kept))), pa.ListArray.from_arrays(off_, pa.array(score[kept]))]
        return pa.Table.from_arrays(columns, names=names)

    own = packed.select(*names).withColumn("_block", F.pmod(F.xxhash64(query), F.lit(blocks)))
    return own.groupBy("_block").applyInArrow(run, T.StructType([packed.schema[c] for c in names]))
