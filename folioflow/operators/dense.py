"""Dense retrieval: exact top-k by inner product of unit vectors.

A stated query set is multiplied with all vectors in blocks; each task keeps its own best, which are then joined by
query. Vectors are read once and never collected; queries are a bounded batch, checked before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.best import Best, joined, packed_schema

MAX_QUERY_FLOATS = 8_000_000
MAX_SCORES = 4_000_000  # products of queries and vectors that a task holds at once


class Encoder(Protocol):
    """Turns texts into unit vectors; given by the caller, since the engine brings no model."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Unit vectors of hashed character trigrams: stands in where no model is at hand, the same on every machine."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            data = f"  {text} ".encode("utf-32-le")
            cp = np.frombuffer(data, np.uint32).astype(np.uint64)
            h = cp[:-2] * np.uint64(0x9E3779B1) + cp[1:-1] * np.uint64(0x85EBCA77) + cp[2:] * np.uint64(0xC2B2AE3D)
            h ^= h >> np.uint64(15)
            out[k] = np.bincount((h % np.uint64(self.size)).astype(np.int64), np.where(h >> np.uint64(20) & np.uint64(1), 1.0, -1.0), self.size)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out[norm[:, 0] == 0, 0] = 1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def encoded(text: Column | str, encoder: Encoder, prefix: str = "") -> Column:
    """Vectors of stripped texts behind the encoder's query prefix."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder.encode([prefix + (t or "").strip() for t in s]), np.float32)))

    return run(text)


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


def top_lists(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int, block: int = 16_384) -> DataFrame | None:
    """query_key, ids and scores (negated inner products at nine decimals) of the k best of all vectors for every query, in
    order; ties go by key. None without queries.

    A task holds ``block`` vectors and the products of some queries with them at a time, and of every query its k best
    so far, so what leaves it grows with the queries alone.
    """
    head = queries.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n"))
    size, n = head.agg(F.max("n"), F.count("*")).first()
    if not n:
        return None
    if n * size > MAX_QUERY_FLOATS:
        raise ValueError("cut the queries into batches")
    asked = queries.where(F.size(vector) == size).select(query_key, vector).toArrow().combine_chunks()
    q = asked[vector].combine_chunks() if isinstance(asked[vector], pa.ChunkedArray) else asked[vector]
    q = q.chunk(0) if isinstance(q, pa.ChunkedArray) else q
    matrix = _matrix(q, size)
    if not np.isfinite(matrix).all() or not np.linalg.norm(matrix, axis=1).all():
        raise ValueError("a query vector isn't finite or is zero")
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
    ids = asked[query_key].combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((ids, matrix))
    schema = packed_schema(queries.schema[query_key], vectors.schema[key].dataType)
    step = max(1, MAX_SCORES // block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = Best(k)
        for part in _blocks(batches, block):
            base = best.documents(part.column(0))
            own = _matrix(part.column(1), size).T
            for s in range(0, len(matrix), step):
                scores = matrix[s : s + step] @ own
                edge = -best.worst(s, np.arange(s, s + len(scores)))
                edge = edge if np.isfinite(edge).all() else np.maximum(edge, _edge(scores, k))
                found = _true(scores >= edge[:, None] - 2e-9)
                query, row = np.divmod(found, scores.shape[1])
                best.add(s, query + s, row + base, -np.round(scores.ravel()[found], 9))
        for _, columns in best.rows(ids):
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    tasks = spark.sparkContext.defaultParallelism
    found = vectors.where(F.size(vector) == size).select(key, vector).coalesce(tasks).mapInArrow(run, schema)
    return joined(found, query_key, n, tasks, k)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The rows again, ``block`` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            held.append(batch.slice(start, block - size))
            start += held[-1].num_rows
            size += held[-1].num_rows
            if size == block:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _true(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask of which little is true, eight places at a time."""
    flat = mask.ravel()
    end = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:end].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[at[flat[at]], end + np.flatnonzero(flat[end:])]


def _edge(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that at least k of each row reach: the k-th of the largest of groups."""
    n = scores.shape[1]
    if n <= k:
        return np.full(len(scores), -np.inf)
    group = max(1, n // (4 * k))
    m = n // group
    top = scores[:, : m * group].reshape(len(scores), group, m).max(axis=1)
    return np.partition(top, m - k, axis=1)[:, m - k]


def top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int, block: int = 16_384) -> DataFrame:
    """query_key, rank, key and cosine of the k best of all vectors for every query; ties go by key.

    Null vectors and vectors of another length are left out; a query vector that isn't finite or has no length is
    refused. The query batch goes to every worker; one of more than
    MAX_QUERY_FLOATS numbers is refused: it must be cut into batches.
    """
    found = top_lists(vectors, key, vector, queries, query_key, k, block)
    if found is None:
        return vectors.sparkSession.createDataFrame([], T.StructType([queries.schema[query_key], T.StructField("rank", T.IntegerType()), vectors.schema[key], T.StructField("cosine", T.DoubleType())]))
    rows = found.select(query_key, F.posexplode(F.arrays_zip("ids", "scores")).alias("r", "hit"))
    return rows.select(query_key, (F.col("r") + 1).alias("rank"), F.col("hit.ids").alias(key), F.round(-F.col("hit.scores"), 6).alias("cosine"))


def validation(vectors: DataFrame, vector: str, tolerance: float = 1e-5) -> DataFrame:
    """One row: n_vectors, n_null, least_size, most_size, n_not_finite, n_not_unit."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return vectors.agg(
        F.count("*").alias("n_vectors"), count(F.col(vector).isNull()).alias("n_null"), F.min(F.size(vector)).cast("long").alias("least_size"),
        F.max(F.size(vector)).cast("long").alias("most_size"), count(broken).alias("n_not_finite"), count(F.abs(norm - 1) > tolerance).alias("n_not_unit"),
    )
