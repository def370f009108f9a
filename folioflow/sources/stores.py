"""Durable index, passage store and vectors: written with a manifest, checked when opened."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators import lexical
from folioflow.sources.tables import fail_if_any

SCHEMA_VERSION = 1

#: Columns that a passage store must have.
STORE_COLUMNS = (
    "passage_id", "version_id", "author_id", "author_name", "work_id", "work_title", "profile", "kind", "ordinal", "display_text", "retrieval_text", "search_alias_text",
    "previous_passage_id", "next_passage_id", "word_count", "unit_count", "member_count",
)


def digest(df: DataFrame, key: str) -> DataFrame:
    """One row: rows and a digest of their keys that doesn't depend on order; partial sums leave every task."""
    h = F.xxhash64(key).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("key_digest"))


def _manifest(df: DataFrame, key: str, kind: str, **more: object) -> DataFrame:
    row = digest(df, key).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("kind"), F.array_join(F.array(*map(F.lit, df.columns)), ",").alias("columns"), "*")
    return row.withColumns({k: F.lit(v) for k, v in more.items()})


def _opened(spark: SparkSession, path: str, kind: str, key: str, verify: bool) -> tuple[DataFrame, dict]:
    told = spark.read.json(f"{path}/manifest").collect()
    if len(told) != 1 or told[0].kind != kind or told[0].schema_version != SCHEMA_VERSION:
        raise ValueError(f"{path} is no {kind} of schema version {SCHEMA_VERSION}")
    rows = spark.read.parquet(f"{path}/rows")
    missing = set(told[0].columns.split(",")) - set(rows.columns)
    if missing:
        raise ValueError(f"{path} lacks columns {sorted(missing)}")
    if verify:
        now = digest(rows, key).first()
        if (now.n, now.key_digest) != (told[0].n, told[0].key_digest):
            raise ValueError(f"{path} doesn't hold the rows of its manifest")
    return rows, told[0].asDict()


def _write(df: DataFrame, path: str, key: str, kind: str, overwrite: bool, by: list[str] | None = None, **more: object) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/rows")
    _manifest(df.sparkSession.read.parquet(f"{path}/rows"), key, kind, **more).coalesce(1).write.mode(mode).json(f"{path}/manifest")


def store_violations(passages: DataFrame) -> DataFrame:
    """passage_id, issue of rows that a store refuses: ids used twice or empty, ordinals used twice or below 1, negative
    counts, texts that are missing."""
    twice = passages.groupBy("passage_id").agg(F.count("*").alias("n")).where("n > 1").select("passage_id", F.lit("repeated_id").alias("issue"))
    shared = passages.groupBy("version_id", "ordinal").agg(F.count("*").alias("n"), F.min("passage_id").alias("passage_id")).where("n > 1")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    negative = F.least(*(F.coalesce(c, F.lit(0)) for c in ("word_count", "unit_count", "member_count"))) < 0
    own = F.array_compact(F.array(
        F.when(empty("passage_id"), "empty_id"), F.when(empty("version_id"), "empty_version"), F.when(~F.coalesce(F.col("ordinal") >= 1, F.lit(False)), "invalid_ordinal"),
        F.when(negative, "negative_count"), F.when(empty("display_text"), "no_display_text"), F.when(empty("retrieval_text"), "no_retrieval_text"),
    ))
    return twice.unionByName(shared.select("passage_id", F.lit("repeated_ordinal").alias("issue"))).unionByName(passages.select("passage_id", F.explode(own).alias("issue")))


def write_store(passages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes passages, laid out by version; rows that ``store_violations`` names are refused."""
    fail_if_any(store_violations(passages), "the store refuses")
    _write(passages.select(*STORE_COLUMNS), path, "passage_id", "passage_store", overwrite, ["version_id"])


def open_store(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    return _opened(spark, path, "passage_store", "passage_id", verify)[0].select(*STORE_COLUMNS)


def write_index(index: lexical.Index, path: str, overwrite: bool = False) -> None:
    """Writes the documents of an index with their tokens, and its postings, by which terms are looked up."""
    _write(index.docs, f"{path}/documents", "doc_id", "index_documents", overwrite)
    _write(index.postings, f"{path}/postings", "term", "index_postings", overwrite)


def open_index(spark: SparkSession, path: str, verify: bool = True) -> lexical.Index:
    docs, _ = _opened(spark, f"{path}/documents", "index_documents", "doc_id", verify)
    postings, _ = _opened(spark, f"{path}/postings", "index_postings", "term", verify)
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return lexical.Index(docs, postings, terms, docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")), True)


def write_vectors(vectors: DataFrame, key: str, vector: str, path: str, model: str, query_prefix: str = "", overwrite: bool = False) -> None:
    """Writes unit vectors with the model that made them; vectors of another length, not finite or not of unit norm are
    refused."""
    size = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    fail_if_any(vectors.where(F.col(vector).isNull() | (F.size(vector) != size) | ~F.coalesce(F.abs(norm - 1) <= 1e-3, F.lit(False))).select(key), "vectors refused")
    _write(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), path, "key", "vectors", overwrite, None, model=model, query_prefix=query_prefix, dimension=size)


def open_vectors(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, dict]:
    """Vectors (key, vector) and their manifest: model, query_prefix, dimension, n."""
    return _opened(spark, path, "vectors", "key", verify)


def read_matrix(spark: SparkSession, path: str, rows_per_task: int = 100_000) -> DataFrame:
    """row_index and vector of a float matrix in a .npy file on a shared disk. Every task maps its own rows."""
    shape, dtype = (m := np.load(path, mmap_mode="r")).shape, m.dtype
    if len(shape) != 2 or dtype != np.float32:
        raise ValueError(f"{path}: a float32 matrix is expected")
    parts = max(1, -(-shape[0] // rows_per_task))
    schema = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = np.ascontiguousarray(matrix[start : start + rows_per_task])
                flat = pa.array(part.ravel())
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.ListArray.from_arrays(offsets, flat)], names=schema.names)

    return spark.range(0, max(1, shape[0]), rows_per_task, parts).mapInArrow(run, schema).where(F.col("row_index") < shape[0])
