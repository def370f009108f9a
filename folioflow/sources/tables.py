"""Parquet tables and validated JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION_SCHEMA = (
    "schema_version string, query_id string, query_text string, query_type string, "
    "judgments array<struct<passage_id: string, grade: int, rationale: string>>, expected_version_ids array<string>, "
    "tags array<string>, include_in_metrics boolean, notes string"
)
PASSAGE_SCHEMA = (
    "schema_version string, passage_id string, version_id string, profile string, kind string, ordinal int, include_in_index boolean, "
    "text struct<display: string, retrieval: string, search_alias: string, word_count: int, unit_count: int, member_count: int>, "
    "context struct<heading_path: array<string>, section_path: array<string>, parent_context_id: string>, "
    "neighbors struct<previous_passage_id: string, next_passage_id: string>"
)


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, EVALUATION_SCHEMA)


def write_evaluation(queries: DataFrame, path: str) -> None:
    """One compact JSON object a line, keys sorted, null fields kept."""
    row = F.to_json(F.struct(*sorted(queries.columns)), {"ignoreNullFields": "false"})
    queries.select(row.alias("value")).write.mode("overwrite").text(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, PASSAGE_SCHEMA)


def write_passage_store(passages: DataFrame, path: str) -> None:
    """The store, laid out by version so that a version is read alone."""
    passages.write.mode("errorifexists").partitionBy("version_id").parquet(path)


def write_manifest(passages: DataFrame, path: str) -> None:
    """Beside a store: rows and a digest of the ids of every version that doesn't depend on order; partial sums leave every
    task, so no version is gathered."""
    ids = F.sum(F.xxhash64("passage_id").cast("decimal(38,0)")).cast("string")
    passages.groupBy("version_id").agg(F.count("*").alias("passage_count"), ids.alias("id_digest")).write.mode("overwrite").json(path)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fail_if_any(violations: DataFrame, what: str) -> None:
    """Raises with an example if there is any violation."""
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")
