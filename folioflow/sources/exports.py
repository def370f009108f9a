"""Parsed versions, passages, samples and reports as JSON, and the settings of a service."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, is_dataclass
from datetime import date, datetime
from enum import Enum
from pathlib import PurePath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.tables import fail_if_any

#: A parsed version as one JSON document (see write_parsed).
PARSED_SCHEMA = (
    "schema_version int, version struct<author_id: string, work_id: string, version_id: string, profile: string, include_in_index: boolean, is_canonical: boolean>, "
    "document struct<version_id: string, profile: string, blocks: array<struct<block_id: string, block_type: string, char_start: long, char_end: long, line_number: long, raw_text: string, group_id: string>>>"
)
GOLDEN_SCHEMA = (
    "schema_version string, sample_id string, version_id string, profile string, line_start int, line_end int, char_start long, char_end long, raw_text string, "
    "lines array<struct<line_number: int, char_start: long, char_end: long, text: string>>, "
    "annotations struct<status: string, blocks: array<struct<block_id: string, block_type: string, char_start: long, char_end: long, line_start: int, line_end: int, raw_text: string, group_id: string>>, notes: string>"
)


def plain_value(value: Any) -> Any:
    """A value of JSON's own types: data classes and mappings become objects, sequences lists, sets sorted lists, enums
    their values, dates and paths texts. Other types are refused."""
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, Enum):
        return plain_value(value.value)
    if is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain_value(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, Mapping):
        return {str(k): plain_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain_value(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain_value(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, PurePath):
        return value.as_posix()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def encoded_list(column: Column | str) -> Column:
    """A list of texts as compact JSON; null stays null."""
    return F.to_json(F.col(column) if isinstance(column, str) else column)


def decoded_list(column: Column | str) -> Column:
    """The texts of a JSON list; null where the text isn't a list."""
    return F.from_json(F.col(column) if isinstance(column, str) else column, "array<string>")


def parsed_documents(versions: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """One row per version: schema_version, version and document with its blocks in order."""
    block = F.struct("char_start", F.struct("block_id", "block_type", "char_start", "char_end", F.col("line_number").cast("long").alias("line_number"), "raw_text", "group_id").alias("b"))
    gathered = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))
    rows = versions.join(gathered, versions["version_id"] == gathered[key], "left")
    own = F.struct("author_id", "work_id", versions["version_id"], "profile", "include_in_index", "is_canonical")
    return rows.select(F.lit(1).alias("schema_version"), own.alias("version"), F.struct(versions["version_id"], "profile", F.coalesce("blocks", F.array()).alias("blocks")).alias("document"), versions["version_id"].alias("file"))


def write_parsed(documents: DataFrame, report: DataFrame, path: str) -> None:
    """Documents, laid out by version, one a line, and the report of the run beside them."""
    documents.write.mode("overwrite").partitionBy("file").json(f"{path}/versions")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed versions; one whose ids or profiles disagree, or which stands under another name, fails."""
    rows = spark.read.schema(PARSED_SCHEMA + ", file string").option("mode", "FAILFAST").json(path)
    fail_if_any(parsed_violations(rows), "parsed versions")
    return rows


def parsed_violations(rows: DataFrame) -> DataFrame:
    """version_id, issue of parsed versions that contradict themselves or occur twice."""
    v, d = F.col("version"), F.col("document")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    issues = F.array_compact(F.array(
        F.when(empty(v["version_id"]) | empty(v["work_id"]) | empty(v["author_id"]), "empty_id"), F.when(~v["version_id"].eqNullSafe(d["version_id"]), "version_differs"),
        F.when(~v["profile"].eqNullSafe(d["profile"]), "profile_differs"), F.when(F.col("file") != v["version_id"], "file_differs"),
    ))
    own = rows.select(v["version_id"].alias("version_id"), F.explode(issues).alias("issue"))
    twice = rows.groupBy(v["version_id"].alias("version_id")).agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(twice.select("version_id", F.lit("repeated_version").alias("issue")))


def write_passages(passages: DataFrame, path: str) -> None:
    """Passages of each version as JSON lines, replacing what stood there, and a manifest: lines, characters and a digest
    of every version that doesn't depend on order."""
    record = F.to_json(F.struct(*passages.columns), {"ignoreNullFields": "false"})
    rows = passages.select("version_id", record.alias("value"))
    rows.write.mode("overwrite").partitionBy("version_id").text(f"{path}/versions")
    sums = rows.groupBy("version_id").agg(F.count("*").alias("line_count"), F.sum(F.length("value") + 1).alias("char_count"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("digest"))
    sums.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Samples annotated by hand, one JSON document a file."""
    return spark.read.schema(GOLDEN_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def golden_blocks(samples: DataFrame) -> DataFrame:
    """Blocks of annotated samples in the form that corpus.block_violations checks."""
    rows = samples.select("sample_id", F.posexplode("annotations.blocks").alias("pos", "b"))
    return rows.select("sample_id", (F.col("pos") + 1).alias("block_no"), "b.block_type", "b.group_id", F.col("b.line_start").alias("line_number"), "b.char_start", "b.char_end", "b.raw_text")


def golden_lines(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.explode("lines").alias("l")).select("sample_id", "l.line_number", "l.char_start", "l.char_end", F.col("l.text").alias("line"))


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)


def sample_differences(samples: DataFrame, lines: DataFrame, version: str) -> DataFrame:
    """sample_id, line_number, issue: lines of a sample that its source hasn't there, or has otherwise."""
    own = samples.select("sample_id", F.col("version_id").alias("v"), F.explode("lines").alias("l")).select("sample_id", "v", "l.*")
    at = lines.select(F.col(version).alias("v"), "line_number", F.col("char_start").alias("s"), F.col("char_end").alias("e"), "line")
    rows = own.join(at, ["v", "line_number"], "left")
    issue = F.when(F.col("s").isNull(), "no_such_line").when((F.col("char_start") != F.col("s")) | (F.col("char_end") != F.col("e")), "offsets_differ").when(F.col("text") != F.col("line"), "text_differs")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("sample_id", "line_number", "issue")


def report_json(**parts: DataFrame) -> str:
    """Small reports (aggregates) as one JSON text."""
    return json.dumps({name: [plain_value(r.asDict(True)) for r in df.collect()] for name, df in parts.items()}, ensure_ascii=False, sort_keys=True)


def exit_code(violations: DataFrame | None) -> int:
    """0 where nothing is wrong, 1 where something is, 2 where nothing could be checked."""
    return 2 if violations is None else int(not violations.isEmpty())


@dataclass(frozen=True)
class ServiceSettings:
    """Where a service finds what it serves."""

    store: str
    index: str
    vectors: str
    limit: int = 10
    suggestions: bool = True

    @staticmethod
    def of(environment: Mapping[str, str] = os.environ, prefix: str = "FOLIOFLOW_") -> "ServiceSettings":
        """From variables such as FOLIOFLOW_STORE; what is missing or malformed is named."""
        got = {f.name: environment.get(prefix + f.name.upper(), "").strip() for f in fields(ServiceSettings)}
        lacking = [prefix + n.upper() for n in ("store", "index", "vectors") if not got[n]]
        if lacking:
            raise ValueError(f"set {', '.join(lacking)}")
        limit, flag = got["limit"] or "10", (got["suggestions"] or "true").lower()
        if not limit.isdigit() or int(limit) < 1:
            raise ValueError(f"{prefix}LIMIT is a positive whole number")
        if flag not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{prefix}SUGGESTIONS is true or false")
        return ServiceSettings(got["store"], got["index"], got["vectors"], int(limit), flag in ("true", "1", "yes"))

    def missing_paths(self, spark: SparkSession) -> list[str]:
        """Folders that aren't there, on whatever file system they lie."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        found = []
        for path in (self.store, self.index, self.vectors):
            p = jvm.org.apache.hadoop.fs.Path(path)
            if not p.getFileSystem(conf).exists(p):
                found.append(path)
        return found
