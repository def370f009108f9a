"""Marked-up source texts: header, body and physical lines with absolute offsets.

A source is text of one version: a magic line, ``#META#`` lines up to an end marker, and the body. Nothing is lost:
lines keep their ends and their offsets tile the body.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions.normalize import metadata_status, strip

#: Format of a source text.
MAGIC = "######OpenITI#"
HEADER_END = "#META#Header#End#"
MAX_HEADER_LINES = 1000
LINE_ENDS = "(?<=\\r\\n)|(?<=[\\n\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029])|(?<=\\r)(?!\\n)"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """version_id (file name) and text of every file; bytes that aren't UTF-8 fail the read, a BOM is dropped."""

    @F.pandas_udf(StringType())
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8-sig"))

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("version_id"), decoded("content").alias("text"))


def split_sources(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, has_magic, header, body, body_char_start and body_line_start (1-based) of each source.

    Without an end marker all is body; null texts are left out.
    """
    t = F.col(text)
    rows = df.where(t.isNotNull()).select(F.col(key), F.startswith(t, F.lit(MAGIC)).alias("has_magic"), t.alias("__t"), F.instr(t, HEADER_END).alias("__at"))
    after = F.expr("locate('\n', __t, __at)")
    start = F.when(F.col("__at") == 0, 0).when(after == 0, F.length("__t")).otherwise(after)
    rows = rows.withColumn("body_char_start", start)
    header = F.substring("__t", F.lit(1), F.col("body_char_start"))
    rows = rows.withColumn("header", header).withColumn("body", F.expr("substring(__t, body_char_start + 1)"))
    breaks = F.length("header") - F.length(F.replace("header", F.lit("\n"), F.lit("")))
    return rows.select(key, "has_magic", "header", "body", F.col("body_char_start").cast("long"), (breaks + 1).cast("long").alias("body_line_start"))


def source_lines(sources: DataFrame, key: str) -> DataFrame:
    """key, line_number, char_start, char_end (absolute, half-open), line (with its end) of every physical line."""
    pieces = sources.select(key, "body_char_start", "body_line_start", F.posexplode(F.split("body", LINE_ENDS)).alias("pos", "line"))
    pieces = pieces.where("line <> ''")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("body_char_start") + F.coalesce(F.sum(F.length("line")).over(before), F.lit(0))
    lines = pieces.select(key, (F.col("body_line_start") + F.col("pos")).alias("line_number"), start.alias("char_start"), "line")
    return lines.select(key, "line_number", "char_start", (F.col("char_start") + F.length("line")).alias("char_end"), "line")


def header_fields(sources: DataFrame, key: str) -> DataFrame:
    """key, line_number, field, raw_value, status and issue of every ``#META#`` line before the end marker, of at
    most the first 1000 lines of a header."""
    lines = sources.select(key, F.posexplode(F.split("header", "\\r\\n|\\n|\\r")).alias("pos", "line"))
    lines = lines.where(F.startswith("line", F.lit("#META#")) & ~F.startswith("line", F.lit(HEADER_END)) & (F.col("pos") < MAX_HEADER_LINES))
    content = strip(F.expr(f"substring(line, {len('#META#') + 1})"))
    lines = lines.select(key, (F.col("pos") + 1).cast("long").alias("line_number"), content.alias("content"))
    has = F.instr("content", ":") > 0
    name = F.when(has, strip(F.substring_index("content", ":", 1)))
    value = F.when(has, strip(F.expr("substring(content, instr(content, ':') + 1)")))
    parsed = lines.withColumn("field", F.when(name != "", name)).withColumn("raw_value", value)
    issue = (
        F.when(F.col("content") == "", "empty_header_line")
        .when(F.col("raw_value").isNull(), "unparsed_header_line")
        .when(F.col("field").isNull(), "invalid_header_field_name")
        .when(metadata_status("raw_value") == "placeholder", "placeholder_header_value")
    )
    status = F.when(F.col("field").isNotNull(), metadata_status("raw_value"))
    return parsed.select(key, "line_number", "field", "raw_value", status.alias("status"), issue.alias("issue"))


def sample_lines(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Lines of an inclusive range of line numbers."""
    return lines.where(F.col("line_number").between(start, end))


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key and issue (missing, unexpected) of ids on one side only."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("issue", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("issue", F.lit("unexpected")))


def is_indexable(include: Column, canonical: Column) -> Column:
    return F.coalesce(include, F.lit(False)) & F.coalesce(canonical, F.lit(False))
