"""Metadata of versions: YAML-like files and text headers as one long table of fields, combined into documents.

A field row is (version_id, source, line_number, field, value, status, issue); source is author_yml, work_yml,
version_yml or text_header. Strictly valid YAML is read as such, anything else line by line without losing a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.normalize import comma_list, metadata_status, strip, version_language, version_language_code
from folioflow.sources.marked import header_fields

FIELDS = ["version_id", "source", "line_number", "field", "value", "status", "issue"]

# Names of the fields that documents are made of.
AUTHOR_URI, WORK_URI, VERSION_URI = "00#AUTH#URI######", "00#BOOK#URI######", "00#VERS#URI######"
NAME_AR, NAME_EN, TITLE = "10#AUTH#SHUHRA#AR", "10#AUTH#SHUHRA#EN", "10#BOOK#TITLEA#AR"
BASED, LINKS, QUALITY = "80#VERS#BASED####", "80#VERS#LINKS####", "90#VERS#ISSUES###"
URL, ORIGIN, LAYER, CONFIDENCE = "url", "Origin", "transcription layer name", "avg transcription confidence"

ENTRIES = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType()), T.StructField("scalar", T.BooleanType())]))


def _strict(text: str | None) -> list[dict] | None:
    """Entries of a YAML mapping, values as they are written; None if the text isn't one."""
    try:
        data = yaml.load(text or "", yaml.BaseLoader)
    except (yaml.YAMLError, ValueError):
        return None
    if not isinstance(data, dict):
        return None
    return [{"field": k if isinstance(k, str) else None, "value": v if isinstance(v, str) else yaml.safe_dump(v), "scalar": isinstance(v, str)} for k, v in data.items()]


def yaml_fields(files: DataFrame) -> DataFrame:
    """Field rows of metadata files (version_id, source, text). Fields of strict YAML are numbered in their order,
    others by the line they begin on."""
    schema = T.StructType([T.StructField("version_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("entries", ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("scalar", pa.bool_())]))
        for batch in batches:
            found = [_strict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

    read = files.where("text IS NOT NULL").select(F.col("version_id").cast("string"), "source", "text").mapInArrow(run, schema)
    strict = read.where("entries IS NOT NULL").select("version_id", "source", F.posexplode("entries").alias("pos", "e"))
    name = F.when(strip("e.field") != "", strip("e.field"))
    status = F.when(~F.col("e.scalar"), "malformed").otherwise(metadata_status("e.value"))
    strict = strict.select("version_id", "source", (F.col("pos") + 1).alias("line_number"), name.alias("field"), strip("e.value").alias("value"), status.alias("status"))
    return _judged(strict).unionByName(_by_lines(read.where("entries IS NULL").select("version_id", "source", "text")))


def _judged(rows: DataFrame) -> DataFrame:
    status = F.when(F.col("field").isNotNull(), F.col("status"))
    issue = F.when(F.col("field").isNull(), "invalid_field_name").when(status == "placeholder", "placeholder_value").when(status == "malformed", "non_scalar_value")
    value = F.when(status != "missing", F.col("value"))
    return rows.select("version_id", "source", F.col("line_number").cast("long"), "field", value.alias("value"), status.alias("status"), issue.alias("issue"))


def _by_lines(files: DataFrame) -> DataFrame:
    """Fields of files that aren't strict YAML: a field goes on in indented lines and in lines that are nothing else."""
    lines = files.select("version_id", "source", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    bare = strip("line")
    kind = (
        F.when(bare == "", "blank").when(bare.isin("---", "...") | (F.startswith(bare, F.lit("#")) & (F.instr(bare, ":") == 0)), "comment")
        .when(F.rlike("line", F.lit("^[ \\t]")), "indented").when(F.rlike("line", F.lit("^[^\\s:][^:]*:")), "field").otherwise("stray")
    )
    file = Window.partitionBy("version_id", "source").orderBy("pos")
    rows = lines.withColumn("kind", kind).where("kind <> 'comment'")
    rows = rows.withColumn("open", F.last(F.when(F.col("kind") == "field", F.col("pos")), True).over(file))
    part = F.when(F.col("kind") == "field", strip(F.expr("substring(line, instr(line, ':') + 1)"))).otherwise(strip("line"))
    held = rows.where("open IS NOT NULL").groupBy("version_id", "source", "open").agg(
        F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"), F.max(F.when(F.col("kind") == "field", strip(F.substring_index("line", ":", 1)))).alias("field")
    )
    # Blank lines before the first part of a value and after its last one say nothing.
    value = strip(F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    fields = held.select("version_id", "source", (F.col("open") + 1).alias("line_number"), "field", value.alias("value")).withColumn("status", metadata_status("value"))
    loose = (
        F.when((F.col("kind") == "indented") & F.col("open").isNull(), "orphan_continuation_line").when((F.col("kind") == "stray") & F.col("open").isNull(), "unparsed_yaml_line")
        .when(F.col("kind") == "stray", "unparsed_yaml_line_attached")
    )
    told = rows.withColumn("issue", loose).where("issue IS NOT NULL")
    none = F.lit(None).cast("string")
    told = told.select("version_id", "source", (F.col("pos") + 1).cast("long").alias("line_number"), none.alias("field"), none.alias("value"), none.alias("status"), "issue")
    return _judged(fields).unionByName(told)


def header_rows(sources: DataFrame, key: str) -> DataFrame:
    """Field rows of the headers of split sources (see marked.split_sources)."""
    rows = header_fields(sources, key)
    value = F.when(F.col("status") != "missing", strip("raw_value"))
    return rows.select(F.col(key).cast("string").alias("version_id"), F.lit("text_header").alias("source"), "line_number", "field", value.alias("value"), "status", "issue")


def read_metadata_files(spark: SparkSession, path: str, source: str) -> DataFrame:
    """version_id (file name without its ending), source and text of metadata files; bytes that aren't UTF-8 fail."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.ya?ml$", "")
    text = F.regexp_replace(F.expr("validate_utf8(cast(content as string))"), "^\\uFEFF", "")
    return files.select(name.alias("version_id"), F.lit(source).alias("source"), text.alias("text"))


def get_all(fields: DataFrame, name: str) -> DataFrame:
    return fields.where(F.col("field") == name)


def get_first(fields: DataFrame, name: str) -> DataFrame:
    """The first row of a field in each source of each version."""
    return get_all(fields, name).groupBy("version_id", "source").agg(F.min_by(F.struct(*FIELDS[2:]), "line_number").alias("r")).select("version_id", "source", "r.*")


def of_status(fields: DataFrame, status: str) -> DataFrame:
    """Valid, placeholder, missing or malformed fields."""
    return fields.where(F.col("status") == status)


def first_valid(source: str, name: str, like: str | None = None) -> Column:
    """Aggregate over field rows: the first valid value of a field; ``like`` is a pattern it must match."""
    good = (F.col("source") == source) & (F.col("field") == name) & (F.col("status") == "valid")
    if like:
        first = F.min_by(F.when(good, F.col("value")), F.when(good, F.col("line_number")))
        return F.when(F.rlike(first, F.lit(like)), first)
    return F.min_by(F.when(good, F.col("value")), F.when(good, F.col("line_number")))


def document_metadata(versions: DataFrame, works: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per version (version_id, work_id, author_id, profile, is_canonical, include_in_index) with what its
    metadata say, and issues: codes of identifiers that are missing or differ, of a confidence that is no number, of a
    version id without a language, and of the field rows.

    The ids of the versions count, whatever the files say. works: work_id, title_fa. Names fall back from the Arabic to
    the English one and to the author id, the address from what the version is based on to the header's and to links.
    """
    web = "^https?://"
    per = fields.groupBy("version_id").agg(
        first_valid("author_yml", AUTHOR_URI).alias("__author"), first_valid("work_yml", WORK_URI).alias("__work"), first_valid("version_yml", VERSION_URI).alias("__version"),
        first_valid("author_yml", NAME_AR).alias("author_name_ar"), first_valid("author_yml", NAME_EN).alias("author_name_en"), first_valid("work_yml", TITLE).alias("title_transliterated"),
        F.coalesce(first_valid("version_yml", BASED, web), first_valid("text_header", URL, web), first_valid("version_yml", LINKS, web)).alias("source_url"),
        first_valid("version_yml", QUALITY).alias("__quality"), first_valid("text_header", ORIGIN).alias("origin"), first_valid("text_header", LAYER).alias("transcription_layer"),
        first_valid("text_header", CONFIDENCE).alias("__confidence"), F.array_sort(F.collect_set("issue")).alias("__issues"),
    )
    rows = versions.join(per, "version_id", "left").join(works.select("work_id", "title_fa").dropDuplicates(["work_id"]), "work_id", "left")
    confidence = F.expr("try_cast(__confidence AS double)")

    def checked(column: str, own: str, label: str) -> Column:
        return F.when(F.col(column).isNull(), f"missing_{label}").when(F.col(column) != F.col(own), f"{label}_mismatch")

    own = F.array_compact(F.array(
        checked("__author", "author_id", "author_uri"), checked("__work", "work_id", "work_uri"), checked("__version", "version_id", "version_uri"),
        F.when(F.col("__confidence").isNotNull() & confidence.isNull(), "invalid_ocr_confidence"), F.when(version_language_code("version_id").isNull(), "missing_language_code"),
    ))
    return rows.select(
        "version_id", "work_id", "author_id", F.coalesce("author_name_ar", "author_name_en", "author_id").alias("author_name"), "author_name_ar", "author_name_en", "title_fa", "title_transliterated",
        version_language_code("version_id").alias("language_code"), version_language("version_id").alias("language"), "source_url",
        F.coalesce(comma_list("__quality"), F.array().cast("array<string>")).alias("text_quality"), "origin", "transcription_layer", confidence.alias("ocr_confidence"),
        "profile", "is_canonical", "include_in_index", F.concat(F.coalesce("__issues", F.array().cast("array<string>")), own).alias("issues"),
    )
