"""Runs over a whole corpus: gates that stop it, measures, and checks of blocks against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import ordered
from folioflow.operators.parsing import CONTENT_TYPES, IMAGE, MARKER_TYPES, MILESTONE, PAGE
from folioflow.sources.tables import fail_if_any


def described(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (of parsing.parse) with block_id, content_text and what their markup says: page_volume, page_number,
    milestone, image_alt, image_target, image_name, heading_level, verse_number; null where it says nothing."""
    raw, kind = F.col("raw_text"), F.col("block_type")
    number = lambda pattern, k, only: F.when(kind == only, F.try_to_number(F.nullif(F.regexp_extract(raw, pattern, k), F.lit("")), F.lit("999999999")).cast("int"))
    image = lambda k: F.when(kind == "image_reference", F.regexp_extract(raw, "!\\[([^\\]]*)\\]\\(([^)]+)\\)", k))
    return blocks.select(
        "*", F.format_string("%s:b%04d", F.col(key).cast("string"), F.col("block_no")).alias("block_id"),
        F.when(kind.isin(*MARKER_TYPES, "blank"), "").otherwise(F.trim(F.regexp_replace(raw, "^\\s+|\\s+$", ""))).alias("content_text"),
        number(PAGE, 1, "page_marker").alias("page_volume"), number(PAGE, 2, "page_marker").alias("page_number"), number(MILESTONE, 1, "milestone").alias("milestone"),
        image(1).alias("image_alt"), image(2).alias("image_target"), F.element_at(F.split(image(2), "/"), -1).alias("image_name"),
        F.when(kind == "heading", F.length(F.regexp_extract(raw, "^\\s*(#+)", 1))).alias("heading_level"), number("^\\s*#\\s*(\\d+)\\b", 1, "verse").alias("verse_number"),
    )


def corpus_violations(versions: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """key and issue that stop a run: a version listed twice, without a source, a source of no version, and a parse that
    loses or doubles text (metrics of parsing.parse_metrics)."""
    listed = versions.groupBy(key).agg(F.count("*").alias("n"))
    both = listed.join(metrics.select(key, "lossless"), key, "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("n") > 1, "repeated_version"), F.when(F.col("lossless").isNull(), "no_source"), F.when(F.col("n").isNull(), "unexpected_source"), F.when(~F.col("lossless"), "not_lossless"),
    ))
    return both.select(key, F.explode(found).alias("issue"))


def require_clean(violations: DataFrame) -> None:
    fail_if_any(violations, "the corpus can't be processed")


def corpus_measures(versions: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """One row: versions, indexable, canonical and reference ones, body characters, blocks, and whether all is lossless."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    canonical, include = F.coalesce("is_canonical", F.lit(False)), F.coalesce("include_in_index", F.lit(False))
    return versions.join(metrics, key, "left").agg(
        F.count("*").alias("n_versions"), n(canonical & include).alias("n_indexable"), n(canonical).alias("n_canonical"), n(~canonical).alias("n_reference"),
        F.coalesce(F.sum("body_chars"), F.lit(0)).cast("long").alias("body_chars"), F.coalesce(F.sum("n_blocks"), F.lit(0)).cast("long").alias("n_blocks"),
        F.coalesce(F.min(F.coalesce("lossless", F.lit(False))), F.lit(True)).alias("all_lossless"),
    )


def block_violations(blocks: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, block_no, issue of blocks (drafted or corrected by hand, too) that don't fit their source: empty or reversed,
    overlapping or apart from the block before, on no line, another text than the source has there, a marker whose text
    isn't one. lines: of marked.source_lines."""
    own = blocks.select(key, "block_no", "block_type", "line_number", "char_start", "char_end", "raw_text")
    rows = ordered.plain(ordered.neighbours(ordered.blocked(own, [key], ["char_start", "block_no"]), ["char_end"], before="__b"))
    at = lines.select(key, "line_number", F.col("char_start").alias("ls"), F.col("char_end").alias("le"), "line")
    rows = rows.join(at, [key, "line_number"], "left")
    inside = (F.col("char_start") >= F.col("ls")) & (F.col("char_end") <= F.col("le"))
    there = F.expr("substring(line, int(char_start - ls) + 1, int(char_end - char_start))")
    shape = F.when(F.col("block_type") == "page_marker", F.lit(PAGE)).when(F.col("block_type") == "milestone", F.lit(MILESTONE)).when(F.col("block_type") == "image_reference", F.lit(IMAGE))
    issues = F.array_compact(F.array(
        F.when(F.col("char_end") <= F.col("char_start"), "empty_or_reversed"), F.when(F.col("__b.char_end") > F.col("char_start"), "overlap"), F.when(F.col("__b.char_end") < F.col("char_start"), "gap"),
        F.when(~F.coalesce(inside, F.lit(False)), "wrong_line"), F.when(inside & (there != F.col("raw_text")), "text_differs"),
        F.when(shape.isNotNull() & ~F.coalesce(F.expr("regexp_like(raw_text, __shape)"), F.lit(False)), "marker_differs"),
    ))
    return rows.withColumn("__shape", shape).select(key, "block_no", F.explode(issues).alias("issue"))


def line_of_character(places: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """places (key, char) with the line_number of the line that holds each character: the last that begins at or before it."""
    a = places.select(key, F.col("char").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("e"))
    b = lines.select(key, F.col("char_start").alias("at"), F.lit(0).alias("side"), F.col("line_number").cast("long").alias("n"), F.col("char_end").cast("long").alias("e"))
    rows = ordered.last_so_far(ordered.blocked(a.unionByName(b), [key], ["at", "side"]), {"l": F.when(F.col("side") == 0, F.struct("n", "e"))})
    return rows.where("side = 1").select(key, F.col("at").alias("char"), F.when(F.col("at") < F.col("l.e"), F.col("l.n")).alias("line_number"))


def with_draft(samples: DataFrame, drafts: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Samples (key, blocks, ...) with the blocks drafted for them; samples that have blocks keep them unless forced."""
    new = drafts.select(key, F.col("blocks").alias("__new"))
    rows = samples.join(new, key, "left")
    empty = F.coalesce(F.size("blocks"), F.lit(0)) <= 0
    rows = rows.withColumn("drafted", F.col("__new").isNotNull() & (F.lit(force) | empty))
    return rows.withColumn("blocks", F.when(F.col("drafted"), F.col("__new")).otherwise(F.col("blocks"))).drop("__new")


def count_differences(blocks: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, block_type, expected, found where the number of blocks of a type isn't what is expected (key, block_type, n)."""
    found = blocks.groupBy(key, "block_type").agg(F.count("*").alias("found"))
    both = expected.select(key, "block_type", F.col("n").alias("expected")).join(found, [key, "block_type"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("expected <> found")


def content_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type").isin(*CONTENT_TYPES))


def marker_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type").isin(*MARKER_TYPES))
