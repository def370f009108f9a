"""Lossless block parsing of marked-up lines, by profile.

Lines are classified by expressions; open verses and paragraphs are islands found by windows over the lines of a
source; inline markers cut a line into spans, which an array fold glues to their neighbours where they are only
white space. Every character of a body belongs to exactly one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POETRY, PROSE, RAW_OCR = "structured_poetry", "mixed_prose_ocr", "raw_ocr_reference"

# The markup of source texts.
PAGE = "(?i:PageV(\\d+)P(\\d+))"
MILESTONE = "(?<![A-Za-z0-9_])ms(\\d+)(?![A-Za-z0-9_])"
IMAGE = "!\\[[^\\]]*\\]\\([^)]+\\)"
DAFTAR = "(?i)^\\s*###\\s*\\|\\s*\\[\\s*daftar\\s+(\\d+)\\s*\\]\\s*$"
MAJLIS = "^\\s*#\\s*~{0,2}\\s*(مجلس\\s+.+?)\\s*$"
IMAGE_LINE = "^\\s*#?\\s*!\\[([^\\]]*)\\]\\(([^)]+)\\)\\s*$"
VERSE_NUMBER = "^\\s*#\\s*(\\d+)\\b"
HEMISTICH = "%~%"
MARKER_TYPES = ("page_marker", "image_reference", "milestone")
CONTENT_TYPES = ("heading", "section", "verse", "paragraph", "raw")


def markers_of(profile: Column) -> tuple[str, str]:
    """Patterns of inline markers: of poetry and prose, and of raw OCR, in which images are inline, too."""
    return f"{PAGE}|{MILESTONE}", f"{PAGE}|{MILESTONE}|{IMAGE}"


def marker_type(marker: Column) -> Column:
    return F.when(F.rlike(marker, F.lit(f"^{PAGE}$")), "page_marker").when(F.startswith(marker, F.lit("!")), "image_reference").otherwise("milestone")


def line_classes(lines: DataFrame, profile: str) -> DataFrame:
    """Adds ``class`` to lines (column ``line``) of a source profile (column ``profile``): blank, markers, image,
    section, heading, verse, continuation, paragraph or raw."""
    plain, with_images = markers_of(F.col(profile))
    bare = F.regexp_replace("line", "[\\r\\n]+$", "")
    stripped = F.regexp_replace("line", "^\\s+", "")
    raw_ocr = F.col(profile) == RAW_OCR
    marker = lambda p: F.rlike(bare, F.lit(p))
    rest = lambda p: F.trim(F.translate(F.regexp_replace(bare, p, " "), "#~|", ""))
    one = F.regexp_count(bare, F.lit(with_images)) == 1
    rest_raw = F.trim(F.regexp_replace(F.regexp_replace(bare, with_images, " "), "^\\s*~~", ""))
    only = F.when(raw_ocr, one & (rest_raw == "")).otherwise(marker(plain) & (F.regexp_replace(rest(plain), "\\s+", "") == ""))
    verse = F.startswith(stripped, F.lit("#")) & F.contains("line", F.lit(HEMISTICH))
    heading = F.startswith(stripped, F.lit("###"))
    follows = F.startswith(stripped, F.lit("~~"))
    poetry = (
        F.when(F.rlike(bare, F.lit(DAFTAR)), "section").when(heading, "heading").when(verse, "verse").when(follows, "continuation").otherwise("raw")
    )
    prose = (
        F.when(F.rlike(bare, F.lit(IMAGE_LINE)), "image").when(heading, "heading").when(F.rlike(bare, F.lit(MAJLIS)), "section")
        .when(verse, "verse").when(follows, "continuation").when(F.startswith(stripped, F.lit("#")), "paragraph").otherwise("raw")
    )
    kind = F.when(F.trim(F.translate(bare, "\t", " ")) == "", "blank").when(only, "markers").when(raw_ocr, "raw")
    return lines.withColumn("class", kind.when(F.col(profile) == POETRY, poetry).otherwise(prose))


def line_groups(lines: DataFrame, key: str, profile: str) -> DataFrame:
    """Adds block_type and group_id of the content of each classified line."""
    c = F.col("class")
    poetry = F.col(profile) == POETRY
    # What a line does to the open verse (poetry) or paragraph (prose): opens, closes, or leaves it.
    event = F.when(
        poetry, F.when(c == "verse", 1).when(c.isin("section", "heading", "raw", "blank"), 0)
    ).otherwise(F.when(c.isin("paragraph", "continuation"), 1).when(c.isin("heading", "section", "verse", "raw"), 0))
    order = Window.partitionBy(key).orderBy("line_number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("__event", event).withColumn("__open", F.coalesce(F.last("__event", True).over(before), F.lit(0)) == 1)
    orphan = (c == "continuation") & ~F.col("__open")
    kind = (
        F.when(c == "image", "image_reference").when(c.isin("blank", "markers"), c)
        .when(c == "continuation", F.when(poetry, F.when(F.col("__open"), "verse").otherwise("raw")).otherwise("paragraph")).otherwise(c)
    )
    rows = rows.withColumn("block_type", kind)
    starts = (
        F.when((c == "verse") | (c == "section") | (c == "heading") | (c == "paragraph"), 1)
        .when(orphan & ~poetry, 1).when((c == "raw") & (F.col(profile) == RAW_OCR), 1).otherwise(0)
    )
    rows = rows.withColumn("__starts", starts)
    number = F.sum("__starts").over(Window.partitionBy(key, "block_type").orderBy("line_number"))
    prefix = F.when(F.col("block_type") == "raw", "raw_ocr").otherwise(F.col("block_type"))
    grouped = F.col("block_type").isin("section", "heading", "verse", "paragraph") | ((F.col("block_type") == "raw") & (F.col(profile) == RAW_OCR))
    group = F.when(grouped, F.format_string("%s_%04d", prefix, number))
    return rows.withColumn("group_id", group).drop("__event", "__open", "__starts")


def _spans(profile: str) -> Column:
    """The line cut at its markers: content and markers in turn, white space glued to the span before (or after)."""
    plain, with_images = markers_of(F.col(profile))

    def cut(pattern: str) -> Column:
        parts = F.split("line", pattern)
        found = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        content = F.transform(parts, lambda x: F.struct(x.alias("text"), F.col("block_type").alias("kind")))
        marks = F.transform(found, lambda x: F.struct(x.alias("text"), marker_type(x).alias("kind")))
        both = F.arrays_zip(content.alias("a"), marks.alias("b"))
        return F.filter(F.flatten(F.transform(both, lambda z: F.array(z["a"], z["b"]))), lambda s: s.isNotNull() & (s["text"] != ""))

    return F.when(F.col(profile) == RAW_OCR, cut(with_images)).otherwise(cut(plain))


def blocks(grouped: DataFrame, key: str, profile: str) -> DataFrame:
    """key, block_no, block_type, group_id, line_number, char_start, char_end, raw_text of every block.

    Block numbers follow the source. Lines of markers only are tiled by their markers; blank lines are one block.
    """
    rows = grouped.withColumn("spans", F.when(F.col("block_type").isin("blank", "image_reference"), F.array(F.struct(F.col("line").alias("text"), F.col("block_type").alias("kind")))).otherwise(_spans(profile)))
    glued = F.expr(
        """aggregate(spans, cast(array() as array<struct<text: string, kind: string>>), (acc, s) -> CASE
             WHEN size(acc) > 0 AND (element_at(acc, -1).kind = 'waiting')
               THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('text', concat(element_at(acc, -1).text, s.text), 'kind',
                 IF(s.kind NOT IN ('page_marker', 'milestone', 'image_reference') AND (trim(translate(s.text, '\\t\\r\\n', '   ')) = '' OR block_type = 'markers'), 'waiting', s.kind))))
             WHEN s.kind NOT IN ('page_marker', 'milestone', 'image_reference') AND (trim(translate(s.text, '\\t\\r\\n', '   ')) = '' OR block_type = 'markers')
               THEN CASE WHEN size(acc) = 0 THEN array(named_struct('text', s.text, 'kind', IF(block_type = 'blank', 'blank', 'waiting')))
                 ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct('text', concat(element_at(acc, -1).text, s.text), 'kind', element_at(acc, -1).kind))) END
             ELSE concat(acc, array(s)) END)"""
    )
    rows = rows.withColumn("glued", glued)
    cut = rows.select(key, "line_number", "char_start", "group_id", "glued", F.posexplode("glued").alias("pos", "span"))
    offset = F.expr("aggregate(slice(glued, 1, pos), 0, (s, x) -> s + length(x.text))")
    kind = F.when(F.col("span.kind") == "waiting", "blank").otherwise(F.col("span.kind"))
    out = cut.select(
        key, "line_number", (F.col("char_start") + offset).alias("char_start"), kind.alias("block_type"), "group_id", F.col("span.text").alias("raw_text"), "pos"
    )
    order = Window.partitionBy(key).orderBy("line_number", "pos")
    out = out.withColumn("block_no", F.row_number().over(order)).withColumn("char_end", F.col("char_start") + F.length("raw_text"))
    group = F.when(F.col("block_type").isin(*CONTENT_TYPES), F.col("group_id"))
    return out.select(key, "block_no", "block_type", group.alias("group_id"), "line_number", "char_start", "char_end", "raw_text")


def parse(lines: DataFrame, key: str, profile: str) -> DataFrame:
    """Blocks of the lines of all sources (columns key, profile, line_number, char_start, line)."""
    return blocks(line_groups(line_classes(lines, profile), key, profile), key, profile)


def page_references(blocks_: DataFrame, key: str) -> DataFrame:
    """key, block_no, volume, page of page markers."""
    pages = blocks_.where("block_type = 'page_marker'")
    part = lambda k: F.regexp_extract("raw_text", PAGE, k).cast("int")
    return pages.select(key, "block_no", part(1).alias("volume"), part(2).alias("page"))


def interval_coverage(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered and covered_twice: lengths covered by at least one and by several half-open intervals.

    A sweep over interval ends; empty and reversed intervals cover nothing.
    """
    good = intervals.where(F.col(end) > F.col(start))
    events = good.select(key, F.col(start).alias("pos"), F.lit(1).alias("d")).unionByName(good.select(key, F.col(end).alias("pos"), F.lit(-1).alias("d")))
    steps = events.groupBy(key, "pos").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(key).orderBy("pos")
    depth = steps.withColumn("depth", F.sum("d").over(order)).withColumn("width", F.lead("pos").over(order) - F.col("pos"))
    total = lambda least: F.coalesce(F.sum(F.when(F.col("depth") >= least, F.col("width"))), F.lit(0)).cast("long")
    return depth.groupBy(key).agg(total(1).alias("covered"), total(2).alias("covered_twice"))


def parse_metrics(blocks_: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, n_blocks, body_chars, covered, covered_twice, raw_share, text_digest (of the text the blocks make up),
    reconstructs, lossless of each source."""
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("char_start", "raw_text"))), lambda x: x["raw_text"]))
    raw = F.sum(F.when(F.col("block_type") == "raw", F.length("raw_text")).otherwise(0))
    per = blocks_.groupBy(key).agg(F.count("*").alias("n_blocks"), text.alias("__text"), raw.alias("__raw"))
    cover = interval_coverage(blocks_, key, "char_start", "char_end")
    out = sources.select(key, "body", F.length("body").cast("long").alias("body_chars")).join(per, key, "left").join(cover, key, "left")
    covered = F.coalesce("covered", F.lit(0)).cast("long")
    twice = F.coalesce("covered_twice", F.lit(0)).cast("long")
    same = F.coalesce(F.col("__text"), F.lit("")) == F.col("body")
    return out.select(
        key, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "body_chars", covered.alias("covered"), twice.alias("covered_twice"),
        F.round(F.coalesce("__raw", F.lit(0)) / F.greatest("body_chars", F.lit(1)), 6).alias("raw_share"), F.md5(F.coalesce(F.col("__text"), F.lit(""))).alias("text_digest"), same.alias("reconstructs"),
        ((covered == F.col("body_chars")) & (twice == 0) & same).alias("lossless"),
    )
