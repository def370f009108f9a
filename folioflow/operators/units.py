"""Logical units of blocks, their page and heading context, and structural cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import ordered
from folioflow.operators.parsing import CONTENT_TYPES

#: Fixed value: a metadata note in a heading.
NOTE = "\\[\\s*([A-Za-z][A-Za-z0-9_-]*)\\s*:\\s*([^\\[\\]]+?)\\s*\\]"


def logical_units(blocks: DataFrame, key: str) -> DataFrame:
    """key, unit_id, unit_type, component_count, char_start, char_end, raw_text, has_gaps, issue of every group of
    content blocks, parts in source order. A group of several block types is an issue, as is content without one."""
    content = blocks.where(F.col("block_type").isin(*CONTENT_TYPES))
    part = F.struct("char_start", "char_end", "raw_text", "block_type")
    grouped = content.groupBy(key, "group_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.collect_set("block_type").alias("types"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    inner = F.expr("exists(sequence(1, greatest(size(parts) - 1, 1)), i -> i < size(parts) AND parts[i].char_start > parts[i - 1].char_end)")
    issue = F.when(F.col("group_id").isNull(), "content_without_group").when(F.size("types") > 1, "mixed_types")
    return grouped.select(
        key, F.concat(F.col(key).cast("string"), F.lit(":"), F.coalesce("group_id", F.lit("none"))).alias("unit_id"), first["block_type"].alias("unit_type"),
        F.size("parts").alias("component_count"), first["char_start"].alias("char_start"), last["char_end"].alias("char_end"),
        F.array_join(F.transform("parts", lambda p: p["raw_text"]), "").alias("raw_text"), inner.alias("has_gaps"), issue.alias("issue"),
    )


def merge_attributes(attributes: DataFrame, unit: str, name: str, value: str) -> DataFrame:
    """unit, name, value where the components of a unit agree; conflict where they don't (value null)."""
    per = attributes.where(F.col(value).isNotNull()).groupBy(unit, name).agg(F.countDistinct(value).alias("n"), F.min(value).alias("least"))
    return per.select(unit, name, F.when(F.col("n") == 1, F.col("least")).alias(value), (F.col("n") > 1).alias("conflict"))


def attribute_map(pairs: Column) -> Column:
    """A map of a list of (name, value) pairs; a name given twice fails, as a map can't hold it."""
    return F.map_from_entries(pairs)


def own_group(given: Column, noted: Column) -> tuple[Column, Column]:
    """The group id of a block, given by itself or noted among its attributes, and whether the two contradict."""
    return F.coalesce(given, noted), given.isNotNull() & noted.isNotNull() & (given != noted)


def spanned_markers(units: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """key, unit_id, n_pages, n_images, n_milestones and spans_page: markers (key, char_start, char_end, block_type) that lie
    within each unit. A marker belongs to the last unit that begins at or before it."""
    u = units.select(key, F.col("char_start").alias("at"), F.lit(0).alias("side"), F.struct("unit_id", "char_end").alias("unit"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("e"))
    m = markers.select(key, F.col("char_start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(u.schema["unit"].dataType).alias("unit"), F.col("block_type").alias("kind"), F.col("char_end").cast("long").alias("e"))
    rows = ordered.last_so_far(ordered.blocked(u.unionByName(m), [key], ["at", "side", "e"]), {"held": F.col("unit")}).where("side = 1 AND e <= held.char_end")
    count = lambda t: F.sum(F.when(F.col("kind") == t, 1).otherwise(0))
    per = rows.groupBy(key, F.col("held.unit_id").alias("unit_id")).agg(count("page_marker").alias("n_pages"), count("image_reference").alias("n_images"), count("milestone").alias("n_milestones"))
    out = units.select(key, "unit_id").join(per, [key, "unit_id"], "left").na.fill(0, ["n_pages", "n_images", "n_milestones"])
    return out.withColumn("spans_page", F.col("n_pages") > 0)


def page_context(units: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Units with the last marker that ends at or before them, the first that starts at or after them, and how many
    lie within. markers: key, char_start, char_end, label. One pass over both, ordered by position (as-of joins)."""
    empty = F.lit(None)
    u = units.select(key, "unit_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.lit(None).cast("string").alias("label"))
    m = markers.select(key, F.lit(None).cast("string").alias("unit_id"), F.col("char_start").alias("s"), F.col("char_end").alias("e"), "label")
    backward = u.withColumn("pos", F.col("s")).withColumn("side", F.lit(1)).unionByName(m.withColumn("pos", F.col("e")).withColumn("side", F.lit(0)))
    order = Window.partitionBy(key).orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = backward.withColumn("preceding", F.last("label", True).over(order)).withColumn("ended", F.sum(F.when(F.col("unit_id").isNull(), 1).otherwise(0)).over(order))
    before = before.where("unit_id IS NOT NULL").select(key, "unit_id", "preceding", "ended")
    forward = u.withColumn("pos", F.col("e")).withColumn("side", F.lit(0)).unionByName(m.withColumn("pos", F.col("s")).withColumn("side", F.lit(1)))
    order = Window.partitionBy(key).orderBy("pos", "side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    started = Window.partitionBy(key).orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = forward.withColumn("following", F.first("label", True).over(order))
    after = after.withColumn("started", F.sum(F.when(F.col("unit_id").isNull(), 1).otherwise(0)).over(started))
    after = after.where("unit_id IS NOT NULL").select(key, "unit_id", "following", "started")
    joined = units.join(before, [key, "unit_id"]).join(after, [key, "unit_id"])
    return joined.withColumn("embedded_markers", (F.col("started") - F.col("ended")).cast("long")).drop("started", "ended", empty)


LEVELS = range(1, 7)


def heading_context(units: DataFrame, key: str) -> DataFrame:
    """Units with section_id, heading_id, section_path and heading_path (ids of the headings above, from the outermost).

    A section clears the headings before it, a heading those of its own and deeper levels. The level of a heading is the
    number of its signs; one without any has level 1 and heading_issue says so.
    """
    kind = F.col("unit_type")
    signs = F.length(F.regexp_extract("raw_text", "^\\s*(#{1,6})", 1))
    level = F.when(kind == "heading", F.when(signs > 0, signs).otherwise(1))
    place = F.struct(F.col("char_start").alias("at"), F.col("unit_id").alias("id"))
    rows = units.withColumn("heading_issue", F.when((kind == "heading") & (signs == 0), "heading_without_level"))
    seen = {"__section": F.when(kind == "section", place), **{f"__h{n}": F.when(level == n, place) for n in LEVELS}}
    rows = ordered.plain(ordered.last_so_far(ordered.blocked(rows, [key], ["char_start", "unit_id"]), seen))
    held = []
    for n in LEVELS:
        own = F.col(f"__h{n}.at")
        above = F.coalesce(F.greatest(F.col("__section.at"), *(F.col(f"__h{m}.at") for m in LEVELS if m < n)) if n > 1 else F.col("__section.at"), F.lit(-1))
        held.append(F.when(own > above, F.col(f"__h{n}.id")))
    rows = rows.withColumn("heading_path", F.array_compact(F.array(*held))).withColumn("section_id", F.col("__section.id"))
    rows = rows.withColumn("section_path", F.array_compact(F.array("section_id"))).withColumn("heading_id", F.try_element_at("heading_path", F.lit(-1)))
    return rows.drop("__section", *(f"__h{n}" for n in LEVELS))


def order_violations(units: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """key, char_start, issue: units that overlap the one before, and markers that cross the edge of a unit."""
    u = ordered.neighbours(ordered.blocked(units.select(key, "char_start", "char_end"), [key], ["char_start", "char_end"]), ["char_end"], before="__b")
    overlap = u.where("__b.char_end > char_start").select(key, "char_start", F.lit("overlapping_units").alias("issue"))
    m = markers.select(key, F.col("char_start").alias("ms"), F.col("char_end").alias("me"))
    # Only the last unit that begins before a marker can hold or cross it.
    both = units.select(key, F.col("char_start").alias("at"), F.lit(0).alias("side"), F.col("char_end").alias("e"), F.lit(None).cast("long").alias("me"))
    both = both.unionByName(m.select(key, F.col("ms").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("e"), "me"))
    last = ordered.last_so_far(ordered.blocked(both, [key], ["at", "side", "me"]), {"__e": F.col("e")})
    crossing = last.where("side = 1 AND __e > at AND __e < me").select(key, F.col("at").alias("char_start"), F.lit("marker_crosses_unit").alias("issue"))
    return overlap.unionByName(crossing)


def cleaned_text(raw: Column, kind: Column, separator: str) -> Column:
    """Text of a unit without structural marks; half-lines are set apart by ``separator``."""
    lines = F.split(raw, "\\r\\n|\\n|\\r")
    head = kind.isin("heading", "section")

    def clean(x: Column, i: Column) -> Column:
        t = F.regexp_replace(x, "^\\s+", "")
        t = F.regexp_replace(t, "^(?:#{1,3}\\s*)+", "")
        t = F.when(head, F.regexp_replace(t, "^\\|{1,2}\\s*", "")).otherwise(t)
        t = F.regexp_replace(t, "^(?:~~\\s*)+", "")
        t = F.when((i == 0) & (kind == "verse"), F.regexp_replace(t, "^\\d+\\s+", "")).otherwise(t)
        t = F.when(head, F.regexp_replace(t, NOTE, " ")).otherwise(t)
        return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))

    text = F.array_join(F.filter(F.transform(lines, clean), lambda x: x != ""), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\s*%~%\\s*", separator), "(?U)\\s+", " "))


def repeated_units(units: DataFrame, key: str) -> DataFrame:
    """key, unit_id, n of units that occur more than once."""
    return units.groupBy(key, "unit_id").agg(F.count("*").alias("n")).where("n > 1")


def cleanup(units: DataFrame, number_column: str | None = None) -> DataFrame:
    """Units with display_text, retrieval_text, verse_number, notes (of headings; the first value of a name wins),
    cleanup_issues and the last of them as cleanup_issue. ``number_column`` holds the verse number that the unit should
    begin with, where one is known."""
    kind, raw = F.col("unit_type"), F.col("raw_text")
    number = F.regexp_extract(raw, "^\\s*(?:#{1,3}\\s*)+(\\d+)\\s", 1)
    names = F.regexp_extract_all(raw, F.lit(NOTE), F.lit(1))
    values = F.regexp_extract_all(raw, F.lit(NOTE), F.lit(2))
    first = F.expr("filter(sequence(0, size(names) - 1), i -> i >= 0 AND array_position(names, names[i]) = i + 1)")
    rows = units.withColumn("display_text", cleaned_text(raw, kind, " | ")).withColumn("retrieval_text", cleaned_text(raw, kind, " "))
    rows = rows.withColumn("verse_number", F.when((kind == "verse") & (number != ""), number.cast("int")))
    rows = rows.withColumn("names", F.when(kind.isin("heading", "section"), names).otherwise(F.array().cast("array<string>"))).withColumn("values", values)
    rows = rows.withColumn("first", F.when(F.size("names") > 0, first).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("notes", F.map_from_entries(F.expr("transform(first, i -> struct(names[i], trim(values[i])))")))
    conflict = F.expr("size(array_distinct(transform(arrays_zip(names, values), z -> concat(z.names, ':', z.values)))) > size(first)")
    told = F.col(number_column) if number_column else F.lit(None).cast("int")
    issues = F.array_compact(F.array(
        F.when((kind == "verse") & told.isNotNull() & F.col("verse_number").isNull(), "missing_verse_number_prefix"),
        F.when((kind == "verse") & (told != F.col("verse_number")), "verse_number_mismatch"),
        F.when((F.size("names") > 0) & conflict, "metadata_conflict"), F.when(F.col("retrieval_text") == "", "structural_only_unit"),
    ))
    # The most telling issue alone, and all of them.
    rows = rows.withColumn("cleanup_issue", F.try_element_at(issues, F.lit(-1))).withColumn("cleanup_issues", issues)
    return rows.drop("names", "values", "first")
