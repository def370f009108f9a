"""Passages from the cleaned units of versions: strategy by profile, runs, windows and packing, texts, ids and links.

Every step is a plan over the units of all versions together. Verses meet their windows by arithmetic on their place
in the run; paragraphs are cut and packed by word counts; texts are put together per passage, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.config import PassageConfig
from folioflow.functions import normalize as nrm
from folioflow.functions import ordered
from folioflow.functions.lineage import settle
from folioflow.operators import passages
from folioflow.operators.parsing import POETRY, PROSE

#: Kinds of passages, and the part of a version id that tells a long rhymed work from other poetry.
DIWAN, MATHNAWI, MIXED = "diwan", "mathnawi", "mixed_prose"
RHYMED_WORK = ".Mathnawi."


def passage_kind(profile: Column, version: Column) -> Column:
    """What passages a version is built into; null where none are (versions kept for reference only)."""
    return F.when(profile == POETRY, F.when(F.contains(version, F.lit(RHYMED_WORK)), MATHNAWI).otherwise(DIWAN)).when(profile == PROSE, MIXED)


def prepared(units: DataFrame, version: str, profile: str, included: str | None = None) -> DataFrame:
    """Units (of units.cleanup and units.heading_context) as members: kind, role (boundary, member, skipped, other),
    the three text views and words.

    Units without text of their own are skipped; types that the kind doesn't take break a run like a boundary.
    """
    kind = passage_kind(F.col(profile), F.col(version).cast("string"))
    if included:
        kind = F.when(F.coalesce(F.col(included), F.lit(False)), kind)
    rows = units.withColumn("kind", kind).where("kind IS NOT NULL")
    rows = rows.withColumn("display_text", nrm.normalize_display("display_text")).withColumn("retrieval_text", nrm.normalize_retrieval("retrieval_text"))
    rows = rows.withColumn("search_alias_text", nrm.alias_from_retrieval("retrieval_text")).withColumn("words", nrm.word_count("retrieval_text"))
    taken = (F.col("unit_type") == "verse") | ((F.col("unit_type") == "paragraph") & (F.col("kind") == MIXED))
    empty = F.coalesce(F.col("retrieval_text"), F.lit("")) == ""
    role = F.when(F.col("unit_type").isin("heading", "section"), "boundary").when(empty, "skipped").when(taken, "member").otherwise("other")
    return rows.withColumn("role", role)


def _cut_long(members: DataFrame, config: PassageConfig) -> DataFrame:
    """Members with segment_no, segment_count and issues: paragraphs above the hard limit in pieces, each with views of
    its own, all others as they are."""
    plain = members.withColumns({"segment_no": F.lit(0), "segment_count": F.lit(1), "issues": F.array().cast("array<string>")})
    long_ = (F.col("unit_type") == "paragraph") & (F.col("words") > config.prose_hard_max) & (F.col("kind") == MIXED)
    rows = members.where(long_)
    cut = T.StructType([T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("apart", T.BooleanType())])
    schema = T.StructType([*rows.schema.fields, T.StructField("cut", cut)])
    at_ = rows.columns.index("display_text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passages.split_paragraph(t or "", config) for t in batch.column(at_).to_pylist()]
            struct = pa.array([{"pieces": p, "apart": a} for p, a in found], pa.struct([("pieces", pa.list_(pa.string())), ("apart", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=schema.names)

    pieces = rows.mapInArrow(split, schema)
    pieces = pieces.select(*members.columns, F.posexplode("cut.pieces").alias("segment_no", "piece"), F.size("cut.pieces").alias("segment_count"), "cut.apart")
    pieces = pieces.withColumn("display_text", nrm.normalize_display("piece")).withColumn("retrieval_text", nrm.normalize_retrieval("piece"))
    pieces = pieces.withColumn("search_alias_text", nrm.alias_from_retrieval("retrieval_text")).withColumn("words", nrm.word_count("retrieval_text"))
    told = F.array(F.when(F.col("apart"), "oversized_unit_word_split").otherwise("oversized_unit_sentence_split"))
    over = F.when(F.col("words") > config.prose_hard_max, F.array(F.lit("fragment_above_limit"))).otherwise(F.array().cast("array<string>"))
    pieces = pieces.withColumn("issues", F.concat(told, over)).drop("piece", "apart")
    return plain.where(~long_).unionByName(pieces)


def _in_windows(verses: DataFrame, config: PassageConfig) -> DataFrame:
    """Verses (version, run_id, place from 0, kind) with passage_no of every window they are in."""
    size, step = config.verse_window, config.verse_window - config.verse_overlap
    runs = verses.groupBy("version", "run_id").agg(F.count("*").alias("n"), F.min("place").alias("base"))
    rows = verses.join(runs, ["version", "run_id"]).withColumn("i", F.col("place") - F.col("base"))
    least = F.when(F.col("kind") == DIWAN, config.diwan_min_tail).otherwise(config.mathnawi_min_tail)
    last = F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / step)).cast("long")
    # The last window goes back to the end of the run where too few verses would be left for it.
    moved = (F.col("n") > size) & (F.col("n") - F.col("last") * step < least)
    start = lambda k: F.when((k == F.col("last")) & moved, F.greatest(F.col("n") - size, F.lit(0))).otherwise(k * step)
    near = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // step)), lambda d: F.floor(F.col("i") / step) - d), F.array(F.col("last"))))
    rows = rows.withColumn("last", last).withColumn("k", F.explode(near)).where("k >= 0 AND k <= last")
    rows = rows.withColumn("s", start(F.col("k"))).where((F.col("i") >= F.col("s")) & (F.col("i") < F.col("s") + size))
    return rows.withColumn("passage_no", (F.col("k") + 1).cast("int")).drop("n", "base", "i", "last", "k", "s")


def build(units: DataFrame, version: str, profile: str, included: str | None = None, config: PassageConfig = PassageConfig()) -> DataFrame:
    """Passages of all versions: version_id, passage_id, ordinal, kind, run_id, heading_path, section_path, unit_ids,
    unit_count, member_count, word_count, has_split_member, parent_context_id, the three texts, previous_passage_id,
    next_passage_id, issues.

    Ordinals count the passages of a version from 1 in the order of the source; links stay within a run. Verses of one
    window stand line by line, pieces of one unit go on in the line, other members are set apart by a blank line.
    """
    rows = prepared(units, version, profile, included).withColumn("version", F.col(version).cast("string"))
    rows = rows.select("version", "kind", "role", "unit_id", "unit_type", "char_start", "heading_path", "section_path", "display_text", "retrieval_text", "search_alias_text", "words")
    rows = passages.runs(rows.withColumn("breaks", F.col("role") != "member"), "version", "char_start", ["heading_path", "section_path"], "breaks")
    members = settle(rows.where("role = 'member'").drop("role", "breaks"))
    verses = members.where(F.col("kind") != MIXED)
    placed = ordered.running_sum(ordered.blocked(verses.withColumn("one", F.lit(1)), ["version"], ["char_start"]), "one", "place")
    windowed = _in_windows(ordered.plain(placed).drop("one"), config).drop("place")
    windowed = windowed.withColumns({"segment_no": F.lit(0), "segment_count": F.lit(1), "issues": F.array().cast("array<string>")})
    cut = settle(_cut_long(members.where(F.col("kind") == MIXED), config))
    at_ = cut.select("version", "run_id", F.struct("char_start", "segment_no").alias("at"), F.least("words", F.lit(config.prose_hard_max)).alias("words"))
    packed = passages.pack_prose(at_, ["version", "run_id"], "at", "words", config)
    packed = cut.join(packed.select("version", F.col("at.char_start").alias("char_start"), F.col("at.segment_no").alias("segment_no"), "passage_no"), ["version", "char_start", "segment_no"])
    held = windowed.unionByName(packed.select(*windowed.columns))
    fields = ["char_start", "segment_no", "segment_count", "unit_id", "unit_type", "display_text", "retrieval_text", "search_alias_text", "words", "issues"]
    gathered = held.groupBy("version", "run_id", "passage_no").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("m"), F.first("kind").alias("kind"), F.first("heading_path").alias("heading_path"), F.first("section_path").alias("section_path")
    )
    gathered = gathered.withColumn("first_char", F.col("m")[0]["char_start"]).withColumn("one", F.lit(1))
    numbered = ordered.running_sum(ordered.blocked(gathered, ["version"], ["first_char", "run_id", "passage_no"]), "one", "ordinal", inclusive=True)
    numbered = ordered.neighbours(numbered, ["run_id"], "__p", "__n").withColumn("ordinal", F.col("ordinal").cast("int"))

    def text(field: str) -> Column:
        return F.expr(
            f"concat_ws('', transform(m, (x, i) -> concat(CASE WHEN i = 0 THEN '' WHEN m[i - 1].unit_id = x.unit_id THEN ' ' "
            f"WHEN m[i - 1].unit_type = 'verse' AND x.unit_type = 'verse' THEN '\\n' ELSE '\\n\\n' END, x.{field})))"
        )

    linked = lambda side, step: F.when(F.col(f"{side}.run_id") == F.col("run_id"), F.format_string("%s:passage_%06d", F.col("version"), F.col("ordinal") + step))
    ids = F.array_distinct(F.transform("m", lambda x: x["unit_id"]))
    return numbered.select(
        F.col("version").alias("version_id"), passages.passage_id("version", "ordinal").alias("passage_id"), "ordinal", "kind", "run_id", "heading_path", "section_path",
        ids.alias("unit_ids"), F.size(ids).alias("unit_count"), F.size("m").alias("member_count"), F.aggregate("m", F.lit(0), lambda s, x: s + x["words"]).alias("word_count"),
        F.exists("m", lambda x: x["segment_count"] > 1).alias("has_split_member"),
        F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.try_element_at("section_path", F.lit(-1))).alias("parent_context_id"),
        text("display_text").alias("display_text"), text("retrieval_text").alias("retrieval_text"), text("search_alias_text").alias("search_alias_text"),
        linked("__p", -1).alias("previous_passage_id"), linked("__n", 1).alias("next_passage_id"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["issues"]))).alias("issues"),
    )


def skipped_units(units: DataFrame, version: str, profile: str, included: str | None = None) -> DataFrame:
    """version_id, unit_id, issue of units that no passage takes for lack of text."""
    rows = prepared(units, version, profile, included).where("role = 'skipped'")
    return rows.select(F.col(version).cast("string").alias("version_id"), "unit_id", F.lit("empty_content_unit").alias("issue"))


def build_violations(built: DataFrame, members: DataFrame, skipped: DataFrame) -> DataFrame:
    """version_id, id, issue: units of ``members`` (version_id, unit_id) that neither a passage nor ``skipped`` has, units
    in both, and pieces above the hard limit. No row is right."""
    covered = built.select("version_id", F.explode("unit_ids").alias("unit_id")).distinct()
    lost = members.join(covered, ["version_id", "unit_id"], "left_anti").join(skipped, ["version_id", "unit_id"], "left_anti")
    both = skipped.select("version_id", "unit_id").join(covered, ["version_id", "unit_id"], "left_semi")
    large = built.where(F.array_contains("issues", "fragment_above_limit")).select("version_id", F.col("passage_id").alias("id"), F.lit("fragment_above_limit").alias("issue"))
    name = lambda df, issue: df.select("version_id", F.col("unit_id").alias("id"), F.lit(issue).alias("issue"))
    return name(lost, "unit_in_no_passage").unionByName(name(both, "skipped_unit_in_passage")).unionByName(large)


def build_report(built: DataFrame, skipped: DataFrame) -> DataFrame:
    """part, name, n: passages by kind, passages by issue, skipped units by issue."""
    kinds = built.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("part"), "name", "n")
    issues = built.select(F.explode("issues").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("passage_issue").alias("part"), "name", "n")
    left = skipped.groupBy(F.col("issue").alias("name")).agg(F.count("*").alias("n")).select(F.lit("build_issue").alias("part"), "name", "n")
    return kinds.unionByName(issues).unionByName(left)
