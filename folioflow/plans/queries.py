"""Queries of the engine's own operators, each with the SQL that DuckDB runs on the same tables where there is one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import normalize as nrm
from folioflow.functions.lineage import settle, shared_folder, spread
from folioflow.operators import building, corpus, dense, evaluation, evidence, fusion, inventory, lexical, parsing, passages, policy, search, store, units
from folioflow.plans import parsesql as psql
from folioflow.plans import sqltext as sql
from folioflow.sources import marked, metadata, stores
from folioflow.sources.tables import duplicates, table
from folioflow.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# Text views


@query(f"SELECT passage_id, {sql.display('display_text')} AS display_view FROM passages")
def norm_display(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "passages").select("passage_id", nrm.normalize_display("display_text").alias("display_view"))


@query(f"SELECT passage_id, {sql.retrieval(sql.display('display_text'))} AS retrieval_view FROM passages")
def norm_retrieval(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "passages").select("passage_id", nrm.normalize_retrieval("display_text").alias("retrieval_view"))


@query(f"SELECT passage_id, {sql.search_alias('display_text')} AS alias_view FROM passages")
def norm_alias(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "passages").select("passage_id", nrm.normalize_search_alias("display_text").alias("alias_view"))


@query()
def norm_scope(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "passages").select("passage_id", nrm.normalize_scope("display_text").alias("scope_view"))


def _found(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


NO_SPACE = sql.WHITE.replace(" ", "", 1)
STEPS = rf"""a AS (SELECT passage_id, display_text AS t, replace(replace(display_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS le FROM passages WHERE display_text IS NOT NULL),
b AS (SELECT *, nfc_normalize(le) AS nfc FROM a), c AS (SELECT *, replace(nfc, chr(1728), chr(1607) || chr(1620)) AS heh FROM b), d AS (SELECT *, translate(heh, chr(160) || chr(8199) || chr(8239), '   ') AS sp FROM c),
e AS (SELECT *, regexp_replace(sp, '{sql.CONTROLS}', '', 'g') AS ctl FROM d), f AS (SELECT *, regexp_replace(ctl, '{sql.FORMATS}', '', 'g') AS fmt FROM e),
g AS (SELECT *, regexp_replace(regexp_replace(fmt, '[ 	]+', ' ', 'g'), '(?m)^[{sql.BLANK}]+|[{sql.BLANK}]+$', '', 'g') AS col FROM f), h AS (SELECT *, {sql.strip('col')} AS shown FROM g),
i AS (SELECT *, replace(replace(replace(regexp_replace(regexp_replace(translate(shown, 'يىك{nrm.ARABIC_DIGITS}', 'ییک{nrm.DIGITS}'), '{sql.HARAKAT}', '', 'g'), '{sql.QURANIC}', '', 'g'), chr(1600), ''), chr(8204), ' '), chr(8205), '') AS bare FROM h),
j AS (SELECT *, {sql.squeeze('bare')} AS searched FROM i)"""
CHANGES = [
    ("display", "normalize_line_endings", _found("t", r"\r\n|\r")), ("display", "unicode_nfc", "CAST(nfc <> le AS INTEGER)"), ("display", "standardize_heh_hamza", _found("nfc", r"\x{06C0}")),
    ("display", "normalize_space_variants", _found("heh", r"[\x{00A0}\x{2007}\x{202F}]")), ("display", "remove_control_characters", _found("sp", sql.CONTROLS)), ("display", "remove_format_characters", _found("ctl", sql.FORMATS)),
    ("display", "collapse_horizontal_spaces", _found("fmt", r"(?m)^[ \t]+|[ \t]+$|\t[ \t]*|[ \t][ \t]+")), ("display", "trim_outer_whitespace", "CAST(shown <> col AS INTEGER)"),
    ("retrieval", "map_yeh_variants", _found("shown", "[يى]")), ("retrieval", "map_arabic_kaf", _found("shown", "ك")), ("retrieval", "map_digits_to_ascii", _found("shown", f"[{nrm.ARABIC_DIGITS}]")),
    ("retrieval", "remove_arabic_harakat", _found("shown", sql.HARAKAT)), ("retrieval", "remove_quranic_marks", _found("shown", sql.QURANIC)), ("retrieval", "remove_tatweel", _found("shown", r"\x{0640}")),
    ("retrieval", "replace_zwnj_with_space", _found("shown", r"\x{200C}")), ("retrieval", "remove_zwj", _found("shown", r"\x{200D}")), ("retrieval", "collapse_whitespace", _found("bare", f"^{sql.WHITE}+|{sql.WHITE}+$|{sql.WHITE}{sql.WHITE}+|{NO_SPACE}")),
    ("search_alias", "fold_alef_hamza_variants", _found("searched", "[أإٱ]")), ("search_alias", "fold_ta_marbuta", _found("searched", "ة")), ("search_alias", "fold_heh_hamza", _found("searched", r"\x{0647}\x{0654}")),
]


@query(f"WITH {STEPS} SELECT passage_id, view, operation, CAST(n AS INTEGER) AS count FROM (" + " UNION ALL ".join(f"SELECT passage_id, '{v}' AS view, '{o}' AS operation, {n} AS n FROM j" for v, o, n in CHANGES) + ") WHERE n > 0")
def norm_changes(spark: SparkSession, at: str) -> DataFrame:
    return nrm.normalization_changes(spread(table(spark, at, "passages").select("passage_id", "display_text")), "display_text").drop("display_text")


@query(
    """SELECT version_id, CASE WHEN p AND a THEN 'mixed_signals' WHEN p THEN 'persian_signals_only' WHEN a THEN 'arabic_variants_only' ELSE 'shared_or_other_only' END AS script_profile, count(*) AS n
    FROM (SELECT version_id, regexp_matches(display_text, '[پچژگکی]') AS p, regexp_matches(display_text, '[يكىةأإٱؤئ]') AS a FROM passages WHERE display_text IS NOT NULL) GROUP BY 1, 2"""
)
def script_profiles(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "passages").where("display_text IS NOT NULL")
    return rows.groupBy("version_id", nrm.script_profile("display_text").alias("script_profile")).agg(F.count("*").alias("n"))


CHARACTERS = {
    "arabic_digits": "[٠-٩]", "persian_digits": "[۰-۹]", "ascii_digits": "[0-9]", "tatweel": "ـ", "zwnj": "‌", "zwj": "‍",
    "nbsp": " ", "arabic_yeh": "[يى]", "arabic_kaf": "ك", "teh_marbuta": "ة", "hemistich": "\\|", "newline": "\\n",
}


@query(
    "SELECT version_id, count(*) AS n_passages, "
    + ", ".join(f"CAST(sum(length(display_text) - length(regexp_replace(display_text, '{p}', '', 'g'))) AS BIGINT) AS n_{k}" for k, p in CHARACTERS.items())
    + " FROM passages GROUP BY version_id"
)
def char_inventory(spark: SparkSession, at: str) -> DataFrame:
    counts = [F.sum(F.regexp_count("display_text", F.lit(p))).cast("long").alias(f"n_{k}") for k, p in CHARACTERS.items()]
    return table(spark, at, "passages").groupBy("version_id").agg(F.count("*").alias("n_passages"), *counts)


@query(
    """SELECT version_id, ord(c) AS code_point, count(*) AS n FROM (SELECT version_id, unnest(regexp_extract_all(display_text, '(?s).')) AS c FROM passages) GROUP BY ALL"""
)
def code_points(spark: SparkSession, at: str) -> DataFrame:
    return inventory.code_points(spread(table(spark, at, "passages").select("version_id", "display_text")), "version_id", "display_text")


@query(
    """WITH w AS (SELECT version_id, passage_id, unnest(regexp_extract_all(display_text, '[0-9٠-٩۰-۹]+')) AS found FROM passages),
    c AS (SELECT version_id, CASE WHEN regexp_matches(found, '^[0-9]+$') THEN 'ascii' WHEN regexp_matches(found, '^[٠-٩]+$') THEN 'arabic' WHEN regexp_matches(found, '^[۰-۹]+$') THEN 'persian' ELSE 'mixed' END AS kind, found, passage_id FROM w)
    SELECT version_id, kind, CAST(row_number() OVER (PARTITION BY version_id, kind ORDER BY n DESC, found) AS INTEGER) AS place, found, n FROM (SELECT version_id, kind, found, count(*) AS n FROM c GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY version_id, kind ORDER BY n DESC, found) <= 25"""
)
def digit_examples(spark: SparkSession, at: str) -> DataFrame:
    """The most frequent numbers of each digit script in each version, 25 at most."""
    return inventory.digit_examples(spread(table(spark, at, "passages").select("version_id", "display_text")), "version_id", "display_text", 25)


@query(
    f"""SELECT version_id, CASE WHEN v IS NULL OR v = '' THEN 'missing' WHEN regexp_matches(v, '(?i){'|'.join(nrm.PLACEHOLDER_PHRASES)}') THEN 'placeholder' ELSE 'valid' END AS status
    FROM (SELECT version_id, {sql.strip('status_raw')} AS v FROM versions)"""
)
def metadata_statuses(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "versions").select("version_id", nrm.metadata_status("status_raw").alias("status"))


@query(
    """SELECT version_id, code, CASE code WHEN 'per' THEN 'Persian' WHEN 'ara' THEN 'Arabic' ELSE code END AS language
    FROM (SELECT version_id, nullif(lower(regexp_extract(version_id, '(?i)-([a-z]{3})[0-9]+$', 1)), '') AS code FROM versions)"""
)
def version_languages(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "versions").select("version_id", nrm.version_language_code("version_id").alias("code"), nrm.version_language("version_id").alias("language"))


@query(
    f"""SELECT part, count(*) AS n FROM (SELECT {sql.squeeze('p')} AS part FROM (SELECT unnest(string_split(lang, ',')) AS p FROM passage_labels)) WHERE part <> '' GROUP BY part"""
)
def label_parts(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "passage_labels").select(F.explode(nrm.comma_list("lang")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query(
    f"""SELECT passage_id, CASE WHEN length(t) <= 280 THEN t ELSE regexp_replace(substr(t, 1, 279), '{sql.WHITE}+$', '') || '…' END AS snippet
    FROM (SELECT passage_id, {sql.squeeze('display_text')} AS t FROM passages)"""
)
def snippet_280(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "passages").select("passage_id", nrm.snippet("display_text").alias("snippet"))


@query("SELECT source, regexp_replace(regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file_name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2")
def safe_filenames(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "documents").where("source IS NOT NULL")
    return rows.groupBy("source", nrm.safe_filename("source").alias("file_name")).agg(F.count("*").alias("n"))


def _yaml(spark: SparkSession, at: str) -> DataFrame:
    """Metadata files of the versions: the version's own, of which those that aren't canonical name another id, and the
    author's with a name; issues go on in a line that strict YAML refuses."""
    v = table(spark, at, "versions").join(table(spark, at, "works").select("work_id", "author_name").dropDuplicates(["work_id"]), "work_id", "left")
    uri = F.concat("version_id", F.when(F.col("is_canonical"), "").otherwise("x"))
    own = F.concat(F.lit(f"{metadata.VERSION_URI}: "), uri, F.lit(f"\n{metadata.QUALITY}: "), F.coalesce("status_raw", F.lit("")), F.lit("\n  , noted: twice\n"))
    author = F.concat(F.lit(f"{metadata.AUTHOR_URI}: "), "author_id", F.lit(f"\n{metadata.NAME_AR}: "), F.coalesce("author_name", F.lit("N/A")), F.lit("\n"))
    files = v.select("version_id", F.lit("version_yml").alias("source"), own.alias("text"))
    return files.unionByName(v.select("version_id", F.lit("author_yml").alias("source"), author.alias("text")))


@query(
    """SELECT version_id, 'version_yml' AS source, CAST(1 AS BIGINT) AS line_number, '00#VERS#URI######' AS field, 'valid' AS status FROM versions UNION ALL SELECT version_id, 'author_yml', 1, '00#AUTH#URI######', 'valid' FROM versions
    UNION ALL SELECT version_id, 'author_yml', 2, '10#AUTH#SHUHRA#AR', CASE WHEN author_name IS NULL THEN 'placeholder' ELSE 'valid' END FROM versions LEFT JOIN (SELECT work_id, min(author_name) AS author_name FROM works GROUP BY work_id) USING (work_id)"""
)
def metadata_fields(spark: SparkSession, at: str) -> DataFrame:
    """Identifiers and names in the metadata files."""
    rows = metadata.yaml_fields(_yaml(spark, at)).where(F.col("field") != metadata.QUALITY)
    return rows.select("version_id", "source", "line_number", "field", "status")


@query(
    """SELECT v.version_id, v.work_id, coalesce(w.author_name, v.author_id) AS author_name, w.title_fa, nullif(lower(regexp_extract(v.version_id, '(?i)-([a-z]{3})[0-9]+$', 1)), '') AS language_code,
    FALSE AS has_address, NOT v.is_canonical AS differs, TRUE AS lacks_work FROM versions v LEFT JOIN (SELECT work_id, min(author_name) AS author_name, min(title_fa) AS title_fa FROM works GROUP BY work_id) w USING (work_id)"""
)
def document_metadata(spark: SparkSession, at: str) -> DataFrame:
    """Versions with their metadata, and which of the planted breaches of identifiers were found."""
    rows = metadata.document_metadata(table(spark, at, "versions"), table(spark, at, "works"), metadata.yaml_fields(_yaml(spark, at)))
    return rows.select(
        "version_id", "work_id", "author_name", "title_fa", "language_code", F.col("source_url").isNotNull().alias("has_address"),
        F.array_contains("issues", "version_uri_mismatch").alias("differs"), F.array_contains("issues", "missing_work_uri").alias("lacks_work"),
    )


# Store, scans, reconciliation


@query(
    """WITH bad AS (SELECT passage_id, CASE WHEN least(coalesce(word_count, 0), coalesce(unit_count, 0), coalesce(member_count, 0)) < 0 THEN 'negative_count' END AS a, CASE WHEN coalesce(trim(display_text), '') = '' THEN 'no_display_text' END AS b,
      CASE WHEN coalesce(trim(retrieval_text), '') = '' THEN 'no_retrieval_text' END AS c, CASE WHEN ordinal - 1 < 1 OR ordinal IS NULL THEN 'invalid_ordinal' END AS d FROM passages)
    SELECT passage_id, issue FROM (SELECT passage_id, unnest([a, b, c, d]) AS issue FROM bad) WHERE issue IS NOT NULL"""
)
def store_violations(spark: SparkSession, at: str) -> DataFrame:
    """What a store refuses of the passages if their ordinals are counted from 0."""
    return stores.store_violations(table(spark, at, "passages").withColumn("ordinal", F.col("ordinal") - 1))


@query(
    """SELECT DISTINCT query_id, passage_id, CASE WHEN p.passage_id IS NULL THEN 'not_stored' WHEN h.version_id IS DISTINCT FROM p.version_id THEN 'version_differs' ELSE 'kind_differs' END AS issue
    FROM retrieved_passages h LEFT JOIN (SELECT * FROM passages WHERE search_alias_text IS NOT NULL) p USING (passage_id) WHERE p.passage_id IS NULL OR h.version_id IS DISTINCT FROM p.version_id OR h.kind IS DISTINCT FROM p.kind"""
)
def hit_disagreements(spark: SparkSession, at: str) -> DataFrame:
    """Stored hits that passages with a search text don't bear out."""
    return policy.disagreeing_hits(table(spark, at, "retrieved_passages"), table(spark, at, "passages").where("search_alias_text IS NOT NULL"))


WORDS = f"CASE WHEN {sql.squeeze('retrieval_text')} = '' THEN 0 ELSE len(string_split({sql.squeeze('retrieval_text')}, ' ')) END"


@query(f"SELECT passage_id, CAST(word_count AS BIGINT) AS stored, CAST({WORDS} AS BIGINT) AS actual FROM passages WHERE word_count IS DISTINCT FROM {WORDS}")
def stale_word_counts(spark: SparkSession, at: str) -> DataFrame:
    return store.stale_counts(table(spark, at, "passages"), nrm.word_count("retrieval_text"))


@query("SELECT query_id, passage_id, count(*) AS n FROM retrieved_passages GROUP BY ALL HAVING count(*) > 1")
def duplicate_hits(spark: SparkSession, at: str) -> DataFrame:
    return duplicates(table(spark, at, "retrieved_passages"), "query_id", "passage_id")


JUDGED = "judged AS (SELECT query_id, j.passage_id AS passage_id, j.grade AS grade FROM (SELECT query_id, unnest(judgments) AS j FROM retrieval_answerability_v1))"


@query(
    f"""WITH {JUDGED} SELECT passage_id, asked_at, version_id, kind, ordinal FROM (SELECT passage_id, min(query_id) AS asked_at FROM judged WHERE passage_id IS NOT NULL GROUP BY passage_id) JOIN passages USING (passage_id)"""
)
def store_get_many(spark: SparkSession, at: str) -> DataFrame:
    asked = table(spark, at, "retrieval_answerability_v1").select("query_id", F.explode("judgments.passage_id").alias("passage_id"))
    return store.get_many(table(spark, at, "passages").select("passage_id", "version_id", "kind", "ordinal"), asked, "passage_id", "query_id")


@query(
    f"""WITH {JUDGED} SELECT DISTINCT passage_id FROM judged WHERE passage_id IS NOT NULL AND passage_id NOT IN (SELECT passage_id FROM passages WHERE search_alias_text IS NOT NULL)"""
)
def missing_ids_anti(spark: SparkSession, at: str) -> DataFrame:
    """Judged passages that the lexical index lacks, having no search text."""
    judged = table(spark, at, "retrieval_answerability_v1").select(F.explode("judgments.passage_id").alias("passage_id"))
    return store.missing(judged, table(spark, at, "passages").where("search_alias_text IS NOT NULL").select("passage_id"), "passage_id")


@query(
    """SELECT version_id, count(*) AS n, min(ordinal) AS least, max(ordinal) AS greatest, count(*) - count(DISTINCT ordinal) AS n_repeated, CAST(max(ordinal) - count(DISTINCT ordinal) AS BIGINT) AS n_left_out FROM passages GROUP BY version_id"""
)
def store_ordinals(spark: SparkSession, at: str) -> DataFrame:
    return store.ordinal_report(table(spark, at, "passages"))


@query(
    """WITH r AS (SELECT passage_id, previous_passage_id, next_passage_id, lag(passage_id) OVER w AS p, lead(passage_id) OVER w AS n FROM passages WHERE search_alias_text IS NOT NULL WINDOW w AS (PARTITION BY version_id ORDER BY ordinal))
    SELECT passage_id, 'previous' AS issue FROM r WHERE previous_passage_id IS NOT NULL AND previous_passage_id IS DISTINCT FROM p
    UNION ALL SELECT passage_id, 'next' FROM r WHERE next_passage_id IS NOT NULL AND next_passage_id IS DISTINCT FROM n"""
)
def link_issues(spark: SparkSession, at: str) -> DataFrame:
    """Links that no longer hold once passages without a search text are gone."""
    return store.link_issues(table(spark, at, "passages").where("search_alias_text IS NOT NULL"))


@query(
    """WITH e AS (SELECT canonical_version AS version_id FROM works UNION SELECT unnest(reference_versions) FROM works), f AS (SELECT DISTINCT version_id FROM versions WHERE include_in_index)
    SELECT version_id, 'missing' AS issue FROM e WHERE version_id IS NOT NULL AND version_id NOT IN (SELECT version_id FROM f)
    UNION ALL SELECT version_id, 'unexpected' FROM f WHERE version_id NOT IN (SELECT version_id FROM e WHERE version_id IS NOT NULL)"""
)
def scan_reconcile(spark: SparkSession, at: str) -> DataFrame:
    works = table(spark, at, "works")
    named = works.select(F.col("canonical_version").alias("version_id")).union(works.select(F.explode("reference_versions"))).where("version_id IS NOT NULL")
    return marked.reconcile(named, table(spark, at, "versions").where("include_in_index"), "version_id")


@query(
    """SELECT author_id, profile, count(*) AS n_versions, count(DISTINCT work_id) AS n_works, count(*) FILTER (is_canonical) AS n_canonical, count(*) FILTER (include_in_index AND is_canonical) AS n_indexable FROM versions GROUP BY author_id, profile"""
)
def corpus_audit(spark: SparkSession, at: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, at, "versions").groupBy("author_id", "profile").agg(
        F.count("*").alias("n_versions"), F.countDistinct("work_id").alias("n_works"), n(F.col("is_canonical")).alias("n_canonical"),
        n(marked.is_indexable(F.col("include_in_index"), F.col("is_canonical"))).alias("n_indexable"),
    )


@query(f"SELECT version_id, kind, count(*) AS n_passages, CAST(sum({WORDS}) AS BIGINT) AS n_words, CAST(max({WORDS}) AS BIGINT) AS most_words, CAST(grouping_id(version_id, kind) AS BIGINT) AS level FROM passages GROUP BY ROLLUP (version_id, kind)")
def passage_roll_up(spark: SparkSession, at: str) -> DataFrame:
    return passages.roll_up(table(spark, at, "passages"))


# Marked-up sources


@query(f"WITH {sql.SOURCES} SELECT doc_id, has_magic, CAST(length(header) AS BIGINT) AS header_chars, CAST(length(body) AS BIGINT) AS body_chars, CAST(body_line_start AS BIGINT) AS body_line_start FROM sources")
def marked_sources(spark: SparkSession, at: str) -> DataFrame:
    s = marked.split_sources(table(spark, at, "documents"), "doc_id", "text")
    return s.select("doc_id", "has_magic", F.length("header").cast("long").alias("header_chars"), F.length("body").cast("long").alias("body_chars"), "body_line_start")


@query(
    f"""WITH {sql.SOURCES}, h AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, ls FROM (SELECT doc_id, string_split(header, chr(10)) AS ls FROM sources)),
    c AS (SELECT doc_id, pos + 1 AS line_number, {sql.strip("substr(ls[pos + 1], 7)")} AS content FROM h WHERE starts_with(ls[pos + 1], '#META#') AND NOT starts_with(ls[pos + 1], '#META#Header#End#')),
    f AS (SELECT doc_id, line_number, {sql.strip("substr(content, 1, instr(content, ':') - 1)")} AS field, {sql.strip("substr(content, instr(content, ':') + 1)")} AS raw_value FROM c WHERE instr(content, ':') > 0)
    SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, field, raw_value FROM f"""
)
def header_metadata(spark: SparkSession, at: str) -> DataFrame:
    s = marked.split_sources(table(spark, at, "documents"), "doc_id", "text")
    return marked.header_fields(s, "doc_id").select("doc_id", "line_number", "field", "raw_value")


def _lines(spark: SparkSession, at: str) -> DataFrame:
    """Lines of all documents with their profile; documents without one are read as mixed prose."""
    docs = spread(table(spark, at, "documents").where("text IS NOT NULL"))
    lines = marked.source_lines(marked.split_sources(docs, "doc_id", "text"), "doc_id")
    return lines.join(docs.select("doc_id", F.coalesce("profile", F.lit(parsing.PROSE)).alias("profile")), "doc_id")


@query(f"WITH {sql.SOURCES} SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(line) AS BIGINT) AS char_end FROM lines")
def line_records(spark: SparkSession, at: str) -> DataFrame:
    s = marked.split_sources(table(spark, at, "documents"), "doc_id", "text")
    return marked.source_lines(s, "doc_id").select("doc_id", "line_number", "char_start", "char_end")


MARKER = "(?i:PageV[0-9]+P[0-9]+)|ms[0-9]+"


@query(
    f"""WITH {sql.SOURCES}, b AS (SELECT doc_id, coalesce(profile, 'mixed_prose_ocr') AS profile, regexp_replace(line, '[\\r\\n]+$', '') AS bare, regexp_replace(line, '^\\s+', '') AS s FROM lines JOIN documents USING (doc_id)),
    k AS (SELECT profile, CASE WHEN trim(translate(bare, chr(9), ' ')) = '' THEN 'blank'
      WHEN profile = 'raw_ocr_reference' THEN CASE WHEN len(regexp_extract_all(bare, '(?i:PageV[0-9]+P[0-9]+)|\\bms[0-9]+\\b|!\\[[^\\]]*\\]\\([^)]+\\)')) = 1
          AND trim(regexp_replace(regexp_replace(bare, '(?i:PageV[0-9]+P[0-9]+)|\\bms[0-9]+\\b|!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'), '^\\s*~~', '')) = '' THEN 'markers' ELSE 'raw' END
      WHEN regexp_matches(bare, '(?i:PageV[0-9]+P[0-9]+)|\\bms[0-9]+\\b') AND regexp_replace(translate(regexp_replace(bare, '(?i:PageV[0-9]+P[0-9]+)|\\bms[0-9]+\\b', ' ', 'g'), '#~|', ''), '\\s+', '', 'g') = '' THEN 'markers'
      WHEN profile = 'structured_poetry' AND regexp_matches(bare, '(?i)^\\s*###\\s*\\|\\s*\\[\\s*daftar\\s+[0-9]+\\s*\\]\\s*$') THEN 'section'
      WHEN profile <> 'structured_poetry' AND regexp_matches(bare, '^\\s*#?\\s*!\\[([^\\]]*)\\]\\(([^)]+)\\)\\s*$') THEN 'image'
      WHEN starts_with(s, '###') THEN 'heading'
      WHEN profile <> 'structured_poetry' AND regexp_matches(bare, '^\\s*#\\s*~{{0,2}}\\s*(مجلس\\s+.+?)\\s*$') THEN 'section'
      WHEN starts_with(s, '#') AND contains(s, '%~%') THEN 'verse' WHEN starts_with(s, '~~') THEN 'continuation'
      WHEN profile <> 'structured_poetry' AND starts_with(s, '#') THEN 'paragraph' ELSE 'raw' END AS class FROM b)
    SELECT profile, class, count(*) AS n FROM k GROUP BY ALL"""
)
def line_classes(spark: SparkSession, at: str) -> DataFrame:
    return parsing.line_classes(_lines(spark, at), "profile").groupBy("profile", "class").agg(F.count("*").alias("n"))


@query(f"WITH {psql.BLOCKS} SELECT doc_id, block_no, block_type, group_id, line_number, char_start, char_end FROM blocks")
def block_parse(spark: SparkSession, at: str) -> DataFrame:
    return parsing.parse(_lines(spark, at), "doc_id", "profile").drop("raw_text")


@query(f"WITH {psql.BLOCKS} SELECT doc_id, block_type, count(*) AS n, CAST(sum(length(raw_text)) AS BIGINT) AS n_chars FROM blocks GROUP BY doc_id, block_type")
def block_counts(spark: SparkSession, at: str) -> DataFrame:
    return parsing.parse(_lines(spark, at), "doc_id", "profile").groupBy("doc_id", "block_type").agg(F.count("*").alias("n"), F.sum(F.length("raw_text")).cast("long").alias("n_chars"))


@query(f"WITH {sql.SOURCES} SELECT doc_id, CAST(length(body) AS BIGINT) AS covered, CAST(0 AS BIGINT) AS covered_twice, md5(body) AS text_digest FROM sources")
def parse_losslessness(spark: SparkSession, at: str) -> DataFrame:
    """Characters that the blocks cover, and a digest of the text they make up again."""
    s = marked.split_sources(table(spark, at, "documents"), "doc_id", "text")
    return parsing.parse_metrics(parsing.parse(_lines(spark, at), "doc_id", "profile"), s, "doc_id").select("doc_id", "covered", "covered_twice", "text_digest")


@query(
    """WITH listed AS (SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'und' UNION ALL SELECT doc_id FROM documents WHERE source IS NULL AND lang IS DISTINCT FROM 'und'),
    l AS (SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id), s AS (SELECT doc_id FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, 'repeated_version' AS issue FROM l WHERE n > 1 UNION ALL SELECT doc_id, 'no_source' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT doc_id, 'unexpected_source' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM l)"""
)
def corpus_violations(spark: SparkSession, at: str) -> DataFrame:
    """What would stop a run whose list leaves out documents of undetermined language and names those without a source
    twice."""
    docs = table(spark, at, "documents").where("NOT lang <=> 'und'")
    listed = docs.select("doc_id").union(docs.where("source IS NULL").select("doc_id"))
    s = marked.split_sources(table(spark, at, "documents"), "doc_id", "text")
    return corpus.corpus_violations(listed, parsing.parse_metrics(parsing.parse(_lines(spark, at), "doc_id", "profile"), s, "doc_id"), "doc_id")


@query(
    f"""WITH {sql.SOURCES}, v AS (SELECT doc_id, coalesce(is_canonical, FALSE) AS c, coalesce(include_in_index, FALSE) AS i FROM documents LEFT JOIN versions USING (version_id))
    SELECT count(*) AS n_versions, count(*) FILTER (c AND i) AS n_indexable, count(*) FILTER (c) AS n_canonical, count(*) FILTER (NOT c) AS n_reference,
      CAST(sum(coalesce(length(body), 0)) AS BIGINT) AS body_chars, bool_and(body IS NOT NULL) AS all_lossless FROM v LEFT JOIN sources USING (doc_id)"""
)
def corpus_measures(spark: SparkSession, at: str) -> DataFrame:
    flags = table(spark, at, "versions").select("version_id", "is_canonical", "include_in_index")
    listed = table(spark, at, "documents").select("doc_id", "version_id").join(flags, "version_id", "left")
    s = marked.split_sources(table(spark, at, "documents"), "doc_id", "text")
    metrics = parsing.parse_metrics(parsing.parse(_lines(spark, at), "doc_id", "profile"), s, "doc_id")
    return corpus.corpus_measures(listed, metrics, "doc_id").drop("n_blocks")


@query(
    rf"""WITH {psql.BLOCKS} SELECT doc_id, block_no, block_type, group_id, line_number, char_start, char_end, CAST(doc_id AS VARCHAR) || ':b' || format('{{:04d}}', block_no) AS block_id,
      CASE WHEN block_type IN ('page_marker', 'milestone', 'image_reference', 'blank') THEN '' ELSE trim(regexp_replace(raw_text, '^\s+|\s+$', '', 'g')) END AS content_text,
      CASE WHEN block_type = 'page_marker' THEN TRY_CAST(regexp_extract(raw_text, '(?i:PageV([0-9]+)P([0-9]+))', 1) AS INTEGER) END AS page_volume, CASE WHEN block_type = 'page_marker' THEN TRY_CAST(regexp_extract(raw_text, '(?i:PageV([0-9]+)P([0-9]+))', 2) AS INTEGER) END AS page_number,
      CASE WHEN block_type = 'milestone' THEN TRY_CAST(regexp_extract(raw_text, '\bms([0-9]+)\b', 1) AS INTEGER) END AS milestone,
      CASE WHEN block_type = 'image_reference' THEN regexp_extract(raw_text, '!\[([^\]]*)\]\(([^)]+)\)', 1) END AS image_alt, CASE WHEN block_type = 'image_reference' THEN regexp_extract(raw_text, '!\[([^\]]*)\]\(([^)]+)\)', 2) END AS image_target,
      CASE WHEN block_type = 'image_reference' THEN string_split(regexp_extract(raw_text, '!\[([^\]]*)\]\(([^)]+)\)', 2), '/')[-1] END AS image_name,
      CASE WHEN block_type = 'heading' THEN CAST(length(regexp_extract(raw_text, '^\s*(#+)', 1)) AS INTEGER) END AS heading_level, CASE WHEN block_type = 'verse' THEN TRY_CAST(nullif(regexp_extract(raw_text, '^\s*#\s*([0-9]+)\b', 1), '') AS INTEGER) END AS verse_number FROM blocks"""
)
def described_blocks(spark: SparkSession, at: str) -> DataFrame:
    return corpus.described(parsing.parse(_lines(spark, at), "doc_id", "profile"), "doc_id").drop("raw_text")


@query(
    f"""WITH {psql.BLOCKS}, moved AS (SELECT doc_id, block_no, line_number, char_start + CASE WHEN block_type = 'page_marker' THEN 1 ELSE 0 END AS s, char_end AS e, raw_text FROM blocks WHERE block_type <> 'image_reference'),
    near AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s, block_no) AS before FROM moved), laid AS (SELECT n.*, s >= l.char_start AND e <= l.char_start + length(l.line) AS inside, substr(l.line, CAST(s - l.char_start AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS there FROM near n LEFT JOIN lines l ON l.doc_id = n.doc_id AND l.line_number = n.line_number)
    SELECT doc_id, block_no, issue FROM (SELECT doc_id, block_no, unnest([CASE WHEN e <= s THEN 'empty_or_reversed' END, CASE WHEN before > s THEN 'overlap' END, CASE WHEN before < s THEN 'gap' END, CASE WHEN NOT coalesce(inside, FALSE) THEN 'wrong_line' END, CASE WHEN inside AND there <> raw_text THEN 'text_differs' END]) AS issue FROM laid) WHERE issue IS NOT NULL"""
)
def block_violations(spark: SparkSession, at: str) -> DataFrame:
    """What is wrong with blocks of which every page marker was moved by a character and every image left out."""
    blocks = parsing.parse(_lines(spark, at), "doc_id", "profile").where("block_type <> 'image_reference'")
    moved = F.col("char_start") + F.when(F.col("block_type") == "page_marker", 1).otherwise(0)
    return corpus.block_violations(blocks.withColumn("char_start", moved), _lines(spark, at), "doc_id")


@query(
    r"""SELECT doc_id, count(*) AS n_pages, CAST(min(p) AS INTEGER) AS first_page, CAST(max(p) AS INTEGER) AS last_page FROM (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '(?i:PageV([0-9]+)P([0-9]+))', 2)) AS INTEGER) AS p FROM documents) GROUP BY doc_id"""
)
def page_markers(spark: SparkSession, at: str) -> DataFrame:
    pages = parsing.page_references(parsing.parse(_lines(spark, at), "doc_id", "profile"), "doc_id")
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(
    """WITH e AS (SELECT query_id, lexical_rank - 5 AS s, lexical_rank + 5 AS e FROM (SELECT DISTINCT * FROM retrieved_passages) WHERE lexical_rank IS NOT NULL),
    ev AS (SELECT query_id, pos, sum(d) AS d FROM (SELECT query_id, s AS pos, 1 AS d FROM e UNION ALL SELECT query_id, e, -1 FROM e) GROUP BY query_id, pos),
    st AS (SELECT query_id, sum(d) OVER (PARTITION BY query_id ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY query_id ORDER BY pos) - pos AS width FROM ev)
    SELECT query_id, CAST(coalesce(sum(width) FILTER (depth >= 1), 0) AS BIGINT) AS covered, CAST(coalesce(sum(width) FILTER (depth >= 2), 0) AS BIGINT) AS covered_twice FROM st GROUP BY query_id"""
)
def interval_coverage(spark: SparkSession, at: str) -> DataFrame:
    h = table(spark, at, "retrieved_passages").distinct().where("lexical_rank IS NOT NULL")
    return parsing.interval_coverage(h.select("query_id", (F.col("lexical_rank") - 5).alias("s"), (F.col("lexical_rank") + 5).alias("e")), "query_id", "s", "e")


def _units(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    blocks = parsing.parse(_lines(spark, at), "doc_id", "profile")
    return blocks, units.logical_units(blocks.where("group_id IS NOT NULL"), "doc_id")


@query(f"WITH {psql.UNITS} SELECT doc_id, unit_id, unit_type, component_count, char_start, char_end, has_gaps, issue FROM units")
def logical_units(spark: SparkSession, at: str) -> DataFrame:
    return _units(spark, at)[1].drop("raw_text")


@query(f"WITH {psql.CLEANED} SELECT doc_id, unit_id, unit_type, display_text, retrieval_text, verse_number FROM cleaned")
def markup_cleanup(spark: SparkSession, at: str) -> DataFrame:
    return units.cleanup(_units(spark, at)[1]).select("doc_id", "unit_id", "unit_type", "display_text", "retrieval_text", "verse_number")


@query(f"WITH {psql.PAGES} SELECT * FROM paged")
def page_context(spark: SparkSession, at: str) -> DataFrame:
    blocks, us = _units(spark, at)
    pages = blocks.where("block_type = 'page_marker'").select("doc_id", "char_start", "char_end", F.trim("raw_text").alias("label"))
    return units.page_context(us.select("doc_id", "unit_id", "char_start", "char_end"), pages, "doc_id")


@query(f"WITH {psql.HEADED} SELECT * FROM headed")
def heading_context(spark: SparkSession, at: str) -> DataFrame:
    return units.heading_context(_units(spark, at)[1], "doc_id").select("doc_id", "unit_id", "unit_type", "section_id", "heading_id")


@query(
    """SELECT l_orderkey AS unit, 'returnflag' AS name, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
    UNION ALL SELECT l_orderkey, 'linestatus', CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END, count(DISTINCT l_linestatus) > 1 FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1"""
)
def attribute_merge(spark: SparkSession, at: str) -> DataFrame:
    items = table(spark, at, "lineitem").select(F.col("l_orderkey").alias("unit"), F.expr("stack(2, 'returnflag', l_returnflag, 'linestatus', l_linestatus) AS (name, value)"))
    return units.merge_attributes(items, "unit", "name", "value")


# Passages


@query(
    """WITH c AS (SELECT version_id, ordinal, passage_id, CASE WHEN lag(ordinal) OVER w IS NULL OR lag(heading_path_json) OVER w IS DISTINCT FROM heading_path_json OR lag(section_path_json) OVER w IS DISTINCT FROM section_path_json THEN 1 ELSE 0 END AS f
      FROM passages WINDOW w AS (PARTITION BY version_id ORDER BY ordinal))
    SELECT passage_id, CAST(sum(f) OVER (PARTITION BY version_id ORDER BY ordinal) AS BIGINT) AS run_id FROM c"""
)
def runs(spark: SparkSession, at: str) -> DataFrame:
    p = table(spark, at, "passages").select("passage_id", "version_id", "ordinal", "heading_path_json", "section_path_json")
    return passages.runs(p, "version_id", "ordinal", ["heading_path_json", "section_path_json"]).select("passage_id", "run_id")


def _verses(spark: SparkSession, at: str) -> DataFrame:
    p = table(spark, at, "passages").where(F.col("kind").isin("diwan", "mathnawi"))
    lines = p.select("passage_id", F.when(F.col("kind") == "diwan", 2).otherwise(6).alias("least"), F.posexplode(F.split("display_text", "\n")).alias("verse_no", "verse"))
    return lines.where("trim(verse) <> ''")


@query(
    """WITH v AS (SELECT passage_id, CASE WHEN kind = 'diwan' THEN 2 ELSE 6 END AS least, len(list_filter(string_split(display_text, chr(10)), lambda x: trim(x) <> '')) AS n FROM passages WHERE kind IN ('diwan', 'mathnawi')),
    s AS (SELECT passage_id, n, least, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 8) / 7.0) AS BIGINT) * 7 + 1 END, 7)) AS s FROM v WHERE n > 0),
    w AS (SELECT DISTINCT passage_id, n, CASE WHEN n > 8 AND s + 8 > n AND n - s < least THEN greatest(n - 8, 0) ELSE s END + 1 AS first_verse FROM s)
    SELECT passage_id, CAST(row_number() OVER (PARTITION BY passage_id ORDER BY first_verse) AS INTEGER) AS window_no, CAST(first_verse AS BIGINT) AS first_verse, CAST(least(first_verse + 7, n) AS BIGINT) AS last_verse,
      CAST(least(first_verse + 7, n) - first_verse + 1 AS BIGINT) AS size FROM w"""
)
def verse_windows(spark: SparkSession, at: str) -> DataFrame:
    return passages.verse_windows(_verses(spark, at), ["passage_id"], "verse_no", "least")


#: Where members (c: version_id, h, place, n) are packed: passage p of each by the greedy fold, and where the tail is cut.
PACK = """m AS (SELECT *, row_number() OVER r AS rn, sum(n) OVER r AS total FROM c WINDOW r AS (PARTITION BY version_id, h ORDER BY place)),
f AS (SELECT version_id, h, rn, 1 AS p, n AS held FROM m WHERE rn = 1
  UNION ALL SELECT m.version_id, m.h, m.rn, CASE WHEN held >= 180 OR held + m.n > 300 THEN p + 1 ELSE p END, CASE WHEN held >= 180 OR held + m.n > 300 THEN m.n ELSE held + m.n END FROM f JOIN m ON m.version_id = f.version_id AND m.h = f.h AND m.rn = f.rn + 1),
ends AS (SELECT version_id, h, max(p) AS last, max(total) AS whole FROM m JOIN f USING (version_id, h, rn) GROUP BY ALL),
edges AS (SELECT version_id, h, last, whole, min(rn) FILTER (p = last - 1) - 1 AS a, min(rn) FILTER (p = last) - 1 AS b FROM f JOIN ends USING (version_id, h) GROUP BY ALL HAVING last > 1),
points AS (SELECT version_id, h, rn AS k, total FROM m UNION ALL SELECT DISTINCT version_id, h, 0, 0 FROM m),
based AS (SELECT e.*, total AS before FROM edges e JOIN points ON points.version_id = e.version_id AND points.h = e.h AND k = a),
cuts AS (SELECT b.version_id, b.h, last, whole, a, before, least(b, greatest(max(k) FILTER (whole - total >= 80), min(k) FILTER (total - before >= 80), min(k) FILTER (whole - total <= 300), a + 1)) AS cut FROM based b JOIN points p ON p.version_id = b.version_id AND p.h = b.h GROUP BY b.version_id, b.h, last, whole, a, b, before),
evened AS (SELECT q.version_id, q.h, last, a, cut, whole - total < 80 AND whole - before <= 300 AS joined FROM cuts q JOIN points p ON p.version_id = q.version_id AND p.h = q.h AND k = cut)"""
PLACED = "CAST(CASE WHEN e.last IS NULL OR rn <= a THEN p WHEN joined OR rn <= cut THEN e.last - 1 ELSE e.last END AS INTEGER)"
PACKING = f"""w AS (SELECT version_id, heading_path_json, ordinal, part, list_filter(string_split(regexp_replace(lines[part + 1], '{sql.WHITE}+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM (SELECT *, unnest(range(0, len(lines))) AS part FROM (SELECT version_id, heading_path_json, ordinal, string_split(retrieval_text, chr(10)) AS lines FROM passages WHERE kind = 'mixed_prose' AND retrieval_text IS NOT NULL))),
c AS (SELECT version_id, heading_path_json, coalesce(heading_path_json, chr(1)) AS h, CAST(ordinal AS BIGINT) * 1000000000 + part * 1000000 + i // 300 AS place, len(ws[i + 1:i + 300]) AS n FROM (SELECT *, unnest(range(0, len(ws), 300)) AS i FROM w WHERE len(ws) > 0)),
{PACK}"""


@query(
    f"""WITH RECURSIVE {PACKING} SELECT m.version_id, heading_path_json, place AS at, {PLACED} AS passage_no
    FROM m JOIN f USING (version_id, h, rn) LEFT JOIN evened e ON e.version_id = m.version_id AND e.h = m.h"""
)
def prose_packing(spark: SparkSession, at: str) -> DataFrame:
    """Paragraphs of every version's prose, packed chapter by chapter; paragraphs above the hard limit are cut first."""
    p = table(spark, at, "passages").where("kind = 'mixed_prose'")
    paragraphs = p.select("version_id", "heading_path_json", "ordinal", F.posexplode(F.split("retrieval_text", "\n")).alias("part", "text"))
    chunks = passages.word_chunks(paragraphs.withColumn("o", F.struct("version_id", "heading_path_json", "ordinal", "part")), "o", "text", 300)
    rows = chunks.select("o.version_id", "o.heading_path_json", F.struct("o.ordinal", "o.part", "chunk_no").alias("at"), "n_words")
    rows = rows.withColumn("at", F.col("at.ordinal").cast("long") * 1_000_000_000 + F.col("at.part").cast("long") * 1_000_000 + F.col("at.chunk_no"))
    return passages.pack_prose(rows, ["version_id", "heading_path_json"], "at", "n_words")


@query(
    f"""WITH w AS (SELECT passage_id, list_filter(string_split({sql.squeeze('retrieval_text')}, ' '), lambda x: x <> '') AS w FROM passages),
    c AS (SELECT passage_id, w, unnest(range(0, len(w), 100)) AS i FROM w WHERE len(w) > 0)
    SELECT passage_id, CAST(i // 100 AS INTEGER) AS chunk_no, CAST(len(w[i + 1:i + 100]) AS INTEGER) AS n_words, array_to_string(w[i + 1:i + 100], ' ') AS chunk FROM c"""
)
def word_chunks(spark: SparkSession, at: str) -> DataFrame:
    return passages.word_chunks(table(spark, at, "passages"), "passage_id", "retrieval_text", 100)


@query(
    r"""WITH s AS (SELECT passage_id, list_filter(string_split(regexp_replace(retrieval_text, '([.!?؟؛])[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS p FROM passages)
    SELECT passage_id, CAST(i - 1 AS INTEGER) AS part_no, p[i] AS part FROM (SELECT passage_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)"""
)
def sentence_split(spark: SparkSession, at: str) -> DataFrame:
    return passages.sentence_split(table(spark, at, "passages"), "passage_id", "retrieval_text")


@query(
    """SELECT passage_id, lag(passage_id) OVER w AS previous_id, lead(passage_id) OVER w AS next_id FROM passages WINDOW w AS (PARTITION BY version_id, heading_path_json ORDER BY ordinal)"""
)
def neighbor_links(spark: SparkSession, at: str) -> DataFrame:
    return passages.neighbor_links(table(spark, at, "passages"), ["version_id", "heading_path_json"], "ordinal", "passage_id")


def _contextual(spark: SparkSession, at: str) -> DataFrame:
    """Cleaned units of all documents with their headings; documents without a profile are read as mixed prose."""
    profiles = table(spark, at, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("profile", F.lit(parsing.PROSE)).alias("profile"))
    return units.heading_context(units.cleanup(_units(spark, at)[1]), "doc_id").join(profiles, "doc_id")


BUILT_COLUMNS = "version_id, passage_id, ordinal, kind, run_id, unit_ids, unit_count, member_count, word_count, has_split_member, parent_context_id, display_text, retrieval_text, search_alias_text, previous_passage_id, next_passage_id, issues"


def _gathered(kind: str, parent: str, words: str, sep: str) -> str:
    """SQL of passages, with ids, ordinals and links, from rows_of (version_id, run_id, passage_no, place, unit_id, shown,
    searched, alias)."""
    name = lambda n: f"version_id || ':passage_' || format('{{:06d}}', {n})"
    text = lambda c: f"string_agg({sep} || {c}, '' ORDER BY place)"
    return f"""gathered AS (SELECT version_id, run_id, passage_no, min(place) AS first_place, {kind} AS kind, string_agg(unit_id, ' ' ORDER BY place) AS unit_ids, CAST(count(*) AS INTEGER) AS unit_count, CAST(count(*) AS INTEGER) AS member_count,
      CAST(sum({words}) AS INTEGER) AS word_count, FALSE AS has_split_member, {parent} AS parent_context_id, {text('shown')} AS display_text, {text('searched')} AS retrieval_text, {text('alias')} AS search_alias_text, '' AS issues FROM rows_of GROUP BY version_id, run_id, passage_no),
    in_order AS (SELECT *, CAST(row_number() OVER v AS INTEGER) AS ordinal, lag(run_id) OVER v AS before, lead(run_id) OVER v AS after FROM gathered WINDOW v AS (PARTITION BY version_id ORDER BY first_place, passage_no)),
    finished AS (SELECT *, {name('ordinal')} AS passage_id, CASE WHEN before = run_id THEN {name('ordinal - 1')} END AS previous_passage_id, CASE WHEN after = run_id THEN {name('ordinal + 1')} END AS next_passage_id FROM in_order)"""


def _built(df: DataFrame) -> DataFrame:
    joined = {c: F.array_join(c, " ") for c in ("unit_ids", "issues")}
    return df.drop("heading_path", "section_path").withColumns(joined)


# Pieces of paragraphs above the hard limit aren't in the SQL; the documents hold none.
BUILT = f"""{psql.HEADED.replace(psql.UNITS, psql.CLEANED)}, viewed AS (SELECT c.doc_id, c.unit_id, c.unit_type, c.char_start, heading_id, section_id, {sql.display('display_text')} AS shown, {sql.retrieval(sql.display('retrieval_text'))} AS searched
  FROM cleaned c JOIN headed h ON c.unit_id = h.unit_id JOIN documents d ON d.doc_id = c.doc_id WHERE coalesce(d.profile, 'mixed_prose_ocr') = 'mixed_prose_ocr'),
stopped AS (SELECT *, NOT (unit_type IN ('verse', 'paragraph') AND searched <> '') AS stop FROM viewed),
flagged AS (SELECT *, CASE WHEN lag(stop) OVER w IS NULL OR stop OR lag(stop) OVER w OR lag(heading_id) OVER w IS DISTINCT FROM heading_id OR lag(section_id) OVER w IS DISTINCT FROM section_id THEN 1 ELSE 0 END AS fresh FROM stopped WINDOW w AS (PARTITION BY doc_id ORDER BY char_start)),
members AS (SELECT * FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY char_start) AS BIGINT) AS run_id FROM flagged) WHERE NOT stop),
c AS (SELECT CAST(doc_id AS VARCHAR) AS version_id, CAST(run_id AS VARCHAR) AS h, char_start AS place, len(string_split(searched, ' ')) AS n FROM members),
{PACK}, packed AS (SELECT m.version_id, m.h, place, {PLACED} AS passage_no FROM m JOIN f USING (version_id, h, rn) LEFT JOIN evened e ON e.version_id = m.version_id AND e.h = m.h),
rows_of AS (SELECT p.version_id, run_id, passage_no, place, unit_id, heading_id, section_id, shown, searched, {sql.alias('searched')} AS alias,
  CASE WHEN lag(unit_type) OVER w IS NULL THEN '' WHEN lag(unit_type) OVER w = 'verse' AND unit_type = 'verse' THEN chr(10) ELSE chr(10) || chr(10) END AS sep
  FROM packed p JOIN members x ON p.version_id = CAST(x.doc_id AS VARCHAR) AND p.place = x.char_start WINDOW w AS (PARTITION BY p.version_id, run_id, passage_no ORDER BY place)),
{_gathered("'mixed_prose'", "coalesce(any_value(heading_id), any_value(section_id))", "len(string_split(searched, ' '))", "sep")}"""


@query(f"WITH RECURSIVE {BUILT} SELECT {BUILT_COLUMNS} FROM finished")
def built_passages(spark: SparkSession, at: str) -> DataFrame:
    """Passages of all documents, from their source text to texts, ids and links."""
    return _built(building.build(_contextual(spark, at), "doc_id", "profile"))


VERSES = f"""given AS (SELECT version_id || CASE WHEN kind = 'mathnawi' THEN '.Mathnawi.' ELSE '' END AS version_id, kind, passage_id, ordinal, heading_path_json AS hp, section_path_json AS sp, string_split(display_text, chr(10)) AS ls FROM passages WHERE kind IN ('diwan', 'mathnawi') AND display_text IS NOT NULL),
parts AS (SELECT version_id, kind, passage_id || ':' || CAST(i AS VARCHAR) AS unit_id, CAST(ordinal AS BIGINT) * 1000000 + i AS place, hp, sp, ls[i + 1] AS t FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM given)),
viewed AS (SELECT *, {sql.display('t')} AS shown, {sql.retrieval(sql.display('t'))} AS searched FROM parts), stopped AS (SELECT *, searched = '' AS stop FROM viewed),
flagged AS (SELECT *, CASE WHEN lag(stop) OVER w IS NULL OR stop OR lag(stop) OVER w OR lag(hp) OVER w IS DISTINCT FROM hp OR lag(sp) OVER w IS DISTINCT FROM sp THEN 1 ELSE 0 END AS fresh FROM stopped WINDOW w AS (PARTITION BY version_id ORDER BY place)),
members AS (SELECT *, row_number() OVER (PARTITION BY version_id, run_id ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY version_id, run_id) AS n FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY version_id ORDER BY place) AS BIGINT) AS run_id FROM flagged) WHERE NOT stop),
runs AS (SELECT DISTINCT version_id, run_id, n, CASE WHEN n <= 8 THEN 0 ELSE CAST(ceil((n - 8) / 7.0) AS BIGINT) END AS last, CASE WHEN kind = 'diwan' THEN 2 ELSE 6 END AS least FROM members),
windows AS (SELECT version_id, run_id, k + 1 AS passage_no, CASE WHEN k = last AND n > 8 AND n - 7 * last < least THEN greatest(n - 8, 0) ELSE 7 * k END AS s FROM (SELECT *, unnest(range(0, last + 1)) AS k FROM runs)),
rows_of AS (SELECT m.*, passage_no, {sql.alias('searched')} AS alias, CASE WHEN i = s THEN '' ELSE chr(10) END AS sep FROM members m JOIN windows x ON m.version_id = x.version_id AND m.run_id = x.run_id AND i >= s AND i < s + 8),
{_gathered("any_value(kind)", "coalesce(any_value(hp), any_value(sp))", "len(string_split(searched, ' '))", "sep")}"""


@query(f"WITH {VERSES} SELECT {BUILT_COLUMNS} FROM finished")
def verse_passages(spark: SparkSession, at: str) -> DataFrame:
    """Passages built anew from the lines of the stored poetry."""
    p = table(spark, at, "passages").where("kind IN ('diwan', 'mathnawi') AND display_text IS NOT NULL")
    version = F.concat("version_id", F.when(F.col("kind") == "mathnawi", ".Mathnawi.").otherwise(""))
    rows = p.select(version.alias("version"), "passage_id", "ordinal", "heading_path_json", "section_path_json", F.posexplode(F.split("display_text", "\n")).alias("i", "t"))
    path = lambda c: F.array_compact(F.array(c))
    us = rows.select(
        "version", F.lit(parsing.POETRY).alias("profile"), F.concat("passage_id", F.lit(":"), F.col("i").cast("string")).alias("unit_id"), F.lit("verse").alias("unit_type"),
        (F.col("ordinal").cast("long") * 1_000_000 + F.col("i")).alias("char_start"), path("heading_path_json").alias("heading_path"), path("section_path_json").alias("section_path"),
        F.col("t").alias("display_text"), F.col("t").alias("retrieval_text"),
    )
    return _built(building.build(us, "version", "profile"))


@query(
    f"""WITH RECURSIVE {BUILT} SELECT 'kind' AS part, kind AS name, count(*) AS n FROM finished GROUP BY kind
    UNION ALL SELECT 'build_issue', 'empty_content_unit', count(*) FROM viewed WHERE unit_type NOT IN ('heading', 'section') AND searched = '' HAVING count(*) > 0"""
)
def build_report(spark: SparkSession, at: str) -> DataFrame:
    us = settle(_contextual(spark, at))
    return building.build_report(building.build(us, "doc_id", "profile"), building.skipped_units(us, "doc_id", "profile"))


@query(f"WITH RECURSIVE {BUILT} SELECT r.version_id, r.unit_id AS id, 'unit_in_no_passage' AS issue FROM rows_of r JOIN finished f ON f.version_id = r.version_id AND f.run_id = r.run_id AND f.passage_no = r.passage_no WHERE ordinal = 1")
def build_violations(spark: SparkSession, at: str) -> DataFrame:
    """What is missed of the units if the first passage of every document is lost."""
    us = settle(_contextual(spark, at))
    members = building.prepared(us, "doc_id", "profile").where("role = 'member'").select(F.col("doc_id").cast("string").alias("version_id"), "unit_id")
    return building.build_violations(building.build(us, "doc_id", "profile").where("ordinal > 1"), members, building.skipped_units(us, "doc_id", "profile"))


# Lexical retrieval


def _asked(spark: SparkSession, at: str) -> DataFrame:
    q = table(spark, at, "retrieval_answerability_v1").select("query_id", "query_text").distinct()
    return lexical.query_terms(q.select("query_id", nrm.normalize_search_alias("query_text").alias("q")), "query_id", "q")


def _index(spark: SparkSession, at: str) -> lexical.Index:
    return lexical.build_index(spread(table(spark, at, "passages")), "passage_id", "search_alias_text")


@query(f"WITH {sql.INDEX} SELECT query_id, array_to_string(q_tokens, ' ') AS q_tokens, len(q_terms) AS n_terms FROM q")
def query_terms(spark: SparkSession, at: str) -> DataFrame:
    return _asked(spark, at).select("query_id", F.array_join("q_tokens", " ").alias("q_tokens"), F.size("q_terms").cast("long").alias("n_terms"))


@query(f"WITH {sql.INDEX} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM terms JOIN (SELECT term, sum(tf) AS cf FROM postings GROUP BY term) USING (term)")
def term_stats(spark: SparkSession, at: str) -> DataFrame:
    return _index(spark, at).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {sql.INDEX}, {sql.MODES} {sql.ranked('s_any', 10)}")
def bm25_any(spark: SparkSession, at: str) -> DataFrame:
    return lexical.ranked(lexical.search_any(_index(spark, at), _asked(spark, at), 10), 10)


@query(f"WITH {sql.INDEX}, {sql.MODES} {sql.ranked('s_all', 10)}")
def bm25_all(spark: SparkSession, at: str) -> DataFrame:
    return lexical.ranked(lexical.search_all(_index(spark, at), _asked(spark, at), 10), 10)


@query(f"WITH {sql.INDEX}, {sql.MODES} {sql.ranked('s_phrase', 10)}")
def bm25_phrase(spark: SparkSession, at: str) -> DataFrame:
    return lexical.ranked(lexical.search_phrase(_index(spark, at), _asked(spark, at), 10), 10)


AUTO = """modes AS (SELECT query_id, doc_id, score, 1 AS p, 'phrase' AS mode FROM s_phrase JOIN q USING (query_id) WHERE len(q_terms) > 1 UNION ALL SELECT query_id, doc_id, score, 2, 'all_terms' FROM s_all
  UNION ALL SELECT query_id, doc_id, score, 3, 'any_terms' FROM s_any), s_auto AS (SELECT * FROM modes QUALIFY p = min(p) OVER (PARTITION BY query_id))"""


@query(f"WITH {sql.INDEX}, {sql.MODES}, {AUTO} {sql.ranked('s_auto', 10, 'mode')}")
def bm25_auto(spark: SparkSession, at: str) -> DataFrame:
    return lexical.ranked(lexical.search_auto(_index(spark, at), _asked(spark, at), 10), 10, "mode")


@query(
    f"""WITH {sql.INDEX}, {sql.MODES}, {AUTO}, best AS ({sql.ranked('s_auto', 1, 'mode')}),
    w AS (SELECT query_id, doc_id, mode, tokens, q_terms, list_min(list_filter(list_transform(q_terms, lambda t: list_position(tokens, t)), lambda p: p > 0)) AS hit FROM best JOIN docs USING (doc_id) JOIN q USING (query_id)),
    c AS (SELECT *, greatest(coalesce(hit, 1) - 6, 1) AS s FROM w)
    SELECT query_id, doc_id, mode, CASE WHEN s > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(tokens[s:s + 23], lambda x: CASE WHEN list_contains(q_terms, x) THEN '[' || x || ']' ELSE x END), ' ')
      || CASE WHEN s + 23 < len(tokens) THEN ' …' ELSE '' END AS excerpt FROM c"""
)
def search_excerpts(spark: SparkSession, at: str) -> DataFrame:
    """The best hit of every query with an excerpt in which its terms are marked."""
    asked = _asked(spark, at)
    index = lexical.written(_index(spark, at))
    best = lexical.ranked(lexical.search_auto(index, asked, 1), 1, "mode")
    rows = best.join(index.docs.select("doc_id", "tokens"), "doc_id").join(asked.select("query_id", "q_terms"), "query_id")
    return rows.select("query_id", "doc_id", "mode", lexical.excerpt(F.col("tokens"), F.col("q_terms")).alias("excerpt"))


# Dense retrieval


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 9) AS c
      FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank, vec_id, round(c, 6) AS cosine FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""
)
def dense_topk(spark: SparkSession, at: str) -> DataFrame:
    """Queries are all vectors whose id is divisible by 20, against all vectors."""
    v = table(spark, at, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k(v, "vec_id", "embedding", q, "query_id", 10)


@query(
    """SELECT count(*) AS n_vectors, count(*) FILTER (embedding IS NULL) AS n_null, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size, CAST(0 AS BIGINT) AS n_not_finite,
      count(*) FILTER (abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-5) AS n_not_unit FROM embeddings"""
)
def dense_validation(spark: SparkSession, at: str) -> DataFrame:
    return dense.validation(table(spark, at, "embeddings"), "embedding")


# Fusion, evidence, decision


def _hits(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "retrieved_passages").distinct()


def _fused(spark: SparkSession, at: str) -> DataFrame:
    h = _hits(spark, at)
    return fusion.fuse(h.where("lexical_rank IS NOT NULL"), h.where("dense_rank IS NOT NULL"))


@query(f"WITH {sql.FUSED} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, at: str) -> DataFrame:
    return _fused(spark, at)


@query(
    f"""WITH {sql.HITS}, s AS (SELECT query_id, passage_id, CAST(NULL AS INTEGER) AS lexical_rank, dense_rank, 1.0 / (60 + dense_rank) AS score FROM hits WHERE dense_rank <= 100)
    SELECT query_id, hybrid_rank, passage_id, round(score, 9) AS fusion_score, lexical_rank, dense_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, dense_rank, passage_id) AS INTEGER) AS hybrid_rank FROM s) WHERE hybrid_rank <= 10"""
)
def rrf_dense_only(spark: SparkSession, at: str) -> DataFrame:
    h = _hits(spark, at)
    return fusion.fuse(h.where("lexical_rank IS NOT NULL").limit(0), h.where("dense_rank IS NOT NULL"))


@query(
    f"""WITH hits AS (SELECT query_id, passage_id, lexical_rank, dense_rank - 1 AS dense_rank FROM retrieved_passages) SELECT query_id, passage_id, 'repeated_passage' AS issue FROM hits GROUP BY query_id, passage_id HAVING count(*) > 1
    UNION ALL SELECT query_id, passage_id, 'repeated_lexical_rank' FROM hits WHERE lexical_rank IS NOT NULL QUALIFY count(*) OVER (PARTITION BY query_id, lexical_rank) > 1
    UNION ALL SELECT query_id, passage_id, 'repeated_dense_rank' FROM hits WHERE dense_rank IS NOT NULL QUALIFY count(*) OVER (PARTITION BY query_id, dense_rank) > 1
    UNION ALL SELECT query_id, passage_id, 'invalid_lexical_rank' FROM hits WHERE lexical_rank < 1 UNION ALL SELECT query_id, passage_id, 'invalid_dense_rank' FROM hits WHERE dense_rank < 1"""
)
def fusion_integrity(spark: SparkSession, at: str) -> DataFrame:
    """Breaches of the stored rankings as they are, repeated rows and all, with dense ranks counted from 0."""
    return fusion.integrity(table(spark, at, "retrieved_passages").withColumn("dense_rank", F.col("dense_rank") - 1))


FEATURES = f"""{sql.FUSED},
f_h AS (SELECT query_id, count(*) AS hybrid_hits, max(CASE WHEN hybrid_rank = 1 THEN passage_id END) AS top_passage_id,
  round(max(CASE WHEN hybrid_rank = 1 THEN fusion_score END) - max(CASE WHEN hybrid_rank = 2 THEN fusion_score END), 6) AS fusion_margin,
  max(CASE WHEN hybrid_rank = 1 AND lexical_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 1 ELSE 0 END) AS dual_support FROM fused GROUP BY query_id),
f_x AS (SELECT query_id, count(*) AS lexical_hits FROM hits WHERE lexical_rank IS NOT NULL GROUP BY query_id),
f_d AS (SELECT query_id, count(*) AS dense_hits, round(max(CASE WHEN dense_rank = 1 THEN dense_cosine_score END), 6) AS dense_top_1,
  round(max(CASE WHEN dense_rank = 1 THEN dense_cosine_score END) - max(CASE WHEN dense_rank = 2 THEN dense_cosine_score END), 6) AS dense_margin FROM hits WHERE dense_rank IS NOT NULL GROUP BY query_id),
f_o AS (SELECT query_id, count(*) FILTER (greatest(lexical_rank, dense_rank) <= 10) AS overlap_at_10, count(*) FILTER (greatest(lexical_rank, dense_rank) <= 100) AS overlap_at_100
  FROM hits WHERE lexical_rank IS NOT NULL AND dense_rank IS NOT NULL GROUP BY query_id),
features AS (SELECT query_id, coalesce(hybrid_hits, 0) AS hybrid_hits, top_passage_id, fusion_margin, coalesce(dual_support, 0) AS dual_support, coalesce(lexical_hits, 0) AS lexical_hits, coalesce(dense_hits, 0) AS dense_hits,
  dense_top_1, dense_margin, coalesce(overlap_at_10, 0) AS overlap_at_10, coalesce(overlap_at_100, 0) AS overlap_at_100
  FROM f_h FULL JOIN f_x USING (query_id) FULL JOIN f_d USING (query_id) LEFT JOIN f_o USING (query_id))"""


def _features(spark: SparkSession, at: str) -> DataFrame:
    h = _hits(spark, at)
    return evidence.rank_features(_fused(spark, at), h.where("lexical_rank IS NOT NULL"), h.where("dense_rank IS NOT NULL"))


@query(f"WITH {FEATURES} SELECT * FROM features")
def evidence_features(spark: SparkSession, at: str) -> DataFrame:
    return _features(spark, at)


def _entities(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """Scope catalog of the tables: authors by name and works by title; one author counts as out of the corpus."""
    w = table(spark, at, "works")
    outside = w.agg(F.min("author_id").alias("out"))
    authors = w.join(F.broadcast(outside)).select("author_id", "author_name", (F.col("author_id") != F.col("out")).alias("in_corpus")).where("author_name IS NOT NULL").distinct()
    named = authors.select(F.col("author_id").alias("entity_id"), F.lit("author").alias("kind"), "in_corpus", F.explode(F.array("author_name", F.split("author_name", " ")[0])).alias("alias"))
    works = w.select(F.col("work_id").alias("entity_id"), F.lit("work").alias("kind"), F.lit(True).alias("in_corpus"), F.col("title_fa").alias("alias")).where("alias IS NOT NULL")
    v = table(spark, at, "versions")
    links = v.select(F.col("author_id").alias("entity_id"), "version_id").union(v.select("work_id", "version_id")).distinct()
    return named.unionByName(works), links


def _scope(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = table(spark, at, "retrieval_answerability_v1").select("query_id", "query_text").distinct()
    aliases, links = _entities(spark, at)
    return q, evidence.scope_mentions(q.where("query_text IS NOT NULL"), "query_text", aliases), links


def scope_sql(c: str) -> str:
    c = f"regexp_replace(translate(translate({c}, 'يىئكؤةۀ', 'یییکوهه'), chr(8204) || chr(8205) || chr(65279), '   '), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}]', '', 'g')"
    return f"trim(regexp_replace(lower(regexp_replace({c}, '[^0-9A-Za-z\\x{{0600}}-\\x{{06FF}}]+', ' ', 'g')), ' +', ' ', 'g'))"


MENTIONS = f"""outside AS (SELECT min(author_id) AS o FROM works), authors AS (SELECT DISTINCT author_id, author_name, author_id <> o AS in_corpus FROM works, outside WHERE author_name IS NOT NULL),
al AS (SELECT author_id AS entity_id, 'author' AS kind, in_corpus, author_name AS alias FROM authors UNION ALL SELECT author_id, 'author', in_corpus, split_part(author_name, ' ', 1) FROM authors
  UNION ALL SELECT work_id, 'work', TRUE, title_fa FROM works WHERE title_fa IS NOT NULL),
an AS (SELECT *, {scope_sql('alias')} AS n FROM al), qn AS (SELECT query_id, {scope_sql('query_text')} AS q FROM (SELECT DISTINCT query_id, query_text FROM retrieval_answerability_v1) WHERE query_text IS NOT NULL),
mentions AS (SELECT query_id, entity_id, kind, in_corpus, alias FROM qn, an WHERE n <> '' AND contains(' ' || q || ' ', ' ' || n || ' ')
  QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY len(string_split(n, ' ')) DESC, length(n) DESC, n, alias) = 1)"""


@query(f"WITH {MENTIONS} SELECT * FROM mentions")
def scope_mentions(spark: SparkSession, at: str) -> DataFrame:
    return _scope(spark, at)[1]


def _versioned(spark: SparkSession, at: str) -> DataFrame:
    versions = _hits(spark, at).select("query_id", "passage_id", "version_id").distinct()
    return _fused(spark, at).join(versions, ["query_id", "passage_id"])


SCOPE = f"""{MENTIONS}, links AS (SELECT author_id AS entity_id, version_id FROM versions UNION SELECT work_id, version_id FROM versions),
flags AS (SELECT query_id, bool_or(in_corpus) AS in_corpus_mentioned, bool_or(NOT in_corpus) AS out_of_corpus_mentioned, bool_or(kind = 'work' AND in_corpus) AS has_work FROM mentions GROUP BY query_id),
wanted AS (SELECT DISTINCT query_id, version_id FROM mentions JOIN flags USING (query_id) JOIN links USING (entity_id) WHERE in_corpus AND (kind = 'work' OR NOT has_work)),
placed AS (SELECT DISTINCT f.query_id, hybrid_rank, f.passage_id, version_id FROM fused f JOIN hits h ON f.query_id = h.query_id AND f.passage_id = h.passage_id),
per AS (SELECT p.query_id, count(*) AS n_hits, count(w.version_id) AS n_match, max(CASE WHEN hybrid_rank = 1 THEN CASE WHEN w.version_id IS NULL THEN 0 ELSE 1 END END) AS top_match
  FROM placed p LEFT JOIN wanted w ON p.query_id = w.query_id AND p.version_id = w.version_id GROUP BY p.query_id),
scope AS (SELECT query_id, coalesce(in_corpus_mentioned, FALSE) AS in_corpus_mentioned, coalesce(out_of_corpus_mentioned, FALSE) AS out_of_corpus_mentioned, coalesce(n_requested, 0) AS n_requested,
  CAST(CASE WHEN n_requested > 0 THEN coalesce(n_match, 0) ELSE 0 END AS BIGINT) AS matching_hits, CASE WHEN n_requested > 0 THEN round(coalesce(n_match / n_hits, 0), 6) END AS matching_rate,
  coalesce(n_requested > 0 AND top_match = 0, FALSE) AS source_conflict
  FROM (SELECT DISTINCT query_id FROM retrieval_answerability_v1) LEFT JOIN flags USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n_requested FROM wanted GROUP BY query_id) USING (query_id) LEFT JOIN per USING (query_id))"""


def _scope_evidence(spark: SparkSession, at: str) -> DataFrame:
    q, mentions, links = _scope(spark, at)
    return evidence.scope_evidence(q, mentions, links, _versioned(spark, at))


@query(f"WITH {sql.FUSED}, {SCOPE} SELECT * FROM scope")
def scope_evidence(spark: SparkSession, at: str) -> DataFrame:
    return _scope_evidence(spark, at)


def _zones(spark: SparkSession, at: str) -> DataFrame:
    """Zones of the tables' versions: the first twentieth is paratext, then one mixed passage, then the work."""
    n = table(spark, at, "passages").groupBy("version_id").agg(F.max("ordinal").alias("n")).where("n >= 10")
    cut = F.expr("n DIV 20").cast("int")
    z = F.array(
        F.struct(F.lit(1).alias("a"), (cut + 1).alias("b"), F.lit("paratext").alias("role")), F.struct((cut + 2).alias("a"), (cut + 2).alias("b"), F.lit("mixed").alias("role")),
        F.struct((cut + 3).alias("a"), F.col("n").alias("b"), F.lit("authorial").alias("role")),
    )
    rows = n.select("version_id", "n", F.explode(z).alias("z"))
    return rows.select("version_id", F.col("z.a").alias("start_ordinal"), F.col("z.b").alias("end_ordinal"), "z.role", F.col("n").alias("expected_passage_count"))


ROLES = f"""{sql.ZONES}, ord AS (SELECT *, CAST(regexp_extract(passage_id, '^(.+):passage_([0-9]+)$', 2) AS INTEGER) AS ordinal FROM placed),
roles AS (SELECT query_id, hybrid_rank, passage_id, o.version_id, ordinal, CASE WHEN k.version_id IS NULL THEN 'unknown' ELSE coalesce(role, 'outside') END AS role
  FROM ord o LEFT JOIN zones z ON o.version_id = z.version_id AND ordinal BETWEEN start_ordinal AND end_ordinal LEFT JOIN (SELECT DISTINCT version_id FROM zones) k ON o.version_id = k.version_id),
role_evidence AS (SELECT query_id, count(*) AS n_hits, count(*) FILTER (role = 'authorial') AS n_authorial, count(*) FILTER (role = 'paratext') AS n_paratext, count(*) FILTER (role = 'mixed') AS n_mixed,
  count(*) FILTER (role = 'unknown') AS n_unknown, coalesce(bool_or(hybrid_rank = 1 AND role = 'paratext'), FALSE) AS top_is_paratext, coalesce(bool_or(hybrid_rank = 1 AND role = 'mixed'), FALSE) AS top_is_mixed FROM roles GROUP BY query_id)"""


@query(f"WITH {sql.FUSED}, {SCOPE}, {ROLES} SELECT * FROM roles")
def paratext_roles(spark: SparkSession, at: str) -> DataFrame:
    return evidence.content_roles(_versioned(spark, at), _zones(spark, at))


@query(f"WITH {sql.FUSED}, {SCOPE}, {ROLES} SELECT * FROM role_evidence")
def paratext_evidence(spark: SparkSession, at: str) -> DataFrame:
    return evidence.role_evidence(evidence.content_roles(_versioned(spark, at), _zones(spark, at)))


@query(
    f"""WITH {sql.ZONES}, p AS (SELECT version_id FROM versions WHERE profile = 'mixed_prose_ocr') SELECT version_id, start_ordinal, 'gap_or_overlap' AS issue FROM zones JOIN p USING (version_id) WHERE role = 'authorial'
    UNION ALL SELECT z.version_id, start_ordinal, 'ends_elsewhere' FROM zones z ANTI JOIN p ON z.version_id = p.version_id JOIN versions v ON v.version_id = z.version_id WHERE role = 'authorial' AND v.profile = 'structured_poetry'"""
)
def zone_validation(spark: SparkSession, at: str) -> DataFrame:
    """Breaches of a catalog whose mixed zones reach a passage too far in prose, and whose poetry has a passage more."""
    profiles = table(spark, at, "versions").select("version_id", "profile")
    z = _zones(spark, at).join(profiles, "version_id")
    far = F.when((F.col("profile") == parsing.PROSE) & (F.col("role") == "mixed"), 1).otherwise(0)
    more = F.when(F.col("profile") == parsing.POETRY, 1).otherwise(0)
    return evidence.zone_violations(z.withColumn("end_ordinal", F.col("end_ordinal") + far).withColumn("expected_passage_count", F.col("expected_passage_count") + more))


DECISIONS = f"""{FEATURES}, {SCOPE}, {ROLES},
tr AS (SELECT query_id, top_passage_id, list_filter([CASE WHEN coalesce(out_of_corpus_mentioned, FALSE) THEN 'known_out_of_corpus_scope' END, CASE WHEN coalesce(source_conflict, FALSE) THEN 'source_attribution_conflict' END,
  CASE WHEN coalesce(top_is_paratext, FALSE) THEN 'top_hit_paratext' END, CASE WHEN coalesce(top_is_mixed, FALSE) THEN 'top_hit_mixed' END, CASE WHEN hybrid_hits = 0 THEN 'no_hybrid_hits' END,
  CASE WHEN hybrid_hits > 0 AND dense_top_1 < 0.863 AND overlap_at_10 <= 0 THEN 'weak_cross_retriever_evidence' END], lambda x: x IS NOT NULL) AS t
  FROM features LEFT JOIN scope USING (query_id) LEFT JOIN role_evidence USING (query_id)),
decisions AS (SELECT query_id, CASE WHEN len(t) > 0 THEN 'abstain' ELSE 'return_results' END AS action, coalesce(t[1], 'baseline_evidence_passed') AS reason,
  CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE 'baseline_evidence_passed' END AS triggered, top_passage_id FROM tr)"""


def _decisions(spark: SparkSession, at: str) -> DataFrame:
    roles = evidence.role_evidence(evidence.content_roles(_versioned(spark, at), _zones(spark, at)))
    return policy.decide(_features(spark, at), _scope_evidence(spark, at), roles)


@query(f"WITH {DECISIONS} SELECT * FROM decisions")
def abstention_decision(spark: SparkSession, at: str) -> DataFrame:
    return _decisions(spark, at)


@query(
    f"""WITH {DECISIONS}, l AS (SELECT query_id, list(passage_id ORDER BY hybrid_rank) AS ps FROM fused GROUP BY query_id)
    SELECT query_id, action, reason, CASE WHEN reason = 'baseline_evidence_passed' THEN 'نتایج مرتبط از مجموعه بازیابی شد.' WHEN reason = 'known_out_of_corpus_scope' THEN 'پرسش به نویسنده یا اثری خارج از مجموعه فعلی اشاره دارد.'
      WHEN reason = 'weak_cross_retriever_evidence' THEN 'شواهد بازیابی برای ارائه نتیجه قابل‌اعتماد کافی نبود.' WHEN contains(reason, 'paratext') THEN 'نتیجه قابل‌اعتمادی از متن اصلی اثر پیدا نشد.' ELSE 'نتیجه قابل‌اعتمادی برای این پرسش پیدا نشد.' END AS message,
      CASE WHEN action = 'return_results' THEN top_passage_id END AS top_passage_id, CAST(CASE WHEN action = 'return_results' THEN coalesce(len(ps), 0) ELSE 0 END AS BIGINT) AS n_public, coalesce(len(ps), 0) AS n_diagnostic,
      CASE WHEN action = 'return_results' THEN coalesce(array_to_string(ps, ' '), '') ELSE '' END AS passages FROM decisions LEFT JOIN l USING (query_id)"""
)
def trusted_response(spark: SparkSession, at: str) -> DataFrame:
    return policy.responses(_decisions(spark, at), _fused(spark, at))


@query(
    f"""WITH {sql.FUSED} SELECT f.query_id, f.hybrid_rank, f.passage_id, p.version_id, p.author_id, p.work_title, p.ordinal, p.previous_passage_id, p.next_passage_id FROM fused f JOIN passages p USING (passage_id)"""
)
def enrich_hits(spark: SparkSession, at: str) -> DataFrame:
    own = table(spark, at, "passages").select("passage_id", "version_id", "author_id", "work_title", "ordinal", "previous_passage_id", "next_passage_id")
    return policy.enrich(_fused(spark, at).select("query_id", "hybrid_rank", "passage_id"), own)


@query()
def suggestions_topn(spark: SparkSession, at: str) -> DataFrame:
    q, mentions, links = _scope(spark, at)
    w = table(spark, at, "works").where("title_fa IS NOT NULL").select(F.col("work_id").alias("entity_id"), F.col("title_fa").alias("label"), F.col("work_id").alias("catalog_order"))
    return policy.suggestions(q.where("query_text IS NOT NULL"), "query_text", _decisions(spark, at), mentions, w, links)


def _searched(spark: SparkSession, at: str) -> tuple[search.Corpus, DataFrame]:
    """The tables as a corpus, vectors made by hashing since no model is at hand, and every query once."""
    p = spread(table(spark, at, "passages"))
    encoder = dense.HashingEncoder()
    vectors = settle(p.where("retrieval_text IS NOT NULL").select(F.col("passage_id").alias("key"), dense.encoded(F.col("retrieval_text"), encoder).alias("vector")))
    aliases, links = _entities(spark, at)
    queries = table(spark, at, "retrieval_answerability_v1").groupBy("query_id").agg(F.min("query_text").alias("query_text"))
    return search.Corpus(_index(spark, at), vectors, encoder, p, aliases, links, _zones(spark, at)), queries


@query()
def hybrid_search(spark: SparkSession, at: str) -> DataFrame:
    """Both rankings run and fused for every query."""
    return search.hybrid_search(*_searched(spark, at), "query_text").hybrid


@query()
def trusted_search(spark: SparkSession, at: str) -> DataFrame:
    """What each query is answered, from its text to the passages shown."""
    return search.search(*_searched(spark, at), "query_text")


@query()
def search_consistency(spark: SparkSession, at: str) -> DataFrame:
    """Hits whose ranks don't bear out those of their components; none is right."""
    return search.run_violations(search.hybrid_search(*_searched(spark, at), "query_text"))


@query(
    f"""WITH {MENTIONS}, named AS (SELECT *, {scope_sql('alias')} AS n FROM al), v AS (SELECT author_id AS entity_id FROM versions WHERE author_id IS NOT NULL UNION SELECT work_id FROM versions WHERE work_id IS NOT NULL), i AS (SELECT DISTINCT entity_id FROM named WHERE in_corpus),
    shared AS (SELECT n FROM named WHERE n <> '' GROUP BY n HAVING count(DISTINCT entity_id) > 1)
    SELECT entity_id, 'repeated_entity' AS issue FROM named GROUP BY entity_id HAVING count(DISTINCT kind) > 1 OR count(DISTINCT in_corpus) > 1 UNION ALL SELECT DISTINCT entity_id, 'shared_alias' FROM named WHERE n IN (SELECT n FROM shared)
    UNION ALL SELECT entity_id, 'not_in_catalog' FROM v WHERE entity_id NOT IN (SELECT entity_id FROM i) UNION ALL SELECT entity_id, 'without_version' FROM i WHERE entity_id NOT IN (SELECT entity_id FROM v)"""
)
def catalog_violations(spark: SparkSession, at: str) -> DataFrame:
    return search.catalog_violations(_entities(spark, at)[0], table(spark, at, "versions"))


@query()
def evidence_alignment(spark: SparkSession, at: str) -> DataFrame:
    """Evidence of one query that doesn't fit together."""
    roles = evidence.role_evidence(evidence.content_roles(_versioned(spark, at), _zones(spark, at)))
    return search.alignment_violations(_features(spark, at), _scope_evidence(spark, at), roles)


# Evaluation


def _evaluated(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, at, "retrieval_answerability_v1").select("query_id", "query_type", "judgments", "include_in_metrics")
    return q, _fused(spark, at).select("query_id", "passage_id", F.col("hybrid_rank").alias("rank"))


METRICS = f"""{sql.FUSED}, {JUDGED}, base AS (SELECT query_id, any_value(query_type) <> 'out_of_corpus' AS answerable FROM retrieval_answerability_v1 WHERE include_in_metrics GROUP BY query_id),
rel AS (SELECT query_id, passage_id, max(grade) AS grade FROM judged WHERE passage_id IS NOT NULL GROUP BY ALL),
hit AS (SELECT r.query_id, r.passage_id, grade, hybrid_rank AS rank, row_number() OVER (PARTITION BY r.query_id ORDER BY grade DESC, r.passage_id) AS ideal FROM rel r LEFT JOIN fused f ON r.query_id = f.query_id AND r.passage_id = f.passage_id),
ks AS (SELECT unnest([1, 5, 10]) AS k),
agg AS (SELECT query_id, k, count(*) AS n, count(*) FILTER (rank <= k) AS hits, min(rank) FILTER (rank <= k) AS first_rank, sum(CASE WHEN rank <= k THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal <= k THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM hit CROSS JOIN ks GROUP BY query_id, k),
shown AS (SELECT query_id, min(hybrid_rank) AS first_shown FROM fused GROUP BY query_id),
metrics AS (SELECT b.query_id, ks.k AS k, answerable, CASE WHEN answerable THEN round(coalesce(hits / n, 0), 6) END AS recall, CASE WHEN answerable THEN round(coalesce(1.0 / first_rank, 0), 6) END AS reciprocal_rank,
  CASE WHEN answerable THEN round(coalesce(dcg / nullif(best, 0), 0), 6) END AS ndcg, CASE WHEN NOT answerable THEN CAST(coalesce(first_shown <= ks.k, FALSE) AS INTEGER) END AS negative_hit
  FROM base b CROSS JOIN ks LEFT JOIN agg a ON a.query_id = b.query_id AND a.k = ks.k LEFT JOIN shown s ON s.query_id = b.query_id)"""


@query(f"WITH {METRICS} SELECT * FROM metrics")
def query_metrics(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.query_metrics(*_evaluated(spark, at))


@query(
    f"""WITH {METRICS} SELECT k, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_out_of_corpus, round(coalesce(avg(recall), 0), 6) AS mean_recall, round(coalesce(avg(reciprocal_rank), 0), 6) AS mean_reciprocal_rank,
    round(coalesce(avg(ndcg), 0), 6) AS mean_ndcg, round(coalesce(avg(negative_hit), 0), 6) AS negative_hit_rate FROM metrics GROUP BY k"""
)
def eval_aggregate(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.aggregate(evaluation.query_metrics(*_evaluated(spark, at)))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(max(value), 6) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def latency_summary(spark: SparkSession, at: str) -> DataFrame:
    return evaluation.latency_summary(table(spark, at, "events"), "event_type", "value")


@query(
    f"""WITH {sql.FUSED}, q AS (SELECT * FROM retrieval_answerability_v1 WHERE query_type <> 'out_of_corpus'), r AS (SELECT DISTINCT query_id FROM fused WHERE hybrid_rank = 1 AND lexical_rank IS NOT NULL AND dense_rank IS NOT NULL)
    SELECT DISTINCT query_id, 'missing_ranking' AS issue FROM q WHERE include_in_metrics AND query_id NOT IN (SELECT query_id FROM r) UNION ALL SELECT query_id, 'unknown_query' FROM r WHERE query_id NOT IN (SELECT query_id FROM q)"""
)
def ranking_issues(spark: SparkSession, at: str) -> DataFrame:
    """Rankings whose top hit both retrievers support, held against the queries of the corpus alone."""
    queries = table(spark, at, "retrieval_answerability_v1").where("query_type <> 'out_of_corpus'").select("query_id", "query_type", "judgments", "include_in_metrics")
    f = _fused(spark, at)
    top = f.where("hybrid_rank = 1 AND lexical_rank IS NOT NULL AND dense_rank IS NOT NULL").select("query_id")
    return evaluation.ranking_issues(queries, f.join(top, "query_id", "left_semi").select("query_id", "passage_id", F.col("hybrid_rank").alias("rank")))


@query(
    f"""WITH {DECISIONS}, {METRICS[len(sql.FUSED) + 2:]}, types AS (SELECT query_id, any_value(query_type) <> 'out_of_corpus' AS ok FROM retrieval_answerability_v1 WHERE include_in_metrics GROUP BY query_id),
    found AS (SELECT query_id, max(recall) FILTER (k = 1) AS r1, max(recall) FILTER (k = 5) AS r5, max(recall) FILTER (k = 10) AS r10 FROM metrics GROUP BY query_id),
    x AS (SELECT ok, action = 'return_results' AS a, r1, r5, r10 FROM types JOIN decisions USING (query_id) LEFT JOIN found USING (query_id))
    SELECT count(*) AS n_queries, count(*) FILTER (ok) AS n_answerable, count(*) FILTER (ok AND a) AS retained, count(*) FILTER (NOT ok AND NOT a) AS rejected, count(*) FILTER (ok AND NOT a) AS false_abstentions, count(*) FILTER (NOT ok AND a) AS false_acceptances,
      round(count(*) FILTER (ok = a) / count(*), 6) AS accuracy, round(count(*) FILTER (a) / count(*), 6) AS coverage, round(count(*) FILTER (ok AND a) / nullif(count(*) FILTER (a), 0), 6) AS precision,
      round(count(*) FILTER (NOT ok AND NOT a OR ok AND a AND r1 > 0) / count(*), 6) AS end_to_end_1, round(count(*) FILTER (NOT ok AND NOT a OR ok AND a AND r5 > 0) / count(*), 6) AS end_to_end_5, round(count(*) FILTER (NOT ok AND NOT a OR ok AND a AND r10 > 0) / count(*), 6) AS end_to_end_10 FROM x"""
)
def answerability_report(spark: SparkSession, at: str) -> DataFrame:
    q, rankings = _evaluated(spark, at)
    return evaluation.answerability(q, _decisions(spark, at), evaluation.query_metrics(q, rankings))


# Streaming


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def event_windows(spark: SparkSession, at: str) -> DataFrame:
    return ingest.event_windows(table(spark, at, "events"), "ts", "event_type", "value")


@query(
    """WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, at: str) -> DataFrame:
    return ingest.sessions(table(spark, at, "events"), "user_id", "ts")


@query(f"WITH {sql.INDEX} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM terms JOIN (SELECT term, sum(tf) AS cf FROM postings GROUP BY term) USING (term)")
def stream_postings(spark: SparkSession, at: str) -> DataFrame:
    """The postings of all passages, ingested as a stream of files into the shared folder."""
    context = spark.sparkContext
    out = f"{shared_folder(context)}/{context.applicationId}-{hashlib.md5(at.encode()).hexdigest()}"
    like = table(spark, at, "passages")
    # The source takes folders: the folder of the table's files, or the table file's folder with a filter on its name.
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    file = f"{at}/passages.parquet"
    is_folder = len(like.inputFiles()) > 1 or not like.inputFiles()[0].endswith("passages.parquet")
    stream = stream.parquet(file) if is_folder else stream.option("pathGlobFilter", "passages.parquet").parquet(at)
    ingest.ingest_postings(stream, "passage_id", "search_alias_text", f"{out}/postings", f"{out}/state").awaitTermination()
    return ingest.term_totals(spark, f"{out}/postings")
