"""DuckDB SQL of block parsing and of what is built on it: lines to blocks, units, context and cleaned text."""

from __future__ import annotations

from folioflow.plans.sqltext import SOURCES, WHITE

MARK = r"(?i:PageV[0-9]+P[0-9]+)|\bms[0-9]+\b"
MARK_OCR = MARK + r"|!\[[^\]]*\]\([^)]+\)"
BLANK_LINE = "trim(translate(bare, chr(9), ' ')) = ''"

CLASSED = rf"""{SOURCES},
bared AS (SELECT l.doc_id, line_number, char_start, line, coalesce(profile, 'mixed_prose_ocr') AS profile, regexp_replace(line, '[\r\n]+$', '') AS bare, regexp_replace(line, '^\s+', '') AS s FROM lines l JOIN documents USING (doc_id)),
classed AS (SELECT *, CASE WHEN {BLANK_LINE} THEN 'blank'
  WHEN profile = 'raw_ocr_reference' THEN CASE WHEN len(regexp_extract_all(bare, '{MARK_OCR}')) = 1 AND trim(regexp_replace(regexp_replace(bare, '{MARK_OCR}', ' ', 'g'), '^\s*~~', '')) = '' THEN 'markers' ELSE 'raw' END
  WHEN regexp_matches(bare, '{MARK}') AND regexp_replace(translate(regexp_replace(bare, '{MARK}', ' ', 'g'), '#~|', ''), '\s+', '', 'g') = '' THEN 'markers'
  WHEN profile = 'structured_poetry' AND regexp_matches(bare, '(?i)^\s*###\s*\|\s*\[\s*daftar\s+[0-9]+\s*\]\s*$') THEN 'section'
  WHEN profile <> 'structured_poetry' AND regexp_matches(bare, '^\s*#?\s*!\[([^\]]*)\]\(([^)]+)\)\s*$') THEN 'image'
  WHEN starts_with(s, '###') THEN 'heading'
  WHEN profile <> 'structured_poetry' AND regexp_matches(bare, '^\s*#\s*~{{0,2}}\s*(مجلس\s+.+?)\s*$') THEN 'section'
  WHEN starts_with(s, '#') AND contains(s, '%~%') THEN 'verse' WHEN starts_with(s, '~~') THEN 'continuation'
  WHEN profile <> 'structured_poetry' AND starts_with(s, '#') THEN 'paragraph' ELSE 'raw' END AS class FROM bared)"""

BLOCKS = rf"""{CLASSED},
evented AS (SELECT *, CASE WHEN profile = 'structured_poetry' THEN CASE WHEN class = 'verse' THEN 1 WHEN class IN ('section', 'heading', 'raw', 'blank') THEN 0 END
  ELSE CASE WHEN class IN ('paragraph', 'continuation') THEN 1 WHEN class IN ('heading', 'section', 'verse', 'raw') THEN 0 END END AS event FROM classed),
opened AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS open FROM evented),
typed AS (SELECT *, CASE WHEN class = 'image' THEN 'image_reference' WHEN class = 'continuation' THEN CASE WHEN profile <> 'structured_poetry' THEN 'paragraph' WHEN open THEN 'verse' ELSE 'raw' END ELSE class END AS kind,
  CASE WHEN class IN ('verse', 'section', 'heading', 'paragraph') THEN 1 WHEN class = 'continuation' AND NOT open AND profile <> 'structured_poetry' THEN 1 WHEN class = 'raw' AND profile = 'raw_ocr_reference' THEN 1 ELSE 0 END AS starts FROM opened),
counted AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, kind ORDER BY line_number) AS number FROM typed),
grouped AS (SELECT *, CASE WHEN kind IN ('section', 'heading', 'verse', 'paragraph') THEN kind || '_' || format('{{:04d}}', CAST(number AS BIGINT))
  WHEN kind = 'raw' AND profile = 'raw_ocr_reference' THEN 'raw_ocr_' || format('{{:04d}}', CAST(number AS BIGINT)) END AS group_id FROM counted),
parted AS (SELECT *, CASE WHEN kind IN ('blank', 'image_reference') THEN [] WHEN profile = 'raw_ocr_reference' THEN regexp_extract_all(line, '{MARK_OCR}') ELSE regexp_extract_all(line, '{MARK}') END AS ms,
  CASE WHEN kind IN ('blank', 'image_reference') THEN [line] WHEN profile = 'raw_ocr_reference' THEN string_split_regex(line, '{MARK_OCR}') ELSE string_split_regex(line, '{MARK}') END AS cs FROM grouped),
judged AS (SELECT *, list_transform(cs, lambda c: kind NOT IN ('markers', 'blank') AND trim(translate(c, chr(9) || chr(10) || chr(13), '   ')) <> '') AS real FROM parted),
pieces_of AS (
  SELECT doc_id, line_number, 0 AS seq, char_start AS place, CASE WHEN real[1] OR kind = 'image_reference' THEN kind ELSE 'blank' END AS block_type, group_id, cs[1] AS raw_text FROM judged WHERE real[1] OR len(ms) = 0
  UNION ALL
  SELECT doc_id, line_number, 2 * j - 1, char_start + CASE WHEN j = 1 AND NOT real[1] THEN 0 ELSE list_sum(list_transform(cs[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) END,
    CASE WHEN regexp_matches(ms[j], '^(?i:PageV[0-9]+P[0-9]+)$') THEN 'page_marker' WHEN starts_with(ms[j], '!') THEN 'image_reference' ELSE 'milestone' END, group_id,
    CASE WHEN j = 1 AND NOT real[1] THEN cs[1] ELSE '' END || ms[j] || CASE WHEN NOT real[j + 1] THEN cs[j + 1] ELSE '' END FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM judged)
  UNION ALL
  SELECT doc_id, line_number, 2 * j, char_start + list_sum(list_transform(cs[1:j], lambda x: length(x))) + list_sum(list_transform(ms[1:j], lambda x: length(x))), kind, group_id, cs[j + 1]
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM judged) WHERE real[j + 1]),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_number, seq) AS INTEGER) AS block_no, block_type, CASE WHEN block_type IN ('heading', 'section', 'verse', 'paragraph', 'raw') THEN group_id END AS group_id,
  CAST(line_number AS BIGINT) AS line_number, CAST(place AS BIGINT) AS char_start, CAST(place + length(raw_text) AS BIGINT) AS char_end, raw_text FROM pieces_of)"""

UNITS = f"""{BLOCKS},
content AS (SELECT *, char_start > lag(char_end) OVER (PARTITION BY doc_id, group_id ORDER BY char_start) AS gap FROM blocks WHERE group_id IS NOT NULL),
units AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || group_id AS unit_id, arg_min(block_type, char_start) AS unit_type, CAST(count(*) AS INTEGER) AS component_count, min(char_start) AS char_start, max(char_end) AS char_end,
  string_agg(raw_text, '' ORDER BY char_start) AS raw_text, coalesce(bool_or(gap), FALSE) AS has_gaps, CASE WHEN count(DISTINCT block_type) > 1 THEN 'mixed_types' END AS issue FROM content GROUP BY doc_id, group_id)"""

NOTE = r"\[\s*([A-Za-z][A-Za-z0-9_-]*)\s*:\s*([^\[\]]+?)\s*\]"


def cleaned(separator: str) -> str:
    """Cleaned text of a unit (columns raw_text, unit_type)."""
    head = "unit_type IN ('heading', 'section')"
    line = r"regexp_replace(regexp_replace(x, '^\s+', ''), '^(?:#{1,3}\s*)+', '')"
    line = rf"CASE WHEN {head} THEN regexp_replace({line}, '^\|{{1,2}}\s*', '') ELSE {line} END"
    line = rf"regexp_replace({line}, '^(?:~~\s*)+', '')"
    line = rf"CASE WHEN i = 1 AND unit_type = 'verse' THEN regexp_replace({line}, '^\d+\s+', '') ELSE {line} END"
    line = rf"CASE WHEN {head} THEN regexp_replace({line}, '{NOTE}', ' ', 'g') ELSE {line} END"
    line = f"trim(regexp_replace({line}, '{WHITE}+', ' ', 'g'))"
    joined = rf"array_to_string(list_filter(list_transform(string_split_regex(raw_text, '\r\n|\n|\r'), lambda x, i: {line}), lambda y: y <> ''), ' ')"
    return rf"trim(regexp_replace(regexp_replace({joined}, '\s*%~%\s*', '{separator}', 'g'), '{WHITE}+', ' ', 'g'))"


CLEANED = rf"""{UNITS},
cleaned AS (SELECT *, {cleaned(' | ')} AS display_text, {cleaned(' ')} AS retrieval_text, CASE WHEN unit_type = 'verse' THEN TRY_CAST(nullif(regexp_extract(raw_text, '^\s*(?:#{{1,3}}\s*)+(\d+)\s', 1), '') AS INTEGER) END AS verse_number FROM units)"""

PAGES = f"""{UNITS}, marks AS (SELECT doc_id, char_start AS ms, char_end AS me, trim(raw_text) AS label FROM blocks WHERE block_type = 'page_marker'),
paged AS (SELECT u.doc_id, u.unit_id, arg_max(m.label, m.me) FILTER (m.me <= u.char_start) AS preceding, arg_min(m.label, m.ms) FILTER (m.ms >= u.char_end) AS following,
  count(m.ms) FILTER (m.ms < u.char_end) - count(m.ms) FILTER (m.me <= u.char_start) AS embedded_markers, any_value(u.char_start) AS char_start, any_value(u.char_end) AS char_end
  FROM units u LEFT JOIN marks m ON u.doc_id = m.doc_id GROUP BY u.doc_id, u.unit_id)"""

HEADED = f"""{UNITS}, placed AS (SELECT doc_id, unit_id, unit_type, char_start, last_value(CASE WHEN unit_type = 'section' THEN unit_id END IGNORE NULLS) OVER w AS section_id, last_value(CASE WHEN unit_type = 'section' THEN char_start END IGNORE NULLS) OVER w AS sa,
  last_value(CASE WHEN unit_type = 'heading' THEN unit_id END IGNORE NULLS) OVER w AS h, last_value(CASE WHEN unit_type = 'heading' THEN char_start END IGNORE NULLS) OVER w AS ha
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY char_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
headed AS (SELECT doc_id, unit_id, unit_type, section_id, CASE WHEN ha > coalesce(sa, -1) THEN h END AS heading_id FROM placed)"""
