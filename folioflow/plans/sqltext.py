"""Pieces of DuckDB SQL shared by the oracle statements."""

from __future__ import annotations

from folioflow.config import LexicalConfig
from folioflow.functions.normalize import ARABIC_DIGITS, DIGITS
from folioflow.operators.lexical import LATIN_FROM, LATIN_TO

BLANK = r" \t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE = "[" + BLANK + r"\n]"
HARAKAT = r"[\x{064B}-\x{0652}\x{0656}-\x{065F}\x{0670}]"
QURANIC = r"[\x{06D6}-\x{06ED}]"
CONTROLS = r"[\x{0001}-\x{0008}\x{000B}-\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
FORMATS = r"[\x{00AD}\x{061C}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def squeeze(c: str) -> str:
    return strip(f"regexp_replace({c}, '{WHITE}+', ' ', 'g')")


def display(c: str) -> str:
    c = f"nfc_normalize(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
    c = f"replace({c}, chr(1728), chr(1607) || chr(1620))"
    c = f"translate({c}, chr(160) || chr(8199) || chr(8239), '   ')"
    c = f"regexp_replace(regexp_replace({c}, '{CONTROLS}', '', 'g'), '{FORMATS}', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '(?m)^[{BLANK}]+|[{BLANK}]+$', '', 'g')"
    return strip(c)


def retrieval(display_view: str) -> str:
    c = f"translate({display_view}, 'يىك{ARABIC_DIGITS}', 'ییک{DIGITS}')"
    c = f"regexp_replace(regexp_replace({c}, '{HARAKAT}', '', 'g'), '{QURANIC}', '', 'g')"
    return squeeze(f"replace(replace(replace({c}, chr(1600), ''), chr(8204), ' '), chr(8205), '')")


def alias(retrieval_view: str) -> str:
    return squeeze(f"replace(translate({retrieval_view}, 'أإٱة', 'اااه'), chr(1607) || chr(1620), chr(1607))")


def search_alias(c: str) -> str:
    return alias(retrieval(display(c)))


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(translate({c}, '{LATIN_FROM}', '{LATIN_TO}')), '[\\p{{L}}\\p{{N}}]+')"


def stopwords(config: LexicalConfig = LexicalConfig()) -> str:
    return ", ".join(f"'{w}'" for w in config.stopwords)


INDEX = f"""
docs AS (SELECT passage_id AS doc_id, coalesce({tokens('search_alias_text')}, []) AS tokens FROM passages),
sized AS (SELECT doc_id, tokens, len(tokens) AS dl FROM docs),
postings AS (SELECT term, doc_id, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM sized) GROUP BY term, doc_id),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM sized),
asked AS (SELECT DISTINCT query_id, query_text FROM retrieval_answerability_v1),
q AS (SELECT query_id, q_tokens, list_distinct(q_tokens) AS q_terms FROM (SELECT query_id, {tokens(search_alias('query_text'))} AS q_tokens FROM asked) WHERE len(q_tokens) > 0)
"""
IDF = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END"
SCORE = f"-({IDF}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))"


def matches(name: str, wanted: str) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, sum({SCORE}) AS score, count(*) AS n_found
    FROM ({wanted}) w JOIN terms USING (term) JOIN postings USING (term) CROSS JOIN totals GROUP BY query_id, doc_id)"""


MODES = ",\n".join(
    [
        matches("m_all", "SELECT query_id, unnest(q_terms) AS term FROM q"),
        "s_all AS (SELECT query_id, doc_id, score FROM m_all JOIN q USING (query_id) WHERE n_found = len(q_terms))",
        "any_q AS (SELECT query_id, CASE WHEN len(kept) > 0 THEN kept ELSE q_terms END AS ts FROM (SELECT query_id, q_terms, "
        f"list_filter(q_terms, lambda t: t NOT IN ({stopwords()}) AND length(t) > 1) AS kept FROM q))",
        matches("s_any", "SELECT query_id, unnest(ts) AS term FROM any_q"),
        "p_tf AS (SELECT query_id, doc_id, dl, len(list_filter(range(0, len(tokens) - len(q_tokens) + 1), lambda i: tokens[i + 1:i + len(q_tokens)] = q_tokens)) AS tf "
        "FROM s_all JOIN q USING (query_id) JOIN sized USING (doc_id) WHERE len(tokens) >= len(q_tokens))",
        "p_df AS (SELECT query_id, count(*) AS df FROM p_tf WHERE tf > 0 GROUP BY query_id)",
        f"s_phrase AS (SELECT query_id, doc_id, {SCORE} AS score FROM p_tf JOIN p_df USING (query_id) CROSS JOIN totals WHERE tf > 0)",
    ]
)


def ranked(hits: str, limit: int, extra: str = "") -> str:
    extra = f", {extra}" if extra else ""
    return f"""SELECT query_id, rank, doc_id, round(score, 6) AS bm25{extra} FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS INTEGER) AS rank FROM {hits}) WHERE rank <= {limit}"""


HITS = "hits AS (SELECT DISTINCT * FROM retrieved_passages)"
FUSED = f"""{HITS},
scored AS (SELECT query_id, passage_id, CASE WHEN lexical_rank <= 100 THEN lexical_rank END AS lexical_rank, CASE WHEN dense_rank <= 100 THEN dense_rank END AS dense_rank FROM hits
  WHERE lexical_rank <= 100 OR dense_rank <= 100),
fused_all AS (SELECT *, coalesce(2.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0) AS score FROM scored),
fused AS (SELECT query_id, hybrid_rank, passage_id, round(score, 9) AS fusion_score, lexical_rank, dense_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 12) DESC, lexical_rank NULLS LAST, dense_rank NULLS LAST, passage_id) AS INTEGER) AS hybrid_rank FROM fused_all) WHERE hybrid_rank <= 10)"""
ZONES = """sizes AS (SELECT version_id, max(ordinal) AS n FROM passages GROUP BY version_id HAVING max(ordinal) >= 10),
zones AS (SELECT version_id, 1 AS start_ordinal, n // 20 + 1 AS end_ordinal, 'paratext' AS role, n AS expected_passage_count FROM sizes
  UNION ALL SELECT version_id, n // 20 + 2, n // 20 + 2, 'mixed', n FROM sizes UNION ALL SELECT version_id, n // 20 + 3, n, 'authorial', n FROM sizes)"""
SOURCES = """marked AS (SELECT doc_id, text, instr(text, '#META#Header#End#') AS head FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, text, CASE WHEN head = 0 THEN 0 WHEN instr(substr(text, head), chr(10)) = 0 THEN length(text) ELSE head - 1 + instr(substr(text, head), chr(10)) END AS body_char_start FROM marked),
sources AS (SELECT doc_id, starts_with(text, '######OpenITI#') AS has_magic, substr(text, 1, body_char_start) AS header, substr(text, body_char_start + 1) AS body, body_char_start,
  length(substr(text, 1, body_char_start)) - length(replace(substr(text, 1, body_char_start), chr(10), '')) + 1 AS body_line_start FROM cut),
pieces AS (SELECT doc_id, body_char_start, body_line_start, unnest(range(0, len(ls))) AS pos, ls FROM (SELECT *, string_split(body, chr(10)) AS ls FROM sources)),
numbered AS (SELECT doc_id, body_char_start, body_line_start, pos, ls[pos + 1] || CASE WHEN pos + 1 < len(ls) THEN chr(10) ELSE '' END AS line FROM pieces),
lines AS (SELECT doc_id, body_line_start + pos AS line_number, body_char_start + coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start, line
  FROM numbered WHERE line <> '')"""
