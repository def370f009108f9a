"""Text views as column expressions: display, retrieval, search alias and scope.

Each view is one Arrow UDF over whole batches (see ``views``), since composition needs Python anyhow and a nest of
regular expressions costs more than a few table look-ups. The single steps, which the changes are counted by, are
column expressions.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions import views

# The characters that each step of the views treats.
CONTROLS = "[\\u0000-\\u0008\\u000B-\\u000C\\u000E-\\u001F\\u007F-\\u009F]"
FORMATS = "[\\u00AD\\u061C\\u200B\\u200E\\u200F\\u202A-\\u202E\\u2060\\u2066-\\u2069\\uFEFF]"
SPACE_VARIANTS = "   "
HARAKAT = "[\\u064B-\\u0652\\u0656-\\u065F\\u0670]"
QURANIC = "[\\u06D6-\\u06ED]"
SCOPE_MARKS = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED]"
BLANK = " \\t\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WHITE = "[" + BLANK + "\\n]"
ARABIC_DIGITS = "".join(chr(0x0660 + k) for k in range(10)) + "".join(chr(0x06F0 + k) for k in range(10))
DIGITS = "0123456789" * 2
YEH_KAF = ("يىك", "ییک")
ALIAS = ("أإٱة", "اااه")
HEH_YEH, HEH_HAMZA, HEH = "ۀ", "هٔ", "ه"
SCOPE_LETTERS = ("يىئكؤةۀ", "یییکوهه")
PERSIAN_SIGNALS = "[پچژگکی]"
ARABIC_SIGNALS = "[يكىةأإٱؤئ]"


def _unicode_form(form: str):
    @F.pandas_udf(StringType())
    def normalized(s: pd.Series) -> pd.Series:
        plain = s.fillna("").map(str.isascii)
        return s if plain.all() else s.where(plain, s.str.normalize(form))

    return normalized


nfc = _unicode_form("NFC")
nfkc = _unicode_form("NFKC")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display_steps(c: Column | str) -> dict[str, Column]:
    """Every step of the display view, by the name of its operation, each built on the one before."""
    steps = {"original": _col(c)}
    steps["normalize_line_endings"] = F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    steps["unicode_nfc"] = nfc(steps["normalize_line_endings"])
    steps["standardize_heh_hamza"] = F.replace(steps["unicode_nfc"], F.lit(HEH_YEH), F.lit(HEH_HAMZA))
    steps["normalize_space_variants"] = F.translate(steps["standardize_heh_hamza"], SPACE_VARIANTS, "   ")
    steps["remove_control_characters"] = F.regexp_replace(steps["normalize_space_variants"], CONTROLS, "")
    steps["remove_format_characters"] = F.regexp_replace(steps["remove_control_characters"], FORMATS, "")
    collapsed = F.regexp_replace(steps["remove_format_characters"], "[ \\t]+", " ")
    steps["collapse_horizontal_spaces"] = F.regexp_replace(collapsed, f"(?md)^[{BLANK}]+|[{BLANK}]+$", "")
    steps["trim_outer_whitespace"] = strip(steps["collapse_horizontal_spaces"])
    return steps


def strip(c: Column | str) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(_col(c), f"\\A{WHITE}+|{WHITE}+\\z", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space of any kind become a single space; none stays at the ends."""
    return strip(F.regexp_replace(_col(c), f"{WHITE}+", " "))


def _view(*steps):
    @F.arrow_udf(StringType())
    def seen(texts: pa.Array) -> pa.Array:
        return views.over(texts, *steps)

    return seen


def _fold_madda(cp, off):
    return views.alias(cp, off, True)


_display, _retrieval, _alias = _view(views.display), _view(views.display, views.retrieval), _view(views.display, views.retrieval, views.alias)
_from_display, _from_retrieval = _view(views.retrieval), _view(views.alias)
_alias_madda, _from_retrieval_madda = _view(views.display, views.retrieval, _fold_madda), _view(_fold_madda)


def normalize_display(c: Column | str) -> Column:
    """The conservative view for readers: composition, line ends, spaces, invisible characters; null stays null."""
    return _display(_col(c))


def retrieval_steps(display: Column | str) -> dict[str, Column]:
    steps = {"display": _col(display)}
    steps["map_yeh_variants"] = F.translate(_col(display), YEH_KAF[0][:2], YEH_KAF[1][:2])
    steps["map_arabic_kaf"] = F.translate(steps["map_yeh_variants"], YEH_KAF[0][2:], YEH_KAF[1][2:])
    steps["map_digits_to_ascii"] = F.translate(steps["map_arabic_kaf"], ARABIC_DIGITS, DIGITS)
    steps["remove_arabic_harakat"] = F.regexp_replace(steps["map_digits_to_ascii"], HARAKAT, "")
    steps["remove_quranic_marks"] = F.regexp_replace(steps["remove_arabic_harakat"], QURANIC, "")
    steps["remove_tatweel"] = F.replace(steps["remove_quranic_marks"], F.lit("ـ"), F.lit(""))
    steps["replace_zwnj_with_space"] = F.replace(steps["remove_tatweel"], F.lit("‌"), F.lit(" "))
    steps["remove_zwj"] = F.replace(steps["replace_zwnj_with_space"], F.lit("‍"), F.lit(""))
    steps["collapse_whitespace"] = squeeze(steps["remove_zwj"])
    return steps


def retrieval_from_display(display: Column | str) -> Column:
    return _from_display(_col(display))


def normalize_retrieval(c: Column | str) -> Column:
    """The view that is searched and embedded."""
    return _retrieval(_col(c))


def alias_from_retrieval(retrieval: Column | str, fold_alef_madda: bool = False) -> Column:
    return (_from_retrieval_madda if fold_alef_madda else _from_retrieval)(_col(retrieval))


def normalize_search_alias(c: Column | str, fold_alef_madda: bool = False) -> Column:
    """The loosest view, for lexical search."""
    return (_alias_madda if fold_alef_madda else _alias)(_col(c))


def search_alias_view(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, normalize_search_alias(text))


def normalize_views(df: DataFrame, text: str) -> DataFrame:
    """Adds display_view, retrieval_view and alias_view of ``text``."""
    shown = df.withColumn("display_view", normalize_display(text))
    shown = shown.withColumn("retrieval_view", retrieval_from_display("display_view"))
    return shown.withColumn("alias_view", alias_from_retrieval("retrieval_view"))


def normalization_changes(df: DataFrame, text: str) -> DataFrame:
    """One row per row and operation of the three views that changed something: view, operation, count.

    ``df`` keeps its columns; rows without a change and null texts give none.
    """
    d = display_steps("__text")
    frame = df.withColumn("__text", F.col(text)).withColumn("__nfc", d["unicode_nfc"])
    for name, c in (
        ("__heh", F.replace("__nfc", F.lit(HEH_YEH), F.lit(HEH_HAMZA))),
        ("__space", F.translate("__heh", SPACE_VARIANTS, "   ")),
        ("__control", F.regexp_replace("__space", CONTROLS, "")),
        ("__format", F.regexp_replace("__control", FORMATS, "")),
        ("__collapse", F.regexp_replace(F.regexp_replace("__format", "[ \\t]+", " "), f"(?md)^[{BLANK}]+|[{BLANK}]+$", "")),
        ("__display", strip("__collapse")),
        ("__beforews", retrieval_steps("__display")["remove_zwj"]),
        ("__retrieval", squeeze("__beforews")),
    ):
        frame = frame.withColumn(name, c)
    count = lambda c, chars: F.regexp_count(F.col(c), F.lit(chars))
    lines = "(?md)^[ \\t]+|[ \\t]+$|(?<![ \\t])(?:\\t[ \\t]*|[ \\t]{2,})(?![ \\t])"
    whites = f"\\A{WHITE}+|{WHITE}+\\z|(?<!{WHITE})(?:(?! (?!{WHITE})){WHITE}+)"
    found = [
        ("display", "normalize_line_endings", F.regexp_count(F.col("__text"), F.lit("\\r\\n|\\r"))),
        ("display", "unicode_nfc", (F.col("__nfc") != d["normalize_line_endings"]).cast("int")),
        ("display", "standardize_heh_hamza", count("__nfc", HEH_YEH)),
        ("display", "normalize_space_variants", count("__heh", f"[{SPACE_VARIANTS}]")),
        ("display", "remove_control_characters", count("__space", CONTROLS)),
        ("display", "remove_format_characters", count("__control", FORMATS)),
        ("display", "collapse_horizontal_spaces", count("__format", lines)),
        ("display", "trim_outer_whitespace", (F.col("__display") != F.col("__collapse")).cast("int")),
        ("retrieval", "map_yeh_variants", count("__display", "[يى]")),
        ("retrieval", "map_arabic_kaf", count("__display", "ك")),
        ("retrieval", "map_digits_to_ascii", count("__display", f"[{ARABIC_DIGITS}]")),
        ("retrieval", "remove_arabic_harakat", count("__display", HARAKAT)),
        ("retrieval", "remove_quranic_marks", count("__display", QURANIC)),
        ("retrieval", "remove_tatweel", count("__display", "ـ")),
        ("retrieval", "replace_zwnj_with_space", count("__display", "‌")),
        ("retrieval", "remove_zwj", count("__display", "‍")),
        ("retrieval", "collapse_whitespace", count("__beforews", whites)),
        ("search_alias", "fold_alef_hamza_variants", count("__retrieval", "[أإٱ]")),
        ("search_alias", "fold_ta_marbuta", count("__retrieval", "ة")),
        ("search_alias", "fold_heh_hamza", count("__retrieval", HEH_HAMZA)),
    ]
    changes = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(o).alias("operation"), n.cast("int").alias("count")) for v, o, n in found))
    kept = [c for c in df.columns]
    out = frame.select(*kept, F.explode(changes).alias("__c"))
    return out.select(*kept, "__c.view", "__c.operation", F.col("__c.count").alias("count")).where("count > 0")


def script_profile(c: Column | str) -> Column:
    """persian_signals_only, arabic_variants_only, mixed_signals or shared_or_other_only."""
    persian, arabic = F.rlike(_col(c), F.lit(PERSIAN_SIGNALS)), F.rlike(_col(c), F.lit(ARABIC_SIGNALS))
    return (
        F.when(persian & arabic, "mixed_signals")
        .when(persian, "persian_signals_only")
        .when(arabic, "arabic_variants_only")
        .when(_col(c).isNotNull(), "shared_or_other_only")
    )


def normalize_scope(c: Column | str) -> Column:
    """The view in which scope aliases are matched: letters, digits and single spaces only."""
    folded = F.translate(nfkc(_col(c)), *SCOPE_LETTERS)
    folded = F.translate(folded, "‌‍﻿", "   ")
    folded = F.regexp_replace(folded, SCOPE_MARKS, "")
    folded = F.regexp_replace(folded, "[^0-9A-Za-z\\u0600-\\u06FF]+", " ")
    return F.trim(F.regexp_replace(F.lower(folded), " +", " "))


def metadata_value(c: Column | str) -> Column:
    """Trimmed value of a metadata field, null where it is missing; a placeholder is kept as it is."""
    return F.when(metadata_status(c) != "missing", strip(c))


#: Phrases that mark a metadata value as a placeholder.
PLACEHOLDER_PHRASES = (
    r"\bunknown\b", r"\bunknown\s+value\b", r"\btodo\b", r"\btbd\b", r"\bxxx+\b", r"\byyyy(?:-mm-dd)?\b", r"^\s*n/?a\s*$",
    r"\bnone\b", r"\bnot\s+available\b", r"\bnot\s+specified\b", r"\bpermalink\b", r"\bthe\s+name\s+of\s+the\s+annotator\b",
    r"\bfulān\b", r"\buris?\s+from\s+althurayya\b", r"\bauth_uri\s+from\s+openiti\b", r"\bbook_uri\s+from\s+openiti\b",
    r"\byear-mon-da\b", r"\ba\s+free\s+running\s+comment\s+here\b", r"\bviaf@id,\s*wikidata@id,\s*src@id\b",
)
PLACEHOLDERS = "(?iU)" + "|".join(PLACEHOLDER_PHRASES)


def metadata_status(c: Column | str) -> Column:
    """valid, missing or placeholder."""
    v = strip(c)
    return F.when(_col(c).isNull() | (v == ""), "missing").when(F.rlike(v, F.lit(PLACEHOLDERS)), "placeholder").otherwise("valid")


def version_language_code(version_id: Column | str) -> Column:
    """Three-letter code of a version id's suffix, null without one."""
    code = F.lower(F.regexp_extract(_col(version_id), "(?i)-([a-z]{3})\\d+$", 1))
    return F.when(code != "", code)


def version_language(version_id: Column | str) -> Column:
    """Language named by a version id's suffix: a name where one is known, else the code."""
    code = version_language_code(version_id)
    return F.when(code == "per", "Persian").when(code == "ara", "Arabic").otherwise(code)


def comma_list(c: Column | str) -> Column:
    """Trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(_col(c), ","), lambda x: squeeze(x)), lambda x: x != "")


def safe_filename(c: Column | str) -> Column:
    """A portable file name."""
    return F.regexp_replace(F.regexp_replace(_col(c), "[^A-Za-z0-9._-]+", "_"), "\\A[._]+|[._]+\\z", "")


def snippet(c: Column | str, max_chars: int = 280) -> Column:
    """Squeezed text of at most ``max_chars`` characters, cut texts ending in an ellipsis."""
    t = squeeze(c)
    return F.when(F.length(t) <= max_chars, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max_chars - 1), f"{WHITE}+\\z", ""), F.lit("…")))


def word_count(c: Column | str) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(_col(c), f"[{BLANK}\\n\\u000B-\\u000D\\u001C-\\u001F\\u0085]+"), lambda w: w != ""))
