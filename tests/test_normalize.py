from pyspark.sql import functions as F

from folioflow.functions import normalize as n
from folioflow.operators import lexical


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_display_keeps_joiners_and_marks(spark):
    assert one(spark, "  می‌رود\t \tکَتب\r\nخط ۲​ ", n.normalize_display("t")) == "می‌رود کَتب\nخط ۲"
    assert one(spark, "ۀ", n.normalize_display("t")) == "هٔ"
    assert one(spark, "é", n.normalize_display("t")) == "é"
    assert one(spark, None, n.normalize_display("t")) is None
    assert one(spark, " \n ", n.normalize_display("t")) == ""


def test_retrieval_and_alias(spark):
    assert one(spark, "كتابـــي ١٢۳ می‌رود", n.normalize_retrieval("t")) == "کتابی 123 می رود"
    assert one(spark, "أمة إلى ٱلخط خانۀ آب", n.normalize_search_alias("t")) == "امه الی الخط خانه آب"
    assert one(spark, "آب", n.normalize_search_alias("t", fold_alef_madda=True)) == "اب"


def test_views_are_idempotent(spark):
    for text in ("  كِتابٌ\r\n ۀ ‌ x ", "", "a\tb"):
        view = one(spark, text, n.normalize_search_alias("t"))
        assert one(spark, view, n.normalize_search_alias("t")) == view


def test_script_profiles(spark):
    for text, want in (("پژگ", "persian_signals_only"), ("أمة", "arabic_variants_only"), ("پأ", "mixed_signals"), ("سلام", "shared_or_other_only")):
        assert one(spark, text, n.script_profile("t")) == want


def test_changes_count_runs(spark):
    rows = spark.createDataFrame([(1, "  a\t\tb  c \nd"), (2, None), (3, "x")], "id int, t string")
    got = {(r.id, r.view, r.operation): r["count"] for r in n.normalization_changes(rows, "t").collect()}
    assert got[1, "display", "collapse_horizontal_spaces"] == 4
    assert got[1, "retrieval", "collapse_whitespace"] == 1
    assert {k[0] for k in got} == {1}


def test_snippet_and_names(spark):
    assert one(spark, "abc  def ghi jkl", n.snippet("t", 10)) == "abc def g…"
    assert one(spark, "short", n.snippet("t", 10)) == "short"
    assert one(spark, "a b/c?", n.safe_filename("t")) == "a_b_c"
    assert one(spark, "N/A", n.metadata_status("t")) == "placeholder"
    assert one(spark, " ", n.metadata_status("t")) == "missing"
    assert one(spark, "x-per1", n.version_language("t")) == "Persian"
    assert one(spark, "a b 　 c", n.word_count("t")) == 3


def test_scope_view(spark):
    assert one(spark, "مولانا‌جلال، ﻣﻮﻻ!", n.normalize_scope("t")) == "مولانا جلال، مولا"


def test_index_tokens(spark):
    assert one(spark, "Ünï-code ٣ x_y", F.array_join(lexical.tokens("t"), " ")) == "uni code ٣ x y"
