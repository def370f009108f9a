"""The decision to answer or abstain, responses and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import PolicyConfig
from folioflow.functions.normalize import squeeze

PASSED = "baseline_evidence_passed"


def decide(features: DataFrame, scope: DataFrame, roles: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """query_id, action, reason, triggered (all reasons in order of precedence, the first is the reason),
    top_passage_id. Missing evidence triggers nothing; a query without hits abstains."""
    e = features.join(scope, "query_id", "left").join(roles.drop("n_hits"), "query_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    weak = (F.col("hybrid_hits") > 0) & (F.col("dense_top_1") < config.weak_dense_top_1) & (F.col("overlap_at_10") <= config.weak_max_overlap_at_10)
    rules = [
        (config.reject_known_out_of_corpus, yes("out_of_corpus_mentioned"), "known_out_of_corpus_scope"),
        (config.reject_source_conflict, yes("source_conflict"), "source_attribution_conflict"),
        (config.reject_paratext_top, yes("top_is_paratext"), "top_hit_paratext"),
        (config.reject_mixed_top, yes("top_is_mixed"), "top_hit_mixed"),
        (True, F.col("hybrid_hits") == 0, "no_hybrid_hits"),
        (config.reject_weak_evidence, F.coalesce(weak, F.lit(False)), "weak_cross_retriever_evidence"),
    ]
    triggered = F.array_compact(F.array(*(F.when(c, F.lit(name)) for on, c, name in rules if on)))
    reason = F.coalesce(F.try_element_at(triggered, F.lit(1)), F.lit(PASSED))
    return e.select(
        "query_id", F.when(F.size(triggered) > 0, "abstain").otherwise("return_results").alias("action"), reason.alias("reason"),
        F.array_join(F.when(F.size(triggered) > 0, triggered).otherwise(F.array(F.lit(PASSED))), ",").alias("triggered"), "top_passage_id",
    )


def message(reason: Column) -> Column:
    """What a reader is told (fixed texts)."""
    return (
        F.when(reason == PASSED, "نتایج مرتبط از مجموعه بازیابی شد.")
        .when(reason == "known_out_of_corpus_scope", "پرسش به نویسنده یا اثری خارج از مجموعه فعلی اشاره دارد.")
        .when(reason == "weak_cross_retriever_evidence", "شواهد بازیابی برای ارائه نتیجه قابل‌اعتماد کافی نبود.")
        .when(F.contains(reason, F.lit("paratext")), "نتیجه قابل‌اعتمادی از متن اصلی اثر پیدا نشد.")
        .otherwise("نتیجه قابل‌اعتمادی برای این پرسش پیدا نشد.")
    )


def missing_passages(hits: DataFrame, store: DataFrame) -> DataFrame:
    """query_id, passage_id of hits that the store lacks; an answer must not be built on them."""
    return hits.select("query_id", "passage_id").join(store.select("passage_id"), "passage_id", "left_anti")


def disagreeing_hits(hits: DataFrame, store: DataFrame) -> DataFrame:
    """query_id, passage_id, issue of hits (with version_id and kind) that aren't stored or are stored otherwise."""
    own = store.select("passage_id", F.col("version_id").alias("v"), F.col("kind").alias("k"), F.lit(True).alias("known"))
    rows = hits.join(own, "passage_id", "left")
    issue = F.when(F.col("known").isNull(), "not_stored").when(~F.col("version_id").eqNullSafe(F.col("v")), "version_differs").when(~F.col("kind").eqNullSafe(F.col("k")), "kind_differs")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("query_id", "passage_id", "issue").distinct()


def enrich(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Hits with the passage's own columns. A hit whose passage isn't stored is left out here and named by
    ``missing_passages``, which must find none."""
    return hits.join(store, "passage_id")


def responses(decisions: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, action, reason, message, top_passage_id, n_public, n_diagnostic, passages (ids in order).

    An abstaining response shows no passage; diagnostic hits are counted all the same.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hybrid_rank", "passage_id"))).alias("ps"), F.count("*").alias("n_diagnostic"))
    out = decisions.join(listed, "query_id", "left")
    answer = F.col("action") == "return_results"
    ids = F.slice(F.transform(F.coalesce("ps", F.expr("array()")), lambda p: p["passage_id"]), 1, limit)
    public = F.when(answer, ids).otherwise(F.array().cast("array<string>"))
    return out.select(
        "query_id", "action", "reason", message(F.col("reason")).alias("message"), F.when(answer, F.col("top_passage_id")).alias("top_passage_id"),
        F.size(public).cast("long").alias("n_public"), F.coalesce("n_diagnostic", F.lit(0)).alias("n_diagnostic"), F.array_join(public, " ").alias("passages"),
    )


#: Words by which a query asks for front or back matter.
PARATEXT_WORDS = (
    "(?U)\\bدر\\s+مقدمه(?:\\s+(?:کتاب|اثر))?", "(?U)\\bمقدمه(?:\\s+(?:کتاب|اثر))?", "(?U)\\bدر\\s+فهرست(?:\\s+مطالب)?", "(?U)\\bفهرست(?:\\s+مطالب)?",
    "(?U)\\bدر\\s+نمایه", "(?U)\\bنمایه", "(?U)\\bدر\\s+واژه[\\u200c ]?نامه", "(?U)\\bواژه[\\u200c ]?نامه",
)
FALLBACK_QUESTION = "درباره موضوع پرسش چه آمده است؟"


#: What is removed, in this order, from a query left over from removals, and what is put in its place.
LEFTOVERS = (
    ("^در\\s+(?:دیوان|کتاب|اثر)ش\\s+", ""), ("^(?:و|یا)\\s+", ""), ("(?U)\\bدر\\s+(?=درباره\\b)", ""),
    ("\\s+([،؛؟?!.,:])", "$1"), ("\\A[ ،؛,:]+|[ ،؛,:]+\\z", ""),
)


def compact(text: Column) -> Column:
    """A query left over from removals, made readable."""
    t = squeeze(text)
    for pattern, put in LEFTOVERS:
        t = F.regexp_replace(t, pattern, put)
    return F.when(t == "", FALLBACK_QUESTION).otherwise(t)


def suggestions(queries: DataFrame, text: str, decisions: DataFrame, mentions: DataFrame, works: DataFrame, entity_versions: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """query_id, suggestion_no, kind, entity_id, query_text: at most max_suggestions per abstained query.

    Works asked for come first, else works of the authors asked for, else all works in catalog order (works: entity_id,
    label, catalog_order; a catalog of configured size).
    """
    asked = queries.select("query_id", F.col(text).alias("t")).join(decisions.where("action = 'abstain'").select("query_id", "reason"), "query_id")
    found = mentions.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("alias")).alias("l"), "alias"))).alias("al"))
    rows = asked.join(found, "query_id", "left")
    body = F.aggregate(F.coalesce("al", F.array().cast("array<struct<l:int,alias:string>>")), F.col("t"), lambda s, a: F.replace(s, a["alias"], F.lit(" ")))
    rows = rows.withColumn("body", compact(body))
    cut = F.col("body")
    for p in PARATEXT_WORDS:
        cut = F.regexp_replace(cut, p, " ")
    rows = rows.withColumn("body", F.when(F.col("reason").isin("top_hit_paratext", "top_hit_mixed"), compact(cut)).otherwise(F.col("body")))
    inside = mentions.where("in_corpus")
    direct = inside.where("kind = 'work'").select("query_id", "entity_id").withColumn("p", F.lit(1))
    by_author = inside.where("kind = 'author'").join(entity_versions, "entity_id").select("query_id", "version_id").distinct()
    of_author = by_author.join(entity_versions.join(works.select("entity_id"), "entity_id"), "version_id").select("query_id", "entity_id").distinct().withColumn("p", F.lit(2))
    wide = rows.select("query_id").join(F.broadcast(works.orderBy("catalog_order").limit(config.max_suggestions)).select("entity_id")).withColumn("p", F.lit(3))
    options = direct.unionByName(of_author).unionByName(wide)
    options = options.join(works, "entity_id")
    best = options.withColumn("b", F.min("p").over(Window.partitionBy("query_id"))).where("p = b").dropDuplicates(["query_id", "entity_id"])
    out = rows.join(best, "query_id").withColumn("query_text", F.concat(F.lit("فقط بر اساس متن اصلی "), "label", F.lit(": "), "body"))
    out = out.withColumn("dup", F.row_number().over(Window.partitionBy("query_id", "query_text").orderBy("catalog_order"))).where("dup = 1")
    out = out.withColumn("suggestion_no", F.row_number().over(Window.partitionBy("query_id").orderBy("catalog_order"))).where(F.col("suggestion_no") <= config.max_suggestions)
    kind = (
        F.when(F.col("reason") == "known_out_of_corpus_scope", "replace_out_of_scope").when(F.col("reason") == "source_attribution_conflict", "restrict_scope")
        .when(F.col("reason").isin("top_hit_paratext", "top_hit_mixed"), "search_primary_text").otherwise("scope_query")
    )
    return out.select("query_id", "suggestion_no", kind.alias("kind"), "entity_id", "query_text")
