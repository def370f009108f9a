"""Evidence about a query's results: rank features, scope mentions and content roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.normalize import normalize_scope


def rank_features(hybrid: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """One row per query of any ranking: hit counts, top ids and scores, margins, overlap of the two rankings at 10
    and 100, and whether both support the top hit. Margins are null with fewer than two hits."""
    at = _at
    h = _hybrid_features(hybrid)
    x = lexical.groupBy("query_id").agg(F.count("*").alias("lexical_hits"))
    d = dense.groupBy("query_id").agg(
        F.count("*").alias("dense_hits"), F.round(at("dense_rank", 1, "dense_cosine_score"), 6).alias("dense_top_1"),
        F.round(at("dense_rank", 1, "dense_cosine_score") - at("dense_rank", 2, "dense_cosine_score"), 6).alias("dense_margin"),
    )
    both = lexical.select("query_id", "passage_id", "lexical_rank").join(dense.select("query_id", "passage_id", "dense_rank"), ["query_id", "passage_id"])
    worst = F.greatest("lexical_rank", "dense_rank")
    o = both.groupBy("query_id").agg(*(F.sum(F.when(worst <= k, 1).otherwise(0)).alias(f"overlap_at_{k}") for k in (10, 100)))
    return _whole(h.join(x, "query_id", "full_outer").join(d, "query_id", "full_outer").join(o, "query_id", "left"))


def list_features(hybrid: DataFrame, lists: DataFrame) -> DataFrame:
    """``rank_features`` of rankings that come as one row per query: query_id, lexical and dense (ids in order) and dense_scores."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    score = lambda k: F.round(F.get("dense_scores", F.lit(k)), 6)
    shared = lambda k: F.coalesce(F.size(F.array_intersect(F.slice("lexical", 1, k), F.slice("dense", 1, k))), F.lit(0)).cast("long")
    own = lists.select(
        "query_id", size("lexical").alias("lexical_hits"), size("dense").alias("dense_hits"), score(0).alias("dense_top_1"), F.round(score(0) - score(1), 6).alias("dense_margin"),
        *(shared(k).alias(f"overlap_at_{k}") for k in (10, 100)),
    )
    return _whole(_hybrid_features(hybrid).join(own, "query_id", "full_outer"))


def _at(rank: str, k: int, c: str) -> Column:
    return F.max(F.when(F.col(rank) == k, F.col(c)))


def _hybrid_features(hybrid: DataFrame) -> DataFrame:
    return hybrid.groupBy("query_id").agg(
        F.count("*").alias("hybrid_hits"), _at("hybrid_rank", 1, "passage_id").alias("top_passage_id"),
        F.round(_at("hybrid_rank", 1, "fusion_score") - _at("hybrid_rank", 2, "fusion_score"), 6).alias("fusion_margin"),
        F.max(F.when((F.col("hybrid_rank") == 1) & F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull(), 1).otherwise(0)).alias("dual_support"),
    )


def _whole(out: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("hybrid_hits", "lexical_hits", "dense_hits", "overlap_at_10", "overlap_at_100", "dual_support")}
    return out.withColumns(zero)


def scope_mentions(queries: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """query_id, entity_id, kind, in_corpus, alias: the longest alias of each entity that a query holds as whole words.

    aliases: entity_id, kind, in_corpus, alias (a catalog of configured size). Aliases are found by their first word:
    words of the query are joined to it, so no query meets every alias.
    """
    named = aliases.select("entity_id", "kind", "in_corpus", "alias", normalize_scope("alias").alias("n")).where("n <> ''")
    named = named.withColumn("first", F.split("n", " ")[0])
    q = queries.select("query_id", normalize_scope(text).alias("q"))
    words = q.select("query_id", "q", F.explode(F.array_distinct(F.split("q", " "))).alias("first"))
    hit = words.join(named, "first").where(F.contains(F.concat(F.lit(" "), "q", F.lit(" ")), F.concat(F.lit(" "), "n", F.lit(" "))))
    order = Window.partitionBy("query_id", "entity_id").orderBy(F.desc(F.size(F.split("n", " "))), F.desc(F.length("n")), "n", "alias")
    best = hit.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.select("query_id", "entity_id", "kind", "in_corpus", "alias")


def scope_evidence(queries: DataFrame, mentions: DataFrame, entity_versions: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """Per query: whether scope is mentioned, in or out of the corpus; requested versions (those of works, where any
    is mentioned, else of authors); how many of the first hits match; and whether the top hit conflicts.

    hits: query_id, hybrid_rank, version_id. entity_versions: entity_id, version_id.
    """
    flags = mentions.groupBy("query_id").agg(
        F.max("in_corpus").alias("in_corpus_mentioned"), F.max(~F.col("in_corpus")).alias("out_of_corpus_mentioned"),
        F.max((F.col("kind") == "work") & F.col("in_corpus")).alias("has_work"),
    )
    inside = mentions.where("in_corpus").join(flags.select("query_id", "has_work"), "query_id").where("kind = 'work' OR NOT has_work")
    wanted = inside.join(entity_versions, "entity_id").select("query_id", "version_id").distinct()
    n_wanted = wanted.groupBy("query_id").agg(F.count("*").alias("n_requested"))
    first = hits.where(F.col("hybrid_rank") <= depth).select("query_id", "hybrid_rank", "version_id")
    marked = first.join(wanted.withColumn("match", F.lit(1)), ["query_id", "version_id"], "left")
    per = marked.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.coalesce(F.sum("match"), F.lit(0)).alias("n_match"),
        F.max(F.when(F.col("hybrid_rank") == 1, F.coalesce("match", F.lit(0)))).alias("top_match"),
    )
    out = queries.select("query_id").distinct().join(flags.drop("has_work"), "query_id", "left").join(n_wanted, "query_id", "left").join(per, "query_id", "left")
    asked = F.coalesce("n_requested", F.lit(0)) > 0
    return out.select(
        "query_id", F.coalesce("in_corpus_mentioned", F.lit(False)).alias("in_corpus_mentioned"), F.coalesce("out_of_corpus_mentioned", F.lit(False)).alias("out_of_corpus_mentioned"),
        F.coalesce("n_requested", F.lit(0)).alias("n_requested"), F.when(asked, F.coalesce("n_match", F.lit(0))).otherwise(0).cast("long").alias("matching_hits"),
        F.when(asked, F.round(F.coalesce(F.col("n_match") / F.col("n_hits"), F.lit(0.0)), 6)).alias("matching_rate"),
        F.coalesce(asked & (F.col("top_match") == 0), F.lit(False)).alias("source_conflict"),
    )


def content_roles(hits: DataFrame, zones: DataFrame) -> DataFrame:
    """Hits (query_id, hybrid_rank, passage_id, version_id) with ordinal and role: that of the zone which holds the
    ordinal of the passage id, unknown for versions without zones, outside for ordinals beyond a version's zones."""
    ordinal = F.regexp_extract("passage_id", "^(.+):passage_([0-9]+)$", 2)
    rows = hits.withColumn("ordinal", F.when(ordinal != "", ordinal.cast("int")))
    z = zones.select(F.col("version_id").alias("zv"), "start_ordinal", "end_ordinal", "role")
    known = zones.select(F.col("version_id").alias("kv")).distinct()
    inside = (F.col("version_id") == F.col("zv")) & F.col("ordinal").between(F.col("start_ordinal"), F.col("end_ordinal"))
    joined = rows.join(z, inside, "left").join(known, F.col("version_id") == F.col("kv"), "left")
    role = F.when(F.col("kv").isNull(), "unknown").otherwise(F.coalesce("role", F.lit("outside")))
    return joined.select("query_id", "hybrid_rank", "passage_id", "version_id", "ordinal", role.alias("role"))


def role_evidence(roles: DataFrame, depth: int = 10) -> DataFrame:
    """Per query: hits of each role among the first, and whether the top hit is paratext or mixed."""
    first = roles.where(F.col("hybrid_rank") <= depth)
    count = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0)).alias(f"n_{r}")
    top = lambda r: F.coalesce(F.max((F.col("hybrid_rank") == 1) & (F.col("role") == r)), F.lit(False)).alias(f"top_is_{r}")
    return first.groupBy("query_id").agg(F.count("*").alias("n_hits"), *map(count, ("authorial", "paratext", "mixed", "unknown")), top("paratext"), top("mixed"))


def zone_violations(zones: DataFrame) -> DataFrame:
    """version_id, start_ordinal, issue: zones that don't begin at 1, don't follow the one before, or end early."""
    w = Window.partitionBy("version_id").orderBy("start_ordinal")
    rows = zones.withColumn("before", F.lag("end_ordinal").over(w)).withColumn("after", F.lead("start_ordinal").over(w))
    issue = (
        F.when(F.col("end_ordinal") < F.col("start_ordinal"), "reversed")
        .when(F.col("before").isNull() & (F.col("start_ordinal") != 1), "starts_late")
        .when(F.col("before") + 1 != F.col("start_ordinal"), "gap_or_overlap")
        .when(F.col("after").isNull() & (F.col("end_ordinal") != F.col("expected_passage_count")), "ends_elsewhere")
    )
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("version_id", "start_ordinal", "issue")
