"""Queries of the training-text operators over whole tables. Each takes (spark, directory of parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.lineage import spread
from folioflow.llm import abuse, canonical, chunking, language, leaks, mixing, overlap, rankwalk, scans, sentences


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table, its rows dealt out over the cores where it comes in fewer parts (as a small file does)."""
    return spread(spark.read.parquet(f"{at}/{name}.parquet"))


VERSE = ("diwan", "mathnawi")
SCORES = [("lexical_rank", False), ("dense_rank", False), ("fusion_score", True)]
TEXTS = ["display_text", "retrieval_text", "search_alias_text"]


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return language.unlabelled_languages(table(spark, at, "passages"), table(spark, at, "passage_labels"))


def p1_segments(spark: SparkSession, at: str) -> DataFrame:
    config = language.LanguageConfig()
    passages, labels = table(spark, at, "passages"), table(spark, at, "passage_labels")
    network = language.fit(language.labelled_sample(passages, labels, config), config)
    verse = F.col("kind").isin(*VERSE)
    return language.language_segments(passages, "passage_id", "display_text", verse, network, config)


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, at, "passages"), "passage_id", "display_text", TEXTS)


def p2_unified(spark: SparkSession, at: str) -> DataFrame:
    return canonical.unify_text(table(spark, at, "passages"), ["passage_id"], TEXTS)


def p2_look_classes(spark: SparkSession, at: str) -> DataFrame:
    return canonical.look_links(table(spark, at, "passages"), "passage_id", "display_text", TEXTS)


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return chunking.oversized(table(spark, at, "passages"), "passage_id", "display_text")


def p3_pieces(spark: SparkSession, at: str) -> DataFrame:
    return chunking.chunk(table(spark, at, "passages"), "passage_id", "display_text")


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return scans.noises(table(spark, at, "passages"), "passage_id", "display_text", "version_id", "profile")


def p4_repaired(spark: SparkSession, at: str) -> DataFrame:
    config = scans.ScanConfig()
    scanned = table(spark, at, "passages").where(F.col("profile").isin(*config.profiles))
    channel = scans.fit(scanned.where("display_text IS NOT NULL"), "display_text", "version_id", config)
    return scans.repaired(scanned, "passage_id", "display_text", "version_id", channel)


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    pairs = overlap.overlapping_pairs(table(spark, at, "retrieval_answerability_v1"), table(spark, at, "retrieval_answerability_split_v1"))
    return pairs.select("query_id_a", "query_id_b")


def p5_overlap_classes(spark: SparkSession, at: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, at, "retrieval_answerability_v1"), table(spark, at, "retrieval_answerability_split_v1"))


def p5_overlap_report(spark: SparkSession, at: str) -> DataFrame:
    return overlap.overlap_report(table(spark, at, "retrieval_answerability_v1"), table(spark, at, "retrieval_answerability_split_v1"))


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return rankwalk.first_places(table(spark, at, "retrieved_passages"), "query_id", "passage_id", SCORES)


def p6_ranking(spark: SparkSession, at: str) -> DataFrame:
    return rankwalk.rank_walk(table(spark, at, "retrieved_passages"), "query_id", "passage_id", SCORES)


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    passages = table(spark, at, "passages").select("passage_id", "display_text", "kind")
    verse = F.col("kind").isin(*VERSE)
    model = sentences.boundary_model(passages, "passage_id", "display_text", ~verse)
    asked = table(spark, at, "sentence_review").select("passage_id").distinct()
    cut = sentences.sentences(passages.join(asked, "passage_id", "left_semi"), "passage_id", "display_text", verse, model)
    return cut.select("passage_id", "end_char").distinct()


def p7_sentences(spark: SparkSession, at: str) -> DataFrame:
    """Sentence units of display_text and retrieval_text of every passage."""
    passages = table(spark, at, "passages").select("passage_id", "display_text", "retrieval_text", "kind")
    verse = F.col("kind").isin(*VERSE)
    model = sentences.boundary_model(passages, "passage_id", "display_text", ~verse)
    shown = sentences.sentences(passages, "passage_id", "display_text", verse, model, with_text=True)
    searched = sentences.sentences(passages, "passage_id", "retrieval_text", F.lit(False), model, with_text=True)
    return shown.withColumn("field", F.lit("display_text")).unionByName(searched.withColumn("field", F.lit("retrieval_text")))


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    found = leaks.leaks(table(spark, at, "documents"), "doc_id", "text", table(spark, at, "heldout_items"), "item_id", "text")
    # The alignment allows for edits; what is asked for here is an unbroken run.
    return found.where("2 * words >= item_words").select("item_id", "doc_id").distinct()


def p8_leaked_items(spark: SparkSession, at: str) -> DataFrame:
    """Per held-out split and item: documents that hold at least half of it, edits allowed for, the largest share of its
    words in one run, and how many documents hold that much without an edit."""
    items = table(spark, at, "heldout_items")
    found = leaks.leaks(table(spark, at, "documents"), "doc_id", "text", items, "item_id", "text")
    per = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max(F.round(F.col("aligned_words") / F.col("item_words"), 6)).alias("largest_share"), F.countDistinct(F.when(F.expr("2 * words >= item_words"), F.col("doc_id"))).alias("n_unbroken"))
    out = items.select("item_id", "split").join(per, "item_id", "left")
    return out.select("item_id", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_unbroken", F.lit(0)).alias("n_unbroken"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))


def p9_mix_report(spark: SparkSession, at: str) -> DataFrame:
    return mixing.mix(table(spark, at, "documents"), "doc_id", "text", "source", table(spark, at, "mix_targets")).report


def p9_mix_selection(spark: SparkSession, at: str) -> DataFrame:
    return mixing.mix(table(spark, at, "documents"), "doc_id", "text", "source", table(spark, at, "mix_targets")).selection


def p9_mix_audit(spark: SparkSession, at: str) -> DataFrame:
    """What the selection breaks, recomputed from it, the documents and the targets by itself: documents used too often
    or under a source that isn't theirs, sources above their quota by more than a document. No row is right."""
    documents, targets = table(spark, at, "documents"), table(spark, at, "mix_targets")
    config = mixing.MixConfig()
    chosen = mixing.mix(documents, "doc_id", "text", "source", targets, config).selection
    counted = mixing.token_counts(documents.withColumn("own", mixing.normal_source(F.col("source"))), ["doc_id", "own"], "text", config).distinct()
    caps = targets.groupBy(mixing.normal_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    per = chosen.groupBy("doc_id", "source").agg(F.sum("uses").alias("uses"), F.max("n_tokens").alias("n_tokens")).join(F.broadcast(caps), "source", "left")
    often = per.where("cap IS NULL OR uses > cap").select("source", F.col("doc_id").cast("string").alias("doc_id"), F.lit("used_too_often").alias("issue"))
    strange = per.join(counted.select("doc_id", F.col("own").alias("source"), "n_tokens"), ["doc_id", "source", "n_tokens"], "left_anti")
    strange = strange.select("source", F.col("doc_id").cast("string").alias("doc_id"), F.lit("not_its_source").alias("issue"))
    total = counted.agg(F.sum("n_tokens").alias("total"))
    reached = per.groupBy("source", "share").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed"), F.max("n_tokens").alias("largest")).join(F.broadcast(total))
    above = reached.where("mixed > share * total + 2 * largest").select("source", F.lit(None).cast("string").alias("doc_id"), F.lit("above_its_quota").alias("issue"))
    return often.unionByName(strange).unionByName(above)


def _lexicon(spark: SparkSession, at: str) -> abuse.Lexicon:
    return abuse.learned_lexicon(table(spark, at, "documents"), "doc_id", "text", table(spark, at, "review_labels"))


def p10_found(spark: SparkSession, at: str) -> DataFrame:
    return abuse.flagged(table(spark, at, "documents"), "doc_id", "text", _lexicon(spark, at))


def p10_scores(spark: SparkSession, at: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, at, "documents"), "doc_id", "text", _lexicon(spark, at))


def p10_source_rates(spark: SparkSession, at: str) -> DataFrame:
    return abuse.source_rates(table(spark, at, "documents"), "doc_id", "text", "source", _lexicon(spark, at))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


#: SQL of the queries that DuckDB can answer by itself: sizes, and the first place by the sum of ranks, at which the walk
#: arrives too.
WHITE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ORACLES = {
    "p3_found": f"SELECT DISTINCT passage_id FROM passages WHERE length(display_text) > 2000 OR len(regexp_extract_all(display_text, '[^{WHITE}]+')) > 300",
    "p6_found": """WITH b AS (SELECT query_id, passage_id, -min(lexical_rank) AS l, -min(dense_rank) AS d, max(fusion_score) AS f FROM retrieved_passages GROUP BY query_id, passage_id),
      s AS (SELECT query_id, passage_id, sum(r) AS ahead FROM (SELECT query_id, passage_id, rank() OVER (PARTITION BY query_id ORDER BY l DESC NULLS LAST) AS r FROM b
        UNION ALL SELECT query_id, passage_id, rank() OVER (PARTITION BY query_id ORDER BY d DESC NULLS LAST) FROM b UNION ALL SELECT query_id, passage_id, rank() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST) FROM b) GROUP BY query_id, passage_id)
      SELECT query_id, passage_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ahead, passage_id) = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
