"""Retrieval evaluation: recall, reciprocal rank, nDCG, negative hits, latency and answerability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10)


def relevance(queries: DataFrame) -> DataFrame:
    """query_id, passage_id, grade of all judgments; of several grades of a passage the highest counts."""
    rows = queries.select("query_id", F.explode("judgments").alias("j")).select("query_id", "j.passage_id", "j.grade")
    return rows.where("passage_id IS NOT NULL").groupBy("query_id", "passage_id").agg(F.max("grade").alias("grade"))


def query_metrics(queries: DataFrame, rankings: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """query_id, k, answerable, recall, reciprocal_rank, ndcg, negative_hit for every query that counts and cutoff.

    queries: query_id, query_type, judgments, include_in_metrics; rankings: query_id, passage_id, rank (1-based).
    Queries out of the corpus have no recall, rank or gain; without judgments these are 0.
    """
    cutoffs = tuple(sorted(set(cutoffs)))
    if not cutoffs or cutoffs[0] < 1:
        raise ValueError("cutoffs must be positive")
    base = queries.where("include_in_metrics").groupBy("query_id").agg(F.first("query_type").alias("query_type"))
    base = base.select("query_id", (F.col("query_type") != "out_of_corpus").alias("answerable"))
    rel = relevance(queries)
    hit = rel.join(rankings, ["query_id", "passage_id"], "left").groupBy("query_id", "passage_id", "grade").agg(F.min("rank").alias("rank"))
    hit = hit.withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "passage_id")))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    per = []
    for k in cutoffs:
        within = F.col("rank") <= k
        per += [
            F.sum(F.when(within, 1).otherwise(0)).alias(f"hits_{k}"),
            F.min(F.when(within, F.col("rank"))).alias(f"first_{k}"),
            F.sum(F.when(within, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias(f"best_{k}"),
        ]
    judged = hit.groupBy("query_id").agg(F.count("*").alias("n_judged"), *per)
    shown = rankings.groupBy("query_id").agg(F.min("rank").alias("first_shown"))
    wide = base.join(judged, "query_id", "left").join(shown, "query_id", "left")
    parts = [
        F.struct(
            F.lit(k).alias("k"),
            F.coalesce(F.col(f"hits_{k}") / F.col("n_judged"), F.lit(0.0)).alias("recall"),
            F.coalesce(F.lit(1.0) / F.col(f"first_{k}"), F.lit(0.0)).alias("rr"),
            F.coalesce(F.col(f"dcg_{k}") / F.when(F.col(f"best_{k}") > 0, F.col(f"best_{k}")), F.lit(0.0)).alias("ndcg"),
            F.coalesce(F.col("first_shown") <= k, F.lit(False)).alias("shown"),
        )
        for k in cutoffs
    ]
    rows = wide.select("query_id", "answerable", F.explode(F.array(*parts)).alias("m"))
    answer = F.col("answerable")
    pick = lambda c: F.when(answer, F.round(F.col(f"m.{c}"), 6))
    return rows.select(
        "query_id", F.col("m.k").alias("k"), "answerable", pick("recall").alias("recall"), pick("rr").alias("reciprocal_rank"), pick("ndcg").alias("ndcg"),
        F.when(~answer, F.col("m.shown").cast("int")).alias("negative_hit"),
    )


def aggregate(metrics: DataFrame) -> DataFrame:
    """k, n_answerable, n_out_of_corpus and the means over queries."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.groupBy("k").agg(
        F.sum(F.when(F.col("answerable"), 1).otherwise(0)).alias("n_answerable"), F.sum(F.when(~F.col("answerable"), 1).otherwise(0)).alias("n_out_of_corpus"),
        mean("recall").alias("mean_recall"), mean("reciprocal_rank").alias("mean_reciprocal_rank"), mean("ndcg").alias("mean_ndcg"), mean("negative_hit").alias("negative_hit_rate"),
    )


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile and maximum per group."""
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"),
        F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})"), 6).alias("p95"), F.round(F.max(value), 6).alias("most"),
    )


def ranking_issues(queries: DataFrame, rankings: DataFrame) -> DataFrame:
    """query_id, issue: counted queries without a ranking, passages ranked twice, rankings of unknown queries."""
    counted = queries.where("include_in_metrics").select("query_id").distinct()
    ranked = rankings.select("query_id").distinct()
    missing = counted.join(ranked, "query_id", "left_anti").withColumn("issue", F.lit("missing_ranking"))
    unknown = ranked.join(queries.select("query_id").distinct(), "query_id", "left_anti").withColumn("issue", F.lit("unknown_query"))
    twice = rankings.groupBy("query_id", "passage_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id").distinct().withColumn("issue", F.lit("repeated_passage"))
    return missing.unionByName(unknown).unionByName(twice)


def answerability(queries: DataFrame, decisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: retained and rejected queries, false decisions, accuracy, coverage, precision, end-to-end accuracy@k."""
    base = queries.where("include_in_metrics").groupBy("query_id").agg(F.first("query_type").alias("t"))
    hit = metrics.groupBy("query_id").pivot("k", [1, 5, 10]).agg(F.max("recall"))
    d = decisions.select("query_id", (F.col("action") == "return_results").alias("answered"))
    rows = base.join(d, "query_id").join(hit, "query_id", "left").withColumn("ok", F.col("t") != "out_of_corpus")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, ok = F.col("answered"), F.col("ok")
    right = lambda k: F.round((n(~ok & ~a) + n(ok & a & (F.col(str(k)) > 0))) / F.count("*"), 6)
    return rows.agg(
        F.count("*").alias("n_queries"), n(ok).alias("n_answerable"), n(ok & a).alias("retained"), n(~ok & ~a).alias("rejected"), n(ok & ~a).alias("false_abstentions"),
        n(~ok & a).alias("false_acceptances"), F.round((n(ok & a) + n(~ok & ~a)) / F.count("*"), 6).alias("accuracy"), F.round(n(a) / F.count("*"), 6).alias("coverage"),
        F.round(n(ok & a) / F.when(n(a) > 0, n(a)), 6).alias("precision"), right(1).alias("end_to_end_1"), right(5).alias("end_to_end_5"), right(10).alias("end_to_end_10"),
    )
