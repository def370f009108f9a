"""Weighted reciprocal-rank fusion of a lexical and a dense ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import FusionConfig


def fuse(lexical: DataFrame, dense: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """query_id, hybrid_rank, passage_id, fusion_score, lexical_rank, dense_rank.

    lexical and dense: query_id, passage_id and lexical_rank or dense_rank; ranks beyond candidate_limit don't count.
    Equal scores go by lexical rank, dense rank (missing last) and id. A query with one ranking only is ranked by it.
    """
    a = lexical.where(F.col("lexical_rank") <= config.candidate_limit).select("query_id", "passage_id", "lexical_rank")
    b = dense.where(F.col("dense_rank") <= config.candidate_limit).select("query_id", "passage_id", "dense_rank")
    both = a.join(b, ["query_id", "passage_id"], "full_outer")
    return scored(both, config)


def score(lexical_rank: Column | str, dense_rank: Column | str, config: FusionConfig = FusionConfig()) -> Column:
    """What the ranks of a hit give; a missing rank gives nothing."""
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(config.rrf_constant) + r), F.lit(0.0))
    named = [F.col(r) if isinstance(r, str) else r for r in (lexical_rank, dense_rank)]
    return part(config.lexical_weight, named[0]) + part(config.dense_weight, named[1])


def scored(both: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """As ``fuse``, of rows that hold both ranks of a hit."""
    rows = both.withColumn("score", score("lexical_rank", "dense_rank", config))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"), "passage_id")
    ranked = rows.withColumn("hybrid_rank", F.row_number().over(order)).where(F.col("hybrid_rank") <= config.limit)
    return ranked.select("query_id", "hybrid_rank", "passage_id", F.round("score", 9).alias("fusion_score"), "lexical_rank", "dense_rank")


def integrity(hits: DataFrame) -> DataFrame:
    """query_id, passage_id, issue: a passage twice in one ranking, a rank below 1 or twice in one ranking."""
    twice = hits.groupBy("query_id", "passage_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", "passage_id", F.lit("repeated_passage").alias("issue"))
    out = twice
    for rank in ("lexical_rank", "dense_rank"):
        w = Window.partitionBy("query_id", rank)
        same = hits.where(F.col(rank).isNotNull()).withColumn("n", F.count("*").over(w)).where("n > 1")
        out = out.unionByName(same.select("query_id", "passage_id", F.lit(f"repeated_{rank}").alias("issue")))
        low = hits.where(F.col(rank) < 1).select("query_id", "passage_id", F.lit(f"invalid_{rank}").alias("issue"))
        out = out.unionByName(low)
    return out
