"""The passage store: lookups by id and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import ordered


def get_many(store: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows of the wanted ids, each once, with the place at which it was first asked for; unknown ids are left out."""
    first = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("asked_at"))
    return first.join(store, key)


def missing(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(store, key, "left_anti")


def ordinal_report(store: DataFrame) -> DataFrame:
    """Per version: passages, least and greatest ordinal, ordinals used twice, ordinals left out."""
    per = store.groupBy("version_id").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("n_ordinals"), F.min("ordinal").alias("least"), F.max("ordinal").alias("greatest"))
    return per.select("version_id", "n", "least", "greatest", (F.col("n") - F.col("n_ordinals")).alias("n_repeated"), (F.col("greatest") - F.col("n_ordinals")).cast("long").alias("n_left_out"))


def link_issues(store: DataFrame) -> DataFrame:
    """passage_id, issue: stored neighbours that aren't the passages before and after in the version."""
    own = store.select("version_id", "ordinal", "passage_id", "previous_passage_id", "next_passage_id")
    rows = ordered.neighbours(ordered.blocked(own, ["version_id"], ["ordinal"]), ["passage_id"], "__p", "__n")
    rows = rows.withColumn("p", F.col("__p.passage_id")).withColumn("n", F.col("__n.passage_id"))
    wrong = lambda a, b, name: F.when(F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b)), F.lit(name))
    issues = F.array_compact(F.array(wrong("previous_passage_id", "p", "previous"), wrong("next_passage_id", "n", "next")))
    return rows.select("passage_id", F.explode(issues).alias("issue"))


def stale_counts(store: DataFrame, actual, column: str = "word_count") -> DataFrame:
    """passage_id, stored, actual where a stored count is missing or wrong."""
    rows = store.select("passage_id", F.col(column).cast("long").alias("stored"), actual.cast("long").alias("actual"))
    return rows.where(~F.col("stored").eqNullSafe(F.col("actual")))
