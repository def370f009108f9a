"""Incremental ingest: new passages feed the index, events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.lexical import build_index


def stream_passages(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of passage files as they arrive in a folder."""
    return spark.readStream.schema(like.schema).parquet(folder)


def ingest_postings(stream: DataFrame, key: str, text: str, out: str, checkpoint: str):
    """Appends the postings of every micro-batch under ``out``; a batch written twice replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        build_index(batch, key, text).postings.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_totals(spark: SparkSession, out: str) -> DataFrame:
    """Document and collection frequency of every term over all ingested batches."""
    return spark.read.parquet(out).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("cf"))


def event_windows(events: DataFrame, time: str, kind: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per tumbling window and kind; rows later than the watermark are left out when streaming."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    w = held.groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: start, end of the last event plus the gap, events."""
    held = events.withWatermark(time, "1 hour") if events.isStreaming else events
    s = held.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
