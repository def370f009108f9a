"""Cutting lineage through the shared checkpoint folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame


def shared_folder(context: SparkContext) -> str:
    """The folder that all executors share: the one set on the context, else the one named in spark.checkpoint.dir.

    Where neither is set, a process of its own (master local, as in tests) gets a temporary folder, removed at its
    end; on a cluster that is refused, since every machine would write to a disk of its own.
    """
    held = context.getCheckpointDir()
    if held:
        return held
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there; survives lost executors.

    Spark removes what was written once nothing refers to it if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; a table of one small file comes in one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
