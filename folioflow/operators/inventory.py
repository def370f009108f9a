"""What characters a corpus holds: code points, digits by script, examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import arrowtext as at


def code_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, code_point and n over all texts; every batch hands on its sums alone."""
    schema = T.StructType([df.schema[key], T.StructField("code_point", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, [text]):
                cp, off = at.decode(part.column(1))
                names = part.column(0).dictionary_encode(null_encoding="encode")
                code = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(off))
                both, n = np.unique(code * 0x110000 + cp, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array(both // 0x110000)), pa.array((both % 0x110000).astype(np.int32)), pa.array(n.astype(np.int64))], names=schema.names
                )

    return df.select(key, text).mapInArrow(run, schema).groupBy(key, "code_point").agg(F.sum("n").alias("n"))


def digit_examples(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, kind (ascii, arabic, persian, mixed), place, found, n: the ``limit`` most frequent numbers of each kind."""
    found = df.select(key, F.explode(F.regexp_extract_all(text, F.lit("[0-9٠-٩۰-۹]+"), F.lit(0))).alias("found")).groupBy(key, "found").agg(F.count("*").alias("n"))
    only = lambda digits: F.rlike("found", F.lit(f"^[{digits}]+$"))
    kind = F.when(only("0-9"), "ascii").when(only("٠-٩"), "arabic").when(only("۰-۹"), "persian").otherwise("mixed")
    order = Window.partitionBy(key, "kind").orderBy(F.desc("n"), "found")
    ranked = found.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return ranked.select(key, "kind", "place", "found", "n")
