"""Order-dependent columns of groups that may be too large for one task.

Rows are laid out in ascending blocks by range partitioning over (keys, order). What depends on rows before - the
neighbouring row, the last value so far, a running sum - is found within the blocks by windows and carried from block
to block through a table with one row per key and block. No group is ever a single task, whatever its share of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.lineage import settle

KEY, BLOCK, AT = "__key", "__block", "__at"


def blocked(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` in blocks; (keys, order) should tell its rows apart. Null keys form a group."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(KEY, F.struct(*keys)).withColumn(AT, F.struct(*order))
    return settle(rows.repartitionByRange(parts, KEY, AT).withColumn(BLOCK, F.spark_partition_id()))


def plain(df: DataFrame) -> DataFrame:
    return df.drop(KEY, BLOCK, AT)


def _carried(rows: DataFrame, per_block: list[Column], carry: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with columns that hold something of the blocks before (or after) each block of the same key."""
    sums = rows.groupBy(KEY, BLOCK).agg(*per_block)
    return rows.join(sums.select(KEY, BLOCK, *(c.alias(name) for name, c in carry)), [KEY, BLOCK])


def neighbours(rows: DataFrame, columns: list[str], before: str | None = None, after: str | None = None) -> DataFrame:
    """Adds the structs ``before`` and ``after`` of the columns of the rows next to each; null at the ends of a group."""
    own = F.struct(*columns)
    within, blocks = Window.partitionBy(KEY, BLOCK).orderBy(AT), Window.partitionBy(KEY).orderBy(BLOCK)
    out = _carried(
        rows,
        [F.max_by(own, AT).alias("last"), F.min_by(own, AT).alias("first")],
        [("__last", F.lag("last").over(blocks)), ("__first", F.lead("first").over(blocks))],
    )
    if before:
        out = out.withColumn(before, F.coalesce(F.lag(own).over(within), F.col("__last")))
    if after:
        out = out.withColumn(after, F.coalesce(F.lead(own).over(within), F.col("__first")))
    return out.drop("__last", "__first")


def running_sum(rows: DataFrame, amount: str, out: str, inclusive: bool = False) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows before each, or with it where inclusive."""
    within = Window.partitionBy(KEY, BLOCK).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(rows, [F.sum(amount).alias("s")], [("__earlier", F.coalesce(F.sum("s").over(earlier), F.lit(0)))])
    return carried.withColumn(out, F.col("__earlier") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("__earlier")


def last_so_far(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds each of ``columns``: its last value that isn't null, of the row itself or one before."""
    within = Window.partitionBy(KEY, BLOCK).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumns({f"__v{k}": c for k, c in enumerate(columns.values())})
    per = [F.max_by(f"__v{k}", F.when(F.col(f"__v{k}").isNotNull(), F.col(AT))).alias(f"l{k}") for k in range(len(columns))]
    carried = _carried(named, per, [(f"__e{k}", F.last(f"l{k}", True).over(earlier)) for k in range(len(columns))])
    out = carried.withColumns({name: F.coalesce(F.last(f"__v{k}", True).over(within), F.col(f"__e{k}")) for k, name in enumerate(columns)})
    return out.drop(*(f"__{x}{k}" for x in "ve" for k in range(len(columns))))
