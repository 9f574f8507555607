"""Running totals and dense numbering over a whole table, without one big window.

A window without partitions pulls the table into one task. Here rows are range
partitioned by the order once, each partition is summed, the sums of the earlier
partitions (one row a partition) are joined back, and the running total is taken
inside each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_partitions


def _ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows range partitioned by the order, with their partition's number, written once."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(c) for c in by], *order)
    return materialize(ranged.withColumn("__part", F.spark_partition_id()), "ordered")[0]


def running_last(df: DataFrame, value: Column, order: Sequence[str | Column], name: str) -> DataFrame:
    """`df` with the last value that is not null so far in the given order (the row's own included)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = _ranged(df.withColumn("__v", value), order, ())
    ends = kept.groupBy("__part").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__s"))
    before = ends.withColumn("__before", F.last("__s", True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))  # one row a partition
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = kept.join(before.drop("__s"), "__part")
    return out.withColumn(name, F.coalesce(F.last("__v", True).over(inside), "__before")).drop("__v", "__part", "__before")


def lagged(df: DataFrame, value: Column, order: Sequence[str | Column], name: str) -> DataFrame:
    """`df` with `value` of the row before in the given order, null for the first row."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = _ranged(df.withColumn("__v", F.struct(value.alias("v"))), order, ())
    inside = W.partitionBy("__part").orderBy(*order)
    at = kept.withColumn("__i", F.row_number().over(inside)).withColumn("__p", F.lag("__v").over(inside))
    last = at.groupBy("__part").agg(F.max_by("__v", "__i").alias("__s"))
    before = last.select("__part", F.lag("__s").over(W.orderBy("__part")).alias("__before"))  # one row a partition
    out = at.join(before, "__part")
    return out.withColumn(name, F.coalesce("__p", "__before")["v"]).drop("__v", "__part", "__i", "__p", "__before")


def running_total(df: DataFrame, value: Column, order: Sequence[str | Column], name: str = "total", by: Sequence[str] = ()) -> DataFrame:
    """`df` with the inclusive running total of `value` in the given order, for each `by` group.

    `order` must break ties; nulls in `value` count as nought."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = _ranged(df.withColumn("__v", F.coalesce(value, F.lit(0))), order, by)
    sums = kept.groupBy(*by, "__part").agg(F.sum("__v").alias("__s"))
    before = sums.withColumn("__before", F.sum("__s").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__s"))
    inside = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = kept.join(before.drop("__s"), [*by, "__part"]) if not by else kept.alias("k").join(
        before.drop("__s").alias("b"), [F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__part"]]
    ).select("k.*", "b.__before")
    return out.withColumn(name, F.sum("__v").over(inside) + F.col("__before")).drop("__v", "__part", "__before")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """Dense numbers from 1 in the given order (id compaction)."""
    return running_total(df, F.lit(1).cast("bigint"), order, name)
