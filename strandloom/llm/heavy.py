"""Most frequent values by lossy counting with guaranteed count intervals.

Each input partition keeps a bounded summary: values with a count and the most
that may have been missed before the value was (re)entered. At the end of every
bucket of 1/epsilon rows, entries whose count plus miss does not exceed the
number of buckets so far are pruned; an entry holds its count exactly from the
moment it was entered. Summaries merge by adding counts and misses; a partition
without the value adds its own largest possible miss. So for each value

    count_low <= true count <= count_high,   count_high - count_low <= epsilon * rows.

`top` settles the order: every value whose interval reaches the k-th largest lower
bound is a candidate (no true top-k value can be outside once the k-th lower bound
exceeds all that the summaries can have missed), and where intervals overlap the
candidates alone are counted exactly in a second scan. Summaries have
at most (1/epsilon) * log(epsilon * rows) entries, whatever the number of
distinct values. Null values are not counted; ties at the border go to the
smaller value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

_SUMMARY = "value bigint, n bigint, miss bigint, bucket bigint"


class LossyCounter:
    """A lossy-counting summary over int64 values, fed bucket by bucket."""

    def __init__(self, epsilon: float):
        self.width = int(np.ceil(1 / epsilon))
        self.value = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.miss = np.zeros(0, np.int64)
        self.bucket = 0
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def _bucket(self, rows: np.ndarray, prune: bool = True) -> None:
        value, n = np.unique(rows, return_counts=True)
        both = np.concatenate([self.value, value])
        keys, inv = np.unique(both, return_inverse=True)
        count = np.bincount(inv, np.concatenate([self.count, n]), len(keys)).astype(np.int64)
        miss = np.full(len(keys), self.bucket, np.int64)
        miss[inv[: len(self.value)]] = self.miss
        if prune:
            self.bucket += 1
            keep = count + miss > self.bucket
            keys, count, miss = keys[keep], count[keep], miss[keep]
        self.value, self.count, self.miss = keys, count, miss

    def add(self, rows: np.ndarray) -> None:
        self.waiting.append(rows)
        self.held += len(rows)
        if self.held >= self.width:
            rows = np.concatenate(self.waiting)
            whole = len(rows) // self.width * self.width
            for at in range(0, whole, self.width):
                self._bucket(rows[at : at + self.width])
            self.waiting, self.held = [rows[whole:]], len(rows) - whole

    def close(self) -> None:
        if self.held:
            self._bucket(np.concatenate(self.waiting), prune=False)
        self.waiting, self.held = [], 0


def _summaries(epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LossyCounter(epsilon)
        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                counter.add(column.to_numpy(zero_copy_only=False))
        counter.close()
        # the row without a value carries the miss that this partition adds for absent values
        value = pa.concat_arrays([pa.array(counter.value), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [
                value,
                pa.array(np.append(counter.count, 0)),
                pa.array(np.append(counter.miss, counter.bucket)),
                pa.array(np.full(len(value), counter.bucket)),
            ],
            names=["value", "n", "miss", "bucket"],
        )

    return run


def _summarised(values: DataFrame, epsilon: float) -> DataFrame:
    """The partitions' summaries, written once: they are bounded, the column is not, and it is read once only."""
    return materialize(values.mapInArrow(_summaries(epsilon), _SUMMARY), "summaries")[0]


def _merged(parts: DataFrame) -> DataFrame:
    merged = parts.groupBy("value").agg(
        F.sum("n").alias("count_low"), F.sum("miss").alias("miss"), F.sum("bucket").alias("covered")
    )
    # for a value absent from a partition, that partition's bucket number bounds the miss
    total = merged.filter("value is null").select(F.col("miss").alias("all_missed"))
    return (
        merged.filter("value is not null")
        .crossJoin(F.broadcast(total))  # one row
        .select("value", "count_low", (F.col("count_low") + F.col("miss") + F.col("all_missed") - F.col("covered")).alias("count_high"))
    )


def intervals(values: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """value, count_low, count_high of every value that may occur more than
    epsilon * rows times. `values` has one BIGINT column."""
    return _merged(_summarised(values, epsilon))


#: Summaries of at most about this many entries; beyond it `top` counts exactly.
FINEST = 4e-7


def top(values: DataFrame, k: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """The k most frequent values: value, count_low, count_high (guaranteed), n (exact, where the intervals alone did
    not settle the order), place (1 = most).

    A value that every summary pruned may occur as often as the summaries can have missed; while the k-th lower bound
    does not exceed that, the pass is repeated with a finer epsilon, and at last with an exact aggregation."""
    spark = values.sparkSession
    schema = "value bigint, count_low bigint, count_high bigint, n bigint, place int"
    name = values.columns[0]
    best, missed = [], 0
    while epsilon >= FINEST:
        parts = _summarised(values, epsilon)
        missed = parts.filter("value is null").agg(F.coalesce(F.sum("miss"), F.lit(0))).first()[0]
        found, _ = materialize(_merged(parts), "intervals")
        # a top-k report and its rivals: bounded by the summary, not by the data
        best = found.orderBy(F.desc("count_low"), "value").limit(k).collect()
        if not missed or (len(best) == k and best[-1]["count_low"] > missed):
            break
        epsilon /= 16
    else:
        counts = values.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        rows = [(r[name], r["n"], r["n"], r["n"]) for r in counts.orderBy(F.desc("n"), name).limit(k).collect()]
        return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], schema)
    if not best:
        return spark.createDataFrame([], schema)
    least = best[-1]["count_low"] if len(best) == k else 0
    near = found.filter(F.col("count_high") >= least)
    rows = [(r["value"], r["count_low"], r["count_high"], None) for r in best]
    if near.limit(k + 1).count() > k or any(a[1] <= b[2] for a, b in zip(rows, rows[1:], strict=False)):
        own = values.select(F.col(name).alias("value"))
        exact = own.join(near.select("value"), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        both = exact.join(near, "value").orderBy(F.desc("n"), "value").limit(k)
        rows = [(r["value"], r["count_low"], r["count_high"], r["n"]) for r in both.collect()]
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], schema)
