"""Filling containers of fixed capacity with items, splitting only oversized ones.

Method: large-item matching. Item sizes are integers from 1 to the capacity, so
the histogram of sizes, at most `capacity` numbers, holds everything the packing
needs. On it, whole runs of equal bins are packed at once:

1. items above a third of the capacity go at most two to a bin: each size, largest
   first, is matched greedily with the largest partner that still fits;
2. smaller items, largest first, go to the smallest gap that takes them;
3. what is left opens bins of its own.

Every step ends a size or a run of bins, so the plan is a short list of
assignments (size, ranks from-to, first bin). Records get their rank among the
records of their size from counts per partition and are joined with the plan on
(size, block of ranks), so neither a size that most records have nor the plan's
length matters, and nothing is broadcast by force.

An item above the capacity is cut into full containers and a rest, which is packed
as any item (its pieces are numbered). Empty and null texts have no tokens and are
given no container (container null, piece 0); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096

_ENCODERS: dict = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The tokenizer, once for each worker process."""
    if (folder, name) not in _ENCODERS:
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[folder, name] = tiktoken.Encoding("rank-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[folder, name]


def _token_counts(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for batch in batches:
            counts = [0 if x is None else len(encode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["item", "tokens"])

    return run


def token_counts(texts: DataFrame, item: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """item, tokens for each row."""
    rows = texts.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(_token_counts(folder, name), "item bigint, tokens bigint")


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Assignments (size, first rank, end rank, first bin, items a bin) and the number of bins."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def take(size: int, count: int, first_bin: int, each: int = 1) -> None:
        out.append((size, used[size], used[size] + count, first_bin, each))
        used[size] += count
        left[size] -= count

    def opened(gap: int, first: int, count: int) -> None:
        if gap > 0 and count:
            gaps.setdefault(gap, []).append((first, count))

    # large items: at most two to a bin, largest first, each with the largest partner that fits
    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            at = bisect.bisect_right(large, capacity - s) - 1
            while at >= 0 and not (left[large[at]] - (large[at] == s) > 0):
                at -= 1
            if at < 0:
                n = left[s]
                take(s, n, bins)
                opened(capacity - s, bins, n)
            else:
                t = large[at]
                n = left[s] // 2 if t == s else min(left[s], left[t])
                if t == s:
                    take(s, 2 * n, bins, 2)
                else:
                    take(s, n, bins)
                    take(t, n, bins)
                opened(capacity - s - t, bins, n)
            bins += n
        del left[s]
        large.remove(s)
    # small items: the smallest gap that takes them
    order = sorted(gaps)
    for s in sorted(left, reverse=True):
        at = bisect.bisect_left(order, s)
        while left[s] and at < len(order):
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            n = min(count, left[s])
            if n < count:
                if gap not in gaps:
                    bisect.insort(order, gap)
                gaps.setdefault(gap, []).append((first + n, count - n))
            take(s, n, first)
            rest = gap - s
            if rest:
                if rest not in gaps:
                    bisect.insort(order, rest)
                gaps.setdefault(rest, []).append((first, n))
            at = bisect.bisect_left(order, s)
        if left[s]:
            each = capacity // s
            full = left[s] // each
            if full:
                rest = capacity - each * s
                take(s, full * each, bins, each)
                if rest:
                    if rest not in gaps:
                        bisect.insort(order, rest)
                    gaps.setdefault(rest, []).append((bins, full))
                bins += full
            if left[s]:
                rest = capacity - left[s] * s
                take(s, left[s], bins, left[s])
                if rest:
                    if rest not in gaps:
                        bisect.insort(order, rest)
                    gaps.setdefault(rest, []).append((bins, 1))
                bins += 1
    return out, bins


def _ranked(capacity: int):
    """Cuts oversized items and ranks pieces among those of their size in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            item = batch.column(0)
            tokens = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = np.maximum(1, -(-tokens // capacity))
            at = np.repeat(np.arange(len(tokens)), pieces)
            number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(tokens[at] - number * capacity, capacity)
            o = np.argsort(size, kind="stable")
            s = size[o]
            head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
            runs = np.diff(np.r_[head, len(s)])
            rank = np.empty(len(s), np.int64)
            rank[o] = np.arange(len(s)) - np.repeat(head, runs) + seen[s]
            seen[s[head]] += runs
            yield pa.RecordBatch.from_arrays(
                [item.take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(at), pid)), pa.array(rank)],
                names=["item", "piece", "size", "part", "rank"],
            )

    return run


def pack(sizes: DataFrame, capacity: int = 4096) -> DataFrame:
    """item, piece, size, container for each piece. `sizes` has item BIGINT and tokens BIGINT."""
    spark: SparkSession = sizes.sparkSession
    ranked, _ = materialize(
        sizes.select("item", "tokens").mapInArrow(_ranked(capacity), "item bigint, piece int, size int, part bigint, rank bigint"), "sizes"
    )
    held = ranked.filter("size > 0")
    per_part = held.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows, whatever the data
    histogram = {r["size"]: r["n"] for r in per_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    steps, _ = plan(histogram, capacity)
    offsets = per_part.select(
        "size", "part", (F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")).alias("before")
    )
    rows = [(s, a, b, f, e) for s, a, b, f, e in steps]
    table = spark.createDataFrame(rows, "size int, low bigint, high bigint, first bigint, each int").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK)))
    )
    placed = held.join(offsets, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = placed.withColumn("block", F.floor(F.col("rank") / BLOCK))
    filled = placed.join(table, ["size", "block"]).filter("rank >= low and rank < high")
    out = filled.select("item", "piece", "size", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("container"))
    return out.unionByName(ranked.filter("size <= 0").select("item", "piece", "size", F.lit(None).cast("bigint").alias("container")))
