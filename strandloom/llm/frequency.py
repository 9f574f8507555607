"""Counts of every distinct value or term prefix, and of the records that hold it.

Method: suffix-sorted n-gram counting. Each occurrence contributes one truncated
suffix (a word of at most `length` letters, packed into a BIGINT). Suffixes are
routed by range of their leading letters, sorted in reverse lexicographic order,
and one pass with a stack of open prefixes (one level for each counted prefix
length) adds up occurrences and record sets; a prefix is closed when the first
suffix without it arrives.

Skew: (suffix, record) pairs are counted before the first shuffle, and the range
routing splits one hot suffix by its records. A prefix that a partition boundary
cuts is not closed there; its record set is handed on and joined afterwards, so
no group is ever gathered in one task.

Null suffixes are no terms and are dropped. A null record adds to occurrences
and to no record count. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_partitions

_OUT = "origin string, level int, prefix bigint, record bigint, n bigint, records bigint"


def _emit(origin, level, prefix, record, n, records) -> pa.RecordBatch:
    size = len(prefix)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([origin] * size, pa.string()),
            pa.array(np.full(size, level, np.int32)),
            pa.array(prefix, pa.int64()),
            pa.array(record, pa.int64()) if record is not None else pa.nulls(size, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(records, pa.int64()) if records is not None else pa.nulls(size, pa.int64()),
        ],
        names=["origin", "level", "prefix", "record", "n", "records"],
    )


class _Level:
    """The stack entry of one prefix length: the prefix that is open now."""

    def __init__(self, length: int, full: int):
        self.length, self.shift = length, 2 * (full - length)
        self.whole = length == full
        self.open: int | None = None
        self.first = True
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Record set of the open prefix: records, their counts, and whether null."""
        rec, n, has = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        keys, inv = np.unique(rec[has], return_inverse=True)
        sums = np.bincount(inv, weights=n[has], minlength=len(keys)).astype(np.int64)
        rest = int(n[~has].sum())
        if (~has).any():
            return np.append(keys, 0), np.append(sums, rest), np.append(np.ones(len(keys), bool), False)
        return keys, sums, np.ones(len(keys), bool)

    def handed_on(self, origin: str) -> Iterator[pa.RecordBatch]:
        """The open prefix as a record set, for a partition's first and last prefix."""
        rec, n, has = self._cut()
        yield _emit(origin, self.length, np.full(len(n), self.open), pa.array(rec, mask=~has), n, None)

    def push(self, origin: str, code: np.ndarray, rec: np.ndarray, has: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        prefix = code >> self.shift
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        ends = np.r_[starts[1:], len(prefix)]
        if self.open is not None and prefix[0] == self.open:
            self.parts.append((rec[: ends[0]], n[: ends[0]], has[: ends[0]]))
            if len(starts) == 1:
                return
            starts, ends = starts[1:], ends[1:]
        if self.open is not None:
            if self.first:
                yield from self.handed_on(origin)
                self.first = False
            else:
                r, c, h = self._cut()
                yield _emit(origin, self.length, np.array([self.open]), None, np.array([c.sum()]), np.array([h.sum()]))
        if len(starts) > 1 and self.first:
            # the partition's very first prefix may have begun in another one
            self.open, self.parts = int(prefix[starts[0]]), [(rec[starts[0] : ends[0]], n[starts[0] : ends[0]], has[starts[0] : ends[0]])]
            yield from self.handed_on(origin)
            self.first = False
            starts, ends = starts[1:], ends[1:]
        if len(starts) > 1:
            at = starts[:-1]
            lo, hi = at[0], ends[-2]
            total = np.add.reduceat(n[lo:hi], at - lo)
            if self.whole:
                distinct = np.add.reduceat(has[lo:hi].astype(np.int64), at - lo)
            else:
                p, r = prefix[lo:hi][has[lo:hi]], rec[lo:hi][has[lo:hi]]
                o = np.lexsort((r, p))
                p, r = p[o], r[o]
                new = np.r_[True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])] if len(p) else np.zeros(0, bool)
                found, c = np.unique(p[new], return_counts=True)
                distinct = np.zeros(len(at), np.int64)
                # prefixes descend, `found` ascends
                pos = np.searchsorted(found, prefix[at])
                ok = (pos < len(found)) & (found[np.minimum(pos, len(found) - 1)] == prefix[at]) if len(found) else np.zeros(len(at), bool)
                distinct[ok] = c[pos[ok]]
            yield _emit(origin, self.length, prefix[at], None, total, distinct)
        s, e = starts[-1], ends[-1]
        self.open, self.parts = int(prefix[s]), [(rec[s:e], n[s:e], has[s:e])]


def _stack(lengths: tuple[int, ...], full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, levels = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist() if batch.column(0).type == pa.string() else batch.column(0).cast(pa.string()).to_pylist()
            code = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.column(3).to_numpy(zero_copy_only=False)
            has = np.asarray(batch.column(2).is_valid())
            rec = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            names = np.asarray(names, dtype=object)
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if names[lo] != origin:
                    for x in levels:
                        yield from x.handed_on(origin)
                    origin, levels = names[lo], [_Level(x, full) for x in lengths]
                for x in levels:
                    yield from x.push(origin, code[lo:hi], rec[lo:hi], has[lo:hi], n[lo:hi])
        for x in levels:
            yield from x.handed_on(origin)

    return run


def term_counts(occurrences: DataFrame, length: int = 31, lengths: Sequence[int] | None = None) -> DataFrame:
    """Occurrences and records of each prefix.

    `occurrences` has origin STRING (counted apart), suffix BIGINT (packed word of
    `length` letters, see functions.dna.pack) and record BIGINT; other columns are
    ignored. `lengths` are the prefix lengths to count, by default the whole word.
    Gives origin, level, prefix (packed), n, records.
    """
    lengths = tuple(sorted(set(lengths or (length,))))
    if lengths[0] < 1 or lengths[-1] > length:
        raise ValueError("prefix lengths must lie between 1 and the word length")
    spark = occurrences.sparkSession
    pairs = (
        occurrences.filter(F.col("suffix").isNotNull())
        .select(F.coalesce("origin", F.lit("")).alias("origin"), "suffix", "record")
        .groupBy("origin", "suffix", "record")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = [F.col("origin").asc(), F.col("suffix").desc(), F.col("record").desc()]
    routed = pairs.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    popped, _ = materialize(routed.mapInArrow(_stack(lengths, length), _OUT), "terms")
    closed = popped.filter("records is not null").select("origin", "level", "prefix", "n", "records")
    cut = (
        popped.filter("records is null")
        .groupBy("origin", "level", "prefix", "record")
        .agg(F.sum("n").alias("n"))
        .groupBy("origin", "level", "prefix")
        .agg(F.sum("n").alias("n"), F.count("record").alias("records"))
    )
    return closed.unionByName(cut)


def marked(counts: DataFrame, rare_below: int = 2, common_from: int = 25) -> DataFrame:
    """Adds `mark`: rare (held by fewer than `rare_below` records), common (by at least
    `common_from`), null in between."""
    return counts.withColumn(
        "mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= common_from, "common")
    )
