"""Percentiles of very large numeric columns with a stated error, by q-digests.

Values are quantised to an ordered universe of 2**32 leaves: the sign, exponent
and first 20 fraction bits of the double. Integers up to 2**21 are exact, other
values keep a relative error below 2**-20. A digest is a set of nodes of the
dyadic tree over the leaves (node id: 1 at the root, 2i and 2i+1 below i) with
counts. Compression moves a node and its sibling into their parent while the three
together hold at most n/k values; so a value's count sits at most one path away
and any rank read from the digest is off by at most (32/k) * n. Digests merge by
adding the counts of equal nodes, after which the same bound holds for the sum.

Each input partition makes one digest a group (bounded by about 3k nodes); digests
are merged in a tree of two levels whose fan-in is about the root of the number of
tasks, and compressed again as they arrive, so neither the group nor the merge is ever
held whole. Digests of days merge into digests of longer periods the same way.

Nulls and NaN are not counted. Infinities are the ends of the universe.
A group without values gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shuffle_partitions

BITS = 32
#: Default compression: rank error at most 32/6400 = 0.5 % of the values.
K = 6400
#: Least number of first-level merges a group.
SALTS = 16


def salts(spark) -> int:
    """First-level merges a group: the root of the number of tasks, so that both levels of the tree have the same fan-in."""
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return max(SALTS, math.isqrt(tasks))


def leaves(values: np.ndarray) -> np.ndarray:
    """Leaf numbers (0 .. 2**32-1), in the order of the values."""
    b = (values.astype(np.float64) + 0.0).view(np.int64)
    ordered = np.where(b < 0, ~b, b | np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def leaf_value(leaf: np.ndarray) -> np.ndarray:
    """The value of a leaf: its bound nearer to zero, so integers come back exactly."""
    high = leaf.astype(np.uint64) << np.uint64(64 - BITS)
    negative = high < np.uint64(1 << 63)
    # a negative leaf's bits are inverted; the bits cut off were ones
    bits = np.where(negative, ~(high | np.uint64((1 << (64 - BITS)) - 1)), high & np.uint64((1 << 63) - 1))
    return bits.view(np.float64)


def compress(node: np.ndarray, count: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Q-digest of nodes with counts: sibling pairs move up while the three hold at most n/k."""
    limit = n // k
    order = np.argsort(node, kind="stable")
    node, count = node[order], count[order]
    head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
    node, count = node[head], np.add.reduceat(count, head) if len(head) else count
    if limit == 0:
        return node, count
    done_n, done_c = [], []
    for level in range(BITS, 0, -1):
        lo = int(np.searchsorted(node, 1 << level))
        deep, deep_c, node, count = node[lo:], count[lo:], node[:lo], count[:lo]
        if not len(deep):
            continue
        parent = deep >> 1
        head = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        pair = np.add.reduceat(deep_c, head)
        p = parent[head]
        at = np.searchsorted(node, p)
        has = (at < len(node)) & (node[np.minimum(at, len(node) - 1)] == p) if len(node) else np.zeros(len(p), bool)
        own = np.zeros(len(p), np.int64)
        own[has] = count[at[has]]
        up = pair + own <= limit
        stay = np.repeat(~up, np.diff(np.r_[head, len(deep)]))
        done_n.append(deep[stay])
        done_c.append(deep_c[stay])
        count = count.copy()
        count[at[up & has]] += pair[up & has]
        new = up & ~has
        if new.any():
            node = np.concatenate([node, p[new]])
            count = np.concatenate([count, pair[new]])
            o = np.argsort(node)
            node, count = node[o], count[o]
    return np.concatenate([node, *done_n]), np.concatenate([count, *done_c])


def ranks(node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in post-order (upper end of each node) and cumulative counts."""
    level = np.floor(np.log2(node)).astype(np.int64)
    shift = BITS - level
    top = ((node + 1) << shift) - 1 - (np.int64(1) << BITS)
    o = np.lexsort((shift, top))
    return top[o], np.cumsum(count[o])


def quantile(node: np.ndarray, count: np.ndarray, q: float) -> float:
    top, cum = ranks(node, count)
    want = max(1, int(np.ceil(q * cum[-1])))
    return float(leaf_value(top[np.searchsorted(cum, want)][None])[0])


def compress_groups(gid: np.ndarray, node: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node addition inside each group, and compression of groups with at least k values."""
    o = np.lexsort((node, gid))
    gid, node, n = gid[o], node[o], n[o]
    head = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (node[1:] != node[:-1])]) if len(gid) else np.zeros(0, np.int64)
    gid, node, n = gid[head], node[head], np.add.reduceat(n, head) if len(head) else n
    first = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]]) if len(gid) else head
    total = np.add.reduceat(n, first) if len(first) else n
    big = np.flatnonzero(total >= k)
    if not len(big):
        return gid, node, n
    ends = np.r_[first[1:], len(gid)]
    keep = np.ones(len(gid), bool)
    parts = []
    for i in big:
        lo, hi = first[i], ends[i]
        keep[lo:hi] = False
        a, c = compress(node[lo:hi], n[lo:hi], int(total[i]), k)
        parts.append((np.full(len(a), gid[lo]), a, c))
    g, a, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.r_[gid[keep], g], np.r_[node[keep], a], np.r_[n[keep], c]


_DIGEST = "grp string, salt int, node bigint, n bigint"
#: Rows a task holds before it compresses again.
HELD = 1 << 20


class _Groups:
    """Digests of many groups in one task: names as numbers, rows as arrays."""

    def __init__(self, k: int):
        self.k, self.number, self.rows, self.held, self.limit = k, {}, [], 0, HELD

    def add(self, grp: pa.Array, node: np.ndarray, n: np.ndarray) -> None:
        coded = grp.dictionary_encode()
        codes = np.array([self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()], np.int64)
        gid = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, np.int64)
        self.rows.append((gid, node, n))
        self.held += len(gid)
        if self.held > self.limit:
            self.close()
            self.limit = 2 * self.held + HELD

    def close(self) -> None:
        gid, node, n = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows = [compress_groups(gid, node, n, self.k)]
        self.held = len(self.rows[0][0])

    def batches(self, salt: int) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.close()
        gid, node, n = self.rows[0]
        names = pa.array(list(self.number), pa.string())
        for at in range(0, len(gid), HELD):
            g = gid[at : at + HELD]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(g)), pa.array(np.full(len(g), salt, np.int32)), pa.array(node[at : at + HELD]), pa.array(n[at : at + HELD])],
                names=["grp", "salt", "node", "n"],
            )


def _partials(k: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups = _Groups(k)
        for batch in batches:
            value = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            ok = ~np.isnan(value)
            grp = batch.column(0) if ok.all() else batch.column(0).filter(pa.array(ok))
            groups.add(grp, leaves(value[ok]) + (np.int64(1) << BITS), np.ones(int(ok.sum()), np.int64))
        yield from groups.batches(TaskContext.get().partitionId() % salts)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(k)
        for batch in batches:
            groups.add(batch.column(0), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)))
        yield from groups.batches(0)

    return run


def digests(values: DataFrame, k: int = K) -> DataFrame:
    """grp, salt (0), node, n: one digest a group. `values` has grp STRING and value DOUBLE."""
    rows = values.filter("grp is not null and value is not null").select("grp", F.col("value").cast("double").alias("value"))
    parts = rows.mapInArrow(_partials(k, salts(values.sparkSession)), _DIGEST)
    return combined(parts, k)


def combined(parts: DataFrame, k: int = K) -> DataFrame:
    """Digests with equal `grp` merged by node addition."""
    salted = parts.repartition("grp", "salt").mapInArrow(_merge(k), _DIGEST)
    return salted.repartition("grp").mapInArrow(_merge(k), _DIGEST)


def _read(qs: tuple[float, ...], k: int):
    names = ["grp", "q", "value", "n", "rank_error"]

    def group(node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
        top, cum = ranks(node, n)
        want = np.maximum(1, np.ceil(np.array(qs) * cum[-1]).astype(np.int64))
        return leaf_value(top[np.searchsorted(cum, want)]), int(cum[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("grp", pa.string()), ("node", pa.int64()), ("n", pa.int64())]))])
        grp = table.column(0).combine_chunks()
        grp = (grp.chunk(0) if isinstance(grp, pa.ChunkedArray) else grp).dictionary_encode()
        gid = grp.indices.to_numpy(zero_copy_only=False)
        o = np.argsort(gid, kind="stable")
        node, n, gid = table.column(1).to_numpy()[o], table.column(2).to_numpy()[o], gid[o]
        cuts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True]) if len(gid) else np.zeros(1, int)
        out: list[tuple] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            value, total = group(node[lo:hi], n[lo:hi])
            name = grp.dictionary[int(gid[lo])].as_py()
            # nothing was moved up while total < k: the digest is exact
            out += [(name, q, float(v), total, BITS * (total // k)) for q, v in zip(qs, value, strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def percentiles(digest: DataFrame, qs: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), k: int = K) -> DataFrame:
    """grp, q, value, n, rank_error: the value's rank differs from ceil(q*n) by rank_error at most.

    A task reads the digests of its groups, each of a few times k nodes at most."""
    rows = digest.select("grp", "node", "n").repartition("grp")
    return rows.mapInArrow(_read(tuple(qs), k), "grp string, q double, value double, n bigint, rank_error bigint")
