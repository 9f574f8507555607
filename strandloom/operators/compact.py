"""Unitigs of all reads without a table of arcs.

A k-mer travels with the letters before and behind it to its place (`graph.kmer_places`); there the k-mers are
counted and the stretches inside the task put together in arrays. A link that leads out of a task is simple if
either side has no other way, so both sides report it. Only the stretches, a fraction of the k-mers, are ranked
by pointer doubling. Nodes are those of `graph.unitigs`; each copy of a read makes its own steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.arrow import text_bytes
from ..functions.packed import _CODE, BLOCK, words
from ..runtime import discard, materialize, shuffle_partitions
from .graph import HELD, chains, kmer_places
from .ordered import numbered

_STEPS = "place bigint, kmer bigint, ways smallint"
_PIECES = "piece bigint, at bigint, length bigint, cov bigint, seq string, head bigint, head_to bigint, tail bigint, tail_to bigint"
_TURN = bytes.maketrans(b"ACGT", b"TGCA")


def _steps(k: int):
    """Each k-mer with its place and the letters beside it: four bits for those behind the canonical word, four for those before it."""
    place = kmer_places(k)

    def block(raw: np.ndarray, off: np.ndarray) -> pa.RecordBatch | None:
        code = _CODE[raw]
        if len(code) < k:
            return None
        fwd, rev = words(code, k)
        lens = np.diff(off)
        owner = np.repeat(np.arange(len(lens)), lens)[: len(fwd)]
        pos = np.arange(len(fwd)) - off[owner]
        at = np.flatnonzero(pos + k <= lens[owner])
        pos, left = pos[at], lens[owner[at]] - pos[at] - k
        behind, before = code[np.minimum(at + k, len(code) - 1)], code[np.maximum(at - 1, 0)]
        fwd, rev = fwd[at], rev[at]
        one = np.int16(1)
        ahead = np.where(left > 0, one << behind.astype(np.int16), 0), np.where(left > 0, one << (3 - behind).astype(np.int16), 0)
        back = np.where(pos > 0, one << before.astype(np.int16), 0), np.where(pos > 0, one << (3 - before).astype(np.int16), 0)
        ways = np.where(fwd <= rev, ahead[0] | (back[0] << 4), back[1] | (ahead[1] << 4)).astype(np.int16)
        kmer = np.minimum(fwd, rev)
        return pa.RecordBatch.from_arrays([pa.array(place(kmer + 1)), pa.array(kmer), pa.array(ways)], names=["place", "kmer", "ways"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            lo, n = 0, len(off) - 1
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
                got = block(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                lo = hi
                if got is not None:
                    yield got

    return run


def _heads(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First vertex and rank of every vertex, given the one before it (-1: none); on cycles, the first has one before it."""
    here = np.arange(len(before))
    to, rank = np.where(before < 0, here, before), (before >= 0).astype(np.int64)
    for _ in range(len(before).bit_length() + 1):
        step = to[to]
        if (step == to).all():
            break
        rank, to = rank + rank[to], step
    return to, rank


def _opened(before: np.ndarray) -> np.ndarray:
    """`before` with every cycle cut: in front of its smallest node on that node's own strand, behind it on the other."""
    to, _ = _heads(before)
    on = before[to] >= 0
    if not on.any():
        return before
    low, step = np.arange(len(before)) >> 1, np.where(on, before, np.arange(len(before)))
    for _ in range(len(before).bit_length() + 1):
        low, step = np.minimum(low, low[step]), step[step]
    v = np.arange(len(before))
    first = np.flatnonzero(on & (v == 2 * low))
    out = before.copy()
    out[before[first] ^ 1] = -1
    out[first] = -1
    return out


def _pieces(k: int):
    """Rows (kmer, ways) sorted by place: the stretches that simple links make among the k-mers held together, each on the strand of
    its smallest k-mer; `head_to` and `tail_to` are the only ways out at the ends that lead to other places (signed, out of -head, out of tail)."""
    top, mask = 2 * (k - 1), (1 << (2 * k)) - 1
    bits = np.array([bin(i).count("1") for i in range(16)])
    letter = np.array([max(i.bit_length() - 1, 0) for i in range(16)], np.int64)
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def joined(kmer: np.ndarray, ways: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(kmer, kind="stable")
        kmer, ways = kmer[order], ways[order]
        start = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]]))
        ids, cov, ways = kmer[start], np.diff(np.concatenate([start, [len(kmer)]])), np.bitwise_or.reduceat(ways, start)
        n = len(ids)
        turned, rest = np.zeros(n, np.int64), ids.copy()
        for _ in range(k):
            turned, rest = (turned << 2) | (3 - (rest & 3)), rest >> 2
        # vertex 2i is node i, vertex 2i + 1 its twin; the only way on from each, where there is one
        word, only, to, minus = np.empty(2 * n, np.int64), np.empty(2 * n, bool), np.empty(2 * n, np.int64), np.empty(2 * n, bool)
        word[0::2], word[1::2] = ids, turned
        for s, w in ((0, ways & 15), (1, ways >> 4)):
            x = letter[w]
            only[s::2] = bits[w] == 1
            if s == 0:
                a, b = ((ids << 2) | x) & mask, (turned >> 2) | ((3 - x) << top)
            else:  # the twin goes on to the twin of the word before
                a, b = ((turned << 2) | (3 - x)) & mask, (ids >> 2) | (x << top)
            to[s::2], minus[s::2] = np.minimum(a, b), a > b
        j = np.minimum(np.searchsorted(ids, to), n - 1)
        known = ids[j] == to
        dst = 2 * j + minus
        v = np.arange(2 * n)
        simple = only & known & only[dst ^ 1] & (j != v >> 1)
        away = np.where(only & ~known, np.where(minus, -(to + 1), to + 1), 0)
        before = np.full(2 * n, -1)
        before[dst[simple]] = v[simple]
        head, rank = _heads(_opened(before))
        order = np.lexsort((rank, head))
        first = np.flatnonzero(np.concatenate([[True], head[order][1:] != head[order][:-1]]))
        low = np.minimum.reduceat(order >> 1, first)
        size = np.diff(np.concatenate([first, [2 * n]]))
        mine = head[2 * low] == head[order[first]]
        order, low, size = order[np.repeat(mine, size)], low[mine], size[mine]
        first = np.cumsum(size) - size
        h, t = order[first], order[first + size - 1]
        # texts: the first word whole, then the last letter of each word
        lens = size + k - 1
        off = np.concatenate([[0], np.cumsum(lens)])
        text = np.empty(off[-1], np.uint8)
        text[np.repeat(off[:-1] + k - 1, size) + rank[order]] = word[order] & 3
        for i in range(k - 1):
            text[off[:-1] + i] = (word[h] >> (2 * (k - 1 - i))) & 3
        text = np.frombuffer(b"ACGT", np.uint8)[text]
        seq = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())).cast(pa.string())
        node = lambda x: np.where(x & 1, -(ids[x >> 1] + 1), ids[x >> 1] + 1)
        columns = [ids[low] + 1, rank[2 * low], size, np.add.reduceat(cov[order >> 1], first), seq, node(h), away[h ^ 1], node(t), away[t]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            size += len(held[-1][0])
            if size > HELD:
                place, kmer, ways = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(place, place[-1], "left"))  # the last place may go on
                if cut:
                    yield joined(kmer[:cut], ways[:cut])
                held, size = [(place[cut:], kmer[cut:], ways[cut:])], len(place) - cut
        if size:
            _, kmer, ways = (np.concatenate(x) for x in zip(*held, strict=True))
            yield joined(kmer, ways)

    return run


def _laid(k: int):
    """Whole chains on the strand that `graph.concatenate` keeps; a cycle begins with its smallest node."""

    def turned(s: bytes) -> bytes:
        return s.translate(_TURN)[::-1]

    def signed(w: bytes) -> int:
        r = turned(w)
        code = int.from_bytes(min(w, r), "big")  # the order of texts is that of packed words
        return code if w <= r else -code

    def laid(s: bytes, n: int, at: int, cyclic: bool) -> bytes:
        if n == 1:
            return s
        if cyclic:
            c = s[at:n] + s[:at]
            s = (c * (1 + (n + k) // n))[: n + k - 1]
        return s if signed(s[:k]) < -signed(s[n - 1 :]) else turned(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("seq", "length", "at", "cyclic")), strict=True)
            seq = pa.array([laid(s.encode(), n, at, c).decode() for s, n, at, c in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("low"), b.column("length"), b.column("cov"), seq], names=["low", "length", "cov", "seq"])

    return run


def unitig_nodes(reads: DataFrame, k: int) -> DataFrame:
    """node_id, length, cov, seq as the nodes of `graph.unitigs`, for reads(seq) and odd k <= 31."""
    spark = reads.sparkSession
    parts = shuffle_partitions(spark)
    steps = reads.filter("read_id is not null and seq is not null").select("seq").mapInArrow(_steps(k), _STEPS)
    pieces, a = materialize(steps.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(_pieces(k), _PIECES), "pieces")
    ways = pieces.select(
        F.explode(F.array(
            F.struct(F.col("tail").alias("src"), F.col("tail_to").alias("dst"), F.col("piece").alias("end")),
            F.struct((-F.col("head")).alias("src"), F.col("head_to").alias("dst"), (-F.col("piece")).alias("end")),
        )).alias("x")
    ).select("x.*").filter("dst <> 0")
    twin = F.abs("dst") < F.abs("src")
    both = ways.groupBy(F.when(twin, -F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(twin, -F.col("src")).otherwise(F.col("dst")).alias("dst")).agg(
        F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")
    ).filter("n = 2")
    pair = F.array(F.struct(F.col("a").alias("u"), (-F.col("b")).alias("v")), F.struct(F.col("b").alias("u"), (-F.col("a")).alias("v")))
    links, b = materialize(both.select(F.explode(pair).alias("x")).select("x.u", "x.v"), "links")
    ranks, c = materialize(chains(links), "ranks")
    kept = ranks.groupBy("head").agg(F.min(F.abs("u")).alias("low"), F.min(F.when(F.col("u") > 0, F.col("u"))).alias("plus")).filter("low = plus")
    kept = kept.join(links.select(F.col("v").alias("head"), F.lit(True).alias("cyclic")), "head", "left").select("head", "low", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    members = ranks.join(kept, "head").select(F.abs("u").alias("piece"), (F.col("u") < 0).alias("turned"), "rank", "low", "cyclic")
    rows = pieces.select("piece", "at", "length", "cov", "seq").join(members, "piece", "left")
    text = F.when(F.coalesce("turned", F.lit(False)), dna.revcomp(F.col("seq"))).otherwise(F.col("seq"))
    rows = rows.select(
        F.coalesce("low", "piece").alias("low"), F.coalesce("rank", F.lit(0).cast("bigint")).alias("rank"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "at", "length", "cov", text.alias("s")
    )
    own = F.when(F.col("rank") == 0, F.col("s")).otherwise(F.expr(f"substring(s, {k})"))
    whole = rows.groupBy("low").agg(
        F.sum("length").alias("length"), F.sum("cov").alias("cov"), F.max("cyclic").alias("cyclic"), F.max(F.when(F.col("rank") == 0, F.col("at"))).alias("at"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rank", own.alias("piece")))), lambda x: x["piece"])).alias("seq"),
    )
    nodes, d = materialize(whole.mapInArrow(_laid(k), "low bigint, length bigint, cov bigint, seq string"), "nodes")
    out = nodes.join(numbered(nodes.select("low"), ["low"], "node_id").hint("merge"), "low").select("node_id", "length", "cov", "seq")
    for path in (a, b, c):
        discard(spark, path)
    return out
