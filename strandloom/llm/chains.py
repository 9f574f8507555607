"""Fuzzy passages between records by collinear chaining of shared seeds.

Queries are a stated set of records, searched against all records:

1. seeds: each record's minimizers (the smallest hash among `window` consecutive
   k-letter words) with their places; equal seeds of two records are matches, and
   matches that overlap on one diagonal are one segment;
2. for each query and target the segments are chained in order. A chain's score is the
   letters of its segments less gap costs: GAP for each letter by which the gaps in query
   and target differ, LENGTH for each letter of the shorter gap. The best predecessor is
   exact: divide and conquer over the query's places, and for predecessors on either side
   of the diagonal a Fenwick tree of prefix maxima whose keys hold the gap cost;
3. a pair gives all its chains: the best one, then the best of what it leaves, and so on;
4. chains are aligned: the letters between segments by edit operations. A chain is cut
   into its best stretches, at gaps that cost more than the letters beside them are worth
   at the least identity, the stretches grow at both ends while letters agree, and those of
   at least `least_span` letters with the least identity are passages.

Equal target texts form one class, searched once: matches are kept with the class's
smallest record and `members` tells how many records it has, so copies of one text
never multiply the matches. The joined matches grow with the query set times the
depth of the text around it, not with the square of all records.

Records without letters, null ids or texts give nothing; ties in score go to the
earlier predecessor. Repeated rows of one record count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mix64, text_bytes
from ..functions.kernels import lcs_length
from ..runtime import materialize
from .spans import _CODE, BLOCK, _rolling, _sliding_min

GAP, LENGTH = 0.5, 0.02
_SEEDS = "rec bigint, seed bigint, place int"


def _minimizers(k: int, window: int, wanted=None):
    def block(raw, off, rec):
        n = len(off) - 1
        lens = np.diff(off)
        code = np.full(len(raw) + n, 4, np.uint8)
        begin = off[:-1] + np.arange(n)
        where = np.ones(len(code), bool)
        where[begin + lens] = False
        code[where] = _CODE[raw]
        if len(code) < k + window:
            return None
        bad = code == 4
        code[bad] = 0
        breaks = np.concatenate([[0], np.cumsum(bad)])
        ok = breaks[k:] == breaks[:-k]
        word = _rolling(code, k, np.uint64)
        h = mix64(word + np.uint64(1))
        h[~ok] = np.uint64(2**64 - 1)
        least = _sliding_min(h, window)
        # a word is a minimizer if it is the least of some window that covers it
        spread = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
        chosen = ok & (np.lib.stride_tricks.sliding_window_view(spread, window)[: len(h)] == h[:, None]).any(1)
        at = np.flatnonzero(chosen)
        owner = np.searchsorted(begin, at, "right") - 1
        # the word, not its hash: it is shorter, so it shuffles smaller
        seed = word[at].astype(np.int64)
        if wanted is not None:
            held = wanted.value.holds(seed)
            seed, at, owner = seed[held], at[held], owner[held]
        return rec[owner], seed, (at - begin[owner]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = text_bytes(batch.column(1))
            lo = 0
            while lo < len(rec):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK // 4, "right")) - 1)
                got = block(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], rec[lo:hi])
                lo = hi
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["rec", "seed", "place"])

    return run


#: Bits of the filter that keeps seeds without a query from being shuffled: a fixed 32 MB, whatever the data. The more seeds
#: the queries have, the less it holds back; it never holds back one that they have.
FILTER_BITS = 1 << 28


class SeedFilter:
    """A bitmap of hashed seeds, out of its words that are not empty."""

    def __init__(self, at: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(FILTER_BITS // 32, np.uint32)
        self.words[at] = bits.astype(np.uint32)

    def holds(self, seed: np.ndarray) -> np.ndarray:
        h = seed_places(seed)
        return (self.words[(h >> np.uint64(5)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def seed_places(seed: np.ndarray) -> np.ndarray:
    """Where in the filter a seed has its bit."""
    return mix64(seed.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(FILTER_BITS - 1)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.unique(seed_places(batch.column(0).to_numpy(zero_copy_only=False)))
        at, head = np.unique((h >> np.uint64(5)).astype(np.int64), return_index=True)
        bits = np.bitwise_or.reduceat(np.int64(1) << (h & np.uint64(31)).astype(np.int64), head) if len(h) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits)], names=["at", "bits"])


def seed_filter(seeds: DataFrame) -> SeedFilter:
    """The filter of seeds(seed): its words are merged by the engine, and at most FILTER_BITS / 32 of them come to the driver."""
    words = seeds.select("seed").mapInArrow(_filter_words, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    return SeedFilter(*(words.column(i).to_numpy() for i in (0, 1)))


class Fenwick:
    """Prefix maxima of (score, -index) over ranks 1..n."""

    def __init__(self, n: int):
        self.best = [(-math.inf, 0)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def most(self, upto: int) -> tuple[float, int]:
        out = (-math.inf, 0)
        while upto:
            if self.best[upto] > out:
                out = self.best[upto]
            upto -= upto & -upto
        return out


def segments(q: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of k letters that overlap or touch on one diagonal as one: query start, target start, letters; by start."""
    o = np.lexsort((q, t - q))
    q, t = q[o], t[o]
    head = np.flatnonzero(np.r_[True, (t[1:] - q[1:] != t[:-1] - q[:-1]) | (q[1:] > q[:-1] + k)])
    tail = np.r_[head[1:], len(q)] - 1
    q, t, n = q[head], t[head], q[tail] + k - q[head]
    o = np.lexsort((t, q))
    return q[o], t[o], n[o]


def link(p: int, a: int, q: list[int], t: list[int], n: list[int], slack: int) -> float | None:
    """What the step from segment p to segment a costs; None where p does not lie before a (they may overlap by `slack`)."""
    gap_q, gap_t = q[a] - q[p] - n[p], t[a] - t[p] - n[p]
    if gap_q < -slack or gap_t < -slack:
        return None
    return GAP * abs(gap_q - gap_t) + LENGTH * min(gap_q, gap_t)


#: Segments up to this number are compared one with the other.
FEW = 12


def chain(q: np.ndarray, t: np.ndarray, n: np.ndarray, slack: int) -> tuple[list[float], list[int]]:
    """Best score of a chain that ends in each segment, and the segment before it there (-1: none).

    Segments come sorted by query start. `slack` must be smaller than every segment."""
    q, t, n = q.tolist(), t.tolist(), n.tolist()
    score, back = [float(x) for x in n], [-1] * len(q)
    diagonal = [y - x for x, y in zip(q, t, strict=True)]

    def offer(a: int, p: int, got: float) -> None:
        got += n[a]
        if got > score[a] or (got == score[a] and 0 <= p < back[a]):
            score[a], back[a] = got, p

    def across(lo: int, mid: int, hi: int) -> None:
        ranks = {d: i + 1 for i, d in enumerate(sorted({diagonal[i] for i in range(lo, hi)}))}
        most = len(ranks)
        # predecessors on the same diagonal or a lower one: the query's gap is the shorter
        left, right = sorted(range(lo, mid), key=lambda i: q[i] + n[i]), sorted(range(mid, hi), key=q.__getitem__)
        tree, i = Fenwick(most), 0
        for a in right:
            while i < len(left) and q[left[i]] + n[left[i]] <= q[a] + slack:
                p = left[i]
                tree.put(ranks[diagonal[p]], (score[p] + GAP * diagonal[p] + LENGTH * (q[p] + n[p]), -p))
                i += 1
            s, p = tree.most(ranks[diagonal[a]])
            if s > -math.inf:
                offer(a, -p, s - GAP * diagonal[a] - LENGTH * q[a])
        # predecessors on a higher diagonal: the target's gap is the shorter
        left, right = sorted(range(lo, mid), key=lambda i: t[i] + n[i]), sorted(range(mid, hi), key=t.__getitem__)
        tree, i = Fenwick(most), 0
        for a in right:
            while i < len(left) and t[left[i]] + n[left[i]] <= t[a] + slack:
                p = left[i]
                tree.put(most + 1 - ranks[diagonal[p]], (score[p] - GAP * diagonal[p] + LENGTH * (t[p] + n[p]), -p))
                i += 1
            s, p = tree.most(most - ranks[diagonal[a]])
            if s > -math.inf:
                offer(a, -p, s + GAP * diagonal[a] - LENGTH * t[a])

    def solve(lo: int, hi: int) -> None:
        if hi - lo <= FEW:
            for a in range(lo, hi):
                for p in range(lo, a):
                    cost = link(p, a, q, t, n, slack)
                    if cost is not None:
                        offer(a, p, score[p] - cost)
            return
        mid = (lo + hi) // 2
        solve(lo, mid)
        across(lo, mid, hi)
        solve(mid, hi)

    solve(0, len(q))
    return score, back


def chains_of(score: list[float], back: list[int]) -> Iterator[list[int]]:
    """All chains, best first; each segment is in one, a chain that runs into an earlier one is cut there."""
    used = [False] * len(score)
    for end in sorted(range(len(score)), key=lambda i: (-score[i], i)):
        path, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            yield path[::-1]


def best_stretches(worth: list[float]) -> list[tuple[int, int]]:
    """All disjoint stretches [from, to) of greatest sum (Ruzzo and Tompa)."""
    held: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, x in enumerate(worth):
        before, total = total, total + x
        if x <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return [(a, b) for a, b, _, _ in held]


def grown(a: np.ndarray, b: np.ndarray, least: float) -> tuple[int, int]:
    """Letters by which a stretch grows into a and b from their beginnings, and how many of them agree."""
    size = min(len(a), len(b))
    if not size:
        return 0, 0
    same = a[:size] == b[:size]
    worth = np.cumsum(np.where(same, 1 - least, -least))
    # stop where it lies four disagreeing letters below its best
    drop = np.flatnonzero(worth < np.maximum(np.maximum.accumulate(worth), 0) - 4 * least)
    if len(drop):
        worth = worth[: drop[0]]
    if not len(worth) or worth.max() <= 0:
        return 0, 0
    at = int(worth.argmax()) + 1
    return at, int(same[:at].sum())


def aligned(q: np.ndarray, t: np.ndarray, n: np.ndarray, path: list[int], a: str, b: str, least: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """Passages of one chain: query start and stop, target start and stop, segments, identity."""
    pieces: list[tuple[int, int, int, int, int, int]] = []  # query and target from-to, equal letters, letters
    at_q = at_t = -1
    for i in path:
        x, y, size = int(q[i]), int(t[i]), int(n[i])
        if pieces:
            over = max(at_q - x, at_t - y, 0)
            x, y, size = x + over, y + over, size - over
            if size <= 0:
                continue
            if x > at_q or y > at_t:
                pieces.append((at_q, x, at_t, y, lcs_length(a[at_q:x], b[at_t:y]), max(x - at_q, y - at_t)))
        at_q, at_t = x + size, y + size
        pieces.append((x, at_q, y, at_t, size, size))
    code_a, code_b = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (a, b))
    for lo, hi in best_stretches([same - least * size for *_, same, size in pieces]):
        part = pieces[lo:hi]
        same, size = sum(p[4] for p in part), sum(p[5] for p in part)
        qs, qe, ts, te = part[0][0], part[-1][1], part[0][2], part[-1][3]
        # not into the neighbouring stretch
        low_q, low_t = (pieces[lo - 1][0], pieces[lo - 1][2]) if lo else (0, 0)
        high_q, high_t = (pieces[hi][1], pieces[hi][3]) if hi < len(pieces) else (len(a), len(b))
        more, good = grown(code_a[low_q:qs][::-1], code_b[low_t:ts][::-1], least)
        qs, ts, same, size = qs - more, ts - more, same + good, size + more
        more, good = grown(code_a[qe:high_q], code_b[te:high_t], least)
        qe, te, same, size = qe + more, te + more, same + good, size + more
        yield qs, qe, ts, te, sum(p[4] == p[5] for p in part), same / size


_MATCHED = "query bigint, target bigint, members bigint, query_start int, query_stop int, target_start int, target_stop int, seeds int, identity double"


def _align(k: int, least_span: int, least_identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, target, members, matches, qtext, ttext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = np.array(matches, np.int64)
                q, t, n = segments(both >> 32, both & 0xFFFFFFFF, k)
                for path in chains_of(*chain(q, t, n, k - 1)):
                    for got in aligned(q, t, n, path, qtext, ttext, least_identity):
                        if got[1] - got[0] >= least_span and got[5] >= least_identity:
                            out.append((query, target, members, *got))
            # one passage may grow out of several chains
            out = list(dict.fromkeys(out))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.float64()]
            names = [x.split()[0] for x in _MATCHED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def passages(
    records: DataFrame, rec: str, text: str, is_query, k: int = 15, window: int = 10, least_seeds: int = 2, least_span: int = 60, least_identity: float = 0.8
) -> DataFrame:
    """query, target (smallest record of its text class), members, spans in both, seeds, identity: one row a passage.

    `is_query` is a condition on the record id column, e.g. "read_id % 50 = 0". A pair with fewer than `least_seeds`
    shared seeds gives no passage; the README has the recall that follows from that."""
    spark = records.sparkSession
    asks = F.coalesce(F.expr(is_query if isinstance(is_query, str) else "false"), F.lit(False))
    rows = records.filter(F.col(rec).isNotNull() & F.col(text).isNotNull() & (F.length(text) >= k + window)).select(
        F.col(rec).cast("bigint").alias("rec"), F.upper(text).alias("text"), asks.alias("asks")
    )
    # a text is told by 128 bits of hash: classes are counted without moving texts, and no class is gathered
    key = ["h1", "h2"]
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text", F.lit(2)))
    ids, _ = materialize(rows.select(*key, "rec", "asks").distinct(), "ids")
    held = ids.groupBy(*key).agg(F.min("rec").alias("rec"), F.count(F.lit(1)).alias("members"), F.max("asks").alias("asked"))
    reps = rows.select(*key, "rec", "text").join(held, [*key, "rec"]).groupBy(*key, "rec").agg(F.first("text").alias("text"), F.first("members").alias("members"), F.first("asked").alias("asked"))
    # written once: texts are scanned for seeds, and read again by the pairs that have enough of them
    classes, _ = materialize(reps, "classes")
    asked = classes.filter("asked")
    queries, _ = materialize(asked.select("rec", "text").mapInArrow(_minimizers(k, window), _SEEDS).select(F.col("rec").alias("asked"), "seed", F.col("place").alias("q")), "seeds")
    wanted = spark.sparkContext.broadcast(seed_filter(queries))
    targets = classes.select("rec", "text").mapInArrow(_minimizers(k, window, wanted), _SEEDS).select(F.col("rec").alias("target"), "seed", F.col("place").alias("t"))
    place = F.shiftleft(F.col("q").cast("bigint"), 32).bitwiseOR(F.col("t").cast("bigint"))
    both = targets.join(queries, "seed").groupBy("asked", "target").agg(F.collect_list(place).alias("matches")).filter(F.size("matches") >= least_seeds)
    full = both.join(asked.select(F.col("rec").alias("asked"), F.col("text").alias("qtext")), "asked").join(
        classes.select(F.col("rec").alias("target"), F.col("text").alias("ttext"), "members"), "target"
    )
    # a query meets its own text class only if the class has another record
    own = full.filter((F.col("asked") != F.col("target")) | (F.col("members") > 1))
    found = own.select("asked", "target", "members", "matches", "qtext", "ttext").mapInArrow(_align(k, least_span, least_identity), _MATCHED)
    # equal queries were searched once
    names = ids.filter("asks").join(asked.select(*key, F.col("rec").alias("query")), key).select("query", F.col("rec").alias("own"))
    return found.join(names, "query").select(F.col("own").alias("query"), *(c.split()[0] for c in _MATCHED.split(", ")[1:]))
