"""Long exact spans shared between records, and fuzzy passages between them.

`shared_spans` finds, for each record, the bases that lie in `span` consecutive
letters standing verbatim in another record.

1. Seeds. Every window of `span` letters is represented by its minimizer, the
   seed of SEED letters with the smallest hash in it. Equal windows have equal
   minimizers, so all of a record's consecutive windows with one minimizer travel
   as one piece (two bits a letter) to the partition of that seed, and only
   records that share a seed ever meet: this is the join on shared seeds.
2. Inside a seed's partition equal windows are found by their 64-bit hashes; a
   window held by two different records is shared by both. No pairs are formed, so
   a seed held by a third of all records costs its own pieces and nothing more.
   Pieces that are equal inside a map batch are settled there and travel once. Seeds
   with far more pieces than others are found first, by lossy counting; their windows
   travel one by one to the place of their own hash, so no task holds a hot seed.
3. The shared windows of a record are chained in order: windows that touch or
   overlap join into one maximal run.

`passages` does the full collinear chaining for fuzzy passages (see below).

Letters other than A, C, G, T (either case) break windows. Null or empty texts
and null ids give no spans. Repeated rows of one record are one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mix64, text_bytes
from ..runtime import materialize, shuffle_partitions
from .heavy import intervals

SEED = 16
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
#: Letters handled at once: bounds the memory of a task, whatever the batch size.
BLOCK = 1 << 21
#: A seed with fewer pieces is never treated as hot.
LEAST_HOT = 20_000

_PIECE = "seed bigint, rec bigint, start bigint, size int, again boolean, bases binary"
_RUN = "rec bigint, start bigint, stop bigint"


def _rolling(code: np.ndarray, k: int, dtype) -> np.ndarray:
    """Packed k-letter words at each position, by doubling."""
    have, out, size = {1: code.astype(dtype)}, None, 1
    while size * 2 <= k:
        a = have[size]
        have[size * 2] = (a[:-size] << dtype(2 * size)) | a[size:]
        size *= 2
    done = 0
    for s in sorted(have, reverse=True):
        if done + s <= k:
            part = have[s][done:]
            out = part if out is None else (out[: len(part)] << dtype(2 * s)) | part
            done += s
    return out[: len(code) - k + 1]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size :]) if size < w else out


def _pieces_of(raw: np.ndarray, off: np.ndarray, rec: np.ndarray, span: int):
    """Pieces of a block of records: seed, record, start, letters, four-letter codes."""
    lens = np.diff(off)
    n = len(lens)
    # one breaking letter after each record
    code = np.full(len(raw) + n, 4, np.uint8)
    begin = off[:-1] + np.arange(n)
    where = np.ones(len(code), bool)
    where[begin + lens] = False
    code[where] = _CODE[raw]
    if len(code) < span:
        return None
    bad = code == 4
    code[bad] = 0
    breaks = np.concatenate([[0], np.cumsum(bad)])
    good = breaks[span:] == breaks[:-span]
    word = _rolling(code, SEED, np.uint32)
    word *= np.uint32(0x9E3779B1)
    word ^= word >> np.uint32(15)
    word *= np.uint32(0x85EBCA77)
    word ^= word >> np.uint32(13)
    least = _sliding_min(word, span - SEED + 1)
    starts = np.flatnonzero(good & np.r_[True, ~good[:-1] | (least[1:] != least[:-1])])
    if not len(starts):
        return None
    stops = np.flatnonzero(good & np.r_[~good[1:] | (least[1:] != least[:-1]), True]) + 1
    owner = np.searchsorted(begin, starts, "right") - 1
    return least[starts].astype(np.int64), rec[owner], starts - begin[owner], (stops - starts + span - 1).astype(np.int32), starts, code


def _packed(code: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a letter for each piece: (bytes, offsets)."""
    long = np.concatenate([code, np.zeros(4, np.uint8)])
    four = (long[:-3] << 6) | (long[1:-2] << 4) | (long[2:-1] << 2) | long[3:]
    count = (size + 3) >> 2
    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    at = np.repeat(starts - 4 * off[:-1].astype(np.int64), count) + 4 * np.arange(off[-1])
    data = four[at]
    # letters beyond the end of a piece must not tell equal pieces apart
    tail = size & 3
    keep = np.array([0xFF, 0xC0, 0xF0, 0xFC], np.uint8)[tail]
    data[off[1:] - 1] &= keep
    return data, off


def _blocks(batches: Iterator[pa.RecordBatch], span: int):
    """Pieces of each block of records: see `_pieces_of`."""
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid()) if batch.column(0).null_count else batch
        if not batch.num_rows:
            continue
        rec = batch.column(0).to_numpy(zero_copy_only=False)
        raw, off = text_bytes(batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1))
        lo = 0
        while lo < len(rec):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
            if hi == lo + 1:
                # a record longer than a block is cut so that every window lies in one cut
                for at in range(int(off[lo]), max(int(off[hi]) - span, int(off[lo])) + 1, BLOCK):
                    stop = min(int(off[hi]), at + BLOCK + span - 1)
                    got = _pieces_of(raw[at:stop], np.array([0, stop - at]), rec[lo:hi], span)
                    if got is not None:
                        yield (*got[:2], got[2] + (at - int(off[lo])), *got[3:])
            else:
                got = _pieces_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], rec[lo:hi], span)
                if got is not None:
                    yield got
            lo = hi


def _seeds(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _blocks(batches, span):
            yield pa.RecordBatch.from_arrays([pa.array(got[0])], names=["value"])

    return run


def _cut(span: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seed, owner, start, size, at, code in _blocks(batches, span):
            many = np.isin(seed, hot) if len(hot) else None
            if many is not None and many.any():
                # each window of a hot seed's piece travels alone, to the place of its own hash
                count = size[many].astype(np.int64) - span + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                places = np.repeat(at[many], count) + step
                own = _hash_at(code, places, span).view(np.int64) | np.int64(-(2**63))
                seed = np.concatenate([seed[~many], own])
                start = np.concatenate([start[~many], np.repeat(start[many], count) + step])
                size = np.concatenate([size[~many], np.full(len(step), span, np.int32)])
                at = np.concatenate([at[~many], places])
                owner = np.concatenate([owner[~many], np.repeat(owner[many], count)])
            data, boff = _packed(code, at, size)
            yield from _settled_in_batch(seed, owner, start, size, data, boff)

    return run


def _settled_in_batch(seed, owner, start, size, data, boff) -> Iterator[pa.RecordBatch]:
    """Equal pieces of different records in this batch are shared: their runs go out as
    settled rows (seed null), and one copy travels on, marked as held again."""
    o = np.lexsort((owner, size, seed))
    s, z = seed[o], size[o]
    near = np.r_[(s[1:] == s[:-1]) & (z[1:] == z[:-1]), False]
    group = np.arange(len(seed))
    if near.any():
        cand = np.unique(np.concatenate([np.flatnonzero(near), np.flatnonzero(near) + 1]))
        text: dict[bytes, int] = {}
        blob = data.tobytes()
        for i in o[cand].tolist():
            key = blob[boff[i] : boff[i + 1]] + size[i].tobytes() + seed[i].tobytes()
            group[i] = text.setdefault(key, i)
    low = np.full(len(seed), np.iinfo(np.int64).max)
    high = np.full(len(seed), np.iinfo(np.int64).min)
    np.minimum.at(low, group, owner)
    np.maximum.at(high, group, owner)
    again = (low < high)[group]
    travels = ~again | (group == np.arange(len(seed)))
    yield _piece_batch(seed, owner, start, size, again, data, boff, np.flatnonzero(travels))
    if again.any():
        i = np.flatnonzero(again)
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, pa.array(owner[i]), pa.array(start[i]), pa.array(size[i]), pa.array(np.ones(len(i), bool)), pa.nulls(len(i), pa.binary())],
            names=["seed", "rec", "start", "size", "again", "bases"],
        )


def _piece_batch(seed, owner, start, size, again, data, boff, at) -> pa.RecordBatch:
    binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(boff), pa.py_buffer(data)])
    full = pa.RecordBatch.from_arrays(
        [pa.array(seed), pa.array(owner), pa.array(start), pa.array(size), pa.array(again), binary],
        names=["seed", "rec", "start", "size", "again", "bases"],
    )
    return full if len(at) == len(size) else full.take(pa.array(at))


def _hash_at(code: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """64-bit hash of the `span` letters from each position of `at`."""
    h = np.zeros(len(at), np.uint64)
    step = min(31, span)
    words = _rolling(code, step, np.uint64)
    for done in range(0, span, step):
        h ^= words[at + min(done, span - step)]
        mix64(h)
        h += np.uint64(0x9E3779B97F4A7C15)
    return h


def _window_hashes(data: np.ndarray, boff: np.ndarray, size: np.ndarray, span: int):
    """64-bit hash of every window of packed pieces, the piece of each, and its offset there."""
    letters = np.empty((len(data), 4), np.uint8)
    for j, shift in enumerate((6, 4, 2, 0)):
        letters[:, j] = (data >> shift) & 3
    count = size.astype(np.int64) - span + 1
    base = boff[:-1].astype(np.int64) * 4
    first = np.concatenate([[0], np.cumsum(count)])
    piece = np.repeat(np.arange(len(size), dtype=np.int32), count)
    at = np.arange(first[-1]) + np.repeat(base - first[:-1], count)
    return _hash_at(letters.reshape(-1), at, span), piece, at - base[piece]


def _shared_runs(seed, rec, start, size, again, data, boff, span: int) -> pa.RecordBatch:
    h, piece, inside = _window_hashes(data, boff, size, span)
    owner = rec[piece]
    o = np.argsort(h)
    hs, ws = h[o], owner[o]
    head = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    many = np.minimum.reduceat(ws, head) < np.maximum.reduceat(ws, head)
    many |= np.logical_or.reduceat(again[piece[o]], head)
    shared = np.empty(len(h), bool)
    shared[o] = np.repeat(many, np.diff(np.r_[head, len(h)]))
    # consecutive shared windows of one piece are one run
    begin = shared & np.r_[True, ~shared[:-1] | (piece[1:] != piece[:-1])]
    finish = shared & np.r_[~shared[1:] | (piece[1:] != piece[:-1]), True]
    b, f = np.flatnonzero(begin), np.flatnonzero(finish)
    p = piece[b]
    return pa.RecordBatch.from_arrays(
        [pa.array(rec[p]), pa.array(start[p] + inside[b]), pa.array(start[p] + inside[f] + span)], names=["rec", "start", "stop"]
    )


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Seed, record, start, letters, held again, bytes and byte counts of a batch of pieces, without Arrow's 2 GiB limit."""
    column = batch.column(5)
    boff = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[boff[0] : boff[-1]]
    seed, rec, start, size, again = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    return seed, rec, start, size, again.astype(bool), data, np.diff(boff).astype(np.int64)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sliced(rows: tuple[np.ndarray, ...], lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """Pieces lo to hi of `rows`."""
    before, inside = int(rows[6][:lo].sum()), int(rows[6][lo:hi].sum())
    return (*(x[lo:hi] for x in rows[:5]), rows[5][before : before + inside], rows[6][lo:hi])


def _of_seeds(rows: tuple[np.ndarray, ...], span: int) -> Iterator[pa.RecordBatch]:
    """Shared runs of pieces sorted by seed, whole seeds up to BLOCK / 2 windows at once."""
    seed = rows[0]
    bounds = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1], True])
    windows = np.concatenate([[0], np.cumsum(rows[3].astype(np.int64) - span + 1)])[bounds]
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(windows, windows[lo] + BLOCK // 2, "right")) - 1)
        part = _sliced(rows, int(bounds[lo]), int(bounds[hi]))
        lo = hi
        yield _shared_runs(*part[:6], np.concatenate([[0], np.cumsum(part[6])]), span)


def _verify(span: int):
    """Pieces arrive sorted by seed (settled ones, without a seed, first): only the last seed of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            settled = batch.column(0).is_null()
            if settled.true_count:
                done = batch.filter(settled)
                start = done.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [done.column(1), pa.array(start), pa.array(start + done.column(3).to_numpy(zero_copy_only=False))],
                    names=["rec", "start", "stop"],
                )
                batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            rows = _arrays(batch)
            # the last seed may go on in the next batch
            at = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if at or (held and held[-1][0][-1] != rows[0][0]):
                yield from _of_seeds(_joined([*held, _sliced(rows, 0, at)]), span)
                held = []
            held.append(_sliced(rows, at, len(rows[0])))
        if held:
            yield from _of_seeds(_joined(held), span)

    return run


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs out of runs sorted by record and start."""
    left: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rec, start, stop = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if left is not None:
            rec, start, stop = (np.concatenate(x) for x in zip(left, (rec, start, stop), strict=True))
        # running maximum of stop inside a record: lift each record above the ones before
        new = np.r_[True, rec[1:] != rec[:-1]]
        lift = np.cumsum(new).astype(np.int64) * (int(stop.max()) + 1)
        reach = np.maximum.accumulate(stop + lift) - lift
        head = np.flatnonzero(new | np.r_[True, start[1:] > reach[:-1]])
        tail = np.r_[head[1:] - 1, len(rec) - 1]
        r, a, b = rec[head], start[head], reach[tail]
        left = (r[-1:], a[-1:], b[-1:])
        if len(r) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1]), pa.array(a[:-1]), pa.array(b[:-1])], names=["rec", "start", "stop"])
    if left is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in left], names=["rec", "start", "stop"])


def hot_seeds(rows: DataFrame, span: int, parts: int, above: int | None = None) -> np.ndarray:
    """Seeds with more pieces than `above`; by default a quarter of a partition's fair share, and LEAST_HOT at least.

    Found by lossy counting, so the summaries are bounded, and at most 4 * parts seeds are reported."""
    found = intervals(rows.mapInArrow(_seeds(span), "value bigint"), 1 / (32 * parts) if above is None else 1e-4)
    found, _ = materialize(found, "seeds")
    total = found.agg(F.coalesce(F.sum("count_low"), F.lit(0))).first()[0]
    most = max(LEAST_HOT, total // (4 * parts)) if above is None else above
    return np.array([r["value"] for r in found.filter(F.col("count_high") > most).select("value").collect()], np.int64)


def shared_spans(records: DataFrame, rec: str, text: str, span: int = 60, hot_above: int | None = None) -> DataFrame:
    """rec, start, stop: maximal runs of letters that lie in `span` letters shared with another record."""
    if span < SEED:
        raise ValueError(f"span must be at least {SEED}")
    parts = shuffle_partitions(records.sparkSession, 2)
    rows = records.select(F.col(rec).cast("bigint").alias("rec"), F.col(text).alias("seq"))
    hot = hot_seeds(rows, span, parts, hot_above)
    pieces = rows.mapInArrow(_cut(span, hot), _PIECE)
    # sorted by the engine, which spills: a task's Python holds one batch and one seed, never the partition
    routed = pieces.repartition(parts, F.coalesce("seed", F.col("rec"))).sortWithinPartitions("seed")
    runs = routed.mapInArrow(_verify(span), _RUN)
    return runs.repartition(parts, "rec").sortWithinPartitions("rec", "start").mapInArrow(_join_runs, _RUN)
