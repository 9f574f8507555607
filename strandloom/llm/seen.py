"""Has this key been seen before? Partitioned cuckoo tables of short fingerprints.

Keys are 64-bit hashes. Every partition of the key space owns a chain of cuckoo
tables: a key's fingerprint may lie in one of two buckets of four slots, the
second bucket following from the first and the fingerprint alone. Insertion moves
fingerprints between their buckets; a table that is full, or where moving fails,
is closed and one of twice the size is chained to it (growth on saturation).
Fingerprints can be deleted. Earlier keys are never kept, only fingerprints.

Rows are taken in the stated order inside each key partition. A row that has an
earlier row with the same key in its own Arrow batch needs no table; such rows
(the bulk of a hot key) are settled before the shuffle and spread over all
partitions, so a key that holds a third of all rows sends one row a batch. A key's
first row is never settled: it is always the tables that answer for it, as if rows
came one by one, so the rates do not depend on batches.

A wrong answer can only be a false `seen`. `rates` counts them exactly.
`update` keeps the tables beyond the job: the next day's rows are asked against saved
tables, deleted keys leave them, and earlier rows are never read again.
Rows with a null key get no answer. Ties in the order are broken by row id; equal
rows count as later occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import mix64
from ..runtime import materialize, shuffle_partitions

SLOTS = 4


class CuckooTable:
    """One table of 2**log_buckets buckets with SLOTS fingerprints each (0 = free)."""

    def __init__(self, log_buckets: int, bits: int, most_kicks: int = 200):
        self.log, self.bits, self.kicks = log_buckets, bits, most_kicks
        self.mask = np.uint64((1 << log_buckets) - 1)
        self.slots = np.zeros((1 << log_buckets, SLOTS), np.uint32)
        self.used = 0

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (h >> np.uint64(64 - self.bits)).astype(np.uint32)
        fp[fp == 0] = 1
        one = (h & self.mask).astype(np.int64)
        return fp, one, self.other(one, fp)

    def other(self, bucket, fp):
        step = mix64(np.atleast_1d(fp).astype(np.uint64)) & self.mask
        return bucket ^ step.astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self.place(h)
        return (self.slots[one] == fp[:, None]).any(1) | (self.slots[two] == fp[:, None]).any(1)

    def delete(self, h: np.ndarray) -> np.ndarray:
        """Remove one fingerprint for each key that is held; true where one was removed. One a bucket and round."""
        out = np.zeros(len(h), bool)
        fp, one, two = self.place(h)
        for bucket in (one, two):
            todo = np.flatnonzero(~out)
            while len(todo):
                _, first = np.unique(bucket[todo], return_index=True)
                now = todo[first]
                same = self.slots[bucket[now]] == fp[now][:, None]
                ok = same.any(1)
                self.slots[bucket[now[ok]], same[ok].argmax(1)] = 0
                self.used -= int(ok.sum())
                out[now[ok]] = True
                left = np.ones(len(todo), bool)
                left[first] = False
                todo = todo[left]
        return out

    def room(self) -> int:
        return max(0, int(0.9 * self.slots.size) - self.used)

    def _settle(self, fp: np.ndarray, bucket: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their bucket, one a bucket and round; the rest."""
        rest = []
        while len(todo):
            _, first = np.unique(bucket[todo], return_index=True)
            now = todo[first]
            free = self.slots[bucket[now]] == 0
            ok = free.any(1)
            self.slots[bucket[now[ok]], free[ok].argmax(1)] = fp[now[ok]]
            self.used += int(ok.sum())
            rest.append(now[~ok])
            left = np.ones(len(todo), bool)
            left[first] = False
            todo = todo[left]
        return np.concatenate(rest) if rest else todo

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Insert keys; gives the ones that found no place."""
        room = self.room()
        late, h = h[room:], h[:room]
        if not len(h):
            return late
        fp, one, two = self.place(h)
        todo = self._settle(fp, one, np.arange(len(h)))
        todo = self._settle(fp, two, todo)
        lost = [i for i in todo if not self._kick(fp[i], int(one[i]), int(i))]
        return np.concatenate([h[lost], late]) if lost else late

    def _kick(self, fp, bucket: int, seed: int) -> bool:
        moved = []
        for k in range(self.kicks):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = fp
                self.used += 1
                return True
            s = (seed + k) % SLOTS
            moved.append((bucket, s, self.slots[bucket, s]))
            self.slots[bucket, s], fp = fp, self.slots[bucket, s]
            bucket = int(self.other(bucket, fp)[0])
        for b, s, old in reversed(moved):
            self.slots[b, s] = old
        return False


class CuckooChain:
    """Tables of growing size that together answer for one key partition."""

    def __init__(self, bits: int = 32, first_log: int = 10):
        if not 4 <= bits <= 32:
            raise ValueError("fingerprints have 4 to 32 bits")
        self.bits = bits
        self.tables = [CuckooTable(first_log, bits)]

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.tables[0].holds(h)
        for x in self.tables[1:]:
            out |= x.holds(h)
        return out

    def insert(self, h: np.ndarray) -> None:
        h = self.tables[-1].insert(h)
        while len(h):
            self.tables.append(CuckooTable(self.tables[-1].log + 1, self.bits))
            h = self.tables[-1].insert(h)

    def delete(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for x in self.tables:
            at = np.flatnonzero(~out)
            out[at] = x.delete(h[at])
        return out

    def seen_then_insert(self, h: np.ndarray) -> np.ndarray:
        """Whether each key came before, as the tables tell; new ones are inserted.

        Answers are those of asking and inserting one key after the other: a key that shares fingerprint and
        buckets with an earlier new one counts as seen, and a table that fills up ends the step. So they do not
        depend on how the keys are cut into calls (but for a move that fails below the filling limit)."""
        out = np.zeros(len(h), bool)
        at = np.arange(len(h))
        while len(at):
            last = self.tables[-1]
            seen = self.holds(h[at])
            fresh = np.flatnonzero(~seen)
            fp, one, two = last.place(h[at[fresh]])
            _, first = np.unique((np.minimum(one, two).astype(np.uint64) << np.uint64(32)) | fp, return_index=True)
            new = fresh[np.sort(first)]
            room = last.room()
            cut = len(at) if len(new) <= room else int(new[room])
            new = new[new < cut]
            again = np.ones(len(at), bool)
            again[new] = False
            out[at[:cut]] = again[:cut]
            lost = last.insert(h[at[new]])
            if len(lost) or cut < len(at):
                self.tables.append(CuckooTable(last.log + 1, self.bits))
                self.insert(lost)
            at = at[cut:]
        return out

    def stored(self) -> Iterator[tuple[int, int, int, bytes]]:
        """number, log of the buckets, fingerprints held, slots of each table."""
        for i, t in enumerate(self.tables):
            yield i, t.log, t.used, t.slots.tobytes()

    @classmethod
    def loaded(cls, bits: int, rows: list[tuple[int, int, int, bytes]]) -> CuckooChain:
        out = cls(bits)
        out.tables = []
        for _, log, used, slots in sorted(rows):
            t = CuckooTable(log, bits)
            t.slots = np.frombuffer(slots, np.uint32).reshape(-1, SLOTS).copy()
            t.used = used
            out.tables.append(t)
        return out


_ROUTED = "kind string, h bigint, ord bigint, id bigint, settled boolean"


def _settle_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.column(0).dictionary_encode()
        k = kind.indices.to_numpy(zero_copy_only=False)
        h, ord_, id_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        o = np.lexsort((id_, ord_, h, k))
        same = np.r_[False, (h[o][1:] == h[o][:-1]) & (k[o][1:] == k[o][:-1])] if len(o) else np.zeros(0, bool)
        settled = np.zeros(len(h), bool)
        settled[o] = same
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(settled)], names=["kind", "h", "ord", "id", "settled"])


def _asked(chains: dict, key, bits: int, at: np.ndarray, h: np.ndarray, seen: np.ndarray) -> None:
    if len(at):
        seen[at] = chains.setdefault(key, CuckooChain(bits)).seen_then_insert(h[at])


def _tables(bits: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[tuple[str, int], CuckooChain] = {}
        for batch in batches:
            settled = np.asarray(batch.column(4)).astype(bool)
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            kinds = np.asarray(batch.column(0).to_pylist(), dtype=object)
            open_ = {kind: np.flatnonzero((kinds == kind) & ~settled) for kind in set(kinds)}
            out = []
            for b in bits:
                seen = settled.copy()
                for kind, at in open_.items():
                    _asked(chains, (kind, b), b, at, h, seen)
                out.append(pa.array(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *out], names=["kind", "h", "ord", "id", *(f"seen_{b}" for b in bits)])

    return run


def _answered(rows: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    routed = rows.filter("h is not null").select("kind", "h", "ord", "id").mapInArrow(_settle_in_batch, _ROUTED)
    parts = shuffle_partitions(rows.sparkSession)
    schema = "kind string, h bigint, ord bigint, id bigint, " + ", ".join(f"seen_{b} boolean" for b in bits)
    return (
        routed.repartition(parts, F.when(F.col("settled"), F.xxhash64("id", "kind")).otherwise(F.col("h")))
        .sortWithinPartitions("ord", "id")
        .mapInArrow(_tables(bits), schema)
    )


def answers(rows: DataFrame, bits: int = 32) -> DataFrame:
    """kind, h, ord, id, seen for each row with a key.

    `rows` has kind STRING (keys of different kinds are kept apart), h BIGINT (64-bit
    hash of the key, null: no key), ord BIGINT (arrival) and id BIGINT (breaks ties).
    """
    return _answered(rows, (bits,)).withColumnRenamed(f"seen_{bits}", "seen")


# --- tables that outlive the job ---------------------------------------------------

TABLES = "part int, kind string, number int, log int, used bigint, slots binary"
_EVENT = "part int, step int, kind string, h bigint, ord bigint, id bigint, settled boolean, number int, log int, used bigint, slots binary"
#: What a row is, in the order in which a part's rows are taken.
_LOAD, _DROP, _ASK = 0, 1, 2


def _carried(bits: int):
    """Rows sorted by part and step: tables are loaded, keys deleted, rows answered; each part's tables go out at its end."""
    names = [x.split()[0] for x in _EVENT.split(", ")] + ["seen"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]

    def out(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def closed(part: int, chains: dict[str, CuckooChain]) -> Iterator[pa.RecordBatch]:
        for kind, chain in chains.items():
            for number, log, used, slots in chain.stored():
                yield out(part=[part], kind=[kind], number=[number], log=[log], used=[used], slots=[slots])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chains, stored = None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, step = (np.asarray(batch.column(i)) for i in (0, 1))
            kinds = np.asarray(batch.column(2).to_pylist(), dtype=object)
            edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (step[1:] != step[:-1]), True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if part[lo] != now:
                    if now is not None:
                        yield from closed(now, chains | {k: CuckooChain.loaded(bits, v) for k, v in stored.items()})
                    now, chains, stored = int(part[lo]), {}, {}
                rows = batch.slice(lo, hi - lo)
                if step[lo] == _LOAD:
                    for r in rows.select(["kind", "number", "log", "used", "slots"]).to_pylist():
                        stored.setdefault(r["kind"], []).append((r["number"], r["log"], r["used"], r["slots"]))
                    continue
                chains |= {k: CuckooChain.loaded(bits, v) for k, v in stored.items()}
                stored = {}
                h = rows.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
                if step[lo] == _DROP:
                    for kind in set(kinds[lo:hi]):
                        if kind in chains:
                            chains[kind].delete(h[kinds[lo:hi] == kind])
                    continue
                seen = np.asarray(rows.column(6)).astype(bool).copy()
                for kind in set(kinds[lo:hi]):
                    _asked(chains, kind, bits, np.flatnonzero((kinds[lo:hi] == kind) & ~seen), h, seen)
                yield out(kind=rows.column(2), h=rows.column(3), ord=rows.column(4), id=rows.column(5), seen=seen)
        if now is not None:
            yield from closed(now, chains | {k: CuckooChain.loaded(bits, v) for k, v in stored.items()})

    return run


def update(rows: DataFrame, saved: DataFrame | None = None, gone: DataFrame | None = None, bits: int = 32, parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(answers, tables): rows answered against saved tables, which come back with the new keys in them.

    `saved` is the second frame of an earlier call with the same `bits` and `parts` (the number of key parts; keep a
    part's tables within a task's memory), stored anywhere; earlier rows are not read again. Keys of `gone`
    (kind, h, each once, and only keys that were inserted) are deleted before the rows are asked."""
    part = F.pmod(F.col("h"), F.lit(parts)).cast("int")
    none = {x.split()[0]: F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _EVENT.split(", ")}

    def event(df: DataFrame, step: int, **columns) -> DataFrame:
        have = {c: F.col(c) for c in df.columns} | columns | {"step": F.lit(step)}
        return df.select(*(have[c].alias(c) if c in have else none[c] for c in none))

    settled = rows.filter("h is not null").select("kind", "h", "ord", "id").mapInArrow(_settle_in_batch, _ROUTED)
    # rows settled in their batch ask no table: they stay where they are
    done = settled.filter("settled").select("kind", "h", "ord", "id", F.lit(True).alias("seen"))
    events = event(settled.filter("not settled"), _ASK, part=part)
    if saved is not None:
        events = events.unionByName(event(saved, _LOAD))
    if gone is not None:
        events = events.unionByName(event(gone.select("kind", "h").filter("h is not null").distinct(), _DROP, part=part))
    routed = events.repartition(parts, "part").sortWithinPartitions("part", "step", "ord", "id")
    both, _ = materialize(routed.mapInArrow(_carried(bits), _EVENT + ", seen boolean"), "tables")
    asked = both.filter("slots is null").select("kind", "h", "ord", "id", "seen")
    return asked.unionByName(done), both.filter("slots is not null").select("part", "kind", "number", "log", "used", "slots")


def rates(rows: DataFrame, bits: tuple[int, ...] = (32,)) -> DataFrame:
    """Exact rates by kind and fingerprint size, from one pass: kind, fingerprint_bits, rows, answered_seen,
    truly_seen, false_seen, false_unseen, wrong_rate. Each size has its own tables over the same rows."""
    first = rows.filter("h is not null").groupBy("kind", "h").agg(F.min(F.struct("ord", "id")).alias("first"))
    truth = _answered(rows, bits).join(first, ["kind", "h"]).withColumn("truly", F.struct("ord", "id") > F.col("first"))
    n = lambda c: F.sum(c.cast("bigint"))
    one = truth.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("truly")).alias("truly_seen"),
        F.array(*[
            F.struct(
                F.lit(b).alias("fingerprint_bits"), n(F.col(f"seen_{b}")).alias("answered_seen"), n(F.col(f"seen_{b}") & ~F.col("truly")).alias("false_seen"),
                n(~F.col(f"seen_{b}") & F.col("truly")).alias("false_unseen"), F.avg((F.col(f"seen_{b}") != F.col("truly")).cast("double")).alias("wrong_rate"),
            )
            for b in bits
        ]).alias("by_bits"),
    )
    return one.select("kind", "rows", "truly_seen", F.explode("by_bits").alias("x")).select(
        "kind", "x.fingerprint_bits", "rows", "x.answered_seen", "truly_seen", "x.false_seen", "x.false_unseen", "x.wrong_rate"
    )
