"""Packed k-mers of whole reads, vectorised over Arrow batches.

Cutting every word out of a text and packing it letter by letter costs k steps a
k-mer; here all words of a block of reads are packed together by doubling, about
log2(k) array operations in all, on both strands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import text_bytes

SCHEMA = "read_id bigint, pos int, kmer bigint, fwd boolean"
#: Letters handled at once.
BLOCK = 1 << 20
#: Unknown letters count as A.
_CODE, _UNKNOWN = np.zeros(256, np.uint8), np.ones(256, bool)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
    _UNKNOWN[ord(_c)] = _UNKNOWN[ord(_c.lower())] = False


def words(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed k-letter words from each position, and those of the other strand."""
    f, r = {1: code.astype(np.int64)}, {1: 3 - code.astype(np.int64)}
    size = 1
    while size * 2 <= k:
        f[size * 2] = (f[size][:-size] << (2 * size)) | f[size][size:]
        r[size * 2] = (r[size][size:] << (2 * size)) | r[size][:-size]
        size *= 2
    fwd = rev = None
    done = 0
    for s in sorted(f, reverse=True):
        if done + s <= k:
            if fwd is None:
                fwd, rev = f[s], r[s]
            else:
                a, b = f[s][done:], r[s][done:]
                fwd, rev = (fwd[: len(a)] << (2 * s)) | a, (b << (2 * done)) | rev[: len(b)]
            done += s
    n = len(code) - k + 1
    return fwd[:n], rev[:n]


def _rows(k: int, stranded: bool, known: bool, extra: tuple[str, ...]):
    def block(raw, off, read, turned):
        code = _CODE[raw]
        if len(code) < k:
            return None
        fwd, rev = words(code, k)
        lens = np.diff(off)
        owner = np.repeat(np.arange(len(lens)), lens)[: len(fwd)]
        pos = np.arange(len(fwd)) - off[owner]
        ok = pos + k <= lens[owner]
        if known:
            gone = np.concatenate([[0], np.cumsum(_UNKNOWN[raw])])
            ok &= gone[k : k + len(fwd)] == gone[: len(fwd)]
        owner, pos, fwd, rev = owner[ok], pos[ok], fwd[ok], rev[ok]
        forward = ~turned[owner] if stranded else fwd <= rev
        return owner, read[owner], pos.astype(np.int32), np.where(forward, fwd, rev), forward

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = text_bytes(batch.column(1))
            turned = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) if stranded else None
            lo = 0
            while lo < len(read):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
                got = block(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], read[lo:hi], turned[lo:hi] if stranded else None)
                if got is not None:
                    owner = pa.array(got[0] + lo)
                    beside = [batch.column(c).take(owner) for c in extra]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in got[1:]), *beside], names=["read_id", "pos", "kmer", "fwd", *extra])
                lo = hi

    return run


def packed_kmers(reads: DataFrame, k: int, strand_specific: bool = False, known: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """read_id, pos, kmer (packed, canonical or by strand), fwd for all k-mers of reads(read_id, seq[, second_in_pair]); k <= 31.

    With `known`, k-mers with a letter other than A, C, G, T are left out. Columns `extra` of the reads go along."""
    if not 1 <= k <= 31:
        raise ValueError("packed k-mers have at most 31 letters")
    columns = ["read_id", "seq", *(["second_in_pair"] if strand_specific else []), *extra]
    rows = reads.filter("read_id is not null and seq is not null").select(*columns)
    schema = ", ".join([SCHEMA, *(f"{c} {reads.schema[c].dataType.simpleString()}" for c in extra)])
    return rows.selectExpr("cast(read_id as bigint) as read_id", *columns[1:]).mapInArrow(_rows(k, strand_specific, known, extra), schema)
