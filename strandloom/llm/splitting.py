"""Cutting oversized items at natural boundaries, with a stated overlap.

Method: dynamic programming over boundary positions. Candidates are the ends of
the item's gaps (runs of N), the ends of shorter runs, and a regular grid; the
least sum of cut penalties and squared relative size differences wins, subject to
the largest length and the overlap between consecutive pieces. A cut at a gap of
at least `gap` letters costs nothing, one at a shorter run SHORT_RUN, one inside
plain sequence PLAIN, so a gap in reach is taken before balance is considered.

White space inside the text is not counted and left out. Items up to the largest
length come out as one piece. Null texts give no pieces; an empty text gives one
empty piece. Repeated rows are cut once each; the query drops repeats.
The work for one item grows in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, SHORT_RUN, PIECE_COST = 4.0, 1.0, 0.02
_SPACE = re.compile(r"\s+")
_RUNS = re.compile(r"[Nn]+")

PIECES = "array<struct<piece:int,start:bigint,stop:bigint,cut:string>>"
SCHEMA = f"id bigint, length bigint, gaps array<bigint>, pieces {PIECES}, body string"


def boundaries(body: str, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions, both ends of every run of N, with their penalties: nothing at a run of `gap` letters or more."""
    ends = [(m.start(), m.end()) for m in _RUNS.finditer(body)]
    at = np.array(ends, np.int64).reshape(-1)
    cost = np.repeat(np.where(at[1::2] - at[::2] >= gap, 0.0, SHORT_RUN), 2)
    return at, cost


def gap_starts(at: np.ndarray, cost: np.ndarray) -> list[int]:
    """Where the gaps begin, read off the boundaries that cost nothing to cut at."""
    return at[::2][cost[::2] == 0.0].tolist()


def cuts(length: int, at: np.ndarray, cost: np.ndarray, most: int, overlap: int, grid: int) -> list[int]:
    """Ends of the pieces, the last being `length`: least total cost by dynamic programming."""
    step = most - overlap
    if length <= most:
        return [length]
    plain = np.arange(grid, length, grid)
    pos = np.concatenate([at, plain, [length]])
    pay = np.concatenate([cost, np.full(len(plain), PLAIN), [0.0]])
    keep = (pos > overlap) & (pos <= length)
    pos, pay = pos[keep], pay[keep]
    o = np.lexsort((pay, pos))
    pos, pay = pos[o], pay[o]
    first = np.r_[True, pos[1:] != pos[:-1]]
    pos, pay = pos[first], pay[first]
    count = -(-(length - overlap) // step)
    ideal = (length - overlap) / count + overlap
    best = np.full(len(pos), np.inf)
    back = np.full(len(pos), -1)
    low = np.searchsorted(pos, pos - step, "left")
    for j in range(len(pos)):
        if pos[j] <= most:
            best[j] = pay[j] + PIECE_COST + ((pos[j] - ideal) / ideal) ** 2
        lo = low[j]
        if lo < j:
            # the piece ending at j begins `overlap` before the earlier end
            size = pos[j] - pos[lo:j] + overlap
            total = best[lo:j] + ((size - ideal) / ideal) ** 2
            k = int(total.argmin())
            if total[k] + pay[j] + PIECE_COST < best[j]:
                best[j], back[j] = total[k] + pay[j] + PIECE_COST, lo + k
    out, j = [], len(pos) - 1
    while j >= 0:
        out.append(int(pos[j]))
        j = int(back[j])
    return out[::-1]


def _split(most: int, overlap: int, gap: int, grid: int, with_body: bool, over_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("cut", pa.string())])
        for batch in batches:
            ids, lens, gaps, pieces, bodies = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                body = _SPACE.sub("", text)
                if over_only and len(body) <= most:
                    continue
                at, cost = boundaries(body, gap)
                ends = cuts(len(body), at, cost, most, overlap, grid)
                price = dict(zip(at.tolist(), cost.tolist(), strict=True))
                start, parts = 0, []
                for k, end in enumerate(ends):
                    how = "end" if end == len(body) else {0.0: "gap", SHORT_RUN: "run"}.get(price.get(end), "plain")
                    parts.append({"piece": k, "start": start, "stop": end, "cut": how})
                    start = end - overlap
                ids.append(i)
                lens.append(len(body))
                gaps.append(gap_starts(at, cost))
                pieces.append(parts)
                bodies.append(body if with_body else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lens, pa.int64()), pa.array(gaps, pa.list_(pa.int64())), pa.array(pieces, pa.list_(kind)), pa.array(bodies, pa.string())],
                names=["id", "length", "gaps", "pieces", "body"],
            )

    return run


def split_items(
    items: DataFrame, id_: str, text: str, most: int = 5000, overlap: int = 100, gap: int = 10, grid: int = 50,
    with_body: bool = False, over_only: bool = False,
) -> DataFrame:
    """id, length, gaps (starts of gaps), pieces (piece, start, stop, cut) and, if asked for, body.

    `cut` tells where a piece ends: gap, run (shorter), plain or end (of the item).
    """
    if not 0 <= overlap < most - 2 * grid:
        raise ValueError("the overlap must be smaller than the largest length by two grid steps at least")
    rows = items.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_split(most, overlap, gap, grid, with_body, over_only), SCHEMA)
