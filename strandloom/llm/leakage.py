"""Evaluation texts leaking into training text: longest verbatim matches.

Method: suffix arrays over the training text, one for each shard (an Arrow batch of
documents). A shard's words become numbers, and its suffixes, from every word on, are
sorted word by word (prefix doubling over the suffixes that are still tied). Every suffix
of every evaluation item is looked up by binary search: the suffixes that begin with
the same `least` words are one range of the array, and each of its places is extended to
the longest verbatim match. A match is reported where it begins, not once a word.

A word that no evaluation item has is a break, so suffixes before it end there; suffixes
of fewer than `least` words can match nothing and are left out of the array.

Items travel to the workers in blocks of at most BLOCK_LETTERS, one search of the
training text a block, however many there are; items of equal text are one class with
its members, so a passage is searched once. The training text is never gathered.

Words are runs of letters or digits in lower case. Markup commands and the
arguments of citing and referring commands are no words; commented lines count.
Null and empty texts have no words. Several equal passages give one row each for
document and item, with the longest match, ties to the first. An empty table on either
side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from ..runtime import materialize

#: Letters of evaluation text that travel to a worker at once.
BLOCK_LETTERS = 20_000_000
#: Places compared at once in a worker.
PLACES = 1 << 20
_WORD = re.compile(r"[^\W_]+")
# Commands whose arguments are no words.
MARKUP = r"\\(?:(?:[a-zA-Z]*cite[a-zA-Z]*|[a-zA-Z]*ref|label)\*?\s*(?:\[[^\]]*\]\s*){0,2}\{[^{}]*\}|[a-zA-Z]+\*?)"
_MARKUP = re.compile(MARKUP)

SCHEMA = "doc bigint, item bigint, words int, doc_word bigint, item_word bigint"


def words_of(text: str) -> list[str]:
    return _WORD.findall(_MARKUP.sub(" ", text).lower())


def _whole(ids: np.ndarray, least: int) -> np.ndarray:
    """Positions from which `least` words follow without a break (0)."""
    if len(ids) < least:
        return np.zeros(0, np.int64)
    gone = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(gone[least:] == gone[:-least])


def suffix_array(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places `at` in order of the suffixes of `ids` that begin there; equal suffixes by place.

    Prefix doubling: places are ranked by their first word, then by twice as many words each round, by the rank of
    what follows. Only places that are still tied before their break are sorted again. A break (0) comes first, and the end is one."""
    at = np.sort(at)
    ids = np.append(ids, 0)
    rank = ids.astype(np.int64)
    if not len(at):
        return at
    # every place has a rank, since a suffix may go on over places outside of `at`
    size, n = 1, len(ids)
    todo = np.arange(n)
    breaks = np.concatenate([[0], np.cumsum(ids == 0)])
    while True:
        key = rank[todo]
        after = np.zeros(len(todo), np.int64)
        inside = todo + size < n
        after[inside] = rank[todo[inside] + size] + 1
        # nothing follows a break
        after[ids[todo] == 0] = 0
        o = np.lexsort((after, key))
        k, a = key[o], after[o]
        head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])]
        if size == 1:
            # ranks become places in the order: the first of each group of equals
            first = np.arange(len(o))
        else:
            # inside a group of equal ranks, count from the group's rank on
            first = np.arange(len(o)) - np.repeat(head, np.diff(np.r_[head, len(o)])) + k
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, len(o)])
        rank[todo[o]] = np.repeat(first[start], sizes)
        todo = todo[o][np.repeat(sizes > 1, sizes)]
        size *= 2
        todo = todo[breaks[np.minimum(todo + size, n)] == breaks[todo]]
        if not len(todo) or size > n:
            break
    return at[np.argsort(rank[at], kind="stable")]


def _compared(shard: np.ndarray, places: np.ndarray, ids: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """-1, 0 or 1 as the `least` words of the shard from `places` are below, like or above the items' words from `starts`."""
    out = np.zeros(len(places), np.int8)
    open_ = np.arange(len(places))
    for j in range(least):
        x, y = shard[places[open_] + j], ids[starts[open_] + j]
        differ = x != y
        out[open_[differ]] = np.where(x[differ] < y[differ], -1, 1)
        open_ = open_[~differ]
        if not len(open_):
            break
    return out


def found_ranges(shard: np.ndarray, array: np.ndarray, ids: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item suffix the range [from, to) of the suffix array that begins with its first `least` words: binary search."""
    out = []
    for side in (0, 1):
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            below = _compared(shard, array[mid], ids, starts[open_], least) < side
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        out.append(lo)
    return out[0], out[1]


class Items:
    """Evaluation items as one array of word numbers, each item ended by a break."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.number: dict[str, int] = {}
        ids: list[int] = []
        owner: list[int] = []
        self.begin_of: dict[int, int] = {}
        for item, text in rows:
            self.begin_of[item] = len(ids)
            for w in words_of(text):
                ids.append(self.number.setdefault(w, len(self.number) + 1))
            ids.append(0)
            owner += [item] * (len(ids) - len(owner))
        self.ids, self.owner = np.array(ids, np.int64), np.array(owner, np.int64)
        self.begin = np.array(list(self.begin_of.values()), np.int64)
        self.at = _whole(self.ids, least)


def _matches(items: Items, shard: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the shard, place in the items, words) of each match that cannot be extended to the left."""
    array = suffix_array(shard, _whole(shard, least))
    lo, hi = found_ranges(shard, array, items.ids, items.at, least)
    some = np.flatnonzero(hi > lo)
    lo, count, starts = lo[some], (hi - lo)[some], items.at[some]
    done = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PLACES, "right")) - 1)
        n = count[a:b]
        j = np.repeat(starts[a:b], n)
        p = array[np.arange(n.sum()) - np.repeat(done[a:b] - done[a], n) + np.repeat(lo[a:b], n)]
        a = b
        # the word before differs, or there is none
        before = np.where((j > 0) & (p > 0), items.ids[j - 1], 0)
        inner = (before != 0) & (before == np.where(p > 0, shard[p - 1], 0))
        j, p = j[~inner], p[~inner]
        size = np.full(len(j), least, np.int64)
        open_ = np.arange(len(j))
        while len(open_):
            x = shard[p[open_] + size[open_]]
            open_ = open_[(x != 0) & (x == items.ids[j[open_] + size[open_]])]
            size[open_] += 1
        yield p, j, size


def _search(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        number = items.number
        for batch in batches:
            ids: list[int] = []
            begin: list[int] = []
            for text in batch.column(1).to_pylist():
                begin.append(len(ids))
                if text:
                    ids.extend([number.get(w, 0) for w in words_of(text)])
                ids.append(0)
            shard, starts = np.array(ids, np.int64), np.array(begin, np.int64)
            for p, j, size in _matches(items, shard, least):
                doc = np.searchsorted(starts, p, "right") - 1
                owner = items.owner[j]
                # the longest of each document and item
                o = np.lexsort((j, p, -size, owner, doc))
                o = o[np.r_[True, (doc[o][1:] != doc[o][:-1]) | (owner[o][1:] != owner[o][:-1])]] if len(o) else o
                base = items.begin[np.searchsorted(items.begin, j[o], "right") - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[o])), pa.array(owner[o]), pa.array(size[o].astype(np.int32)), pa.array(p[o] - starts[doc[o]]), pa.array(j[o] - base)],
                    names=["doc", "item", "words", "doc_word", "item_word"],
                )

    return run


def matches(
    documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 12
) -> DataFrame:
    """doc, item, words (longest verbatim match), and the word positions where it begins in each."""
    spark = documents.sparkSession
    wanted = items.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    members, _ = materialize(wanted.groupBy("text").agg(F.min("item").alias("class"), F.collect_set("item").alias("members")), "items")
    blocks, _ = materialize(
        running_total(members.select("class", "text"), F.length("text").cast("bigint"), ["class", "text"], "sum").withColumn("block", F.expr(f"(sum - length(text)) div {BLOCK_LETTERS}")), "blocks"
    )
    rows = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = None
    for r in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        # a block of the items is bounded, whatever their number
        index = Items([tuple(x) for x in blocks.filter(F.col("block") == r["block"]).select("class", "text").orderBy("class", "text").collect()], least)
        one = rows.mapInArrow(_search(spark.sparkContext.broadcast(index), least), SCHEMA)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    # a shard reports a pair once in each group of places it compares; equal item ids with several texts are one item
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    each = found.join(members.select(F.col("class").alias("item"), F.explode("members").alias("member")), "item")
    return each.groupBy("doc", F.col("member").alias("item")).agg(best.alias("b")).select(
        "doc", "item", "b.words", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word")
    )


def removed(documents: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """The training documents without those that hold a passage."""
    return documents.join(found.select(F.col("doc").alias(doc)).distinct(), doc, "left_anti")
