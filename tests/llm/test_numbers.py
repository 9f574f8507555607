"""Percentiles, term counts, seen-before, heavy hitters, components, packing."""

import bisect
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from strandloom.llm import components, frequency, heavy, packing, quantiles, seen

# --- percentiles ------------------------------------------------------------------


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=60))
def test_leaves_keep_the_order_and_nearly_the_value(values):
    x = np.array(sorted(values))
    leaf = quantiles.leaves(x)
    assert (np.diff(leaf) >= 0).all()
    back = quantiles.leaf_value(leaf)
    near = np.abs(back - x) <= np.maximum(np.abs(x) * 2.0**-20, 1e-300)
    assert (near | (back == x) | (np.abs(x) < 1e-300)).all()


def test_whole_numbers_and_infinities_come_back():
    x = np.array([-(2**20), -7, -1, 0, 1, 5, 12345, 2**21 - 1, math.inf, -math.inf])
    assert (quantiles.leaf_value(quantiles.leaves(x)) == x).all()


@pytest.mark.parametrize("k", [50, 200])
def test_percentiles_stay_within_the_bound(spark, k):
    r = random.Random(1)
    rows = [("hot", r.gauss(0, 1000)) for _ in range(20000)] + [("few", float(i)) for i in range(5)] + [("ties", 3.0)] * 400
    df = spark.createDataFrame(rows + [("none", None), ("few", math.nan), (None, 1.0)], "grp string, value double").repartition(7)
    digest = quantiles.digests(df, k)
    assert digest.groupBy("grp").count().filter(f"count > {4 * k}").count() == 0
    want = defaultdict(list)
    for g, v in rows:
        want[g].append(v)
    got = quantiles.percentiles(digest, (0.0, 0.1, 0.5, 0.9, 1.0), k).collect()
    assert {x.grp for x in got} == {"hot", "few", "ties"}
    for x in got:
        a = sorted(want[x.grp])
        assert x.n == len(a)
        w = max(1, math.ceil(x.q * len(a)))
        lo = bisect.bisect_left(a, x.value - abs(x.value) * 2**-19) + 1
        hi = bisect.bisect_right(a, x.value + abs(x.value) * 2**-19)
        assert max(0, lo - w, w - hi) <= x.rank_error
    # digests merge: the same groups again, twice the values, the same bound
    twice = quantiles.combined(digest.unionByName(digest), k)
    assert {x.grp: x.n for x in quantiles.percentiles(twice, (0.5,), k).collect()} == {"hot": 40000, "few": 10, "ties": 800}
    assert quantiles.percentiles(quantiles.digests(df.limit(0), k)).count() == 0


# --- term counts ------------------------------------------------------------------


@pytest.mark.parametrize("lengths", [(3,), (1, 2, 3)])
def test_term_counts_equal_brute_force(spark, lengths):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([0, 0, 0, *range(64)]), r.choice([None, *range(9)])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("a", None, 1), (None, 5, 1)], "origin string, suffix bigint, record bigint")
    n, rec = Counter(), defaultdict(set)
    for o, s, d in [*rows, ("", 5, 1)]:
        for x in lengths:
            key = (o, x, s >> 2 * (3 - x))
            n[key] += 1
            rec[key] |= {d} - {None}
    got = {(x.origin, x.level, x.prefix): (x.n, x.records) for x in frequency.term_counts(df, 3, lengths).collect()}
    assert got == {k: (n[k], len(rec[k])) for k in n}
    assert frequency.term_counts(df.limit(0), 3).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(1,), (2,), (24,), (25,), (0,)], "records bigint")
    assert {x.records: x.mark for x in frequency.marked(df).collect()} == {0: "rare", 1: "rare", 2: None, 24: None, 25: "common"}


# --- seen before ------------------------------------------------------------------


def test_cuckoo_never_forgets_and_deletes():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**64, 5000, dtype=np.uint64)
    chain = seen.CuckooChain(32, first_log=4)
    chain.insert(keys)
    assert len(chain.tables) > 3 and chain.holds(keys).all()
    assert chain.holds(r.integers(0, 2**64, 5000, dtype=np.uint64)).sum() <= 1
    assert chain.delete(keys[:100]).all()
    assert chain.holds(keys[100:]).all() and chain.holds(keys[:100]).sum() <= 1


def test_short_fingerprints_err_at_their_rate():
    r = np.random.default_rng(4)
    chain = seen.CuckooChain(8)
    chain.insert(r.integers(0, 2**64, 3000, dtype=np.uint64))
    rate = chain.holds(r.integers(0, 2**64, 20000, dtype=np.uint64)).mean()
    assert 0.001 < rate < len(chain.tables) * 8 / 256 * 1.5


def test_seen_rows_equal_brute_force(spark):
    r = random.Random(5)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(2500)]
    rows = [("k", r.choice([keys[7]] * 500 + keys), r.randrange(100), i) for i in range(3000)] + [("k", None, 1, 9999)]
    df = spark.createDataFrame(rows, "kind string, h bigint, ord bigint, id bigint").repartition(5)
    got = seen.answers(df)
    first: dict = {}
    for _, h, o, i in rows:
        if h is not None:
            first[h] = min(first.get(h, (o, i)), (o, i))
    assert {x.id: x.seen for x in got.collect()} == {i: (o, i) > first[h] for _, h, o, i in rows if h is not None}
    by_bits = {x.fingerprint_bits: x for x in seen.rates(df, (4, 32)).collect()}
    assert all(x.false_unseen == 0 and x.rows == 3000 for x in by_bits.values())
    assert by_bits[32].wrong_rate == 0 and by_bits[4].false_seen > 0 and by_bits[4].wrong_rate == by_bits[4].false_seen / 3000
    # the rates do not depend on how rows are cut into Arrow batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    small = {x.fingerprint_bits: x for x in seen.rates(df, (4, 32)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == by_bits
    assert seen.answers(df.limit(0)).count() == 0


def test_saved_tables_answer_for_later_rows(spark):
    r = random.Random(8)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(6000)]
    schema = "kind string, h bigint, ord bigint, id bigint"
    day = [[("k", h, i, i) for i, h in enumerate(part)] for part in (keys[:4000], keys[3000:5000] + keys[3000:3010], keys)]
    first, tables = seen.update(spark.createDataFrame(day[0], schema).repartition(3), parts=5)
    assert first.filter("seen").count() == 0 and first.count() == 4000
    second, tables = seen.update(spark.createDataFrame(day[1], schema), tables, parts=5)
    assert {x.id for x in second.filter("seen").collect()} == set(range(1000)) | set(range(2000, 2010))
    gone = spark.createDataFrame([("k", h) for h in keys[:500]] + [("k", None)], "kind string, h bigint")
    third, tables = seen.update(spark.createDataFrame(day[2], schema), tables, gone, parts=5)
    assert {x.id for x in third.filter("seen").collect()} == set(range(500, 5000))
    none, same = seen.update(spark.createDataFrame([], schema), tables, parts=5)
    assert none.count() == 0 and same.agg({"used": "sum"}).first()[0] == 6000


# --- heavy hitters ----------------------------------------------------------------


def test_intervals_hold_the_true_counts(spark):
    r = random.Random(6)
    values = [min(int(r.paretovariate(0.7)), 10**6) for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value bigint").repartition(6)
    true = Counter(values)
    for x in heavy.intervals(df, 0.002).collect():
        assert x.count_low <= true[x.value] <= x.count_high
        assert x.count_high - x.count_low <= 0.002 * len(values) + 6
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [x.value for x in heavy.top(df, 10, 0.002).orderBy("place").collect()] == [v for v, _ in want]
    assert heavy.top(df.limit(0), 10).count() == 0
    # a flat column: the summaries prune everything, so the exact way answers
    flat = spark.range(4000).selectExpr("id % 1000 as value").unionByName(spark.createDataFrame([(7,), (3,)], "value bigint"))
    assert [(x.value, x.n) for x in heavy.top(flat, 2, 0.01).orderBy("place").collect()] == [(3, 5), (7, 5)]
    assert [x.value for x in heavy.top(spark.createDataFrame([(2,), (1,)], "value bigint"), 10).orderBy("place").collect()] == [1, 2]


# --- components -------------------------------------------------------------------


def test_components_of_a_chain_a_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(500, 500), (700, 600), (700, 600), (None, 3), (4, None)]
    got = {x.node: x.group_id for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)} | {500: 500, 600: 600, 700: 600}
    assert got == want


def test_salted_components_and_empty_links(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 10)
    links = spark.createDataFrame([(1, x) for x in range(2, 90)], "a bigint, b bigint")
    assert {x.group_id for x in components.components(links).collect()} == {1}
    assert components.components(links.limit(0)).count() == 0
    monkeypatch.setattr(components, "MOST_HOT", 20)
    two = spark.createDataFrame([(1, x) for x in range(2, 90)] + [(100, x) for x in range(101, 140)], "a bigint, b bigint")
    assert {(x.node, x.group_id) for x in components.components(two).collect()} == {(i, 1) for i in range(1, 90)} | {(i, 100) for i in range(100, 140)}


# --- packing ----------------------------------------------------------------------


def unfold(steps):
    load, placed = defaultdict(int), Counter()
    for size, low, high, first, each in steps:
        for rank in range(low, high):
            load[first + (rank - low) // each] += size
            placed[size, rank] += 1
    return load, placed


def fewest_bins(histogram, capacity):
    """A lower bound of any packing: the sum of sizes, or the items of which no two, and the halves of which no three, share a bin."""
    total = sum(s * n for s, n in histogram.items())
    above = sum(n for s, n in histogram.items() if 2 * s > capacity)
    return max(math.ceil(total / capacity), above + math.ceil(sum(n for s, n in histogram.items() if 2 * s == capacity) / 2))


@settings(max_examples=60, deadline=None)
@example({21: 13})
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_places_every_item_once_and_never_overfills(histogram):
    steps, bins = packing.plan(histogram, 40)
    load, placed = unfold(steps)
    assert placed == Counter({(s, r): 1 for s, n in histogram.items() for r in range(n)})
    assert all(x <= 40 for x in load.values()) and set(load) == set(range(bins))
    assert fewest_bins(histogram, 40) <= bins <= 1.5 * fewest_bins(histogram, 40) + 1


def test_pack_whole_table(spark):
    r = random.Random(7)
    sizes = {i: r.choice([0, 5, 5, 5, 17, 30, 64, 99, 100, 101, 250, r.randrange(1, 300)]) for i in range(400)}
    df = spark.createDataFrame([(i, t) for i, t in sizes.items()], "item bigint, tokens bigint").repartition(5)
    rows = packing.pack(df, 100).collect()
    load, pieces = defaultdict(int), defaultdict(list)
    for x in rows:
        pieces[x.item].append((x.piece, x.size))
        if x.container is not None:
            load[x.container] += x.size
    assert max(load.values()) <= 100
    for i, t in sizes.items():
        got = sorted(pieces[i])
        assert sum(s for _, s in got) == t and len(got) == max(1, -(-t // 100)) and [p for p, _ in got] == list(range(len(got)))
    assert len(load) <= 1.05 * math.ceil(sum(sizes.values()) / 100)
    assert packing.pack(df.limit(0), 100).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 5000)], "i bigint, t string")
    got = {x.item: x.tokens for x in packing.token_counts(df, "i", "t").collect()}
    enc = packing.encoder()
    assert got == {1: 2, 2: 0, 3: 0, 4: len(enc.encode_ordinary("a" * 5000))}
    assert enc.decode(enc.encode_ordinary("Straße, ñ\n\t 12")) == "Straße, ñ\n\t 12"
