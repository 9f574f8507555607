"""Graph operators on graphs made by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.kernels import lcs_length
from strandloom.operators import compact, graph, joining, pairs, stats
from strandloom.plans.assemble import assemble
from strandloom.settings import AssemblySettings

READS = "read_id bigint, category int, seq string"


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bases(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def tiled(s, size=60, step=10):
    cut = [s[i : i + size] for i in range(0, len(s) - size + 1, step)]
    return cut if cut[-1].endswith(s[-5:]) else [*cut, s[-size:]]


def frame(spark, seqs):
    return spark.createDataFrame([(i + 1, 0, s) for i, s in enumerate(seqs)], READS)


def only(nodes):
    rows = nodes.collect()
    assert len(rows) == 1
    return rows[0]


def test_one_unitig_from_both_strands(spark):
    genome = bases(500, 1)
    cut = [s if i % 2 else turned(s) for i, s in enumerate(tiled(genome))]
    nodes, arcs = graph.unitigs(frame(spark, cut), 21)
    n = only(nodes)
    assert n.length == 480 and n.seq in (genome, turned(genome)) and arcs.count() == 0
    assert n.cov == sum(len(s) - 20 for s in cut)


def test_turning_all_reads_changes_nothing(spark):
    cut = tiled(bases(200, 2)) + tiled(bases(150, 3))
    a, _ = graph.unitigs(frame(spark, cut), 21)
    b, _ = graph.unitigs(frame(spark, [turned(s) for s in cut]), 21)
    key = lambda df: sorted((r.length, r.cov, min(r.seq, turned(r.seq))) for r in df.collect())
    assert key(a) == key(b)


def test_pure_cycle_is_one_node(spark):
    c = bases(60, 4)
    nodes, arcs = graph.unitigs(frame(spark, [c + c[:40]]), 21)
    assert only(nodes).length == 60
    assert [(r.src, r.dst) for r in arcs.collect()] in ([(1, 1)], [(-1, -1)])


def test_tip_and_bubble_are_removed(spark):
    main = bases(300, 5)
    other = main[:150] + ("A" if main[150] != "A" else "C") + main[151:]
    tip = main[200:230] + bases(12, 6)
    nodes, arcs = graph.unitigs(frame(spark, [main, main, main, other, tip]), 21)
    assert nodes.count() > 1
    nodes, arcs = graph.clip_tips(nodes, arcs, 21)
    nodes, arcs = graph.pop_bubbles(nodes, arcs, 21)
    n = only(nodes)
    assert n.seq in (main, turned(main))
    assert n.cov >= 4 * 280 - 21


def test_tip_of_twice_k_is_kept(spark):
    rows = spark.createDataFrame([(1, 100, 500, "A" * 120), (2, 42, 42, "C" * 62), (3, 41, 41, "G" * 61)], "node_id bigint, length bigint, cov bigint, seq string")
    arcs = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "src bigint, dst bigint, mult bigint")
    assert [r.node_id for r in graph.dead_ends(rows, arcs, 21, minority=False).collect()] == [3]


def test_minority_rule(spark):
    rows = spark.createDataFrame([(1, 100, 1, ""), (2, 10, 1, ""), (3, 10, 1, ""), (4, 5, 1, "")], "node_id bigint, length bigint, cov bigint, seq string")
    arcs = spark.createDataFrame([(1, 2, 5), (1, 3, 3)], "src bigint, dst bigint, mult bigint")
    # 2 has the strongest arc, 3 the weaker one, 4 is isolated
    assert sorted(r.node_id for r in graph.dead_ends(rows, arcs, 21, minority=True).collect()) == [3, 4]


def test_hairpin_and_self_loop_do_not_merge(spark):
    arcs = spark.createDataFrame([(1, -1, 2), (2, 2, 1)], "src bigint, dst bigint, mult bigint")
    assert graph.simple_links(arcs).count() == 0
    counts = {r.node_id: (r.arc_count, r.simple_arc_count) for r in stats.arc_counts(arcs).collect()}
    assert counts[1] == (2, 1)


def test_threading_stops_at_the_first_miss(spark):
    genome = bases(200, 7)
    nodes, _ = graph.unitigs(frame(spark, [genome]), 21)
    broken = genome[:60] + ("A" if genome[60] != "A" else "C") + genome[61:120]
    t = graph.thread(spark.createDataFrame([(9, 0, "T" * 5 + broken)], READS), nodes, 21)
    got = t.agg(F.min("pos"), F.max("pos"), F.count("*")).first()
    assert tuple(got) == (5, 44, 40)
    assert graph.coverage(t).first().cov == 40


def test_chains_with_empty_links(spark):
    assert graph.chains(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_scaffold_gap_has_at_least_ten_bases(spark):
    a, b = bases(200, 8), bases(200, 9)
    nodes = spark.createDataFrame([(1, 180, 1800, a), (2, 180, 900, b)], "node_id bigint, length bigint, cov bigint, seq string")
    unique = nodes.select("node_id")
    for distance, gap in ((183.0, 10), (240.0, 60)):
        conns = spark.createDataFrame([(1, 2, distance, 4.0, 0, 9)], "src bigint, dst bigint, distance double, variance double, direct bigint, paired bigint")
        out, gaps, members = pairs.scaffolds(nodes, conns, unique, 21)
        row = only(out)
        assert row.seq in (a + "N" * gap + b, turned(b) + "N" * gap + turned(a)) and row.cov == 2700 and row.length == 380 + gap
        assert [(r.start, r.stop) for r in gaps.collect()] == [(200, 200 + gap)]
        at = {abs(r.old): (r.old > 0, r.start) for r in members.collect()}
        assert at in ({1: (True, 0), 2: (True, 200 + gap)}, {2: (False, 0), 1: (False, 200 + gap)})


def test_a_walk_fills_the_gap(spark):
    whole = bases(420, 12)
    k = 21
    cut = {1: (0, 200), 3: (180, 240), 4: (220, 260), 2: (240, 420)}
    nodes = spark.createDataFrame([(i, b - a - k + 1, 10, turned(whole[a:b]) if i == 4 else whole[a:b]) for i, (a, b) in cut.items()], "node_id bigint, length bigint, cov bigint, seq string")
    arcs = spark.createDataFrame([(1, 3, 5), (3, -4, 5), (-4, 2, 5), (3, 7, 1)], "src bigint, dst bigint, mult bigint")
    # 4 and 3 stand in the neighbourhood of both ends
    conns = spark.createDataFrame([(1, 2, 231.0, 4.0, 0, 9), (1, 3, 100.0, 4.0, 3, 3), (1, -4, 150.0, 4.0, 3, 3), (-2, 4, 90.0, 4.0, 3, 3), (-2, -3, 120.0, 4.0, 3, 3)], "src bigint, dst bigint, distance double, variance double, direct bigint, paired bigint")
    unique = nodes.filter("node_id < 3").select("node_id")
    out, gaps, members = pairs.scaffolds(nodes, conns, unique, k, arcs=arcs)
    row = only(out)
    assert row.seq in (whole, turned(whole)) and row.length == 400 and gaps.count() == 0
    places = spark.createDataFrame([(1, 10, 5, 0), (-2, 11, 3, 2), (1, 12, -1, 0), (3, 13, 4, 0)], "node bigint, read_id bigint, position bigint, offset bigint")
    moved = {r.read_id: (r.node, r.position) for r in joining.moved_places(places, members, nodes).collect()}
    n, ahead = row.node_id, row.seq == whole
    assert moved == ({10: (n, 5), 11: (-n, 3), 12: (n, -1)} if ahead else {10: (-n, 5), 11: (n, 3), 12: (-n, -1)})


def test_lists_of_read_starts(spark):
    rows = [(1, 5, 3, 0), (1, 5, 9, 4), (1, 6, 2, 0), (2, 6, 7, 1), (2, 8, -1, 0)]
    places = spark.createDataFrame(rows, "node bigint, read_id bigint, position bigint, offset bigint")
    assert {(r.node, r.read_id): (r.position, r.offset) for r in joining.merged_places(places).collect()} == {(1, 5): (-1, 0), (1, 6): (2, 0), (2, 6): (7, 1), (2, 8): (-1, 0)}
    assert [(r.a_node, r.b_node, r.read_id) for r in joining.common_reads(places.filter("node = 1"), places.filter("node = 2")).collect()] == [(1, 2, 6)]
    cuts = spark.createDataFrame([(2, 4, 20, 21)], "node bigint, at bigint, front bigint, back bigint")
    assert sorted(map(tuple, joining.split_places(places, cuts).collect())) == [(20, 8, -1, 0), (21, 6, 3, 1), (21, 8, -1, 0)]


def test_arms_of_several_nodes_with_side_branches_merge(spark):
    k = 11
    main = bases(300, 13)
    # two changes eight bases apart make one arm; a branch leaves the arm between them, so the arm is of several nodes
    other = main[:140] + ("A" if main[140] != "A" else "C") + main[141:148] + ("G" if main[148] != "G" else "T") + main[149:]
    branch = other[120:145] + bases(60, 14)
    nodes, arcs = graph.unitigs(frame(spark, [main] * 4 + [other, branch, branch]), k)
    found = graph.tours(nodes, arcs, 100).filter("size(fast) > 1 or size(slow) > 1")
    assert found.count() > 0
    nodes, arcs = graph.pop_bubbles(nodes, arcs, k)
    rows = nodes.collect()
    # the main walk is left, and the branch hangs on it
    assert any(r.length >= 60 - k for r in rows) and sum(r.length for r in rows) < 300 - k + 1 + 75
    text = "".join(r.seq for r in rows)
    assert main[:130] in text or turned(main)[-130:] in text
    assert not any(other[141 - k + 1 : 141 + 1] in s for r in rows for s in (r.seq, turned(r.seq)))
    assert graph.tours(nodes, arcs, 100).count() == 0


def test_handicaps_leave_the_graph_alone(spark):
    main = bases(200, 15)
    other = main[:100] + ("A" if main[100] != "A" else "C") + main[101:]
    nodes, arcs = graph.unitigs(frame(spark, [main, main, other]), 21)
    slow = [r.node_id for r in graph.local_handicaps(nodes, arcs, nodes.select("node_id"), 21).collect()]
    inner = nodes.filter("length < 40").orderBy("cov").first()
    assert slow == [inner.node_id]
    assert graph.local_handicaps(nodes, arcs, nodes.limit(0).select("node_id"), 21).count() == 0


def test_whole_run_gives_the_genome_back(spark):
    genome = bases(400, 10)
    run = assemble(frame(spark, tiled(genome)), AssemblySettings(k=21, read_trkg=True, unused_reads=True))
    row = only(run.contigs)
    assert row.seq in (genome, turned(genome))
    assert row.name.startswith("NODE_1_length_380_cov_")
    n = len(tiled(genome))
    assert run.summary.first().line == f"Final graph has 1 nodes and n50 of 380, max 380, total 380, using {n}/{n} reads"
    assert run.unused.count() == 0


@pytest.mark.parametrize(("a", "b", "n"), [("", "A", 0), ("ACGT", "ACGT", 4), ("ACGT", "AGT", 3), ("AAAA", "TTTT", 0), ("ACGTACGT", "TACGTACG", 7)])
def test_lcs(a, b, n):
    assert lcs_length(a, b) == n


def walked(lengths, arcs, start, most):
    """All walks from `start` without repeated nodes: node reached -> [(time, nodes between)]."""
    steps = {}
    for a, b, m in arcs:
        for x, y in {(a, b), (-b, -a)}:
            steps.setdefault(x, []).append((y, lengths[abs(x)] / m))
    out, todo = {}, [(y, (), 0, c) for y, c in steps.get(start, ()) if abs(y) != abs(start)]
    while todo:
        at, path, inner, time = todo.pop()
        out.setdefault(at, []).append((time, path))
        inner += lengths[abs(at)]
        if inner <= most:
            todo += [(y, (*path, at), inner, time + c) for y, c in steps.get(at, ()) if abs(y) not in {abs(start), *map(abs, path), abs(at)}]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tours_are_walks_that_meet(spark, seed):
    r = random.Random(seed)
    lengths = {i: r.randint(1, 30) for i in range(1, 13)}
    arcs = list({(a, b): (a, b, r.randint(1, 9)) for a, b in ((r.choice([-1, 1]) * r.randint(1, 12), r.choice([-1, 1]) * r.randint(1, 12)) for _ in range(16))}.values())
    nodes = spark.createDataFrame([(i, n, 1, "") for i, n in lengths.items()], "node_id bigint, length bigint, cov bigint, seq string")
    table = stats.canonical_arcs(spark.createDataFrame(arcs, "src bigint, dst bigint, mult bigint"))
    known = [tuple(x) for x in table.collect()]
    found = graph.tours(nodes, table, 60).collect()
    for x in found:
        walks = {path: time for time, path in walked(lengths, known, x.start, 60)[x.stop]}
        assert tuple(x.fast) in walks and tuple(x.slow) in walks
        # faster on the strand on which the pair was met
        back = {tuple(-n for n in reversed(path)): time for time, path in walked(lengths, known, -x.stop, 60)[-x.start]}
        assert any(w.get(tuple(x.fast), 1e9) <= w.get(tuple(x.slow), 0) + 1e-9 for w in (walks, back))
        assert not {abs(n) for n in x.fast} & {abs(n) for n in x.slow}
    # two single nodes between one start and one stop are always told of
    both = {(x, y) for a, b, _ in known for x, y in ((a, b), (-b, -a))}
    told = {(x.start, x.stop, frozenset(map(abs, (*x.fast, *x.slow)))) for x in found} | {(-x.stop, -x.start, frozenset(map(abs, (*x.fast, *x.slow)))) for x in found}
    for s in {x for x, _ in both}:
        arms = {}
        for m in {y for x, y in both if x == s and abs(y) != abs(s)}:
            for e in {y for x, y in both if x == m and abs(y) not in (abs(m), abs(s))}:
                if lengths[abs(m)] <= 60:
                    arms.setdefault(e, set()).add(m)
        for e, ms in arms.items():
            ms = {m for m in ms if abs(m) != abs(e)}
            if len({abs(m) for m in ms}) == 2 and len(ms) == 2 and (s, e) not in both and not any(len(p) > 1 for _, p in walked(lengths, known, s, 60)[e]):
                assert (s, e, frozenset(map(abs, ms))) in told


@pytest.mark.parametrize("held", [3, 1 << 20])
def test_chains_by_places_equal_plain_ones(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    r = random.Random(5)
    ids = r.sample(range(1, 4000), 600)
    links, at = [], 0
    for size in [*[1, 2, 3, 40, 100] * 3, 7]:
        part = [r.choice([-1, 1]) * x for x in ids[at : at + size]]
        at += size
        links += list(zip(part, part[1:])) + [(-b, -a) for a, b in zip(part, part[1:])]
        if size in (3, 40):  # pure cycles, some inside one place, some over several
            links += [(part[-1], part[0]), (-part[0], -part[-1])]
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(3)
    key = lambda x: sorted((y.u, y.head, y["rank"]) for y in x.collect())
    want = key(graph.chains(df))
    for place in (lambda x: np.abs(x) // 500, lambda x: np.zeros(len(x), np.int64), lambda x: np.abs(x)):
        assert key(graph.placed_chains(df, place)) == want
    assert graph.placed_chains(df.limit(0), lambda x: x).count() == 0


def test_neighbouring_kmers_mostly_share_a_place():
    k, s = 21, bases(3000, 77)
    code = np.array([int("".join("0123"["ACGT".index(c)] for c in min(w, turned(w))), 4) + 1 for w in (s[i : i + k] for i in range(len(s) - k + 1))])
    p = graph.kmer_places(k)(code)
    assert (p[1:] == p[:-1]).mean() > 0.75 and (graph.kmer_places(k)(-code) == p).all()


def test_threading_takes_each_copy_of_a_read_once_and_joins_no_reads(spark):
    """A read given twice with other letters is threaded as the SQL twin says, up to the first miss of either copy; reads are scanned once."""
    s = bases(80, 41)
    nodes = spark.createDataFrame([(1, 60, 1, s)], "node_id bigint, length bigint, cov bigint, seq string")
    broken = s[:50] + ("A" if s[50] != "A" else "C") + s[51:]
    reads = spark.createDataFrame([(7, 0, s), (7, 2, broken), (8, 0, s), (8, 4, s[:40]), (9, 0, "T" * 3 + s)], READS)
    t = graph.thread(reads, nodes, 21)
    got = sorted((x.read_id, x.category, x.pos, x.node, x.off) for x in t.collect())
    # copies of one read share their positions: 7 ends where one copy misses; 8's shorter copy ends without a miss
    assert got == sorted([(7, c, p, 1, p) for c in (0, 2) for p in range(30)] + [(8, 0, p, 1, p) for p in range(60)] + [(8, 4, p, 1, p) for p in range(20)] + [(9, 0, p + 3, 1, p) for p in range(60)])
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert "Broadcast" not in t._jdf.queryExecution().sparkPlan().toString()


def test_compact_unitigs_equal_those_over_arcs(spark):
    """Branches, hairpins, repeats of one letter, cycles inside and across places, reads from both strands; no table of arcs is needed."""
    m, c, d = bases(300, 51), bases(60, 52), bases(400, 53)
    seqs = [m, turned(m)[40:200], m[:150] + turned(m[:150]), m[100:160] + bases(40, 54), c + c[:40], turned(d + d[:30]), bases(12, 55) * 5, "A" * 40, "AC" * 20, "ACG"]
    df = frame(spark, seqs)
    for k in (21, 7):
        rows = lambda x: sorted(map(tuple, x.select("node_id", "length", "cov", "seq").collect()))  # noqa: E731, B023
        got = rows(compact.unitig_nodes(df, k))
        assert got == rows(graph.unitigs(df, k)[0])
        assert sum(x[1] for x in got) == graph.kmer_graph(df, k)[0].count()
