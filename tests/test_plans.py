"""Parameter search and metagenome plans on small simulated data."""

from strandloom.operators import longreads, meta, tools, traverse
from strandloom.plans import optimise
from strandloom.settings import AssemblySettings

from tests.test_graph import bases, frame, tiled, turned


def test_sweep_and_cutoff(spark):
    genome = bases(300, 21)
    reads = frame(spark, tiled(genome))
    table, runs = optimise.sweep(reads, [17, 21], AssemblySettings(k=21), "n50 + max")
    rows = {r.k: (r.ncon, r.tbp, r.score) for r in table.collect()}
    assert rows == {17: (1, 284, 568.0), 21: (1, 280, 560.0)} and set(runs) == {17, 21}
    nodes = spark.createDataFrame([(1, 2000, 40000), (2, 1500, 3000)], "node_id bigint, length bigint, cov bigint")
    cutoff, left = optimise.best_cutoff(nodes, 20.0)
    assert left in (3500.0, 2000.0) and 0 <= cutoff <= 16


def test_merged_assembly_keeps_the_genome(spark):
    genome = bases(260, 22)
    run = optimise.merged(frame(spark, tiled(genome)), [15, 21], AssemblySettings(k=21))
    assert any(genome in (r.seq, turned(r.seq)) for r in run.nodes.collect())


def test_parts_and_walks(spark):
    arcs = spark.createDataFrame([(1, 2, 3), (2, -3, 1), (5, 6, 1), (9, 9, 1)], "src bigint, dst bigint, mult bigint")
    nodes = spark.createDataFrame([(i, 600 if i in (3, 6) else 10, 5, "") for i in (1, 2, 3, 5, 6, 9, 11)], "node_id bigint, length bigint, cov bigint, seq string")
    assert {r.node_id: r.part for r in traverse.parts(arcs, nodes).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9, 11: 11}
    short = nodes.filter("length < 20").select("node_id")
    assert sorted((r.node_id, r.side, r.flank) for r in traverse.flanks(nodes, arcs, short, 500, 3).collect()) == [(1, 3, 3), (2, 3, 3), (5, 3, 6)]
    starts = spark.createDataFrame([(1,)], "node bigint")
    stops = spark.createDataFrame([(3,)], "node_id bigint")
    assert [list(r.path) for r in traverse.best_paths(traverse.paths(arcs, starts, stops)).collect()] == [[1, 2, -3]]


def test_bypass_writes_shared_bases_once(spark):
    s = bases(60, 23)
    nodes = spark.createDataFrame([(1, 20, 1, s[:30]), (2, 20, 2, turned(s[20:50])), (3, 9, 1, s[40:59])], "node_id bigint, length bigint, cov bigint, seq string")
    links = spark.createDataFrame([(1, -2), (2, -1)], "u bigint, v bigint")
    got = {r.node_id: (r.length, r.cov, r.seq) for r in traverse.bypass(nodes, links, 11).collect()}
    assert got[3] == (9, 1, s[40:59]) and len(got) == 2
    merged = next(v for k, v in got.items() if k != 3)
    assert merged[:2] == (40, 3) and merged[2] in (s[:50], turned(s[:50]))


def test_votes_of_long_reads(spark):
    marks = spark.createDataFrame([(r, o, n) for r in (1, 2) for o, n in enumerate([7, 1, 8, 2, 9])], "seq_id bigint, ord int, node bigint")
    unique = spark.createDataFrame([(1,), (2,)], "node_id bigint")
    kept = longreads.trimmed(marks, unique)
    assert sorted({r.node for r in kept.collect()}) == [1, 2, 8]
    assert sorted((r.u, r.v, r.votes) for r in longreads.unique_links(kept, 2).collect()) == [(-2, -1, 2), (1, 2, 2)]
    assert longreads.unique_links(kept, 3).count() == 0


def test_repeat_becomes_two_nodes(spark):
    # 1 and 2 enter 3, which leaves to 4 and 5; 1-4 is the dense path
    nodes = spark.createDataFrame([(1, 100, 4000, ""), (2, 100, 1000, ""), (3, 100, 5000, ""), (4, 100, 4000, ""), (5, 100, 1000, "")], "node_id bigint, length bigint, cov bigint, seq string")
    arcs = spark.createDataFrame([(1, 3, 9), (2, 3, 4), (3, 4, 9), (3, 5, 4)], "src bigint, dst bigint, mult bigint")
    decided = meta.repeat_splits(nodes, arcs, [40.0, 10.0])
    row = decided.first()
    assert row.split and (row.in_primary, row.out_secondary) == (1, 5)
    n, a = meta.split_repeats(nodes, arcs, decided)
    assert {r.node_id: r.cov for r in n.collect()} == {1: 4000, 2: 1000, 3: 4000, 4: 4000, 5: 1000, 6: 1000}
    assert sorted((r.src, r.dst, r.mult) for r in a.collect()) == [(1, 3, 9), (2, 6, 4), (3, 4, 9), (-6, 5, 4)] or sorted((r.src, r.dst, r.mult) for r in a.collect()) == sorted([(1, 3, 9), (2, 6, 4), (3, 4, 9), (-5, -6, 4)])


def test_mixture_finds_two_levels():
    import math

    bins = [(x, int(1000 * (0.6 * math.exp(-20) * 20**x / math.factorial(x) + 0.4 * math.exp(-50) * 50**x / math.factorial(x)))) for x in range(100)]
    got = meta.poisson_mixture(bins, 2)
    assert [round(m) for m, _ in got] == [50, 20] and abs(got[0][1] - 0.4) < 0.02
    assert meta.poisson_mixture([], 2) == []


def test_lengths_and_breaks_along_markers(spark):
    # 1 always goes on to 2 and that to 3; 5 goes on to 6 or to 7
    walks = {1: [1, 2, 3], 2: [-3, -2, -1], 3: [5, 6], 4: [5, 7]}
    marks = spark.createDataFrame([(s, o, n) for s, w in walks.items() for o, n in enumerate(w)], "seq_id bigint, ord int, node bigint")
    nodes = spark.createDataFrame([(i, 10 * i) for i in (1, 2, 3, 5, 6, 7)], "node_id bigint, length bigint")
    got = {r.node_id: r.virtual_length for r in longreads.virtual_length(marks, nodes).collect()}
    assert got == {1: 60, 2: 60, 3: 60, 5: 50, 6: 110, 7: 120}
    assert {r.node_id: r.breaks for r in longreads.break_points(marks).collect()} == {1: 0, 2: 0, 3: 0, 5: 1, 6: 0, 7: 0}
    strains = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "seq_id bigint, strain string")
    kinds = {r.node_id: r["class"] for r in longreads.strain_classes(marks, strains, "a").collect()}
    assert kinds == {1: "mixed", 2: "mixed", 3: "mixed", 5: "mixed", 6: "only_genome", 7: "only_strain"}


def test_slices_and_piled_reads(spark):
    tiles = spark.createDataFrame([(1, 7, 3, False), (1, 8, 5, True), (2, 9, 4, False), (1, 10, 40, False)], "node_id bigint, read_id bigint, off bigint, turned boolean")
    reads = spark.createDataFrame([(7, "ACGT"), (8, "AACC"), (9, "GG"), (10, "T")], "read_id bigint, seq string")
    one = tools.contig_slice(tiles, reads, 1)
    assert sorted((r.read_id, r.line) for r in tools.pileup(one, 3, 10).collect()) == [(7, "ACGT"), (8, "..GGTT")]
    rows = spark.createDataFrame([(1, "ACGTN", "II#I#"), (2, "AC", None), (3, "", "")], "read_id bigint, seq string, qual string")
    assert {r.read_id: r.seq for r in tools.trimmed(rows).collect()} == {1: "ACGT", 2: "AC", 3: ""}


def test_scores_are_arithmetic_over_the_metrics(spark):
    import pytest

    row = spark.createDataFrame([(3, 100, 40)], "ncon bigint, tbp bigint, n50 bigint")
    assert tools.score(row, "(n50 + tbp/2) * 1e1 - ncon").first().score == 897.0
    for bad in ("n50; drop", "java_method('a')", "sum(n50)", "n50 = 3", "other", "'n50'"):
        with pytest.raises(ValueError):
            tools.score(row, bad)
