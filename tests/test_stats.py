import pytest

from strandloom.operators import ordered, pairs, stats, tools
from strandloom.settings import AssemblySettings, k_values, valid_k

NODES = "node_id bigint, length bigint, cov bigint"


def test_coverage_filter_divides_whole(spark):
    nodes = spark.createDataFrame([(1, 10, 79), (2, 10, 80), (3, 0, 5), (4, 10, None)], NODES)
    assert [r.node_id for r in stats.low_coverage(nodes, 7.5).collect()] == [1]
    assert stats.low_coverage(nodes, -1).count() == 0
    assert [r.node_id for r in stats.high_coverage(nodes, 7).collect()] == [2]


def test_n50_both_ways_and_empty(spark):
    nodes = spark.createDataFrame([(i, n, 0) for i, n in enumerate([1, 2, 3, 4, 10])], NODES)
    assert stats.n50(nodes).first().n50 == 4
    assert stats.n50(nodes, descending=True).first().n50 == 10
    assert stats.n50(nodes.limit(0)).count() == 0


def test_weighted_median(spark):
    nodes = spark.createDataFrame([(1, 10, 20), (2, 30, 300), (3, 5, 500), (4, 0, 9)], NODES)
    assert stats.weighted_median_coverage(nodes).first().median_coverage == pytest.approx(10.0)
    assert stats.weighted_median_coverage(nodes.limit(0)).count() == 0


def test_running_total_matches_a_plain_sum(spark):
    rows = [(i % 3, (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v bigint, i bigint")
    for by in ([], ["g"]):
        got = {r.i: r.total for r in ordered.running_total(df, df["v"], ["v", "i"], by=by).collect()}
        for g, v, i in rows:
            same = [x for x in rows if not by or x[0] == g]
            assert got[i] == sum(x[1] for x in same if (x[1], x[2]) <= (v, i))
    assert ordered.running_total(df.limit(0), df["v"], ["v"]).count() == 0


def test_low_coverage_intervals(spark):
    marks = spark.createDataFrame([(1, 0, 100, 0), (1, 10, 40, 1), (1, 30, 60, 1), (1, 60, 80, 1)], "node_id bigint, start bigint, stop bigint, weight int")
    got = sorted((r.start, r.stop) for r in stats.low_coverage_intervals(marks, 1).collect())
    assert got == [(0, 10), (80, 100)]


def test_merged_intervals_touch(spark):
    spans = spark.createDataFrame([("a", 1, 5), ("a", 5, 9), ("a", 11, 12), ("b", 1, 1)], "key string, start bigint, stop bigint")
    assert sorted((r.key, r.start, r.stop) for r in tools.merged(spans, "key").collect()) == [("a", 1, 9), ("a", 11, 12), ("b", 1, 1)]


def test_mates_by_adjacency(spark):
    cats = [1, 1, 1, 0, 1, 1, 3, 3]
    reads = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cats)], "read_id bigint, category int")
    got = {r.read_id: (r.category, r.mate_id) for r in pairs.mates(reads).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (0, None), 4: (0, None), 5: (1, 6), 6: (1, 5), 7: (3, 8), 8: (3, 7)}


def test_insert_estimate_ignores_far_values(spark):
    sizes = spark.createDataFrame([(0, x) for x in (100, 102, 104, -5, 9000)], "library int, insert_size bigint")
    row = pairs.insert_estimates(sizes).first()
    assert (row.ins_len, row.ins_var) == (102, (4 + 0 + 4) // 3)


def test_connections_join_twins(spark):
    links = spark.createDataFrame(
        [(1, 2, 100.0, 4.0, 1, 0), (-2, -1, 110.0, 4.0, 0, 2), (3, None, 5.0, 1.0, 1, 1), (1, 2, None, None, 1, 1), (0, 2, 1.0, 1.0, 1, 1)],
        "src bigint, dst bigint, distance double, variance double, direct bigint, paired bigint",
    )
    rows = pairs.connections(links).collect()
    assert [(r.src, r.dst, r.distance, r.variance, r.direct, r.paired) for r in rows] == [(1, 2, 105.0, 2.0, 2, 3)]


def test_settings():
    assert valid_k(22) == 21 and valid_k(99) == 31
    assert k_values("19,31,4") == [19, 23, 27] and k_values("21") == [21]
    s = AssemblySettings(k=22, exp_cov="auto", ins_length={0: 400})
    assert s.k == 21 and s.tracking and s.library(0) == (400, 1600) and s.library(1) is None and s.least_contig == 42
    with pytest.raises(ValueError):
        AssemblySettings(cov_cutoff="maybe")


def test_golden_section_finds_a_peak():
    x, _ = tools.golden_section(lambda v: -(v - 7.3) ** 2, 0, 20, 0.1)
    assert abs(x - 7.3) < 0.1


def test_score_refuses_other_functions(spark):
    df = spark.createDataFrame([(5, 7)], "n50 int, Lbp int")
    assert tools.score(df, "n50 * 2 + Lbp").first().score == 17.0
    with pytest.raises(ValueError):
        tools.score(df, "java_method('a','b')")


def test_numbers_as_text_round_by_their_exact_value(spark):
    from pyspark.sql import functions as F

    from strandloom.functions.kernels import erf, six_places

    rows = [(74.7578125,), (1 / 640,), (0.0,), (1e9 + 0.5,), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x double").select(six_places("x")).collect()] == ["%f" % x if x is not None else None for (x,) in rows]
    import math

    xs = [0.0, 1e-9, -0.3, 0.7, 2.5, -5.9, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select(erf(F.col("x"))).collect()]
    assert got[-1] is None and all(abs(a - math.erf(x)) < 1e-14 for a, x in zip(got, xs))
