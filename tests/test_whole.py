"""Queries that cover their whole table, on tables made by hand."""

from strandloom.operators import tools, traverse
from strandloom.plans import queries as core

from tests.test_graph import bases

READ_SET = "read_id bigint, category tinyint, second_in_pair boolean, library int, mate_id bigint, seq string"


def test_unitigs_of_every_category(spark, tmp_path):
    rows = [(c + 1, c, False, c // 2, None, bases(50 + 10 * c, 40 + c)) for c in range(5)]
    spark.createDataFrame(rows, READ_SET).write.parquet(f"{tmp_path}/read_set.parquet")
    assert sorted(r.length for r in core.QUERIES["unitigs"](spark, str(tmp_path)).collect()) == [30, 40, 50, 60, 70]


def test_reads_of_every_node(spark, small):
    places = spark.createDataFrame([(1, 4), (1, -4), (2, -4), (3, 30)], "read_id bigint, node bigint")
    assert sorted(map(tuple, tools.reads_of_nodes(places).collect())) == [(4, 2), (30, 1)]
    assert {r.node_id for r in core.QUERIES["contig_reads_all"](spark, small).collect()} - {1, 2, 3, 5, 8, 13, 21}


def test_walks_end_where_the_graph_does(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1) for i in range(1, 9)] + [(11, 12, 1), (12, -12, 2), (-11, 13, 1)], "src bigint, dst bigint, mult bigint")
    nodes = spark.createDataFrame([(i, 600 if i in (9, 13) else 10) for i in (*range(1, 10), 11, 12, 13)], "node_id bigint, length bigint")
    short = nodes.filter("node_id in (1, 11)").select("node_id")
    # over the hairpin at 12 a walk from 11 would come back through 11 to 13
    assert sorted(map(tuple, traverse.flanks(nodes, arcs, short).collect())) == [(1, 3, 9), (11, 5, 13)]
    starts = spark.createDataFrame([(1,), (11,)], "node bigint")
    found = traverse.best_paths(traverse.nearest_paths(arcs, starts, nodes.filter("length = 600").select("node_id")))
    assert [list(r.path) for r in found.collect()] == [list(range(1, 10))]
