"""Graph structure, threading, pairs, connections, long reads, metagenome splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, hashing, longreads, meta, ordered, pairs, stats, tools, traverse
from ..runtime import new_path, table
from ..sources import seqreads, sinks
from .common import SQL_ARCS, SQL_BOTH, SQL_NODES, SQL_PLACES, SQL_READS, SQL_THREADS, arcs, contig_nodes, kmer_threads, long_nodes, nodes, places, reads
from .assemble import low_spans
from .q_kmers import _ROAD
from .registry import query

_ONE = f"""{SQL_NODES}, n1 AS (SELECT node_id, max(length) AS length, max(cov) AS cov FROM nd GROUP BY 1)"""


def _one(spark: SparkSession, d: str) -> DataFrame:
    """One row a node, over assemblies."""
    return nodes(spark, d).groupBy("node_id").agg(F.max("length").alias("length"), F.max("cov").alias("cov"))


@query(
    f"""WITH {SQL_ARCS}, {SQL_BOTH}, o AS (SELECT src FROM bo GROUP BY 1 HAVING count(*) = 1), i AS (SELECT dst FROM bo GROUP BY 1 HAVING count(*) = 1)
SELECT bo.src AS u, bo.dst AS v FROM bo JOIN o USING (src) JOIN i USING (dst) WHERE bo.src <> bo.dst AND bo.src <> -bo.dst"""
)
def simple_links(spark: SparkSession, d: str) -> DataFrame:
    """Arcs along which nodes merge."""
    return graph.simple_links(arcs(spark, d))


@query(
    f"""WITH RECURSIVE {SQL_ARCS}, {SQL_BOTH}, o AS (SELECT src FROM bo GROUP BY 1 HAVING count(*) = 1), i AS (SELECT dst FROM bo GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT bo.src AS u, bo.dst AS v FROM bo JOIN o USING (src) JOIN i USING (dst) WHERE bo.src <> bo.dst AND bo.src <> -bo.dst),
c AS (SELECT u, u AS head, CAST(0 AS BIGINT) AS rank FROM l WHERE u NOT IN (SELECT v FROM l) UNION ALL SELECT l.v, c.head, c.rank + 1 FROM c JOIN l ON l.u = c.u)
SELECT u, head, rank FROM c"""
)
def chain_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Chains of mergeable nodes, ranked by pointer doubling (those that are no cycles)."""
    links = graph.simple_links(arcs(spark, d))
    ranks = graph.chains(links)
    # a cycle's head has a predecessor
    starts = links.select("u").join(links.select(F.col("v").alias("u")), "u", "left_anti").distinct()
    return ranks.join(starts.select(F.col("u").alias("head")), "head", "left_semi").select("u", "head", "rank")


@query(
    f"""WITH RECURSIVE {SQL_ARCS}, {SQL_BOTH}, o AS (SELECT src FROM bo GROUP BY 1 HAVING count(*) = 1), i AS (SELECT dst FROM bo GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT bo.src AS u, bo.dst AS v FROM bo JOIN o USING (src) JOIN i USING (dst) WHERE bo.src <> bo.dst AND bo.src <> -bo.dst),
c AS (SELECT u, u AS head, CAST(0 AS BIGINT) AS rank FROM l WHERE u NOT IN (SELECT v FROM l) UNION ALL SELECT l.v, c.head, c.rank + 1 FROM c JOIN l ON l.u = c.u),
cy AS (SELECT u, v FROM l WHERE u NOT IN (SELECT u FROM c)), cl(u, x) AS (SELECT u, v FROM cy UNION SELECT cl.u, cy.v FROM cl JOIN cy ON cy.u = cl.x), lw AS (SELECT u, min(abs(x)) AS low FROM cl GROUP BY 1),
hd AS (SELECT u AS head FROM lw WHERE u = low UNION SELECT cy.v FROM cy JOIN lw USING (u) WHERE cy.u = -low),
ck AS (SELECT head AS u, head, CAST(0 AS BIGINT) AS rank FROM hd UNION ALL SELECT cy.v, ck.head, ck.rank + 1 FROM ck JOIN cy ON cy.u = ck.u WHERE cy.v NOT IN (SELECT head FROM hd))
SELECT u, head, rank FROM c UNION ALL SELECT u, head, rank FROM ck"""
)
def chain_ranks_all(spark: SparkSession, d: str) -> DataFrame:
    """Chains of mergeable nodes and pure cycles, cut at their smallest node, ranked by pointer doubling."""
    return graph.chains(graph.simple_links(arcs(spark, d))).select("u", "head", "rank")


@query(
    f"""WITH {_ONE}, {SQL_ARCS}, {SQL_BOTH}, s AS (SELECT node_id AS n FROM n1 WHERE length < 42 UNION ALL SELECT -node_id FROM n1 WHERE length < 42)
SELECT DISTINCT abs(n) AS node_id FROM s WHERE n NOT IN (SELECT src FROM bo)"""
)
def dead_ends(spark: SparkSession, d: str) -> DataFrame:
    """Short nodes with nothing on one side: the candidates of hard clipping."""
    return graph.dead_ends(_one(spark, d), arcs(spark, d), 21, minority=False)


@query(
    f"""WITH {_ONE}, {SQL_ARCS}, {SQL_BOTH}, s AS (SELECT node_id AS n FROM n1 WHERE length < 42 UNION ALL SELECT -node_id FROM n1 WHERE length < 42),
dd AS (SELECT n FROM s WHERE n NOT IN (SELECT src FROM bo)), b AS (SELECT *, max(mult) OVER (PARTITION BY src) AS best FROM bo),
wi AS (SELECT src, min(abs(dst)) AS winner FROM b WHERE mult = best GROUP BY 1),
j AS (SELECT dd.n, b.src, b.mult, b.best, wi.winner FROM dd LEFT JOIN b ON b.dst = dd.n LEFT JOIN wi ON wi.src = b.src)
SELECT abs(n) AS node_id FROM j GROUP BY 1 HAVING min(CASE WHEN src IS NULL OR mult = 1 OR mult < best OR abs(n) <> winner THEN 1 ELSE 0 END) = 1"""
)
def minority_tips(spark: SparkSession, d: str) -> DataFrame:
    """Tips that the minority rule clips."""
    return graph.dead_ends(_one(spark, d), arcs(spark, d), 21, minority=True)


@query(f"WITH {SQL_ARCS}, {SQL_BOTH}, m AS (SELECT src, max(mult) AS m FROM bo GROUP BY 1) SELECT src AS node_id, m AS strongest, row_number() OVER (ORDER BY m DESC, src) AS place FROM m")
def start_node_order(spark: SparkSession, d: str) -> DataFrame:
    """Start nodes of the correction in order of their strongest arc."""
    best = stats.both_strands(arcs(spark, d)).groupBy(F.col("src").alias("node_id")).agg(F.max("mult").alias("strongest"))
    return ordered.numbered(best, [F.desc("strongest"), F.asc("node_id")], "place")


@query("SELECT node_id, row_number() OVER (ORDER BY node_id) AS number FROM (SELECT DISTINCT node_id FROM node_stats WHERE node_id IS NOT NULL) x")
def compact_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "node_stats").filter("node_id is not null").select("node_id").distinct()
    return ordered.numbered(rows, ["node_id"])


_STARTS = f"""{SQL_THREADS}, ke AS (SELECT *, lag(node) OVER (PARTITION BY read_id ORDER BY pos) AS prev FROM kt),
ks AS (SELECT node, read_id, min(pos) AS p, arg_min(off, pos) AS o, count(*) AS n FROM ke WHERE prev IS NULL OR prev <> node GROUP BY 1, 2)"""


@query(
    f"""WITH {_STARTS} SELECT read_id, node, CAST(CASE WHEN n > 1 THEN -1 WHEN node > 0 THEN o ELSE length(s) - 31 - o END AS BIGINT) AS position, CAST(p AS BIGINT) AS "offset" FROM ks JOIN cg ON cg.node_id = abs(node)"""
)
def read_places(spark: SparkSession, d: str) -> DataFrame:
    """The first entry of each read into each node (a long read), from k-mer hits."""
    return graph.read_starts(kmer_threads(spark, d), long_nodes(spark, d)).select("read_id", "node", "position", "offset")


@query(f"WITH {SQL_THREADS} SELECT abs(node) AS node_id, category, count(*) AS cov FROM kt GROUP BY 1, 2")
def threaded_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of nodes (long reads) by k-mer hits, by category."""
    return graph.coverage(kmer_threads(spark, d))


@query(
    f"""WITH {SQL_THREADS}, s AS (SELECT node AS a, lead(node) OVER (PARTITION BY read_id ORDER BY pos) AS b FROM kt), t AS (SELECT a, b FROM s WHERE b IS NOT NULL AND a <> b),
tw AS (SELECT a, b, (abs(b) < abs(a) OR (abs(b) = abs(a) AND a < 0 AND b < 0)) AS f FROM t)
SELECT CASE WHEN f THEN -b ELSE a END AS src, CASE WHEN f THEN -a ELSE b END AS dst, CAST(sum(CASE WHEN a = -b THEN 2 ELSE 1 END) AS BIGINT) AS mult FROM tw GROUP BY 1, 2"""
)
def threaded_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arcs that reads make between consecutive nodes (long reads); a hairpin counts twice."""
    return graph.arcs_of_threads(kmer_threads(spark, d))


_MARKS = f"""{SQL_THREADS}, mt AS (SELECT *, lag(node) OVER w AS pn, lag(off) OVER w AS po, lag(pos) OVER w AS pp FROM kt WHERE category >= 4 WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
mo AS (SELECT *, sum(CASE WHEN pn = node AND off = po + (CASE WHEN node > 0 THEN 1 ELSE -1 END) AND pos = pp + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY pos) AS ord FROM mt),
mk AS (SELECT read_id AS seq_id, ord, any_value(node) AS node, min(pos) AS start, max(pos) + 1 AS finish, arg_min(off, pos) AS start_off, arg_max(off, pos) AS finish_off FROM mo GROUP BY 1, 2)"""


def _markers(spark: SparkSession, d: str) -> DataFrame:
    return longreads.passage_markers(kmer_threads(spark, d), (4, 5))


@query(f"WITH {_MARKS} SELECT seq_id, CAST(ord AS BIGINT) AS ord, node, CAST(start AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish, CAST(start_off AS BIGINT) AS start_off, CAST(finish_off AS BIGINT) AS finish_off FROM mk")
def passage_markers(spark: SparkSession, d: str) -> DataFrame:
    """Paths of long reads over nodes as runs of consecutive positions."""
    return _markers(spark, d).withColumn("ord", F.col("ord").cast("bigint")).select("seq_id", "ord", "node", "start", "finish", "start_off", "finish_off")


@query(
    f"""WITH {_MARKS}, lo AS (SELECT seq_id, min(CASE WHEN abs(node) % 2 = 1 THEN ord END) AS lo, max(CASE WHEN abs(node) % 2 = 1 THEN ord END) AS hi FROM mk GROUP BY 1)
SELECT seq_id, CAST(ord AS BIGINT) AS ord, node FROM mk JOIN lo USING (seq_id) WHERE ord BETWEEN lo AND hi"""
)
def trimmed_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers between a read's first and last one on a unique node; here those with an odd id are labelled so."""
    unique = long_nodes(spark, d).filter("node_id % 2 = 1").select("node_id")
    return longreads.trimmed(_markers(spark, d), unique).select("seq_id", F.col("ord").cast("bigint").alias("ord"), "node")


@query(
    f"""WITH {_MARKS}, n AS (SELECT abs(node) AS node_id, seq_id % 3 AS strain, finish - start AS size FROM mk)
SELECT node_id, CAST(sum(CASE WHEN strain = 0 THEN 1 ELSE 0 END) AS BIGINT) AS genome_copies, CAST(sum(CASE WHEN strain <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS strain_copies,
CASE WHEN sum(CASE WHEN strain <> 0 THEN 1 ELSE 0 END) = 0 THEN 'only_genome' WHEN sum(CASE WHEN strain = 0 THEN 1 ELSE 0 END) = 0 THEN 'only_strain' ELSE 'mixed' END AS class FROM n GROUP BY 1"""
)
def strain_classes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that long reads of the genome, of other strains or of both pass; the reads' strains follow from their ids."""
    strains = table(spark, d, "read_set").filter("read_id is not null").select(F.col("read_id").alias("seq_id"), (F.col("read_id") % 3).cast("string").alias("strain")).distinct()
    return longreads.strain_classes(_markers(spark, d), strains, "0")


@query(f"WITH {SQL_PLACES} SELECT count(DISTINCT read_id) AS unused FROM read_set WHERE read_id IS NOT NULL AND read_id NOT IN (SELECT read_id FROM pl JOIN (SELECT DISTINCT node_id FROM node_stats WHERE lgth >= 100) n ON abs(node) = node_id)")
def unused_reads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "read_set").filter("read_id is not null")
    return sinks.unused_reads(rows, places(spark, d), _one(spark, d), 100).agg(F.countDistinct("read_id").alias("unused"))


@query(f"WITH {SQL_PLACES} SELECT abs(node) AS node_id, count(DISTINCT read_id) AS reads FROM pl GROUP BY 1")
def contig_reads_all(spark: SparkSession, d: str) -> DataFrame:
    """Reads of every node, in one pass."""
    return tools.reads_of_nodes(places(spark, d))


@query(
    """WITH r AS (SELECT DISTINCT read_id, category FROM read_set WHERE read_id IS NOT NULL AND category IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY read_id, category) AS n FROM r),
i AS (SELECT *, n - row_number() OVER (PARTITION BY category ORDER BY n) AS g FROM o WHERE category % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY category, g ORDER BY n) AS i, lead(read_id) OVER (PARTITION BY category, g ORDER BY n) AS nx, lag(read_id) OVER (PARTITION BY category, g ORDER BY n) AS pv FROM i)
SELECT read_id, CAST(CASE WHEN m IS NULL THEN category - 1 ELSE category END AS INTEGER) AS category, m AS mate_id FROM (SELECT *, CASE WHEN i % 2 = 1 THEN nx ELSE pv END AS m FROM k) x
UNION ALL SELECT read_id, CAST(category AS INTEGER), NULL FROM o WHERE category % 2 = 0"""
)
def mate_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Mates by adjacency in runs of one paired category."""
    return pairs.mates(table(spark, d, "read_set"))


@query("SELECT count(DISTINCT CASE WHEN category % 2 = 1 THEN category // 2 END) AS paired_libraries, count(DISTINCT CASE WHEN category % 2 = 1 THEN category // 2 END) + 1 AS rounds FROM read_set")
def paired_libraries(spark: SparkSession, d: str) -> DataFrame:
    return pairs.paired_libraries(table(spark, d, "read_set"))


_PAIRS = "pr AS (SELECT DISTINCT read_id, mate_id, library FROM read_set WHERE read_id IS NOT NULL AND mate_id IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_set").filter("read_id is not null and mate_id is not null").select("read_id", "mate_id", "library").distinct()


@query(f"WITH {_PAIRS}, b AS (SELECT DISTINCT read_id FROM read_set WHERE read_id IS NOT NULL AND (seq IS NULL OR seq = '')) SELECT read_id, mate_id FROM pr WHERE read_id NOT IN (SELECT read_id FROM b) AND mate_id NOT IN (SELECT read_id FROM b)")
def detached_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs left when reads without sequence lose their mates."""
    bad = table(spark, d, "read_set").filter("read_id is not null and (seq is null or seq = '')").select("read_id")
    return pairs.detach(_pairs(spark, d), bad).select("read_id", "mate_id")


_SIZES = "sz AS (SELECT CAST(library AS TINYINT) AS library, distance AS insert_size FROM (SELECT mini_id, arg_max(library, loaded_at) AS library, arg_max(distance, loaded_at) AS distance FROM mini_connections GROUP BY 1) x WHERE distance IS NOT NULL AND library IS NOT NULL)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mini_connections").filter("mini_id is not null")
    # arg_max skips rows whose value is null: take each column's last value that is there
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("loaded_at"))).alias(c)
    return rows.groupBy("mini_id").agg(last("library"), last("distance")).filter("distance is not null and library is not null").select("library", F.col("distance").alias("insert_size"))


_EST = f"""{_SIZES}, o AS (SELECT library, insert_size, row_number() OVER (PARTITION BY library ORDER BY insert_size) AS p, count(*) OVER (PARTITION BY library) AS n FROM sz),
m AS (SELECT library, n, insert_size AS ins_len FROM o WHERE p = n // 2 + 1),
v AS (SELECT m.library, m.n, m.ins_len, CAST(sum(CASE WHEN s.insert_size > 0 AND s.insert_size < 5 * ins_len THEN (s.insert_size - ins_len) * (s.insert_size - ins_len) END) AS BIGINT) AS s,
 count(CASE WHEN s.insert_size > 0 AND s.insert_size < 5 * ins_len THEN 1 END) AS c, CAST(sum((s.insert_size - ins_len) * (s.insert_size - ins_len)) AS HUGEINT) AS sa FROM sz s JOIN m USING (library) GROUP BY 1, 2, 3)"""


@query(f"WITH {_EST} SELECT library, n, ins_len, CAST(greatest(CASE WHEN c > 0 THEN s // c ELSE sa // n END, 1) AS BIGINT) AS ins_var FROM v")
def insert_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Insert length (upper median) and variance of each library."""
    return pairs.insert_estimates(_sizes(spark, d))


@query(
    f"""WITH {_SIZES}, o AS (SELECT library, insert_size, row_number() OVER (PARTITION BY library ORDER BY insert_size) AS p, count(*) OVER (PARTITION BY library) AS n FROM sz),
m AS (SELECT library, n, insert_size AS median FROM o WHERE p = n // 2 + 1), f AS (SELECT library, insert_size, count(*) AS c FROM sz GROUP BY 1, 2),
mo AS (SELECT library, arg_min(insert_size, -c * 1000000000000 + insert_size) AS mode FROM f GROUP BY 1), s AS (SELECT library, stddev_pop(insert_size) AS sd FROM sz GROUP BY 1)
SELECT library, n, median, mode, round(sd, 4) AS sd FROM m JOIN mo USING (library) JOIN s USING (library)"""
)
def observed_inserts(spark: SparkSession, d: str) -> DataFrame:
    return tools.observed_inserts(_sizes(spark, d)).withColumn("sd", F.round("sd", 4))


@query(
    f"""WITH {_ONE}, {SQL_PLACES}, {_PAIRS}, b AS (SELECT p.read_id, p.library, abs(x.node) AS nid, x.position AS p1, x."offset" AS o1, y.position AS p2, y."offset" AS o2 FROM pr p JOIN pl x ON x.read_id = p.read_id JOIN pl y ON y.read_id = p.mate_id
 WHERE p.read_id < p.mate_id AND x.node = -y.node AND x.position > 0 AND y.position > 0),
s AS (SELECT read_id, library, nid, length + 30 - (p1 - o1) - (p2 - o2) AS x FROM b JOIN n1 ON nid = node_id), r AS (SELECT *, row_number() OVER (PARTITION BY read_id, library ORDER BY nid, x) AS k FROM s)
SELECT library, x AS insert_size, count(*) AS n FROM r WHERE k = 1 GROUP BY 1, 2"""
)
def insert_observations(spark: SparkSession, d: str) -> DataFrame:
    """Insert sizes of pairs whose mates lie on one node."""
    found = pairs.insert_sizes(places(spark, d), _pairs(spark, d), _one(spark, d), 31)
    return found.groupBy("library", "insert_size").agg(F.count(F.lit(1)).alias("n"))


_CONN = """cx AS (SELECT CASE WHEN abs(dst) < abs(src) THEN -dst ELSE src END AS src, CASE WHEN abs(dst) < abs(src) THEN -src ELSE dst END AS dst, distance, CASE WHEN variance > 0 AND distance IS NOT NULL THEN variance END AS variance,
 coalesce(direct, 0) AS direct, coalesce(paired, 0) AS paired FROM (SELECT DISTINCT * FROM connections) q WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> 0 AND dst <> 0),
cn AS (SELECT src, dst, sum(distance / variance) / sum(1 / variance) AS distance, 1 / sum(1 / variance) AS variance, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(paired) AS BIGINT) AS paired FROM cx GROUP BY 1, 2)"""


def _connections(spark: SparkSession, d: str) -> DataFrame:
    return pairs.connections(table(spark, d, "connections").distinct())


@query(f"WITH {_CONN} SELECT src, dst, round(distance, 6) AS distance, round(variance, 6) AS variance, direct, paired FROM cn")
def connections(spark: SparkSession, d: str) -> DataFrame:
    """Links of a pair of nodes combined by inverse variance, twins included."""
    return _connections(spark, d).withColumn("distance", F.round("distance", 6)).withColumn("variance", F.round("variance", 6))


@query(
    f"""WITH {_ONE}, {SQL_PLACES}, {_PAIRS}, {_EST}, li AS (SELECT library, ins_len, greatest(CASE WHEN c > 0 THEN s // c ELSE sa // n END, 1) AS ins_var FROM v),
b AS (SELECT x.node AS src, -y.node AS dst, x.position - x."offset" AS a, y.position - y."offset" AS z, p.library FROM pr p JOIN pl x ON x.read_id = p.read_id JOIN pl y ON y.read_id = p.mate_id WHERE p.read_id < p.mate_id AND abs(x.node) <> abs(y.node)),
e AS (SELECT src, dst, ins_len - (i.length / 2 - a) - (j.length / 2 - z) AS distance, CAST(ins_var AS DOUBLE) AS variance, (i.length + j.length) / 2 AS touch FROM b JOIN n1 i ON abs(src) = i.node_id JOIN n1 j ON abs(dst) = j.node_id JOIN li USING (library))
SELECT src, dst, round(greatest(distance, touch), 4) AS distance, round(variance, 4) AS variance, count(*) AS paired FROM e WHERE distance >= touch - 6 * sqrt(variance) GROUP BY 1, 2, 3, 4"""
)
def pair_links(spark: SparkSession, d: str) -> DataFrame:
    """Distance estimates between nodes from pairs that lie on two of them."""
    libs = pairs.insert_estimates(_sizes(spark, d)).select("library", "ins_len", "ins_var")
    found = pairs.pair_links(places(spark, d), _pairs(spark, d), _one(spark, d), libs)
    return found.groupBy("src", "dst", F.round("distance", 4).alias("distance"), F.round("variance", 4).alias("variance")).agg(F.count(F.lit(1)).alias("paired"))


@query(
    f"""WITH {_ONE}, {SQL_PLACES}, b AS (SELECT x.node AS src, y.node AS dst, x.position - x."offset" AS a, y.position - y."offset" AS z FROM pl x JOIN pl y USING (read_id) WHERE abs(x.node) < abs(y.node)),
e AS (SELECT src, dst, abs(z + j.length / 2 - (a + i.length / 2)) AS distance, (i.length + j.length) / 2 AS touch FROM b JOIN n1 i ON abs(src) = i.node_id JOIN n1 j ON abs(dst) = j.node_id)
SELECT src, dst, round(greatest(distance, touch), 4) AS distance, count(*) AS direct FROM e WHERE distance - touch >= -10 GROUP BY 1, 2, 3"""
)
def read_links(spark: SparkSession, d: str) -> DataFrame:
    """Distance estimates from single reads on two nodes."""
    found = pairs.read_links(places(spark, d), _one(spark, d))
    return found.groupBy("src", "dst", F.round("distance", 4).alias("distance")).agg(F.sum("direct").alias("direct"))


_UNIQUE = f"un AS (SELECT node_id FROM n1 WHERE length > 50 AND (0.34657359027997264 + length / 60.0 * (900.0 - (cov / length) * (cov / length) / 2)) > 5)"


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d).filter(stats.unique_node(30.0)).select("node_id")


@query(f"WITH {_ONE}, {_UNIQUE}, {_CONN} SELECT src, dst, direct, paired FROM cn WHERE abs(dst) NOT IN (SELECT node_id FROM un) OR (paired + direct >= 5 AND paired >= 10 * 0.1)")
def accepted_connections(spark: SparkSession, d: str) -> DataFrame:
    """Connections that the link filter keeps, ten pairs being expected everywhere."""
    u = _unique(spark, d).select(F.col("node_id").alias("u"), F.lit(True).alias("dst_unique"))
    rows = _connections(spark, d).join(u, F.abs("dst") == F.col("u"), "left").withColumn("expected", F.lit(10).cast("bigint"))
    return pairs.accepted(rows).select("src", "dst", "direct", "paired")


#: The error function as a series of positive terms.
_ERF = "(sign({x}) * least(1.0, 2 / sqrt(pi()) * exp(-(least(abs({x}), 6.0) * least(abs({x}), 6.0))) * list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln(greatest(least(abs({x}), 6.0), 1e-300)) + j * ln(4.0) + lgamma(j + 1.0) - lgamma(2 * j + 2.0))))))"


def _ramp(c: str) -> str:
    z = f"(({c} - ins_len) / sd)"
    return f"(sd * (0.4 * exp(-{z} * {z} / 2) - {z} * (0.5 - {_ERF.format(x=f'(0.7 * {z})')} / 2)))"


_LIBS = f"""{_EST}, lb AS (SELECT library, CAST(ins_len AS DOUBLE) AS ins_len, sqrt(CAST(greatest(CASE WHEN c > 0 THEN s // c ELSE sa // n END, 1) AS DOUBLE)) AS sd FROM v WHERE library < 2)"""
_RATE = """rd AS (SELECT node_id, max(short1_nb) AS nb0, max(short2_nb) AS nb1 FROM nd GROUP BY 1)"""
_MODEL = f"""{_ONE}, {_RATE}, {_CONN}, {_LIBS}, cl AS (SELECT cn.*, i.length AS l1, j.length AS l2, CASE WHEN i.length >= j.length THEN i.node_id ELSE j.node_id END AS longer, greatest(i.length, j.length) AS ll
  FROM cn JOIN n1 i ON abs(src) = i.node_id JOIN n1 j ON abs(dst) = j.node_id WHERE distance IS NOT NULL AND greatest(i.length, j.length) > 0),
ex AS (SELECT cl.*, library, ins_len, sd, distance - (l1 + l2) / 2 AS gap, coalesce(CASE WHEN library = 0 THEN nb0 ELSE nb1 END, 0) / ll AS density FROM cl JOIN rd ON longer = rd.node_id, lb),
ev AS (SELECT src, dst, any_value(direct) AS direct, any_value(paired) AS paired, CAST(sum(floor(greatest(({_ramp('gap')} - {_ramp('(gap + l1)')} - {_ramp('(gap + l2)')} + {_ramp('(gap + l1 + l2)')}) * density, 0))) AS BIGINT) AS expected FROM ex GROUP BY 1, 2)"""


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, direct, paired, expected: pairs that the insert model of both short libraries puts across each connection."""
    one = _one(spark, d)
    ln = one.select("node_id", "length")
    rows = _connections(spark, d).filter("distance is not null").join(ln.select(F.col("node_id").alias("i1"), F.col("length").alias("l1")), F.abs("src") == F.col("i1")).join(
        ln.select(F.col("node_id").alias("i2"), F.col("length").alias("l2")), F.abs("dst") == F.col("i2")
    ).filter("greatest(l1, l2) > 0")
    reads_ = nodes(spark, d).groupBy(F.col("node_id").alias("longer")).agg(F.max("short1_nb").alias("nb0"), F.max("short2_nb").alias("nb1"))
    libs = pairs.insert_estimates(_sizes(spark, d)).filter("library < 2").select("library", F.col("ins_len").cast("double").alias("ins_len"), F.col("ins_var").cast("double").alias("ins_var"))
    rows = rows.withColumn("longer", F.when(F.col("l1") >= F.col("l2"), F.col("i1")).otherwise(F.col("i2"))).join(reads_, "longer").crossJoin(F.broadcast(libs))  # two rows
    rows = rows.withColumn("density", F.coalesce(F.when(F.col("library") == 0, F.col("nb0")).otherwise(F.col("nb1")), F.lit(0)) / F.greatest("l1", "l2"))
    return pairs.expected_links(rows).groupBy("src", "dst").agg(F.max("direct").alias("direct"), F.max("paired").alias("paired"), F.sum("expected").alias("expected"))


@query(f"WITH {_MODEL} SELECT src, dst, paired, expected, CASE WHEN paired >= expected * 0.1 THEN 'OK' ELSE 'NG' END AS verdict FROM ev")
def expected_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs a Gaussian insert model expects across each connection, and the verdict on the found ones."""
    found = _expected(spark, d)
    return found.select("src", "dst", "paired", "expected", F.when(F.col("paired") >= F.col("expected") * 0.1, "OK").otherwise("NG").alias("verdict"))


@query(f"WITH {_MODEL}, {_UNIQUE} SELECT src, dst, direct, paired, expected FROM ev WHERE abs(dst) NOT IN (SELECT node_id FROM un) OR (paired + direct >= 5 AND paired >= expected * 0.1)")
def modelled_connections(spark: SparkSession, d: str) -> DataFrame:
    """Connections that the link filter keeps against the model's expectation."""
    u = _unique(spark, d).select(F.col("node_id").alias("u"), F.lit(True).alias("dst_unique"))
    rows = _expected(spark, d).join(u, F.abs("dst") == F.col("u"), "left")
    return pairs.accepted(rows).select("src", "dst", "direct", "paired", "expected")


_NEAR = f"""{_ONE}, {_UNIQUE}, {_CONN}, tb AS (SELECT src, dst, distance, variance FROM cn WHERE variance > 0 AND distance IS NOT NULL UNION ALL SELECT -dst, -src, distance, variance FROM cn WHERE variance > 0 AND distance IS NOT NULL),
st AS (SELECT * FROM tb WHERE abs(src) IN (SELECT node_id FROM un)), al AS (SELECT src AS node, dst AS other, distance, variance FROM st UNION ALL
 SELECT m.src, t.dst, m.distance + t.distance, m.variance + t.variance FROM st m JOIN tb t ON m.dst = t.src WHERE abs(m.dst) IN (SELECT node_id FROM un) AND abs(t.dst) <> abs(m.src)),
nb AS (SELECT node, other, sum(distance / variance) / sum(1 / variance) AS distance, 1 / sum(1 / variance) AS variance FROM al GROUP BY 1, 2)"""


@query(f"WITH {_NEAR} SELECT node, other, round(distance, 5) AS distance, round(variance, 5) AS variance FROM nb")
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """Nodes around each unique node, directly or over one unique node."""
    near = pairs.neighbourhood(_connections(spark, d), _unique(spark, d))
    return near.withColumn("distance", F.round("distance", 5)).withColumn("variance", F.round("variance", 5))


@query(f"WITH {_NEAR}, a AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(distance, 6), other) AS k FROM nb WHERE abs(other) IN (SELECT node_id FROM un) AND distance > 0) SELECT node, other AS target, round(distance, 5) AS distance FROM a WHERE k = 1")
def extension_targets(spark: SparkSession, d: str) -> DataFrame:
    """The nearest unique node ahead of each unique node."""
    near = pairs.neighbourhood(_connections(spark, d), _unique(spark, d)).withColumn("distance", F.round("distance", 6))
    return pairs.nearest_unique(near, _unique(spark, d)).withColumn("distance", F.round("distance", 5))


_SCAFFOLD = f"""{_NEAR}, ah AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, other) AS k FROM nb WHERE abs(other) IN (SELECT node_id FROM un) AND distance > 0),
bt AS (SELECT node AS u, other AS v, distance FROM ah WHERE k = 1), mu AS (SELECT a.u, a.v, a.distance FROM bt a JOIN bt b ON b.u = -a.v AND b.v = -a.u WHERE abs(a.u) <> abs(a.v)),
cq AS (SELECT node_id, min(upper(regexp_replace(seq, '\\s', '', 'g'))) AS s FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
ct AS (SELECT node_id, length(s) AS bases, length(s) - 30 AS l FROM cq WHERE length(s) > 30),
lk AS (SELECT u, v, CAST(greatest(floor(distance - (i.l + j.l) / 2), 10) AS BIGINT) AS gap FROM mu JOIN ct i ON abs(u) = i.node_id JOIN ct j ON abs(v) = j.node_id)"""


@query(
    f"""WITH RECURSIVE {_SCAFFOLD}, ch AS (SELECT u AS head, u, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS gap FROM lk WHERE u NOT IN (SELECT v FROM lk) UNION ALL SELECT ch.head, lk.v, ch.rank + 1, lk.gap FROM ch JOIN lk ON lk.u = ch.u),
tl AS (SELECT head, arg_max(u, rank) AS tail FROM ch GROUP BY 1), kp AS (SELECT ch.* FROM ch JOIN tl USING (head) WHERE head <= -tail),
sc AS (SELECT abs(head) AS scaffold, sum(bases + gap) AS bases, count(CASE WHEN gap > 0 THEN 1 END) AS gaps, sum(gap) AS gap_bases FROM kp JOIN ct ON abs(u) = node_id GROUP BY head)
SELECT scaffold, CAST(bases - 30 AS BIGINT) AS length, gaps, CAST(gap_bases AS BIGINT) AS gap_bases FROM sc UNION ALL SELECT node_id, CAST(l AS BIGINT), 0, 0 FROM ct WHERE node_id NOT IN (SELECT abs(u) FROM kp)"""
)
def scaffold_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Scaffolds over contigs: length and gaps of each."""
    rows = contig_nodes(spark, d).filter("length > 0")
    made = pairs.scaffolds(rows, _connections(spark, d), _unique(spark, d), 31)
    if made is None:
        return rows.select(F.col("node_id").alias("scaffold"), "length", F.lit(0).cast("bigint").alias("gaps"), F.lit(0).cast("bigint").alias("gap_bases"))
    out, gaps, _ = made
    g = gaps.groupBy("node_id").agg(F.count(F.lit(1)).alias("gaps"), F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("gap_bases"))
    return out.join(g, "node_id", "left").select(F.col("node_id").alias("scaffold"), "length", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("gap_bases", F.lit(0)).alias("gap_bases"))


@query(
    f"""WITH {_MARKS}, st AS (SELECT node AS u, lead(node) OVER (PARTITION BY seq_id ORDER BY ord) AS v FROM mk), bt AS (SELECT u, v FROM st WHERE v IS NOT NULL AND v <> u UNION ALL SELECT -v, -u FROM st WHERE v IS NOT NULL AND v <> u),
vt AS (SELECT u, v, count(*) AS votes FROM bt GROUP BY 1, 2), ct AS (SELECT *, count(*) OVER (PARTITION BY u) AS o, count(*) OVER (PARTITION BY v) AS i FROM vt) SELECT u, v, votes, 0 AS between FROM ct WHERE o = 1 AND i = 1 AND u <> -v"""
)
def unique_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between nodes, all taken as unique, that long reads vote for on both sides, and the nodes between."""
    every = long_nodes(spark, d).select("node_id")
    return longreads.unique_links(longreads.trimmed(_markers(spark, d), every), 1).select("u", "v", "votes", F.size("inner").alias("between"))


@query(
    f"""WITH {_ONE}, {SQL_ARCS}, {SQL_BOTH}, i AS (SELECT node_id, length AS l, cov / length AS d FROM n1 WHERE length > 0),
o AS (SELECT src AS n, count(DISTINCT dst) AS c, max(d) AS hi, min(d) AS lo FROM bo JOIN i ON abs(dst) = node_id GROUP BY 1), e AS (SELECT dst AS n, count(DISTINCT src) AS c, max(d) AS hi, min(d) AS lo FROM bo JOIN i ON abs(src) = node_id GROUP BY 1),
j AS (SELECT o.n AS node_id, i.d AS density, e.hi AS in_hi, e.lo AS in_lo, o.hi AS out_hi, o.lo AS out_lo FROM o JOIN e USING (n) JOIN i ON i.node_id = o.n WHERE o.c = 2 AND e.c = 2 AND o.n > 0),
k AS (SELECT *, CASE WHEN abs(in_hi - 40) <= abs(in_hi - 12) THEN 40 ELSE 12 END AS a, CASE WHEN abs(in_lo - 40) <= abs(in_lo - 12) THEN 40 ELSE 12 END AS b, CASE WHEN abs(out_hi - 40) <= abs(out_hi - 12) THEN 40 ELSE 12 END AS c, CASE WHEN abs(out_lo - 40) <= abs(out_lo - 12) THEN 40 ELSE 12 END AS f, (in_hi + in_lo + out_hi + out_lo) / 2 AS m FROM j)
SELECT node_id, round(density, 6) AS density, round(in_hi, 6) AS in_hi, round(in_lo, 6) AS in_lo, round(out_hi, 6) AS out_hi, round(out_lo, 6) AS out_lo, CAST(a AS DOUBLE) AS primary_level, CAST(b AS DOUBLE) AS secondary_level, (a = c AND b = f AND a <> b AND abs(density - m) <= 0.5 * m) AS split FROM k"""
)
def repeat_splits(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and decision for every node with two ways in and two out, at levels 40 and 12."""
    rows = meta.repeat_splits(_one(spark, d), arcs(spark, d), [40.0, 12.0], sd=0.5)
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("node_id", r("density"), r("in_hi"), r("in_lo"), r("out_hi"), r("out_lo"), "primary_level", "secondary_level", "split")


@query(
    f"""WITH {_ONE}, {SQL_ARCS}, {SQL_BOTH}, i AS (SELECT node_id, length AS l, cov / length AS d FROM n1 WHERE length > 0),
o AS (SELECT src AS n, count(DISTINCT dst) AS c, max(d) AS hi, min(d) AS lo, arg_min(dst, (d, dst)) AS second FROM bo JOIN i ON abs(dst) = node_id GROUP BY 1), e AS (SELECT dst AS n, count(DISTINCT src) AS c, max(d) AS hi, min(d) AS lo, arg_min(src, (d, src)) AS second FROM bo JOIN i ON abs(src) = node_id GROUP BY 1),
j AS (SELECT o.n AS node_id, i.d AS density, e.hi AS in_hi, e.lo AS in_lo, o.hi AS out_hi, o.lo AS out_lo, e.second AS ent, o.second AS ext FROM o JOIN e USING (n) JOIN i ON i.node_id = o.n WHERE o.c = 2 AND e.c = 2 AND o.n > 0),
q AS (SELECT *, abs(in_hi - 40) <= abs(in_hi - 12) AS a, abs(in_lo - 40) <= abs(in_lo - 12) AS b, abs(out_hi - 40) <= abs(out_hi - 12) AS c, abs(out_lo - 40) <= abs(out_lo - 12) AS f, (in_hi + in_lo + out_hi + out_lo) / 2 AS m FROM j),
y AS (SELECT node_id, ent, ext, row_number() OVER (ORDER BY node_id) + (SELECT max(node_id) FROM n1) AS twin FROM q WHERE a = c AND b = f AND a <> b AND abs(density - m) <= 0.5 * m),
mv AS (SELECT ent AS a, node_id AS b, ent AS s2, twin AS d2 FROM y UNION SELECT node_id, ext, twin, ext FROM y), tw AS (SELECT * FROM mv UNION SELECT -b, -a, -d2, -s2 FROM mv),
rn AS (SELECT coalesce(s2, src) AS s, coalesce(d2, dst) AS t, mult FROM ar LEFT JOIN tw ON src = a AND dst = b),
ca AS (SELECT s, t, mult, (abs(t) < abs(s) OR (abs(t) = abs(s) AND s < 0 AND t < 0)) AS f FROM rn)
SELECT CASE WHEN f THEN -t ELSE s END AS src, CASE WHEN f THEN -s ELSE t END AS dst, CAST(sum(mult) AS BIGINT) AS mult FROM ca GROUP BY 1, 2"""
)
def repeats_split(spark: SparkSession, d: str) -> DataFrame:
    """Arcs after the accepted repeats became two nodes each."""
    one = _one(spark, d)
    decided = meta.repeat_splits(one, arcs(spark, d), [40.0, 12.0], sd=0.5)
    return meta.split_repeats(one, arcs(spark, d), decided)[1]


@query(
    f"""WITH {_ONE}, x AS (SELECT assembly AS g, length, cov FROM nd WHERE length > 0 AND assembly IS NOT NULL),
s AS (SELECT g, sum(length) AS t, sum(CASE WHEN abs(cov / length - 40) <= abs(cov / length - 12) THEN length ELSE 0 END) AS p FROM x GROUP BY 1)
SELECT g AS group_id, CAST(t AS BIGINT) AS length, round(p / t, 6) AS primary_share, (p / t > 0.1 AND (t - p) / t > 0.1) AS chimeric FROM s"""
)
def chimera_tests(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).filter("assembly is not null").withColumn("group_id", F.col("assembly"))
    out = meta.chimera(rows, 40.0, 12.0, 0.1)
    return out.select("group_id", "length", F.round("primary_share", 6).alias("primary_share"), "chimeric")


@query(
    f"""WITH {SQL_ARCS}, q AS (SELECT node_id, min(upper(regexp_replace(seq, '\\s', '', 'g'))) AS s FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL GROUP BY 1)
SELECT 'node' AS kind, node_id AS a, CAST(length(s) - 30 AS BIGINT) AS b, CAST(1 AS BIGINT) AS n, md5(substr(s, 31)) AS digest, md5(substr(translate(reverse(s), 'ACGTN', 'TGCAA'), 31)) AS twin FROM q WHERE length(s) > 30 UNION ALL SELECT 'arc', src, dst, mult, NULL, NULL FROM ar"""
)
def graph_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and arcs written in the graph's text form and read back."""
    path = new_path(spark, "graph")
    sinks.write_lines(sinks.graph(contig_nodes(spark, d).filter("length > 0"), arcs(spark, d), 31), path, ["part", "a", "b"])
    n, a = seqreads.graph_file(spark, path)
    none = F.lit(None).cast("string")
    return n.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("length").alias("b"), F.col("cov").alias("n"), F.md5("tail").alias("digest"), F.md5("twin_tail").alias("twin")).unionByName(
        a.select(F.lit("arc").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("mult").alias("n"), none.alias("digest"), none.alias("twin"))
    )


@query(
    """WITH RECURSIVE l AS (SELECT abs(pre_node_left) AS a, abs(pre_node_right) AS b FROM prearcs WHERE pre_node_left <> 0 AND pre_node_right <> 0),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l UNION SELECT b, b FROM l),
c(node_id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.g FROM c JOIN e ON e.a = c.node_id WHERE e.b > c.g)
SELECT node_id, min(g) AS part FROM c GROUP BY 1"""
)
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected parts of the pre-graph."""
    return traverse.parts(arcs(spark, d))


@query(
    f"""WITH RECURSIVE {_ONE}, {SQL_ARCS}, lv AS (SELECT node_id, length, cov, CASE WHEN abs(cov / length - 40) <= abs(cov / length - 12) THEN 40 ELSE 12 END AS level FROM n1 WHERE length > 0),
le AS (SELECT x.level, abs(src) AS a, abs(dst) AS b FROM ar JOIN lv x ON x.node_id = abs(src) JOIN lv y ON y.node_id = abs(dst) WHERE x.level = y.level),
e AS (SELECT a, b FROM le UNION SELECT b, a FROM le UNION SELECT node_id, node_id FROM lv),
c(node_id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.g FROM c JOIN e ON e.a = c.node_id WHERE e.b > c.g), p AS (SELECT node_id, min(g) AS part FROM c GROUP BY 1)
SELECT CAST(level AS DOUBLE) AS level, CASE WHEN level = 40 THEN 1 ELSE 2 END AS place, part, count(*) AS nodes, CAST(sum(length) AS BIGINT) AS length, CAST(sum(cov) AS BIGINT) AS cov FROM lv JOIN p USING (node_id) GROUP BY 1, 2, 3"""
)
def level_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected parts of each coverage level, highest first."""
    return meta.level_parts(_one(spark, d), arcs(spark, d), [40.0, 12.0])


@query(
    f"""WITH RECURSIVE {_ONE}, {SQL_ARCS}, {SQL_BOTH}, s AS (SELECT node_id AS n FROM n1 WHERE length < 30), lg AS (SELECT node_id FROM n1 WHERE length >= 500),
st AS (SELECT 3 AS side, n FROM s UNION ALL SELECT 5, -n FROM s),
w AS (SELECT side, n AS start, n AS cur, [abs(n)] AS p, false AS e FROM st UNION ALL
 SELECT w.side, w.start, bo.dst, list_append(w.p, abs(bo.dst)), abs(bo.dst) IN (SELECT node_id FROM lg) FROM w JOIN bo ON bo.src = w.cur WHERE NOT w.e AND NOT list_contains(w.p, abs(bo.dst)))
SELECT DISTINCT abs(start) AS node_id, side, abs(cur) AS flank FROM w WHERE e"""
)
def insertion_flanks_all(spark: SparkSession, d: str) -> DataFrame:
    """Long nodes first met on loop-free walks on either side of every short node."""
    one = _one(spark, d)
    return traverse.flanks(one, arcs(spark, d), one.filter("length < 30").select("node_id"), 500)


@query()
def walk_choice(spark: SparkSession, d: str) -> DataFrame:
    """The shortest loop-free walk from each unique node to another one, where there is a single nearest."""
    u = _unique(spark, d)
    starts = u.select(F.explode(F.array(F.col("node_id"), -F.col("node_id"))).alias("node"))
    return traverse.best_paths(traverse.nearest_paths(arcs(spark, d), starts, u)).select("start", "stop", F.size("path").alias("nodes"))


@query(f"WITH {SQL_ARCS}, n AS (SELECT DISTINCT node_id FROM contigs WHERE node_id IS NOT NULL) SELECT src, dst, mult FROM ar WHERE abs(src) IN (SELECT node_id FROM n) AND abs(dst) IN (SELECT node_id FROM n)")
def projected_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Arcs between the nodes that have a contig."""
    return traverse.subgraph(_one(spark, d), arcs(spark, d), table(spark, d, "contigs").select("node_id"))[1]


@query(
    f"""WITH RECURSIVE {SQL_ARCS}, {SQL_BOTH}, q AS (SELECT node_id, min(upper(regexp_replace(seq, '\\s', '', 'g'))) AS s FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL GROUP BY 1), sq AS (SELECT * FROM q WHERE length(s) > 30),
o AS (SELECT src FROM bo GROUP BY 1 HAVING count(*) = 1), i AS (SELECT dst FROM bo GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT bo.src AS u, bo.dst AS v FROM bo JOIN o USING (src) JOIN i USING (dst) WHERE bo.src <> bo.dst AND bo.src <> -bo.dst AND abs(bo.src) IN (SELECT node_id FROM sq) AND abs(bo.dst) IN (SELECT node_id FROM sq)),
c AS (SELECT u AS head, u, CAST(0 AS BIGINT) AS rank FROM l WHERE u NOT IN (SELECT v FROM l) UNION ALL SELECT c.head, l.v, c.rank + 1 FROM c JOIN l ON l.u = c.u),
t AS (SELECT head, arg_max(u, rank) AS tail FROM c GROUP BY 1), k AS (SELECT c.* FROM c JOIN t USING (head) WHERE head <= -tail),
z AS (SELECT head, rank, CASE WHEN u > 0 THEN s ELSE translate(reverse(s), 'ACGTN', 'TGCAA') END AS s FROM k JOIN sq ON node_id = abs(u)),
m AS (SELECT abs(head) AS node_id, string_agg(CASE WHEN rank = 0 THEN s ELSE substr(s, 31) END, '' ORDER BY rank) AS s, count(*) AS cov FROM z GROUP BY head)
SELECT node_id, CAST(length(s) - 30 AS BIGINT) AS length, CAST(cov AS BIGINT) AS cov, md5(s) AS digest FROM m UNION ALL SELECT node_id, length(s) - 30, 1, md5(s) FROM sq WHERE node_id NOT IN (SELECT abs(u) FROM k)"""
)
def bypassed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Contigs merged along simple links of the pre-graph."""
    rows = contig_nodes(spark, d).filter("length > 0")
    both = rows.select(F.explode(F.array(F.col("node_id"), -F.col("node_id"))).alias("n"))
    links = graph.simple_links(arcs(spark, d)).join(both.select(F.col("n").alias("u")), "u", "left_semi").join(both.select(F.col("n").alias("v")), "v", "left_semi")
    return traverse.bypass(rows, links, 31).select("node_id", "length", "cov", F.md5("seq").alias("digest"))


@query(
    f"""WITH r AS (SELECT DISTINCT read_id, length(seq) AS n, md5(regexp_replace(upper(seq), '[^ACGT]', 'A', 'g')) AS digest FROM read_set WHERE read_id IS NOT NULL AND seq IS NOT NULL AND length(seq) >= 31)
SELECT read_id AS node_id, CAST(n - 30 AS BIGINT) AS length, digest FROM r"""
)
def pregraph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pre-nodes written in their text form and read back."""
    rows = reads(spark, d).filter("length(seq) >= 31").select(F.col("read_id").alias("node_id"), (F.length("seq") - 30).cast("bigint").alias("length"), "seq").distinct()
    path = new_path(spark, "pregraph")
    sinks.write_lines(sinks.pregraph(rows), path, ["node_id"])
    return seqreads.pregraph_file(spark, path).select("node_id", "length", F.md5("seq").alias("digest"))


@query(
    f"WITH {_ROAD} SELECT read_id, CAST(ord AS BIGINT) AS ord, any_value(target) AS target, CAST(min(written) AS BIGINT) AS position, arg_min(coord, pos) AS start, arg_max(coord, pos) + any_value(CASE WHEN target > 0 THEN 1 ELSE -1 END) AS finish FROM ho WHERE NOT novel GROUP BY read_id, ord"
)
def roadmaps_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Roadmaps written in their text form and read back."""
    rows = reads(spark, d)
    made = hashing.roadmaps(hashing.kmer_rows(rows, 21, packed=True))
    path = new_path(spark, "roadmaps")
    sinks.write_lines(sinks.roadmaps(made, rows.select("read_id").distinct()), path, ["read_id", "ord"])
    return seqreads.roadmaps_file(spark, path).withColumn("ord", F.col("ord").cast("bigint"))


@query(
    f"""WITH {_STARTS} SELECT read_id, node, CAST(CASE WHEN n > 1 THEN -1 WHEN node > 0 THEN o ELSE length(s) - 31 - o END AS BIGINT) AS position, CAST(p AS BIGINT) AS "offset" FROM ks JOIN cg ON cg.node_id = abs(node)"""
)
def connected_graph_starts(spark: SparkSession, d: str) -> DataFrame:
    """Read starts on a graph that was built elsewhere: nodes and arcs as given."""
    every = reads(spark, d).select("read_id", "category", "seq")
    return seqreads.connected_graph(long_nodes(spark, d), arcs(spark, d), every, 31)[2].select("read_id", "node", "position", "offset")


#: A sequence in lines of 60, without a last line break.
_LINES = "regexp_replace(regexp_replace({x}, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10) || '$', '')"


@query(
    f"""WITH {SQL_PLACES}, {SQL_READS}, {_PAIRS}, {_EST}, li AS (SELECT library, ins_len, greatest(CASE WHEN c > 0 THEN s // c ELSE sa // n END, 1) AS ins_var FROM v),
sq AS (SELECT node_id, min(upper(regexp_replace(seq, '\\s', '', 'g'))) AS s FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
te AS (SELECT abs(node) AS node_id, string_agg('{{TLE' || chr(10) || 'src:' || read_id || chr(10) || 'off:' || position || chr(10) || 'clr:0,100' || chr(10) || '}}', chr(10) ORDER BY position, read_id) AS t FROM pl GROUP BY 1),
al AS (SELECT 0 AS part, '{{LIB' || chr(10) || 'iid:' || (library + 1) || chr(10) || '{{DST' || chr(10) || 'mea:' || CAST(ins_len AS BIGINT) || chr(10) || 'std:' || CAST(floor(sqrt(ins_var)) AS BIGINT) || chr(10) || '}}' || chr(10) || '}}' AS line FROM li
UNION ALL SELECT 1, '{{FRG' || chr(10) || 'iid:' || read_id || chr(10) || 'lib:' || (library + 1) || chr(10) || 'typ:I' || chr(10) || 'rds:' || read_id || ',' || mate_id || chr(10) || '}}' FROM pr WHERE read_id < mate_id
UNION ALL SELECT 2, '{{RED' || chr(10) || 'iid:' || read_id || chr(10) || 'eid:' || read_id || chr(10) || 'seq:' || chr(10) || {_LINES.format(x='s')} || chr(10) || '.' || chr(10) || 'qlt:' || chr(10) || {_LINES.format(x='s')} || chr(10) || '.' || chr(10) || '}}' FROM r
UNION ALL SELECT 3, '{{CTG' || chr(10) || 'iid:' || node_id || chr(10) || 'eid:' || node_id || '-0' || chr(10) || 'seq:' || chr(10) || {_LINES.format(x='s')} || chr(10) || '.' || chr(10) || 'qlt:' || chr(10) || {_LINES.format(x='s')} || chr(10) || '.' || chr(10) || coalesce(t, '') || chr(10) || '}}' FROM sq LEFT JOIN te USING (node_id))
SELECT part, md5(line) AS digest, count(*) AS n FROM al GROUP BY 1, 2"""
)
def amos_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the AMOS export."""
    p = places(spark, d)
    tiles = p.select(F.abs("node").alias("node_id"), "read_id", F.col("position").alias("off"), F.lit(0).alias("clear_start"), F.lit(100).alias("clear_stop"))
    libs = pairs.insert_estimates(_sizes(spark, d))
    lines = sinks.amos(contig_nodes(spark, d).select("node_id", "seq"), tiles, reads(spark, d), libs, _pairs(spark, d))
    return lines.groupBy("part", F.md5("line").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_MARKS}, ar AS (SELECT DISTINCT read_id AS ref_id, 'r' || read_id AS name, read_id % 2 = 0 AS positive FROM read_set WHERE read_id IS NOT NULL),
al AS (SELECT abs(node) AS node_id, node > 0 AS fwd, start_off, finish - start + 30 AS span, length(s) - 30 AS l, name, positive, start FROM mk JOIN ar ON seq_id = ref_id JOIN cg ON cg.node_id = abs(node) WHERE length(s) > 30)
SELECT node_id, CAST(CASE WHEN fwd THEN start_off + 1 ELSE start_off + 31 END AS BIGINT) AS node_start, CAST(CASE WHEN fwd THEN start_off + span ELSE start_off + 31 - span + 1 END AS BIGINT) AS node_stop, name AS reference,
CAST(CASE WHEN positive THEN 1 + start ELSE 10000 - start END AS BIGINT) AS ref_start, CAST(CASE WHEN positive THEN start + span ELSE 10000 - start - span + 1 END AS BIGINT) AS ref_stop FROM al"""
)
def contig_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of long reads, as reference segments of either strand, on nodes: the four strand cases."""
    heads = table(spark, d, "read_set").filter("read_id is not null").select(F.col("read_id").alias("ref_id"), F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("name")).distinct()
    areas = heads.select("ref_id", "name", (F.col("ref_id") % 2 == 0).alias("positive"), F.lit(1).cast("bigint").alias("region_start"), F.lit(10000).cast("bigint").alias("region_finish"))
    return sinks.alignments(_markers(spark, d), areas, long_nodes(spark, d), 1, 31)


@query()
def branch_tours(spark: SparkSession, d: str) -> DataFrame:
    """Walks from one branching node that meet again: the candidates of bubble removal, with nodes of the pre-graph."""
    return graph.tours(_one(spark, d).filter("length > 0"), arcs(spark, d), 100).select("start", "stop", F.size("fast").alias("fast"), F.size("slow").alias("slow"))


@query(
    f"""WITH {SQL_THREADS}, sp AS (SELECT abs(node) AS node_id, min(off) AS a, max(off) + 31 AS b FROM kt WHERE category < 4 GROUP BY read_id, abs(node)),
ev AS (SELECT node_id, a AS p, 1 AS step FROM sp UNION ALL SELECT node_id, b, -1 FROM sp UNION ALL SELECT node_id, 0, 0 FROM cg UNION ALL SELECT node_id, length(s), 0 FROM cg WHERE length(s) > 30),
es AS (SELECT node_id, p, sum(step) AS step FROM ev GROUP BY 1, 2), dp AS (SELECT *, sum(step) OVER w AS depth, lead(p) OVER w AS nxt FROM es WINDOW w AS (PARTITION BY node_id ORDER BY p)),
lw AS (SELECT *, depth < 2 AS low, lag(depth < 2) OVER (PARTITION BY node_id ORDER BY p) AS before FROM dp WHERE nxt IS NOT NULL), rn AS (SELECT *, sum(CASE WHEN low AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY p) AS run FROM lw)
SELECT node_id, CAST(min(p) AS BIGINT) AS start, CAST(max(nxt) AS BIGINT) AS stop FROM rn WHERE low GROUP BY node_id, run"""
)
def low_coverage_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of nodes (long reads) with fewer than two short reads on them."""
    return low_spans(kmer_threads(spark, d).filter("category < 4"), long_nodes(spark, d), 2, 31).select("node_id", "start", "stop")


@query(
    """WITH cq AS (SELECT node_id, min(upper(regexp_replace(seq, '\\s', '', 'g'))) AS s FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL GROUP BY 1), c AS (SELECT *, length(s) - 30 AS l FROM cq WHERE length(s) - 30 >= 62)
SELECT node_id, printf('NODE_%d_length_%d_cov_%.6f', node_id, l, 1.0 / l) AS name, md5(substr(s, 1, 40) || lower(substr(s, 41, 10)) || 'NNNNN' || lower(substr(s, 56, 5)) || substr(s, 61)) AS digest FROM c"""
)
def contig_records(spark: SparkSession, d: str) -> DataFrame:
    """Contig records with low coverage in lower case and gaps as N; the two spans are the same in every contig."""
    nodes_ = contig_nodes(spark, d)
    span = lambda a, b: nodes_.select("node_id", F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("stop"))
    return sinks.contigs(nodes_, 62, 31, span(50, 55), span(40, 60)).select("node_id", "name", F.md5("seq").alias("digest"))
