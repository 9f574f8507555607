"""Views of the given tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..runtime import table

K = 21

#: Reads as the graph sees them: one row a read, upper case, other letters A.
SQL_READS = """r AS (SELECT DISTINCT read_id, category, second_in_pair, library, mate_id, regexp_replace(upper(seq), '[^ACGT]', 'A', 'g') AS s
  FROM read_set WHERE seq IS NOT NULL AND read_id IS NOT NULL)"""


def sql_kmers(k: int = K) -> str:
    """read_id, category, pos, kmer, fwd."""
    return f"""{SQL_READS},
w AS (SELECT read_id, category, p AS pos, substr(s, p + 1, {k}) AS word FROM (SELECT * FROM r WHERE length(s) >= {k}) q, unnest(range(0, length(s) - {k} + 1)) t(p)),
km AS (SELECT read_id, category, pos, word, least(word, translate(reverse(word), 'ACGT', 'TGCA')) AS kmer, word <= translate(reverse(word), 'ACGT', 'TGCA') AS fwd FROM w)"""


def reads(spark: SparkSession, d: str) -> DataFrame:
    """read_id, category, second_in_pair, library, mate_id, seq; a read delivered again counts once."""
    return (
        table(spark, d, "read_set")
        .filter("seq is not null and read_id is not null")
        .select("read_id", "category", "second_in_pair", "library", "mate_id", dna.bases(F.col("seq")).alias("seq"))
        .distinct()
    )


#: Nodes of all assemblies, each given once; coverages without a finite value count as nought.
SQL_NODES = """nd AS (SELECT DISTINCT assembly, node_id, lgth AS length, out_nb, in_nb,
  CASE WHEN isfinite(short1_cov) THEN CAST(floor(short1_cov * lgth + 0.5) AS BIGINT) ELSE 0 END AS cov,
  CASE WHEN isfinite(short2_cov) THEN CAST(floor(short2_cov * lgth + 0.5) AS BIGINT) ELSE 0 END AS cov2,
  CASE WHEN isfinite(long_cov) THEN CAST(floor(long_cov * lgth + 0.5) AS BIGINT) ELSE 0 END AS long_cov,
  short1_nb, short2_nb, long_nb
  FROM node_stats WHERE node_id IS NOT NULL AND lgth IS NOT NULL)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def whole(c: str):
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(ok, F.floor(F.col(c) * F.col("lgth") + 0.5)).otherwise(0).cast("bigint")

    return (
        table(spark, d, "node_stats")
        .filter("node_id is not null and lgth is not null")
        .select(
            "assembly", "node_id", F.col("lgth").alias("length"), "out_nb", "in_nb", whole("short1_cov").alias("cov"), whole("short2_cov").alias("cov2"),
            whole("long_cov").alias("long_cov"), "short1_nb", "short2_nb", "long_nb",
        )
        .distinct()
    )


#: Arcs of the pre-graph, an arc and its twin summed.
SQL_ARCS = """ar AS (SELECT a AS src, b AS dst, CAST(sum(m) AS BIGINT) AS mult FROM (
  SELECT CASE WHEN tw THEN -r ELSE l END AS a, CASE WHEN tw THEN -l ELSE r END AS b, m FROM (
    SELECT pre_node_left AS l, pre_node_right AS r, coalesce(mult, 0) AS m,
      (abs(pre_node_right) < abs(pre_node_left) OR (abs(pre_node_right) = abs(pre_node_left) AND pre_node_left < 0 AND pre_node_right < 0)) AS tw
    FROM prearcs WHERE pre_node_left IS NOT NULL AND pre_node_right IS NOT NULL AND pre_node_left <> 0 AND pre_node_right <> 0) x) y GROUP BY 1, 2)"""
SQL_BOTH = """bo AS (SELECT src, dst, mult FROM ar UNION ALL SELECT -dst, -src, mult FROM ar WHERE src <> -dst)"""


def arcs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import canonical_arcs

    return canonical_arcs(table(spark, d, "prearcs").select(F.col("pre_node_left").alias("src"), F.col("pre_node_right").alias("dst"), "mult"))


#: Places of reads on nodes, out of their mappings: second mates lie on the other strand. A read's k-mers (k = 31)
#: follow each other on the node from the mapped position on.
SQL_PLACES = """mp AS (SELECT DISTINCT read_id, n, x.ref_id * (CASE WHEN coalesce(second_in_pair, false) THEN -1 ELSE 1 END) AS node, x.pos AS p FROM (
    SELECT read_id, length(seq) AS n, second_in_pair, unnest(mappings) AS x FROM read_set WHERE read_id IS NOT NULL AND seq IS NOT NULL) q WHERE x.ref_id IS NOT NULL AND x.pos IS NOT NULL),
th AS (SELECT read_id, i AS pos, node, p + i AS off FROM (SELECT read_id, n, node, min(p) AS p FROM mp WHERE n >= 31 GROUP BY 1, 2, 3) m, unnest(range(0, n - 30)) t(i)),
pl AS (SELECT read_id, node, min(off) AS position, min(pos) AS "offset" FROM th GROUP BY 1, 2)"""


def threads(spark: SparkSession, d: str) -> DataFrame:
    """read_id, pos, node, off: the read's k-mers (k = 31) on the nodes it is mapped to."""
    rows = table(spark, d, "read_set").filter("read_id is not null and seq is not null").select(
        "read_id", F.length("seq").alias("n"), "second_in_pair", F.explode("mappings").alias("x")
    )
    node = F.col("x.ref_id") * F.when(F.coalesce("second_in_pair", F.lit(False)), -1).otherwise(1)
    spots = rows.filter("n >= 31 and x.ref_id is not null and x.pos is not null").groupBy("read_id", "n", node.alias("node")).agg(F.min("x.pos").alias("p"))
    return spots.select("read_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 31)).alias("pos"), "node", "p").select(
        "read_id", "pos", "node", (F.col("p") + F.col("pos")).alias("off")
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).groupBy("read_id", "node").agg(F.min("off").alias("position"), F.min("pos").alias("offset"))


#: K-mers of reads (k = 31) on the long reads, taken as the graph's nodes: a k-mer that stands there more than once counts at its
#: first place. Reads start at their first hit and end at the first miss after it.
SQL_THREADS = f"""{sql_kmers(31)},
cg AS (SELECT read_id AS node_id, min(upper(seq)) AS s FROM read_set WHERE seq IS NOT NULL AND read_id IS NOT NULL AND category >= 4 GROUP BY 1),
cb AS (SELECT node_id, a, substr(s, a + 1, 2030) AS t FROM cg, unnest(range(0, length(s), 2000)) u(a)),
cw AS (SELECT node_id, a + p AS off, substr(t, p + 1, 31) AS word FROM (SELECT * FROM cb WHERE length(t) >= 31) q, unnest(range(0, least(2000, length(t) - 30))) v(p)),
cc AS (SELECT node_id, off, word, translate(reverse(word), 'ACGT', 'TGCA') AS rc FROM cw WHERE regexp_full_match(word, '[ACGT]{{31}}')),
ck AS (SELECT least(word, rc) AS kmer, CASE WHEN word <= rc THEN node_id ELSE -node_id END AS node, off, row_number() OVER (PARTITION BY least(word, rc) ORDER BY node_id, off) AS place FROM cc),
hk AS (SELECT km.read_id, km.category, km.pos, CASE WHEN fwd THEN node ELSE -node END AS node, off FROM km LEFT JOIN (SELECT * FROM ck WHERE place = 1) c USING (kmer)),
hs AS (SELECT *, max(CASE WHEN node IS NULL THEN 0 ELSE 1 END) OVER w AS seen FROM hk WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
hm AS (SELECT *, sum(CASE WHEN seen = 1 AND node IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos) AS missed FROM hs),
kt AS (SELECT read_id, category, pos, node, off FROM hm WHERE seen = 1 AND missed = 0)"""


def contig_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The contigs as nodes: node_id, length (k = 31), cov 1, seq without white space, upper case."""
    rows = table(spark, d, "contigs").filter("seq is not null and node_id is not null")
    seqs = rows.groupBy("node_id").agg(F.min(F.upper(F.regexp_replace("seq", r"\s", ""))).alias("seq"))
    return seqs.select("node_id", (F.length("seq") - 30).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("cov"), "seq")


def long_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The long reads as nodes: node_id, length (k = 31), cov 1, seq in upper case."""
    rows = table(spark, d, "read_set").filter("seq is not null and read_id is not null and category >= 4")
    seqs = rows.groupBy(F.col("read_id").alias("node_id")).agg(F.min(F.upper("seq")).alias("seq"))
    return seqs.select("node_id", (F.length("seq") - 30).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("cov"), "seq")


def kmer_threads(spark: SparkSession, d: str) -> DataFrame:
    """read_id, category, pos, node, off of reads threaded over the long reads."""
    from ..operators.graph import thread

    return thread(reads(spark, d).select("read_id", "category", "seq"), long_nodes(spark, d), 31)
