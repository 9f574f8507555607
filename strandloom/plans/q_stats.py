"""Coverage and length statistics, filters, optimisers and result utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import meta, stats, tools
from ..runtime import table
from ..sources import sinks
from .common import SQL_ARCS, SQL_BOTH, SQL_NODES, arcs, nodes
from .registry import query


def _r(c, n: int = 6):
    return F.round(c, n)


@query(
    f"""WITH {SQL_NODES}, d AS (SELECT *, cov / length AS density FROM nd WHERE length > 0),
t AS (SELECT assembly, sum(length) // 2 AS half FROM d GROUP BY 1),
c AS (SELECT d.*, sum(length) OVER (PARTITION BY assembly ORDER BY density, length, node_id ROWS UNBOUNDED PRECEDING) AS cum FROM d)
SELECT c.assembly, round(arg_min(density, cum), 6) AS median_coverage FROM c JOIN t ON c.assembly IS NOT DISTINCT FROM t.assembly WHERE cum >= half GROUP BY 1"""
)
def weighted_median_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Length-weighted median coverage of each assembly."""
    return stats.weighted_median_coverage(nodes(spark, d), ["assembly"]).select("assembly", _r("median_coverage").alias("median_coverage"))


@query(
    f"""WITH {SQL_NODES}, d AS (SELECT *, cov / length AS density FROM nd WHERE length > 0), t AS (SELECT sum(length) // 2 AS half FROM d),
c AS (SELECT d.*, sum(length) OVER (ORDER BY density, length, node_id, assembly ROWS UNBOUNDED PRECEDING) AS cum FROM d)
SELECT round(min(density), 6) AS median_coverage FROM c, t WHERE cum >= half"""
)
def weighted_median_coverage_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over all nodes at once, without a window over the whole table."""
    return stats.weighted_median_coverage(nodes(spark, d)).select(_r("median_coverage").alias("median_coverage"))


def _n50_sql(order: str) -> str:
    return f"""WITH {SQL_NODES}, t AS (SELECT assembly, sum(length) // 2 AS half FROM nd GROUP BY 1),
c AS (SELECT assembly, length, sum(length) OVER (PARTITION BY assembly ORDER BY length {order} ROWS UNBOUNDED PRECEDING) AS cum FROM nd)
SELECT c.assembly, CAST({'min' if not order else 'max'}(length) AS BIGINT) AS n50 FROM c JOIN t ON c.assembly IS NOT DISTINCT FROM t.assembly WHERE cum >= half GROUP BY 1"""


@query(_n50_sql(""))
def n50_ascending(spark: SparkSession, d: str) -> DataFrame:
    return stats.n50(nodes(spark, d), by=["assembly"])


@query(_n50_sql("DESC"))
def n50_descending(spark: SparkSession, d: str) -> DataFrame:
    return stats.n50(nodes(spark, d), descending=True, by=["assembly"])


@query(f"WITH {SQL_NODES} SELECT assembly, count(*) AS nodes, max(length) AS longest, CAST(sum(length) AS BIGINT) AS total_length FROM nd GROUP BY 1")
def node_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(nodes(spark, d), ["assembly"])


@query(
    f"WITH {SQL_NODES} SELECT assembly, node_id, cov, cov2, cov + cov2 AS total_cov, CASE WHEN length > 0 THEN round((cov + cov2) / length, 6) END AS density FROM nd WHERE length > 500"
)
def node_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of long nodes over all short libraries."""
    rows = nodes(spark, d).filter("length > 500").withColumn("total_cov", F.col("cov") + F.col("cov2"))
    return rows.select("assembly", "node_id", "cov", "cov2", "total_cov", _r(stats.density("total_cov")).alias("density"))


@query(f"WITH {SQL_NODES} SELECT assembly, node_id, length, cov FROM nd WHERE length > 0 AND cov // length < 4")
def low_coverage_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below a coverage cutoff, by whole division: 3.9 fails a cutoff of 4, 4.0 passes."""
    return stats.low_coverage(nodes(spark, d), 4).select("assembly", "node_id", "length", "cov")


@query(
    f"WITH {SQL_NODES} SELECT assembly, node_id FROM nd WHERE length > 0 AND long_cov // length < 2 AND node_id NOT IN (SELECT abs(src) FROM connections WHERE direct > 0 AND src IS NOT NULL)"
)
def low_long_coverage_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Low long-read coverage, but nodes with a direct connection are spared."""
    rows = nodes(spark, d).drop("cov").withColumnRenamed("long_cov", "cov")
    spared = table(spark, d, "connections").filter("direct > 0 and src is not null").select(F.abs("src").alias("node_id"))
    return stats.low_coverage(rows, 2, spared).select("assembly", "node_id")


@query(f"WITH {SQL_NODES} SELECT assembly, node_id, cov FROM nd WHERE length > 0 AND cov // length > 60")
def high_coverage_nodes(spark: SparkSession, d: str) -> DataFrame:
    return stats.high_coverage(nodes(spark, d), 60).select("assembly", "node_id", "cov")


@query(
    f"WITH {SQL_NODES} SELECT assembly, node_id FROM nd WHERE length > 0 AND (cov / length < 3 OR long_cov / length < 1) AND node_id IN (SELECT node_id FROM contigs)"
)
def low_reference_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a reference marker (here: with a contig) whose density is too low."""
    marked = table(spark, d, "contigs").select("node_id").distinct()
    low = (F.col("cov") / F.col("length") < 3) | (F.col("long_cov") / F.col("length") < 1)
    return nodes(spark, d).filter("length > 0").filter(low).join(marked, "node_id", "left_semi").select("assembly", "node_id")


@query(f"WITH {SQL_ARCS} SELECT src, dst, mult FROM ar")
def canonical_arcs(spark: SparkSession, d: str) -> DataFrame:
    """An arc and its twin as one, multiplicities summed."""
    return arcs(spark, d)


@query(f"WITH {SQL_ARCS} SELECT src, dst, mult FROM ar WHERE mult > 2")
def low_arcs_removed(spark: SparkSession, d: str) -> DataFrame:
    return stats.low_arcs(arcs(spark, d), 2)


@query(
    f"WITH {SQL_ARCS}, {SQL_BOTH} SELECT src AS node_id, CAST(sum(CASE WHEN src = -dst THEN 2 ELSE 1 END) AS BIGINT) AS arc_count, count(*) AS simple_arc_count, CAST(sum(mult) AS BIGINT) AS out_mult FROM bo GROUP BY 1"
)
def arc_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.arc_counts(arcs(spark, d))


@query(
    f"""WITH {SQL_NODES} SELECT assembly, CAST(floor((cov / length) / 1.0) AS BIGINT) AS bin, CAST(sum(length) AS BIGINT) AS length FROM nd WHERE length > 0 GROUP BY 1, 2"""
)
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(nodes(spark, d), 1.0, F.col("cov") / F.col("length"), ["assembly"])


_BINS = f"""{SQL_NODES}, hb AS (SELECT CAST(floor(cov / length) AS BIGINT) AS bin, sum(length) AS length FROM nd WHERE length > 0 GROUP BY 1),
fb AS (SELECT b AS bin, coalesce(length, 0) AS length FROM (SELECT unnest(range((SELECT min(bin) FROM hb), (SELECT max(bin) FROM hb) + 1)) AS b) x LEFT JOIN hb ON bin = b)"""


@query(
    f"""WITH {_BINS}, ne AS (SELECT *, coalesce(lag(length) OVER (ORDER BY bin), 0) AS p, coalesce(lead(length) OVER (ORDER BY bin), 0) AS n FROM fb),
va AS (SELECT min(bin) AS v FROM ne WHERE length < n), tp AS (SELECT bin, length FROM ne, va WHERE bin >= v AND length > p AND length > n),
k AS (SELECT * FROM tp WHERE length * 10 >= (SELECT max(length) FROM tp))
SELECT CAST(row_number() OVER (ORDER BY bin DESC) AS INTEGER) AS place, CAST(bin AS DOUBLE) AS coverage, CAST(length AS BIGINT) AS length FROM k"""
)
def coverage_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Coverage levels of a mixture, highest first."""
    return meta.coverage_peaks(nodes(spark, d)).select("place", F.col("coverage").cast("double").alias("coverage"), "length")


@query(f"WITH {_BINS} SELECT bin, round(sum(length) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS smooth FROM fb")
def smoothed_histogram(spark: SparkSession, d: str) -> DataFrame:
    bins = stats.histogram(nodes(spark, d), 1.0, F.col("cov") / F.col("length"))
    return stats.smoothed(bins, 2).select("bin", _r("smooth").alias("smooth"))


@query()
def mixture_levels(spark: SparkSession, d: str) -> DataFrame:
    """Coverage levels by a Poisson mixture over the histogram of all nodes; coverages from LAST_BIN on share one bin, so it is bounded."""
    capped = F.least(F.col("cov") / F.col("length"), F.lit(float(meta.LAST_BIN)))
    bins = stats.histogram(nodes(spark, d).filter("length > 0"), 1.0, capped).orderBy("bin").collect()
    rows = meta.poisson_mixture([(r["bin"], r["length"]) for r in bins], 6)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "place int, coverage double, weight double")


@query(
    f"""WITH {SQL_NODES}, x AS (SELECT assembly, node_id, length, cov / length AS c FROM nd WHERE length > 50)
SELECT assembly, node_id, (0.34657359027997264 + length / 60.0 * (900.0 - c * c / 2)) > 5 AS plus_unique, (-0.34657359027997264 + length / 60.0 * (900.0 - c * c / 2)) > 5 AS minus_unique FROM x"""
)
def unique_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness by log-odds at an expected coverage of 30, in both variants."""
    rows = nodes(spark, d).filter("length > 50")
    return rows.select("assembly", "node_id", stats.unique_node(30.0).alias("plus_unique"), stats.unique_node(30.0, False).alias("minus_unique"))


@query(
    f"""WITH {SQL_NODES}, x AS (SELECT assembly, CAST(floor(cov / length) AS BIGINT) AS c, count(*) AS n FROM nd WHERE length >= 61 GROUP BY 1, 2)
SELECT assembly, arg_min(c, -n * 1000000000 + c) AS expected_coverage FROM x GROUP BY 1"""
)
def expected_coverage_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).filter("length > 0").withColumn("coverage", F.col("cov") / F.col("length"))
    return tools.coverage_mode(rows, 61, False, by=("assembly",))


@query(
    f"""WITH {SQL_NODES}, x AS (SELECT assembly, CAST(floor(cov / length) AS BIGINT) AS c, sum(length) AS n FROM nd WHERE length >= 62 AND cov / length > 2 GROUP BY 1, 2)
SELECT assembly, arg_min(c, -n * 1000000000 + c) AS expected_coverage FROM x GROUP BY 1"""
)
def weighted_coverage_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).filter("length > 0").withColumn("coverage", F.col("cov") / F.col("length"))
    return tools.coverage_mode(rows, 62, True, 2, by=("assembly",))


_METRICS = f"""{SQL_NODES}, sc AS (SELECT assembly, length, 'all' AS scope FROM nd WHERE assembly IS NOT NULL UNION ALL SELECT assembly, length, 'long' FROM nd WHERE length >= 1000 AND assembly IS NOT NULL),
m AS (SELECT assembly, scope, count(*) AS contigs, CAST(sum(length) AS BIGINT) AS total, min(length) AS shortest, avg(length) AS mean, max(length) AS longest FROM sc GROUP BY 1, 2),
cu AS (SELECT assembly, scope, length, sum(length) OVER (PARTITION BY assembly, scope ORDER BY length ROWS UNBOUNDED PRECEDING) AS cum FROM sc),
me AS (SELECT m.*, (SELECT min(length) FROM cu WHERE cu.assembly = m.assembly AND cu.scope = m.scope AND cum >= m.total // 2) AS n50 FROM m)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return tools.assembly_metrics(nodes(spark, d).filter("assembly is not null"), ("assembly",))


@query(f"WITH {_METRICS} SELECT assembly, scope, contigs, total, shortest, round(mean, 6) AS mean, longest, CAST(n50 AS BIGINT) AS n50 FROM me")
def assembly_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).withColumn("mean", _r("mean"))


@query(f"WITH {_METRICS}, s AS (SELECT assembly, n50 * 2 + total / 1000.0 AS score FROM me WHERE scope = 'all') SELECT assembly, round(score, 6) AS score FROM s ORDER BY score DESC, assembly LIMIT 1")
def best_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The best of a sweep by a user's score expression."""
    rows = tools.score(_metrics(spark, d).filter("scope = 'all'").withColumn("Lbp", F.col("total")).withColumn("k", F.col("assembly")), "n50 * 2 + Lbp / 1000.0")
    return tools.best_of(rows).select("assembly", _r("score").alias("score"))


@query(
    f"""WITH {SQL_NODES}, x AS (SELECT *, cov / length AS c FROM nd WHERE length > 0) SELECT CAST(floor(c / (20.0 * 0.5)) AS BIGINT) AS multiple, CAST(sum(length) AS BIGINT) AS length, count(*) AS nodes FROM x WHERE c > 30.0 GROUP BY 1"""
)
def repeat_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).filter("length > 0").withColumn("coverage", F.col("cov") / F.col("length"))
    return tools.repeat_histogram(rows, 20.0)


@query("SELECT CAST(k AS INTEGER) AS k, round((-109635 + 18977 * 100 + 86326 * 5 + 233353 * 2 - 51092 * k) / 1024.0 / 1024.0, 6) AS gb FROM (SELECT unnest([21, 25, 31]) AS k) x")
def memory_estimates(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, round(tools.memory_estimate_gb(100, 5, 2, k), 6)) for k in (21, 25, 31)]
    return spark.createDataFrame(rows, "k int, gb double")


_CONTIGS = "cs AS (SELECT DISTINCT node_id AS name, regexp_replace(seq, '\\s', '', 'g') AS seq FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL)"


def _contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contigs").filter("seq is not null and node_id is not null").select(F.col("node_id").alias("name"), F.regexp_replace("seq", r"\s", "").alias("seq")).distinct()


@query(
    f"""WITH {_CONTIGS}, p AS (SELECT name, list_filter(string_split(regexp_replace(seq, '([Nn]{{10,}})', '|\\1|', 'g'), '|'), lambda x: x <> '') AS parts FROM cs),
e AS (SELECT name, i, parts[i] AS t FROM p, unnest(range(1, len(parts) + 1)) u(i)),
r AS (SELECT name, i, t, sum(length(t)) OVER (PARTITION BY name ORDER BY i) AS stop FROM e)
SELECT name AS object, CAST(stop - length(t) + 1 AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(i AS INTEGER) AS part, CASE WHEN regexp_full_match(t, '[Nn]{{10,}}') THEN 'N' ELSE 'W' END AS kind, CAST(length(t) AS INTEGER) AS length FROM r"""
)
def agp(spark: SparkSession, d: str) -> DataFrame:
    """Contigs and gaps of each scaffold with running coordinates."""
    return sinks.agp(_contigs(spark, d)).withColumn("start", F.col("start").cast("bigint")).withColumn("stop", F.col("stop").cast("bigint"))


_SPANS = "sp AS (SELECT node_id AS key, greatest(pos - 100, 1) AS start, pos + 131 + 0 AS stop FROM kmer_index WHERE node_id IS NOT NULL AND pos IS NOT NULL)"


@query(
    f"""WITH {_SPANS}, w AS (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
h AS (SELECT *, sum(CASE WHEN reach >= start THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY start, stop) AS run FROM w)
SELECT key, min(start) AS start, max(stop) AS stop, count(*) AS spans FROM h GROUP BY key, run"""
)
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Enlarged intervals around indexed positions, overlapping ones merged."""
    rows = table(spark, d, "kmer_index").filter("node_id is not null and pos is not null").select(F.col("node_id").alias("key"), F.col("pos").alias("start"), (F.col("pos") + 31).alias("stop"))
    return tools.merged(tools.enlarged(rows, 100), "key")


@query(
    f"""WITH {_CONTIGS}, h AS (SELECT name, seq, length(seq) // 2 AS m FROM cs) SELECT name AS key, CAST(1 AS BIGINT) AS start, CAST(m AS BIGINT) AS stop, md5(substr(seq, 1, m)) AS digest FROM h UNION ALL SELECT name, m + 1, length(seq), md5(substr(seq, m + 1)) FROM h"""
)
def fetched_halves(spark: SparkSession, d: str) -> DataFrame:
    """The bases under intervals: both halves of every contig."""
    seqs = _contigs(spark, d).withColumnRenamed("name", "key").withColumn("k2", F.concat_ws(":", "key", F.md5("seq")))
    half = F.floor(F.length("seq") / 2).cast("bigint")
    ends = F.array(F.struct(F.lit(1).cast("bigint").alias("start"), half.alias("stop")), F.struct((half + 1).alias("start"), F.length("seq").cast("bigint").alias("stop")))
    spans = seqs.select("key", "k2", F.explode(ends).alias("x")).select("key", "k2", "x.start", "x.stop")
    return tools.fetched(spans, seqs, "k2").select("key", "start", "stop", F.md5("bases").alias("digest"))


@query(
    """WITH q AS (SELECT doc_id, upper(text) AS seq FROM documents WHERE text IS NOT NULL AND text <> '') SELECT doc_id, CAST(length(seq) - length(replace(seq, 'N', '')) AS INTEGER) AS n_bases FROM q"""
)
def n_counts(spark: SparkSession, d: str) -> DataFrame:
    """Letters N of each text, as the pair quality filter counts them (qualities all good)."""
    rows = table(spark, d, "documents").filter("text is not null and text <> ''").select("doc_id", F.upper("text").alias("seq"))
    return rows.select("doc_id", (F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))).alias("n_bases"))


@query(
    f"""WITH {SQL_NODES}, {SQL_ARCS}, {SQL_BOTH}, oc AS (SELECT src, sum(CASE WHEN src = -dst THEN 2 ELSE 1 END) AS c FROM bo GROUP BY 1)
SELECT nd.assembly, nd.node_id AS "ID", nd.length AS lgth, CAST(coalesce(a.c, 0) AS BIGINT) AS "out", CAST(coalesce(b.c, 0) AS BIGINT) AS "in", CASE WHEN length > 0 THEN round(cov / length, 6) END AS short1_cov, length = 0 AS infinite
FROM nd LEFT JOIN oc a ON a.src = nd.node_id LEFT JOIN oc b ON b.src = -nd.node_id"""
)
def stats_file(spark: SparkSession, d: str) -> DataFrame:
    """Node statistics: arc counts on both sides, coverage null and marked infinite for nodes without length."""
    rows = nodes(spark, d).select("assembly", "node_id", "length", "long_cov", F.col("cov").alias("cov_0"), F.col("cov").alias("ocov_0"), F.col("short1_nb").alias("nb_0"), "long_nb")
    tagged = rows.withColumn("node_key", F.concat_ws("|", "assembly", "node_id"))
    counts = stats.arc_counts(arcs(spark, d)).select(F.col("node_id").alias("n"), F.col("arc_count").alias("c"))
    out = tagged.join(counts, F.col("node_id") == F.col("n"), "left").withColumn("out", F.coalesce("c", F.lit(0)).cast("bigint")).drop("n", "c")
    both = out.join(counts, -F.col("node_id") == F.col("n"), "left").withColumn("in", F.coalesce("c", F.lit(0)).cast("bigint"))
    return both.select("assembly", F.col("node_id").alias("ID"), F.col("length").alias("lgth"), "out", "in", F.when(F.col("length") > 0, _r(F.col("cov_0") / F.col("length"))).alias("short1_cov"), (F.col("length") == 0).alias("infinite"))


@query(f"""WITH {SQL_ARCS} SELECT '  ' || abs(src) || ':' || CASE WHEN src > 0 THEN 'right' ELSE 'left' END || ' -> ' || abs(dst) || ':' || CASE WHEN dst > 0 THEN 'left' ELSE 'right' END || ' [label=' || mult || '];' AS line FROM ar""")
def dot_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import graph

    return graph.dot(arcs(spark, d))


@query(
    f"""WITH {SQL_NODES}, n1 AS (SELECT node_id, max(length) AS length, max(cov) AS cov, max(long_cov) AS long_cov, max(short1_nb) AS nb, max(long_nb) AS long_nb FROM nd GROUP BY 1), {SQL_ARCS}, {SQL_BOTH},
oc AS (SELECT src, sum(CASE WHEN src = -dst THEN 2 ELSE 1 END) AS c FROM bo GROUP BY 1)
SELECT n1.node_id AS "ID", length AS lgth, CAST(coalesce(a.c, 0) AS BIGINT) AS "out", CAST(coalesce(b.c, 0) AS BIGINT) AS "in", CASE WHEN length = 0 THEN 'Inf' ELSE printf('%.6f', long_cov / length) END AS long_cov,
CASE WHEN length = 0 THEN 'Inf' ELSE printf('%.6f', cov / length) END AS short1_cov, CASE WHEN length = 0 THEN 'Inf' ELSE printf('%.6f', cov / length) END AS "short1_Ocov", CAST(long_nb AS VARCHAR) AS long_nb, CAST(nb AS VARCHAR) AS short1_nb
FROM n1 LEFT JOIN oc a ON a.src = n1.node_id LEFT JOIN oc b ON b.src = -n1.node_id"""
)
def stats_records(spark: SparkSession, d: str) -> DataFrame:
    """The statistics file's records, as text: Inf for coverages of nodes without length."""
    rows = nodes(spark, d).groupBy("node_id").agg(
        F.max("length").alias("length"), F.max("cov").alias("cov_0"), F.max("cov").alias("ocov_0"), F.max("long_cov").alias("long_cov"), F.max("short1_nb").alias("nb_0"), F.max("long_nb").alias("long_nb")
    )
    out = sinks.stats_table(rows, arcs(spark, d), [0], True)
    return out.withColumn("out", F.col("out").cast("bigint")).withColumn("in", F.col("in").cast("bigint"))
