"""Scans, base functions, hashing and threading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import compact, graph, hashing, pregraph, stretches, tools
from ..runtime import materialize, new_path, table
from ..settings import k_values
from ..sources import seqreads, sinks
from .common import SQL_READS, K, reads, sql_kmers
from .registry import query

_SEQ_CLEAN = "SELECT DISTINCT read_id, category, upper(seq) AS u FROM read_set WHERE seq IS NOT NULL AND seq <> '' AND read_id IS NOT NULL"
_SUM = "count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS letters, count(DISTINCT seq) AS distinct_seqs, count(DISTINCT name) AS distinct_names"


def _named(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "read_set").filter("seq is not null and seq <> '' and read_id is not null")
    return rows.select("read_id", "category", F.upper("seq").alias("seq")).distinct().withColumn("name", F.concat(F.lit("r"), F.col("read_id").cast("string")))


def _totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("seq")).cast("bigint").alias("letters"), F.countDistinct("seq").alias("distinct_seqs"), F.countDistinct("name").alias("distinct_names")
    )


_TOTALS_SQL = f"WITH c AS ({_SEQ_CLEAN}), n AS (SELECT 'r' || read_id AS name, u AS seq FROM c) SELECT {_SUM} FROM n"


def _files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x for s in fs.listStatus(where) if (x := s.getPath().toString()).rsplit("/", 1)[1].startswith("part-"))


@query(_TOTALS_SQL)
def scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    """FASTA written in lines of 60 and read back in blocks."""
    path = new_path(spark, "fasta")
    rows = _named(spark, d)
    sinks.write_lines(sinks.fasta(rows, F.col("name"), F.col("seq"), "read_id"), path, ["read_id"])
    return _totals(seqreads.fasta_split(spark, path))


@query(_TOTALS_SQL)
def scan_fasta_gz(spark: SparkSession, d: str) -> DataFrame:
    """Gzip FASTA through the data source, layout found by the first bytes."""
    path = new_path(spark, "fastagz")
    rows = _named(spark, d)
    sinks.write_lines(sinks.fasta(rows, F.col("name"), F.col("seq"), "read_id"), path, ["read_id"], compression="gzip")
    return _totals(seqreads.scan(spark, _files(spark, path)))


@query(_TOTALS_SQL)
def scan_fastq(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "fastq")
    rows = _named(spark, d).withColumn("q", F.expr("repeat('I', length(seq))"))
    sinks.write_lines(sinks.fastq(rows, F.col("name"), F.col("seq"), F.col("q"), "read_id"), path, ["read_id"])
    return _totals(seqreads.scan(spark, _files(spark, path), "fastq"))


@query(f"WITH c AS ({_SEQ_CLEAN}) SELECT count(*) AS records, CAST(sum(length(u)) AS BIGINT) AS letters, 1 AS distinct_names FROM c")
def scan_raw(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "raw")
    sinks.write_lines(_named(spark, d), path, ["read_id"], "seq")
    rows = seqreads.scan(spark, _files(spark, path), "raw")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("seq")).cast("bigint").alias("letters"), F.countDistinct("name").cast("int").alias("distinct_names"))


@query(
    f"WITH c AS ({_SEQ_CLEAN}) SELECT read_id, category, length(u) AS letters, md5(regexp_replace(u, '[^ACGT]', 'N', 'g')) AS digest FROM c"
)
def sequences_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The Sequences text form written and read back."""
    path = new_path(spark, "sequences")
    rows = _named(spark, d).withColumn("seq", dna.normalise(F.col("seq")))
    sinks.write_lines(sinks.sequences(rows), path, ["read_id"])
    back = seqreads.sequences_file(spark, path)
    return back.select("read_id", "category", F.length("seq").cast("bigint").alias("letters"), F.md5("seq").alias("digest"))


_SAM_SQL = """SELECT read_id, m.ref_id AS ref_id, m.pos AS pos FROM (SELECT read_id, unnest(mappings) AS m FROM (
 SELECT read_id, arg_max(mappings, loaded_at) AS mappings FROM read_set WHERE read_id IS NOT NULL AND seq IS NOT NULL AND seq <> '' GROUP BY 1) q) x"""


@query(f"SELECT read_id, ref_id, pos, count(*) AS n FROM ({_SAM_SQL}) y GROUP BY 1, 2, 3")
def scan_sam_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Mappings of reads written as SAM, read back, collapsed to reads and unfolded from their CIGARs."""
    path = new_path(spark, "sam")
    rows = table(spark, d, "read_set").filter("read_id is not null and seq is not null and seq <> ''").groupBy("read_id").agg(F.max_by(F.struct("mappings", "seq"), "loaded_at").alias("x"))
    hits = rows.select("read_id", F.col("x.seq").alias("seq"), F.posexplode("x.mappings").alias("i", "m"))
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("read_id")), F.lit("0"), F.concat(F.lit("ref"), F.col("m.ref_id")), F.col("m.pos"), F.lit("60"), F.concat(F.length("seq"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), F.lit("*"))
    sinks.write_lines(hits.withColumn("line", line), path, ["read_id", "i"])
    found = seqreads.aligned_reads(seqreads.scan(spark, _files(spark, path), "sam"))
    spots = found.select("name", F.explode("mappings").alias("m")).select("name", "m.rname", "m.pos", "m.cigar")
    blocks = seqreads.cigar_blocks(spots)
    return blocks.groupBy(
        F.expr("cast(substring(name, 2) as bigint)").alias("read_id"), F.expr("cast(substring(rname, 4) as bigint)").alias("ref_id"), F.col("block_pos").alias("pos")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT DISTINCT node_id AS ref_id, regexp_replace(upper(regexp_replace(seq, '\\s', '', 'g')), '[^ACGT]', 'N', 'g') AS u FROM contigs WHERE seq IS NOT NULL AND node_id IS NOT NULL),
p AS (SELECT ref_id, md5(u) AS tie, list_filter(string_split(regexp_replace(u, '(N+)', '|\\1|', 'g'), '|'), lambda x: x <> '') AS parts FROM s),
e AS (SELECT ref_id, tie, i, length(parts[i]) AS n, parts[i][1] = 'N' AS gap FROM p, unnest(range(1, len(parts) + 1)) t(i)),
r AS (SELECT *, sum(n) OVER (PARTITION BY ref_id, tie ORDER BY i) AS stop FROM e)
SELECT ref_id, CAST(stop - n AS BIGINT) AS start, CAST(stop - 1 AS BIGINT) AS finish FROM r WHERE gap"""
)
def reference_masks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of unknown bases in each contig."""
    rows = table(spark, d, "contigs").filter("seq is not null and node_id is not null").select(F.col("node_id").alias("ref_id"), dna.normalise(F.regexp_replace("seq", r"\s", "")).alias("seq")).distinct()
    return hashing.n_masks(rows).select("ref_id", F.col("start").cast("bigint").alias("start"), F.col("finish").cast("bigint").alias("finish"))


@query(
    f"WITH {SQL_READS} SELECT k, CAST(sum(CASE WHEN length(s) >= k THEN length(s) - k + 1 ELSE 0 END) AS BIGINT) AS kmers, count(CASE WHEN length(s) < k THEN 1 END) AS too_short FROM r, (SELECT unnest([19, 21, 23, 25, 27, 29]) AS k) ks GROUP BY k"
)
def multi_k_lengths(spark: SparkSession, d: str) -> DataFrame:
    """K-mers of all reads for each word length of a sweep, from one scan."""
    ks = F.explode(F.array(*[F.lit(k) for k in k_values("19,31,2")])).alias("k")
    n = F.length("seq") - F.col("k") + 1
    rows = reads(spark, d).select("seq", ks)
    return rows.groupBy("k").agg(F.sum(F.when(n > 0, n).otherwise(0)).cast("bigint").alias("kmers"), F.count(F.when(n <= 0, 1)).alias("too_short"))


@query(
    """SELECT read_id, md5(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')) AS normal, md5(translate(reverse(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')), 'ACGTN', 'TGCAA')) AS turned, count(*) AS n
FROM read_set WHERE seq IS NOT NULL GROUP BY 1, 2, 3"""
)
def base_functions(spark: SparkSession, d: str) -> DataFrame:
    """Normalised bases and their reverse complement."""
    s = dna.normalise(F.col("seq"))
    return table(spark, d, "read_set").filter("seq is not null").groupBy("read_id", F.md5(s).alias("normal"), F.md5(dna.revcomp(s)).alias("turned")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql_kmers()}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1) SELECT n AS multiplicity, count(*) AS kmers FROM c GROUP BY 1")
def kmer_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many canonical k-mers occur how often (packed keys, counted before the shuffle)."""
    counts = hashing.kmer_rows(reads(spark, d), K, packed=True).groupBy("kmer").agg(F.count(F.lit(1)).alias("multiplicity"))
    return counts.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("kmers"))


@query(f"WITH {sql_kmers()} SELECT kmer, count(*) AS n, CAST(sum(CASE WHEN fwd THEN 1 ELSE 0 END) AS BIGINT) AS forward_n FROM km GROUP BY 1 HAVING count(*) >= 8")
def frequent_kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = hashing.kmer_rows(reads(spark, d), K, packed=True).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fwd").cast("bigint")).alias("forward_n"))
    return rows.filter("n >= 8").withColumn("kmer", dna.unpack(F.col("kmer"), K))


@query(
    f"WITH {SQL_READS}, w AS (SELECT read_id, coalesce(second_in_pair, false) AS t, substr(s, p + 1, {K}) AS word FROM (SELECT * FROM r WHERE length(s) >= {K}) q, unnest(range(0, length(s) - {K} + 1)) x(p)), "
    "c AS (SELECT CASE WHEN t THEN translate(reverse(word), 'ACGT', 'TGCA') ELSE word END AS kmer, count(*) AS n FROM w GROUP BY 1) SELECT n AS multiplicity, count(*) AS kmers FROM c GROUP BY 1"
)
def kmer_histogram_stranded(spark: SparkSession, d: str) -> DataFrame:
    """The histogram in strand-specific mode: second mates are turned."""
    counts = hashing.kmer_rows(reads(spark, d), K, strand_specific=True, packed=True).groupBy("kmer").agg(F.count(F.lit(1)).alias("multiplicity"))
    return counts.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("kmers"))


_FIRST = f"""{sql_kmers()},
f AS (SELECT kmer, arg_min(read_id, read_id * 1000000 + pos) AS owner, arg_min(pos, read_id * 1000000 + pos) AS owner_pos, arg_min(fwd, read_id * 1000000 + pos) AS owner_fwd FROM km GROUP BY 1),
fc AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY owner_pos) - 1 AS coord FROM f)"""


@query(f"WITH {_FIRST} SELECT owner, count(*) AS novel, max(coord) AS last_coord, CAST(sum(owner_pos) AS BIGINT) AS pos_sum FROM fc GROUP BY 1")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """K-mers first seen in each read."""
    rows = hashing.first_occurrences(hashing.kmer_rows(reads(spark, d), K, packed=True))
    return rows.groupBy("owner").agg(F.count(F.lit(1)).alias("novel"), F.max("coord").alias("last_coord"), F.sum("owner_pos").cast("bigint").alias("pos_sum"))


_ROAD = f"""{_FIRST},
h AS (SELECT km.read_id, km.pos, (owner = km.read_id AND owner_pos = km.pos) AS novel, owner * (CASE WHEN fwd = owner_fwd THEN 1 ELSE -1 END) AS target, coord FROM km JOIN fc USING (kmer)),
hw AS (SELECT *, coalesce(sum(CASE WHEN novel THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS written,
  lag(novel) OVER w AS pn, lag(target) OVER w AS pt, lag(coord) OVER w AS pc FROM h WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
hh AS (SELECT *, CASE WHEN NOT novel AND NOT coalesce(NOT pn AND pt = target AND coord = pc + (CASE WHEN target > 0 THEN 1 ELSE -1 END), false) THEN 1 ELSE 0 END AS head FROM hw),
ho AS (SELECT *, sum(head) OVER (PARTITION BY read_id ORDER BY pos) AS ord FROM hh)"""


@query(
    f"WITH {_ROAD} SELECT read_id, CAST(ord AS BIGINT) AS ord, any_value(target) AS target, CAST(min(written) AS BIGINT) AS position, arg_min(coord, pos) AS start, arg_max(coord, pos) + any_value(CASE WHEN target > 0 THEN 1 ELSE -1 END) AS finish FROM ho WHERE NOT novel GROUP BY read_id, ord"
)
def roadmaps(spark: SparkSession, d: str) -> DataFrame:
    """Run-length encoded hits of each read in earlier reads."""
    rows = hashing.roadmaps(hashing.kmer_rows(reads(spark, d), K, packed=True))
    return rows.select("read_id", F.col("ord").cast("bigint").alias("ord"), "target", "position", "start", F.col("finish").cast("bigint").alias("finish"))


@query(
    f"WITH {_ROAD}, ru AS (SELECT read_id, ord, any_value(target) AS target, arg_min(coord, pos) AS s, arg_max(coord, pos) + any_value(CASE WHEN target > 0 THEN 1 ELSE -1 END) AS e FROM ho WHERE NOT novel GROUP BY read_id, ord) "
    "SELECT seq_id, count(DISTINCT cut) AS cuts FROM (SELECT abs(target) AS seq_id, least(s, e) + CASE WHEN target < 0 THEN 1 ELSE 0 END AS cut FROM ru UNION ALL SELECT abs(target), greatest(s, e) + CASE WHEN target < 0 THEN 1 ELSE 0 END FROM ru) x GROUP BY 1"
)
def break_points(spark: SparkSession, d: str) -> DataFrame:
    """Cut positions that annotations put on their target sequences."""
    return pregraph.cuts(_roads(spark, d)).groupBy("seq_id").agg(F.count("cut").alias("cuts"))


def _roads(spark: SparkSession, d: str) -> DataFrame:
    return hashing.roadmaps(hashing.kmer_rows(reads(spark, d), K, packed=True))


def _prenodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Roadmaps and pre-nodes of all reads."""
    roads, own = stretches.roadmaps(reads(spark, d), K)
    return roads, materialize(pregraph.prenodes(own, roads), "prenodes")[0]


_CUT = f"""{_ROAD}, rw AS (SELECT read_id, ord, any_value(target) AS target, min(written) AS position, arg_min(coord, pos) AS s, arg_max(coord, pos) + any_value(CASE WHEN target > 0 THEN 1 ELSE -1 END) AS e FROM ho WHERE NOT novel GROUP BY read_id, ord),
nv AS (SELECT owner AS seq_id, count(*) AS own FROM fc GROUP BY 1),
ac AS (SELECT seq_id, 0 AS cut FROM nv UNION SELECT seq_id, own FROM nv UNION SELECT read_id, position FROM rw UNION SELECT abs(target), least(s, e) + CASE WHEN target < 0 THEN 1 ELSE 0 END FROM rw UNION SELECT abs(target), greatest(s, e) + CASE WHEN target < 0 THEN 1 ELSE 0 END FROM rw),
iv AS (SELECT ac.seq_id, cut, lead(cut) OVER (PARTITION BY ac.seq_id ORDER BY cut) AS nxt FROM ac JOIN nv USING (seq_id) WHERE cut BETWEEN 0 AND own),
pn AS (SELECT row_number() OVER (ORDER BY seq_id, cut) AS node_id, seq_id, cut AS start, nxt - cut AS length FROM iv WHERE nxt IS NOT NULL)"""


@query(f"WITH {_CUT} SELECT node_id, seq_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM pn")
def pre_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Pre-nodes: each read's own k-mers, cut where annotations begin and end."""
    return _prenodes(spark, d)[1]


@query(
    f"""WITH {_CUT}, tr AS (SELECT read_id, ord, target, CASE WHEN target > 0 THEN s ELSE e + 1 END AS lo, CASE WHEN target > 0 THEN e ELSE s + 1 END AS hi FROM rw)
SELECT read_id, CAST(ord AS BIGINT) AS ord, CASE WHEN target > 0 THEN a.node_id ELSE -b.node_id END AS first_node, CASE WHEN target > 0 THEN b.node_id ELSE -a.node_id END AS last_node
FROM tr JOIN pn a ON a.seq_id = abs(target) AND a.start = lo JOIN pn b ON b.seq_id = abs(target) AND b.start + b.length = hi"""
)
def translated_markers(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with pre-node ids in place of coordinates."""
    return pregraph.translated(*_prenodes(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))


@query(f"WITH {sql_kmers()} SELECT CAST(count(*) AS BIGINT) AS kmers, CAST(sum(read_id * (pos + 1)) AS BIGINT) AS places FROM km")
def pre_node_walks(spark: SparkSession, d: str) -> DataFrame:
    """Reads as walks over pre-nodes, unfolded again: every k-mer of every read is passed once, at its place."""
    walk = pregraph.walks(*_prenodes(spark, d))
    each = walk.select("read_id", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("length"))).alias("p"))
    return each.agg(F.count(F.lit(1)).alias("kmers"), F.sum(F.col("read_id") * F.col("p")).cast("bigint").alias("places"))


@query(f"WITH {sql_kmers()}, n AS (SELECT read_id, count(*) AS n FROM km WHERE category >= 4 GROUP BY 1) SELECT read_id AS ref_id, CAST(n AS BIGINT) AS length FROM n")
def reference_walks(spark: SparkSession, d: str) -> DataFrame:
    """Long reads as references on pre-nodes: the segments of each cover it whole."""
    rows = pregraph.reference_markers(pregraph.walks(*_prenodes(spark, d)), table(spark, d, "read_set").filter("category >= 4 and read_id is not null"))
    return rows.groupBy("ref_id").agg(F.sum("length").cast("bigint").alias("length"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The long reads, taken as reference sequences for the short ones."""
    rows = table(spark, d, "read_set").filter("seq is not null and read_id is not null and category >= 4")
    return rows.select(F.col("read_id").alias("ref_id"), "seq").distinct()


_REF = f"""{sql_kmers(31)}, s AS (SELECT DISTINCT read_id AS ref_id, regexp_replace(upper(seq), '[^ACGT]', 'N', 'g') AS u FROM read_set WHERE seq IS NOT NULL AND read_id IS NOT NULL AND category >= 4),
rw AS (SELECT ref_id, p AS coord, substr(u, p + 1, 31) AS word FROM (SELECT * FROM s WHERE length(u) >= 31) q, unnest(range(0, length(u) - 30)) t(p)),
rk AS (SELECT least(word, translate(reverse(word), 'ACGT', 'TGCA')) AS kmer, ref_id * (CASE WHEN word <= translate(reverse(word), 'ACGT', 'TGCA') THEN 1 ELSE -1 END) AS ref, coord FROM rw WHERE word NOT LIKE '%N%'),
hi AS (SELECT km.read_id, km.pos, ref * (CASE WHEN fwd THEN 1 ELSE -1 END) AS ref, coord FROM km JOIN rk USING (kmer) WHERE category < 4)"""


@query(f"WITH {_REF}, u AS (SELECT *, count(*) OVER (PARTITION BY read_id, pos) AS n FROM hi) SELECT ref, count(*) AS hits, count(CASE WHEN n = 1 THEN 1 END) AS single_hits FROM u GROUP BY 1")
def reference_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of short reads on the unmasked k-mers of the long ones, and those without a rival."""
    found = hashing.reference_hits(hashing.kmer_rows(reads(spark, d).filter("category < 4"), 31), hashing.reference_index(_references(spark, d), 31))
    n = F.count(F.lit(1)).over(W.partitionBy("read_id", "pos"))
    return found.withColumn("n", n).groupBy("ref").agg(F.count(F.lit(1)).alias("hits"), F.count(F.when(F.col("n") == 1, 1)).alias("single_hits"))


@query(
    f"""WITH {_REF}, u AS (SELECT *, count(*) OVER (PARTITION BY read_id, pos) AS n FROM hi), mp AS (SELECT read_id, ref, arg_min(CASE WHEN ref > 0 THEN coord - pos ELSE coord + pos END, (pos, coord)) AS at0 FROM hi GROUP BY 1, 2),
sv AS (SELECT DISTINCT read_id, pos, ref, coord FROM u JOIN mp USING (read_id, ref) WHERE n > 1 AND coord = at0 + CASE WHEN ref > 0 THEN pos ELSE -pos END), s1 AS (SELECT *, count(*) OVER (PARTITION BY read_id, pos) AS m FROM sv)
SELECT read_id, CAST(pos AS BIGINT) AS pos, ref, CAST(coord AS BIGINT) AS coord FROM u WHERE n = 1 UNION ALL SELECT read_id, pos, ref, coord FROM s1 WHERE m = 1"""
)
def resolved_reference_hits(spark: SparkSession, d: str) -> DataFrame:
    """One hit a k-mer: the only one, or the only one at the place to which the read's first hit on that reference maps it."""
    found = _reference_hits(spark, d)
    at = F.when(F.col("ref") > 0, F.col("coord") - F.col("pos")).otherwise(F.col("coord") + F.col("pos"))
    maps = found.groupBy("read_id", "ref").agg(F.min_by(at, F.struct("pos", "coord")).alias("at"))
    return hashing.resolved_hits(found, maps).withColumn("pos", F.col("pos").cast("bigint")).select("read_id", "pos", "ref", "coord")


def _reference_hits(spark: SparkSession, d: str) -> DataFrame:
    return hashing.reference_hits(hashing.kmer_rows(reads(spark, d).filter("category < 4"), 31), hashing.reference_index(_references(spark, d), 31))


@query(
    f"""WITH RECURSIVE {_REF}, u AS (SELECT *, count(*) OVER (PARTITION BY read_id, pos) AS n FROM hi), g AS (SELECT read_id, pos, ref, coord, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS i FROM u WHERE n = 1),
sm AS (SELECT read_id, i, ref, coord, true AS keep, true AS has, pos AS lp, ref AS lr, coord AS lc, CAST(-1 AS BIGINT) AS blocked FROM g WHERE i = 1
UNION ALL SELECT read_id, i, ref, coord, keep, CASE WHEN stopped THEN has ELSE keep END, CASE WHEN keep THEN pos ELSE lp END, CASE WHEN keep THEN ref ELSE lr END, CASE WHEN keep THEN coord ELSE lc END, CASE WHEN broken AND NOT stopped THEN lp + 31 ELSE blocked END FROM (
  SELECT *, NOT stopped AND NOT (broken AND pos < lp + 31) AS keep FROM (
    SELECT g.read_id, g.i, g.pos, g.ref, g.coord, sm.has, sm.lp, sm.lr, sm.lc, sm.blocked, g.pos < sm.blocked AS stopped,
      sm.has AND (g.ref <> sm.lr OR g.coord - sm.lc <> (CASE WHEN sm.lr > 0 THEN 1 ELSE -1 END) * (g.pos - sm.lp) OR g.pos <> sm.lp + 1) AS broken FROM sm JOIN g ON g.read_id = sm.read_id AND g.i = sm.i + 1) a) b)
SELECT ref, count(*) AS hits, min(coord) AS first_coord, max(coord) AS last_coord FROM sm WHERE keep GROUP BY 1"""
)
def anchored_reference_hits(spark: SparkSession, d: str) -> DataFrame:
    """Unambiguous hits kept by the anchored scan of each read."""
    kept = hashing.anchored_hits(hashing.resolved_hits(_reference_hits(spark, d)), 31)
    return kept.groupBy("ref").agg(F.count(F.lit(1)).alias("hits"), F.min("coord").alias("first_coord"), F.max("coord").alias("last_coord"))


@query(
    """WITH e AS (SELECT DISTINCT user_id AS read_id, event_id AS pos, CASE WHEN event_type = 'purchase' THEN event_id END AS anchor FROM events),
b AS (SELECT read_id, pos, anchor, last_value(anchor IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos) AS bp, first_value(anchor IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap FROM e)
SELECT read_id, pos, anchor, CASE WHEN bp IS NULL OR (ap IS NOT NULL AND ap - pos <= pos - bp) THEN ap ELSE bp END AS near_pos FROM b"""
)
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    """As-of join in both directions: the nearest purchase of each user's event."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("read_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("anchor")).distinct()
    return hashing.nearest_anchor(rows).select("read_id", "pos", "anchor", "near_pos")


@query(f"WITH {sql_kmers()} SELECT length(kmer) AS k, count(*) AS steps FROM (SELECT kmer, lead(kmer) OVER (PARTITION BY read_id ORDER BY pos) AS nxt FROM km) q WHERE nxt IS NOT NULL GROUP BY 1")
def walk_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of reads between consecutive k-mers: the sum of all arc multiplicities."""
    nodes, arcs = graph.kmer_graph(reads(spark, d), K)
    hairpin = F.col("src") == -F.col("dst")
    return arcs.agg(F.lit(K).cast("bigint").alias("k"), F.sum(F.when(hairpin, F.expr("mult div 2")).otherwise(F.col("mult"))).cast("bigint").alias("steps"))


@query()
def unitigs(spark: SparkSession, d: str) -> DataFrame:
    """Unitigs of all reads at k = 21: length, coverage, sequence."""
    return compact.unitig_nodes(reads(spark, d), K).select("node_id", "length", "cov", F.md5("seq").alias("digest"))


@query(
    """WITH n AS (SELECT DISTINCT read_id, regexp_replace(read_name, '/[12]$', '') AS base, regexp_extract(read_name, '/([12])$', 1) AS e FROM read_set WHERE read_name IS NOT NULL)
SELECT base, min(CASE WHEN e = '1' THEN read_id END) AS first, min(CASE WHEN e = '2' THEN read_id END) AS second FROM n WHERE e <> '' GROUP BY 1"""
)
def select_paired(spark: SparkSession, d: str) -> DataFrame:
    return tools.paired_by_name(table(spark, d, "read_set"))


@query(
    """WITH n AS (SELECT DISTINCT read_id, regexp_replace(read_name, '/[12]$', '') AS base, regexp_extract(read_name, '/([12])$', 1) AS e FROM read_set WHERE read_name IS NOT NULL),
p AS (SELECT base, min(CASE WHEN e = '1' THEN read_id END) AS a, min(CASE WHEN e = '2' THEN read_id END) AS b FROM n WHERE e <> '' GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY base) - 1 AS i FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 2 * i AS ordinal, a AS read_id FROM o UNION ALL SELECT 2 * i + 1, b FROM o"""
)
def interleaved_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tools.interleaved(tools.paired_by_name(table(spark, d, "read_set")))


@query(
    f"WITH c AS ({_SEQ_CLEAN}), n AS (SELECT 2 * (row_number() OVER (ORDER BY read_id, category, u) - 1) AS o, 'r' || read_id AS name, u AS seq FROM c) SELECT o AS ordinal, name, md5(seq) AS digest FROM n UNION ALL SELECT o + 1, 'm' || substr(name, 2), md5(reverse(seq)) FROM n"
)
def scan_separate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two gzip files, first and second mates, read and zipped by position."""
    rows = _named(spark, d)
    order = ["read_id", "category", "seq"]
    sides = []
    for name, seq in ((F.col("name"), F.col("seq")), (F.concat(F.lit("m"), F.expr("substring(name, 2)")), F.reverse("seq"))):
        path = new_path(spark, "mates")
        lines = sinks.fasta(rows.withColumn("key", F.struct(*order)), name, seq, "key")
        sinks.write_lines(lines, path, ["key"], compression="gzip")
        sides.append(seqreads.in_order(seqreads.scan(spark, _files(spark, path), "fasta")))
    return seqreads.zipped(*sides).select("ordinal", "name", F.md5("seq").alias("digest"))


@query(
    """WITH c AS (SELECT DISTINCT node_id FROM contigs WHERE node_id IS NOT NULL), r AS (SELECT 'n' || node_id AS name, 1 AS a, 500 AS b, true AS positive FROM c UNION ALL SELECT 'n' || node_id, 801, 2000, false FROM c),
s AS (SELECT DISTINCT 'n' || abs(node_id) AS name, pos AS p FROM kmer_index WHERE node_id IS NOT NULL AND pos IS NOT NULL)
SELECT s.name, p AS "at", CAST(a AS BIGINT) AS start, positive FROM s JOIN r ON s.name = r.name AND p BETWEEN a AND b"""
)
def region_hits(spark: SparkSession, d: str) -> DataFrame:
    """Region headers read, and indexed positions that lie in a region."""
    ids = table(spark, d, "contigs").filter("node_id is not null").select("node_id").distinct()
    heads = F.array(F.format_string("n%d:1-500", "node_id"), F.format_string("n%d:2000-801", "node_id"))
    areas = seqreads.regions(ids.select("node_id", F.posexplode(heads).alias("i", "header")).select((F.col("node_id") * 2 + F.col("i")).alias("ref_id"), "header"))
    spots = table(spark, d, "kmer_index").filter("node_id is not null and pos is not null").select(F.concat(F.lit("n"), F.abs("node_id").cast("string")).alias("name"), F.col("pos").alias("at")).distinct()
    return seqreads.in_regions(spots, areas).select("name", "at", "start", "positive")


_QUALITY = """q AS (SELECT read_id, any_value(mate_id) AS mate_id, min(seq) AS seq FROM read_set WHERE read_id IS NOT NULL AND seq IS NOT NULL AND seq <> '' GROUP BY 1),
f AS (SELECT read_id, mate_id, length(seq) - length(regexp_replace(seq, '[Nn]', '', 'g')) AS n_bases, length(regexp_replace(seq, '[^A-Z]', '', 'g')) AS good, length(seq) AS l FROM q),
p AS (SELECT *, coalesce(n_bases <= 2 AND CASE WHEN l > n_bases THEN good / (l - n_bases) END >= 0.9, false) AS ok FROM f)"""


def _with_quality(spark: SparkSession, d: str) -> DataFrame:
    """One row a read, with a good quality for capitals and a poor one for other letters."""
    rows = table(spark, d, "read_set").filter("read_id is not null and seq is not null and seq <> ''").groupBy("read_id").agg(F.min("seq").alias("seq"))
    return rows.withColumn("qual", F.regexp_replace(F.regexp_replace("seq", "[A-Z]", "I"), "[^I]", "#"))


@query(f"WITH {_QUALITY} SELECT read_id, n_bases, round(CASE WHEN l > n_bases THEN good / (l - n_bases) END, 6) AS good_share FROM p")
def quality_shares(spark: SparkSession, d: str) -> DataFrame:
    """Unknown bases and the share of good ones of each read."""
    return tools.quality_share(_with_quality(spark, d)).select("read_id", F.col("n_bases").cast("bigint").alias("n_bases"), F.round("good_share", 6).alias("good_share"))


@query(
    """WITH b AS (SELECT DISTINCT read_id, mate_id FROM read_set WHERE read_id IS NOT NULL AND mate_id IS NOT NULL AND read_id < mate_id), """ + _QUALITY + """,
r AS (SELECT b.read_id, b.mate_id, coalesce(x.ok, false) AS a, coalesce(y.ok, false) AS c FROM b LEFT JOIN p x ON x.read_id = b.read_id LEFT JOIN p y ON y.read_id = b.mate_id)
SELECT read_id, mate_id, CASE WHEN a AND c THEN 'pair' WHEN a OR c THEN 'single' ELSE 'fail' END AS route FROM r"""
)
def filtered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs routed by the quality of both mates: pair, single or fail."""
    pairs_ = table(spark, d, "read_set").filter("read_id < mate_id").select("read_id", "mate_id").distinct()
    return tools.routed_pairs(_with_quality(spark, d), pairs_, 2, 0.9).select("read_id", "mate_id", "route")
