"""Queries and DuckDB twins of the training-data operators, named pN_... by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import canonical_code, unpack
from ..runtime import table
from . import chains, splitting
from . import components as cc
from . import frequency, heavy, leakage, packing, pii, quantiles, seen, spans

K = 31


def micros(column: str):
    """Microseconds of a timestamp without zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- problem 1 -----------------------------------------------------------------


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """grp ("measure|key|day") and value. An observation delivered again counts once, as last loaded."""
    mini = (
        table(spark, d, "mini_connections")
        .select("mini_id", "library", "distance", "observed_at", "loaded_at")
        .groupBy("mini_id")
        .agg(F.max_by(F.struct("library", "distance", "observed_at"), F.struct("loaded_at", "distance")).alias("x"))
        .select(
            F.concat_ws("|", F.lit("distance"), F.coalesce(F.col("x.library").cast("string"), F.lit("none")), F.to_date("x.observed_at").cast("string")).alias("grp"),
            F.col("x.distance").cast("double").alias("value"),
        )
    )
    stats = table(spark, d, "node_stats").select("node_id", "assembly", "run_day", "short1_cov", "lgth").distinct()
    key = F.concat_ws("|", F.coalesce("assembly", F.lit("none")), F.coalesce(F.col("run_day").cast("string"), F.lit("none")))
    pair = F.array(
        F.struct(F.concat_ws("|", F.lit("short1_cov"), key).alias("grp"), F.col("short1_cov").alias("value")),
        F.struct(F.concat_ws("|", F.lit("lgth"), key).alias("grp"), F.col("lgth").cast("double").alias("value")),
    )
    return mini.unionByName(stats.select(F.explode(pair).alias("x")).select("x.*"))


def _split_group(df: DataFrame) -> DataFrame:
    part = F.split("grp", r"\|")
    return df.select(
        part[0].alias("measure"), part[1].alias("group_key"), part[2].alias("period"), "q", "value", "n", "rank_error"
    )


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each measure, group and day."""
    return _split_group(quantiles.percentiles(quantiles.digests(p1_values(spark, d))))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """The digests of days combined into months and into the whole time."""
    days = quantiles.digests(p1_values(spark, d))
    part = F.split("grp", r"\|")
    longer = days.withColumn("grp", F.explode(F.array(
        F.concat_ws("|", part[0], part[1], F.substring(part[2], 1, 7)), F.concat_ws("|", part[0], part[1], F.lit("all")),
    ))).withColumn("salt", F.pmod(F.xxhash64(part[2]), F.lit(quantiles.salts(spark))).cast("int"))
    return _split_group(quantiles.percentiles(quantiles.combined(longer)))


# --- problem 2 -----------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_items(table(spark, d, "contigs"), "node_id", "seq", over_only=True)
    starts = F.when(F.size("gaps") > 0, F.col("gaps")).otherwise(F.array(F.lit(-1).cast("bigint")))
    return cut.select(F.col("id").alias("node_id"), F.explode(starts).alias("gap_start")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every contig in pieces of at most 5,000 bases that overlap by 100."""
    rows = table(spark, d, "contigs").select("node_id", "seq").distinct()
    cut = splitting.split_items(rows, "node_id", "seq", with_body=True)
    return cut.select("id", "body", F.explode("pieces").alias("p")).select(
        F.col("id").alias("node_id"), "p.piece", "p.start", "p.stop", "p.cut",
        F.expr("substring(body, cast(p.start + 1 as int), cast(p.stop - p.start as int))").alias("seq"),
    )


# --- problem 3 -----------------------------------------------------------------


def p3_occurrences(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "kmer_index").select(
        F.lit("kmer_index").alias("origin"), canonical_code(F.col("kmer")).alias("suffix"), F.abs("node_id").alias("record")
    )
    first = table(spark, d, "kmer_first").select(
        F.lit("kmer_first").alias("origin"), canonical_code(F.col("kmer")).alias("suffix"), F.col("seq_id").alias("record")
    )
    return index.unionByName(first)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = frequency.marked(frequency.term_counts(p3_occurrences(spark, d), K))
    return counts.filter("mark is not null").select("origin", unpack(F.col("prefix"), K).alias("kmer"), "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = frequency.marked(frequency.term_counts(p3_occurrences(spark, d), K))
    return counts.select(
        "origin", unpack(F.col("prefix"), K).alias("kmer"), F.col("n").alias("occurrences"), "records",
        F.coalesce("mark", F.lit("kept")).alias("mark"),
    )


def p3_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of 6 and 12 letters and the whole word, from one sort."""
    counts = frequency.term_counts(p3_occurrences(spark, d), K, (6, 12, K))
    return counts.groupBy("origin", "level").agg(
        F.count(F.lit(1)).alias("prefixes"), F.sum("n").alias("occurrences"), F.sum("records").alias("records"), F.max("records").alias("most_records")
    )


# --- problem 4 -----------------------------------------------------------------


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "prearcs").select(F.abs("pre_node_left").alias("a"), F.abs("pre_node_right").alias("b"))
    c = table(spark, d, "connections").select(F.abs("src").alias("a"), F.abs("dst").alias("b"))
    return a.unionByName(c).filter("a <> 0 and b <> 0")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cc.components(p4_links(spark, d)).select(F.col("node").alias("node_id"), "group_id")


# --- problem 5 -----------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_spans(table(spark, d, "read_set"), "read_id", "seq", 60)
    return found.select(F.col("rec").alias("read_id"), F.col("start").alias("span_start"), F.col("stop").alias("span_end"))


def p5_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each read stands verbatim in others."""
    reads = table(spark, d, "read_set").filter("read_id is not null").groupBy("read_id").agg(F.max(F.length("seq")).alias("bases"))
    runs = p5_found(spark, d).groupBy("read_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    out = reads.join(runs, "read_id", "left").na.fill(0, ["spans", "shared"])
    return out.withColumn("share", F.when(F.col("bases") > 0, F.col("shared") / F.col("bases")))


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy passages of every fiftieth read in all reads, by collinear chaining."""
    return chains.passages(table(spark, d, "read_set"), "read_id", "seq", "read_id % 50 = 0")


# --- problem 6 -----------------------------------------------------------------


def p6_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kmer_first").select(
        "entry_id", "seq_id", micros("arrived_at").alias("ord"), canonical_code(F.col("kmer")).alias("code")
    ).filter("code is not null")
    keys = F.array(
        F.struct(F.lit("kmer").alias("kind"), F.xxhash64("code").alias("h")),
        F.struct(F.lit("kmer_seq").alias("kind"), F.when(F.col("seq_id").isNotNull(), F.xxhash64("code", "seq_id")).alias("h")),
    )
    return rows.select("ord", F.col("entry_id").alias("id"), F.explode(keys).alias("k")).select("ord", "id", "k.kind", "k.h")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.answers(p6_keys(spark, d)).filter("seen").select(F.col("id").alias("entry_id"), F.col("kind").alias("key_kind"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Exact rates of wrong answers for fingerprints of 8, 12, 16 and 32 bits."""
    return seen.rates(p6_keys(spark, d), (8, 12, 16, 32))


# --- problem 7 -----------------------------------------------------------------


def p7_top(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "kmer_index").select(canonical_code(F.col("kmer")).alias("value"))
    return heavy.top(values, 10)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_top(spark, d).select(unpack(F.col("value"), K).alias("kmer"))


def p7_intervals(spark: SparkSession, d: str) -> DataFrame:
    return p7_top(spark, d).select("place", unpack(F.col("value"), K).alias("kmer"), "count_low", "count_high", F.col("n").alias("count"))


# --- problem 8 -----------------------------------------------------------------

CAPACITY = 4096


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, CAPACITY).select(
        F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), "container"
    )


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    each = p8_containers(spark, d).filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
        F.ceil(F.sum("t") / CAPACITY).alias("least_containers"), (F.sum("t") / (F.count(F.lit(1)) * CAPACITY)).alias("filled"),
    )


# --- problem 9 -----------------------------------------------------------------


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.matches(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "words", "doc_word", "item_word")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_matches(spark, d).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no passage of an evaluation item."""
    docs = table(spark, d, "documents")
    found = leakage.matches(docs, "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return leakage.removed(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id", found)


# --- problem 10 ----------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.entities(table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("doc").alias("doc_id"), "kind", F.col("value").alias("pii_text")).distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    clean = pii.redacted(docs, "doc_id", "text", pii.judged(docs, "doc_id", "text"))
    return clean.select(F.col("doc").alias("doc_id"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_percentiles, p1_periods, p2_found, p2_pieces, p3_found, p3_counts, p3_prefix_counts, p4_found, p5_found, p5_shared,
        p5_passages,
        p6_found, p6_rates, p7_found, p7_intervals, p8_containers, p8_fill, p9_found, p9_matches, p9_clean, p10_found,
        p10_redacted,
    )
}

_CANON = "CASE WHEN length(kmer) = 31 AND translate(upper(kmer), 'ACGT', '') = '' THEN least(upper(kmer), translate(reverse(upper(kmer)), 'ACGT', 'TGCA')) END"
_COUNTS = f"""o AS (SELECT 'kmer_index' AS origin, {_CANON} AS kmer, abs(node_id) AS r FROM kmer_index UNION ALL SELECT 'kmer_first', {_CANON}, seq_id FROM kmer_first),
c AS (SELECT origin, kmer, count(*) AS occurrences, count(DISTINCT r) AS records FROM o WHERE kmer IS NOT NULL GROUP BY 1, 2)"""
_SHARED = "SELECT DISTINCT read_id, upper(seq) AS s FROM read_set WHERE seq IS NOT NULL AND read_id IS NOT NULL AND length(seq) >= 60"

ORACLE: dict[str, str] = {
    "p2_found": """WITH c AS (SELECT DISTINCT node_id, regexp_replace(seq, '\\s', '', 'g') AS s FROM contigs WHERE seq IS NOT NULL), l AS (SELECT * FROM c WHERE length(s) > 5000),
p AS (SELECT node_id, md5(s) AS tie, list_filter(string_split(regexp_replace(s, '([Nn]{10,})', '|\\1|', 'g'), '|'), lambda x: x <> '') AS parts FROM l),
e AS (SELECT node_id, tie, i, length(parts[i]) AS n, regexp_full_match(parts[i], '[Nn]{10,}') AS gap FROM p, unnest(range(1, len(parts) + 1)) t(i)),
r AS (SELECT *, sum(n) OVER (PARTITION BY node_id, tie ORDER BY i) AS stop FROM e), g AS (SELECT DISTINCT node_id, CAST(stop - n AS BIGINT) AS gap_start FROM r WHERE gap)
SELECT node_id, gap_start FROM g UNION ALL SELECT DISTINCT node_id, CAST(-1 AS BIGINT) FROM l WHERE NOT regexp_matches(s, '[Nn]{10}')""",
    "p3_found": f"WITH {_COUNTS} SELECT origin, kmer, CASE WHEN records < 2 THEN 'rare' ELSE 'common' END AS mark FROM c WHERE records < 2 OR records >= 25",
    "p3_counts": f"WITH {_COUNTS} SELECT origin, kmer, occurrences, records, CASE WHEN records < 2 THEN 'rare' WHEN records >= 25 THEN 'common' ELSE 'kept' END AS mark FROM c",
    "p3_prefix_counts": f"""WITH {_COUNTS}, x AS (SELECT origin, l AS level, substr(kmer, 1, l) AS p, r FROM o, (SELECT unnest([6, 12, 31]) AS l) q WHERE kmer IS NOT NULL),
y AS (SELECT origin, level, p, count(*) AS n, count(DISTINCT r) AS records FROM x GROUP BY 1, 2, 3)
SELECT origin, CAST(level AS INTEGER) AS level, count(*) AS prefixes, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records, max(records) AS most_records FROM y GROUP BY 1, 2""",
    "p4_found": """WITH RECURSIVE l AS (SELECT abs(pre_node_left) AS a, abs(pre_node_right) AS b FROM prearcs WHERE pre_node_left <> 0 AND pre_node_right <> 0 UNION SELECT abs(src), abs(dst) FROM connections WHERE src <> 0 AND dst <> 0),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l UNION SELECT b, b FROM l),
c(node_id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.g FROM c JOIN e ON e.a = c.node_id WHERE e.b > c.g)
SELECT node_id, min(g) AS group_id FROM c GROUP BY 1""",
    "p5_found": f"""WITH s AS ({_SHARED}), w AS (SELECT read_id, p, hash(substr(s, p + 1, 60)) AS h, md5(substr(s, p + 1, 60)) AS m FROM s, unnest(range(0, length(s) - 59)) t(p) WHERE regexp_full_match(substr(s, p + 1, 60), '[ACGT]{{60}}')),
k AS (SELECT h, m FROM w GROUP BY 1, 2 HAVING min(read_id) < max(read_id)), x AS (SELECT DISTINCT read_id, p FROM w SEMI JOIN k USING (h, m)),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY read_id ORDER BY p) + 60 THEN 0 ELSE 1 END AS head FROM x), r AS (SELECT *, sum(head) OVER (PARTITION BY read_id ORDER BY p) AS run FROM g)
SELECT read_id, min(p) AS span_start, max(p) + 60 AS span_end FROM r GROUP BY read_id, run""",
    "p6_found": f"""WITH o AS (SELECT entry_id, seq_id, arrived_at, {_CANON} AS k FROM kmer_first),
a AS (SELECT entry_id, seq_id, row_number() OVER (PARTITION BY k ORDER BY arrived_at, entry_id) AS x, row_number() OVER (PARTITION BY k, seq_id ORDER BY arrived_at, entry_id) AS y FROM o WHERE k IS NOT NULL)
SELECT entry_id, 'kmer' AS key_kind FROM a WHERE x > 1 UNION ALL SELECT entry_id, 'kmer_seq' FROM a WHERE y > 1 AND seq_id IS NOT NULL""",
    "p9_found": f"""WITH x AS (SELECT doc_id AS id, 'd' AS side, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT item_id, 'i', text FROM eval_items WHERE text IS NOT NULL),
w AS (SELECT id, side, regexp_extract_all(lower(regexp_replace(text, '{leakage.MARKUP}', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+') AS words FROM x),
g AS (SELECT DISTINCT id, side, array_to_string(list_slice(words, i, i + 11), ' ') AS gram FROM w, unnest(range(1, len(words) - 10)) t(i))
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b USING (gram) WHERE a.side = 'd' AND b.side = 'i'""",
    "p7_found": f"WITH c AS (SELECT {_CANON} AS kmer, count(*) AS n FROM kmer_index GROUP BY 1) SELECT kmer FROM c WHERE kmer IS NOT NULL ORDER BY n DESC, kmer LIMIT 10",
}
