"""Result utilities and parameter search."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import n50


def coverage_mode(nodes: DataFrame, least: int, weighted: bool, above: int = -1, by: tuple[str, ...] = ()) -> DataFrame:
    """Whole coverage with most nodes (or most length): expected_coverage. Ties go to the smaller coverage."""
    rows = nodes.filter((F.col("length") >= least) & (F.col("coverage") > above)).withColumn("c", F.floor("coverage"))
    size = F.sum("length") if weighted else F.count(F.lit(1))
    return rows.groupBy(*by, "c").agg(size.alias("n")).groupBy(*by).agg(F.min_by("c", F.struct((-F.col("n")).alias("m"), F.col("c"))).alias("expected_coverage"))


def assembly_metrics(contigs: DataFrame, by: tuple[str, ...] = (), least: int = 1000) -> DataFrame:
    """Count, total, shortest, mean, longest and N50 (ascending), for all and for lengths of at least `least`."""
    out = None
    for tag, rows in (("all", contigs), ("long", contigs.filter(F.col("length") >= least))):
        one = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("contigs"), F.sum("length").alias("total"), F.min("length").alias("shortest"), F.avg("length").alias("mean"), F.max("length").alias("longest")
        )
        half = n50(rows, by=by)
        one = one.join(half, list(by)) if by else one.crossJoin(half)
        one = one.select(*by, F.lit(tag).alias("scope"), "contigs", "total", "shortest", "mean", "longest", "n50")
        out = one if out is None else out.unionByName(one)
    return out


def score(metrics: DataFrame, expression: str) -> DataFrame:
    """A user's arithmetic over the metrics' columns (LNbp, Lbp, Lcon, max, n50, ncon, tbp): names, numbers, + - * / and brackets."""
    parts = re.findall(r"\s*([A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|[-+*/()])", expression)
    if "".join(parts) != re.sub(r"\s+", "", expression):
        raise ValueError("arithmetic over the metrics only")
    names = {c.lower() for c in metrics.columns}
    for i, x in enumerate(parts):
        if x[0].isalpha() or x[0] == "_":
            if x.lower() not in names or parts[i + 1 : i + 2] == ["("]:
                raise ValueError(f"no metric {x}")
    return metrics.withColumn("score", F.expr(expression).cast("double"))


def memory_estimate_gb(read_size: float, genome_mb: float, reads_millions: float, k: int) -> float:
    """Linear memory model, in GB."""
    # Intercept and slopes of the model, in KB.
    kb = -109635 + 18977 * read_size + 86326 * genome_mb + 233353 * reads_millions - 51092 * k
    return kb / 1024 / 1024


def golden_section(run: Callable[[float], float], low: float, high: float, width: float = 1.0) -> tuple[float, float]:
    """Argument and value of the maximum of `run` in a bracket, until the bracket is at most `width` wide."""
    ratio = 0.618
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = run(c), run(d)
    while b - a > width:
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = run(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = run(d)
    return (c, fc) if fc >= fd else (d, fd)


def best_of(results: DataFrame) -> DataFrame:
    """The row with the highest score, ties to the smaller k."""
    return results.orderBy(F.desc("score"), "k").limit(1)


def observed_inserts(distances: DataFrame) -> DataFrame:
    """median (upper), mode (smallest of the most frequent) and population deviation of column `insert_size`, by library."""
    from .pairs import insert_estimates

    med = insert_estimates(distances).select("library", "n", F.col("ins_len").alias("median"))
    sd = distances.groupBy("library").agg(F.stddev_pop("insert_size").alias("sd"))
    mode = distances.filter("insert_size is not null").groupBy("library", "insert_size").count().groupBy("library").agg(
        F.min_by("insert_size", F.struct((-F.col("count")).alias("m"), "insert_size")).alias("mode")
    )
    return med.join(mode, "library").join(sd, "library")


def repeat_histogram(nodes: DataFrame, dominant: float, width: float = 0.5) -> DataFrame:
    """Length by coverage multiple (in steps of `width`) above one and a half of the dominant coverage."""
    rows = nodes.filter((F.col("length") > 0) & (F.col("coverage") > 1.5 * dominant))
    return rows.groupBy(F.floor(F.col("coverage") / (dominant * width)).cast("bigint").alias("multiple")).agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("nodes"))


def reads_of_nodes(places: DataFrame) -> DataFrame:
    """node_id, reads: distinct reads with a place on each node, on either strand."""
    return places.groupBy(F.abs("node").alias("node_id")).agg(F.countDistinct("read_id").alias("reads"))


def paired_by_name(reads: DataFrame) -> DataFrame:
    """base name, first, second: reads whose names differ in /1 and /2 only; one side null for singletons."""
    base, end = F.regexp_replace("read_name", "/[12]$", ""), F.regexp_extract("read_name", "/([12])$", 1)
    rows = reads.filter("read_name is not null").select(base.alias("base"), end.alias("end"), "read_id")
    return rows.filter("end <> ''").groupBy("base").agg(F.min(F.when(F.col("end") == "1", F.col("read_id"))).alias("first"), F.min(F.when(F.col("end") == "2", F.col("read_id"))).alias("second"))


def interleaved(pairs: DataFrame) -> DataFrame:
    """ordinal, read_id: first and second mates in turn for pairs(base, first, second) with both, by base name."""
    from .ordered import numbered

    both = numbered(pairs.filter("first is not null and second is not null"), ["base"], "n")
    return both.select(F.posexplode(F.array("first", "second")).alias("side", "read_id"), "n").select(((F.col("n") - 1) * 2 + F.col("side")).alias("ordinal"), "read_id")


def quality_share(reads: DataFrame, least: int = 20, offset: int = 33) -> DataFrame:
    """Adds n_bases and good_share: bases of quality >= least over those that are not N. Null quality: null share."""
    n = F.length("seq") - F.length(F.regexp_replace("seq", "[Nn]", ""))
    good = F.size(F.filter(F.split("qual", ""), lambda c: (c != "") & (F.ascii(c) - offset >= least)))
    return reads.withColumn("n_bases", n).withColumn("good_share", F.when(F.length("seq") > F.col("n_bases"), good / (F.length("seq") - F.col("n_bases"))))


def trimmed(reads: DataFrame, least: int = 20, offset: int = 33) -> DataFrame:
    """Reads without the bases at their end that lie below the quality, and without their qualities; null quality: as they are."""
    poor = F.array_join(F.transform(F.split("qual", ""), lambda c: F.when(F.ascii(c) - offset < least, "x").otherwise("o")), "")
    size = F.length(F.regexp_replace(poor, "x+$", ""))
    rows = reads.withColumn("__n", F.when(F.col("qual").isNull() | (F.col("qual") == ""), F.length("seq")).otherwise(size))
    return rows.withColumn("seq", F.expr("substring(seq, 1, __n)")).withColumn("qual", F.expr("substring(qual, 1, __n)")).drop("__n")


def routed_pairs(reads: DataFrame, pairs: DataFrame, most_n: int, least_share: float, least: int = 20, offset: int = 33) -> DataFrame:
    """read_id, mate_id, route of pairs(read_id, mate_id): `pair` if both mates are good, `single` if one is, else `fail`.

    A read of reads(read_id, seq, qual) is good with at most `most_n` N and the least share of good bases; one that is missing is not."""
    good = quality_share(reads, least, offset).select("read_id", ((F.col("n_bases") <= most_n) & (F.col("good_share") >= least_share)).alias("ok"))
    a = good.select("read_id", F.col("ok").alias("a"))
    b = good.select(F.col("read_id").alias("mate_id"), F.col("ok").alias("b"))
    both = pairs.join(a, "read_id", "left").join(b, "mate_id", "left").fillna(False, ["a", "b"])
    return both.select("read_id", "mate_id", F.when(F.col("a") & F.col("b"), "pair").when(F.col("a") | F.col("b"), "single").otherwise("fail").alias("route"))


def enlarged(spans: DataFrame, by: int = 100) -> DataFrame:
    return spans.withColumn("start", F.greatest(F.col("start") - by, F.lit(1))).withColumn("stop", F.col("stop") + by)


def merged(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching spans(key, start, stop) joined."""
    w = W.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("head", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("head").over(w))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("spans")).drop("run")


def fetched(spans: DataFrame, seqs: DataFrame, key: str) -> DataFrame:
    """spans with the bases they cover, coordinates from 1 inclusive."""
    return spans.join(seqs.select(key, "seq"), key).withColumn("bases", F.expr("substring(seq, cast(start as int), cast(stop - start + 1 as int))")).drop("seq")


def contig_slice(tiles: DataFrame, reads: DataFrame, node: int) -> DataFrame:
    """tiles(node_id, read_id, off, ...) of one contig with the bases of their reads(read_id, seq)."""
    return tiles.filter(F.col("node_id") == node).join(reads.select("read_id", "seq"), "read_id")


def pileup(tiles: DataFrame, start: int, stop: int) -> DataFrame:
    """Reads of tiles(read_id, off, seq[, turned]) that begin in a window, on the contig's strand, padded with dots to their place."""
    from ..functions.dna import revcomp

    rows = tiles.filter((F.col("off") >= start) & (F.col("off") < stop))
    s = F.when(F.col("turned"), revcomp(F.col("seq"))).otherwise(F.col("seq")) if "turned" in tiles.columns else F.col("seq")
    return rows.select("read_id", "off", F.concat(F.expr(f"repeat('.', cast(off - {start} as int))"), s).alias("line"))
