"""Text forms of results. Each builder gives a frame of ordered lines or records; `write_lines` stores one.

Lines carry their order (`a`, `b`, ...) so that the writer can range partition and sort
instead of gathering the file in one task; the parts, read in name order, are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import six_places


def write_lines(lines: DataFrame, path: str, order: list[str], column: str = "line", compression: str | None = None) -> None:
    out = lines.orderBy(*order).select(F.col(column).alias("value"))
    writer = out.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def wrapped(seq: Column, width: int = 60) -> Column:
    """Sequence in lines of `width`, without a last line break."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def sequences(reads: DataFrame) -> DataFrame:
    """read_id, line: `>name<TAB>id<TAB>category` and bases at 60 a line; a full last line is followed by an empty one.

    Where reads have mappings (ref_id, pos), a line `M<TAB>ref<TAB>pos` follows for each that is whole, in their order."""
    head = F.format_string(">%s\t%d\t%d\n", F.coalesce("name", F.lit("")), F.col("read_id"), F.col("category").cast("int"))
    body = F.regexp_replace("seq", "(.{60})", "$1\n")
    if "mappings" in reads.columns:
        whole = F.filter("mappings", lambda m: m["ref_id"].isNotNull() & m["pos"].isNotNull())
        lines = F.concat_ws("", F.transform(whole, lambda m: F.concat(F.lit("\nM\t"), m["ref_id"], F.lit("\t"), m["pos"])))
        body = F.concat(F.regexp_replace(body, "\n$", ""), F.coalesce(lines, F.lit("")))
    return reads.filter("read_id is not null and seq is not null").select("read_id", F.concat(head, body).alias("line"))


def fasta(rows: DataFrame, name: Column, seq: Column, key: str, width: int = 60) -> DataFrame:
    return rows.select(F.col(key), F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width)).alias("line"))


def fastq(rows: DataFrame, name: Column, seq: Column, qual: Column, key: str) -> DataFrame:
    return rows.select(F.col(key), F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("line"))


def roadmaps(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, ord, line: `ROADMAP id` for each read and its annotations, tab separated."""
    heads = reads.select("read_id", F.lit(0).cast("bigint").alias("ord"), F.format_string("ROADMAP %d", F.col("read_id")).alias("line"))
    body = rows.select("read_id", F.col("ord").cast("bigint").alias("ord"), F.concat_ws("\t", "target", "position", "start", "finish").alias("line"))
    return heads.unionByName(body)


def pregraph(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.format_string("NODE\t%d\t%d\n%s", F.col("node_id"), F.col("length"), F.col("seq")).alias("line"))


def graph(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """part, a, b, line: NODE blocks (both strands' bases without the first k-1), then ARC lines, each pair once."""
    from ..functions.dna import revcomp

    n = nodes.select(
        F.lit(0).alias("part"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.concat(F.format_string("NODE\t%d\t%d\t%d\t%d\n", F.col("node_id"), F.col("length"), F.col("cov"), F.col("cov")), F.expr(f"substring(seq, {k})"), F.lit("\n"), revcomp(F.col("seq")).substr(F.lit(k), F.length("seq"))).alias("line"),
    )
    a = arcs.filter("abs(dst) >= abs(src) and not (src = dst and src < 0)").select(
        F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string("ARC\t%d\t%d\t%d", F.col("src"), F.col("dst"), F.col("mult")).alias("line")
    )
    return n.unionByName(a)


def _painter(change):
    """A step of F.aggregate: the text with `change` applied to one span."""

    def paint(acc, x):
        size = F.greatest(x["stop"] - x["start"], F.lit(0))
        return F.concat(F.substring(acc, F.lit(1), x["start"]), change(F.substring(acc, x["start"] + 1, size)), F.substring(acc, x["start"] + size + 1, F.length(acc)))

    return paint


def contigs(nodes: DataFrame, least: int, k: int, gaps: DataFrame | None = None, low: DataFrame | None = None) -> DataFrame:
    """node_id, name, seq of nodes of at least `least` k-mers; gaps become N, low coverage lower case beyond the first k bases.

    gaps and low have node_id, start, stop (in bases, stop exclusive)."""
    rows = nodes.filter(F.col("length") >= least).withColumn("seq", F.upper("seq"))
    for spans, change in ((low, F.lower), (gaps, lambda t: F.regexp_replace(t, ".", "N"))):
        if spans is None:
            continue
        s = spans.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        rows = rows.join(s, "node_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")))
        clipped = F.transform("spans", lambda x: F.struct(F.greatest(x["start"], F.lit(k)).cast("int").alias("start"), F.least(x["stop"], F.length("seq")).cast("int").alias("stop")))
        rows = rows.withColumn("spans", clipped).withColumn("seq", F.aggregate("spans", F.col("seq"), _painter(change))).drop("spans")
    name = F.format_string("NODE_%d_length_%d_cov_%s", F.col("node_id"), F.col("length"), six_places(F.col("cov") / F.when(F.col("length") > 0, F.col("length"))))
    return rows.select("node_id", name.alias("name"), "seq")


def stats_table(nodes: DataFrame, arcs: DataFrame, libraries: list[int], tracked: bool) -> DataFrame:
    """Node statistics as text columns: `Inf` for coverages of nodes without length, `N/A` for counts without tracking.

    nodes needs cov_<lib>, ocov_<lib>, nb_<lib>, long_cov, long_nb (BIGINT)."""
    from ..operators.stats import arc_counts

    c = arc_counts(arcs).select(F.col("node_id").alias("n"), F.col("arc_count").alias("c"))
    outs = nodes.join(c, F.col("node_id") == F.col("n"), "left").withColumn("out", F.coalesce("c", F.lit(0))).drop("n", "c")
    both = outs.join(c, -F.col("node_id") == F.col("n"), "left").withColumn("in", F.coalesce("c", F.lit(0))).drop("n", "c")
    d = lambda x: F.when(F.col("length") == 0, "Inf").otherwise(six_places(F.col(x) / F.when(F.col("length") > 0, F.col("length"))))
    nb = lambda x: F.col(x).cast("string") if tracked else F.lit("N/A")
    cols = [F.col("node_id").alias("ID"), F.col("length").alias("lgth"), "out", "in", d("long_cov").alias("long_cov")]
    for i in libraries:
        cols += [d(f"cov_{i}").alias(f"short{i + 1}_cov"), d(f"ocov_{i}").alias(f"short{i + 1}_Ocov")]
    return both.select(*cols, nb("long_nb").alias("long_nb"), *[nb(f"nb_{i}").alias(f"short{i + 1}_nb") for i in libraries])


def unused_reads(reads: DataFrame, places: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Reads without a place on a node of at least `least` k-mers."""
    long_ = nodes.filter(F.col("length") >= least).select("node_id")
    used = places.join(long_, F.abs("node") == F.col("node_id"), "left_semi").select("read_id").distinct()
    return reads.join(used, "read_id", "left_anti")


def final_line(nodes: DataFrame, n50: DataFrame, used: DataFrame, reads: DataFrame) -> DataFrame:
    """The one-line summary of a run."""
    a = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("length"), F.lit(0)).alias("m"), F.coalesce(F.sum("length"), F.lit(0)).alias("t"))
    one = a.join(n50.agg(F.coalesce(F.max("n50"), F.lit(0)).alias("h"))).join(used.agg(F.countDistinct("read_id").alias("u"))).join(reads.agg(F.countDistinct("read_id").alias("r")))
    return one.select(F.format_string("Final graph has %d nodes and n50 of %d, max %d, total %d, using %d/%d reads", "n", "h", "m", "t", "u", "r").alias("line"))


def agp(contigs_: DataFrame, least: int = 10) -> DataFrame:
    """object, start, stop, part, kind (W or N), length for contigs(name, seq), split at runs of at least `least` N."""
    from pyspark.sql import Window as W

    parts = F.expr(f"split(regexp_replace(seq, '([Nn]{{{least},}})', '\\u0001$1\\u0001'), '\\u0001')")
    rows = contigs_.select("name", F.posexplode(F.filter(parts, lambda x: F.length(x) > 0)).alias("i", "p"))
    w = W.partitionBy("name").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("stop", F.sum(F.length("p")).over(w))
    return run.select(
        F.col("name").alias("object"), (F.col("stop") - F.length("p") + 1).alias("start"), "stop", (F.col("i") + 1).alias("part"),
        F.when(F.col("p").rlike(f"^[Nn]{{{least},}}$"), "N").otherwise("W").alias("kind"), F.length("p").alias("length"),
    )


def amos(nodes: DataFrame, tiles: DataFrame, reads: DataFrame, libraries: DataFrame, mates: DataFrame | None = None) -> DataFrame:
    """part, a, b, line: AMOS messages: LIB, FRG for each pair, RED and CTG with its TLE lines. The quality field repeats the bases.

    tiles(node_id, read_id, off, clear_start, clear_stop), mates(read_id, mate_id, library)."""
    zero = F.lit(0).cast("bigint").alias("b")
    lib = libraries.select(F.lit(0).alias("part"), F.col("library").cast("bigint").alias("a"), zero,
        F.format_string("{LIB\niid:%d\n{DST\nmea:%d\nstd:%d\n}\n}", F.col("library").cast("int") + 1, F.col("ins_len").cast("bigint"), F.sqrt(F.col("ins_var")).cast("bigint")).alias("line"))
    red = reads.filter("seq is not null").select(F.lit(2).alias("part"), F.col("read_id").alias("a"), zero,
        F.format_string("{RED\niid:%d\neid:%d\nseq:\n%s\n.\nqlt:\n%s\n.\n}", F.col("read_id"), F.col("read_id"), wrapped(F.col("seq")), wrapped(F.col("seq"))).alias("line"))
    tle = F.format_string("{TLE\nsrc:%d\noff:%d\nclr:%d,%d\n}", F.col("read_id"), F.col("off"), F.col("clear_start"), F.col("clear_stop"))
    t = tiles.groupBy("node_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("off", "read_id", tle.alias("l")))), lambda x: x["l"])).alias("tiles"))
    ctg = nodes.join(t, "node_id", "left").select(F.lit(3).alias("part"), F.col("node_id").alias("a"), zero,
        F.format_string("{CTG\niid:%d\neid:%d-0\nseq:\n%s\n.\nqlt:\n%s\n.\n%s\n}", F.col("node_id"), F.col("node_id"), wrapped(F.col("seq")), wrapped(F.col("seq")), F.coalesce("tiles", F.lit(""))).alias("line"))
    out = lib.unionByName(red).unionByName(ctg)
    if mates is None:
        return out
    pair = mates.filter("read_id < mate_id").select(F.lit(1).alias("part"), F.col("read_id").alias("a"), zero,
        F.format_string("{FRG\niid:%d\nlib:%d\ntyp:I\nrds:%d,%d\n}", F.col("read_id"), F.col("library").cast("int") + 1, F.col("read_id"), F.col("mate_id")).alias("line"))
    return out.unionByName(pair)


def alignments(markers: DataFrame, regions: DataFrame, nodes: DataFrame, least: int, k: int) -> DataFrame:
    """Contig to reference alignments: node_id, node_start, node_stop, reference, ref_start, ref_stop, in four strand cases.

    markers(node signed, seq_id = ref_id, start, finish, start_off), offsets counted on the node's own strand: against it, the
    first k-mer's last base is where the alignment begins."""
    rows = markers.join(regions, F.col("seq_id") == F.col("ref_id")).join(nodes.filter(F.col("length") >= least).select("node_id", "length"), F.abs("node") == F.col("node_id"))
    span = F.col("finish") - F.col("start") + (k - 1)
    fwd = F.col("node") > 0
    n0 = F.when(fwd, F.col("start_off") + 1).otherwise(F.col("start_off") + k)
    n1 = F.when(fwd, F.col("start_off") + span).otherwise(F.col("start_off") + k - span + 1)
    r0 = F.when(F.col("positive"), F.col("region_start") + F.col("start")).otherwise(F.col("region_finish") - F.col("start"))
    r1 = F.when(F.col("positive"), F.col("region_start") + F.col("start") + span - 1).otherwise(F.col("region_finish") - F.col("start") - span + 1)
    return rows.select("node_id", n0.alias("node_start"), n1.alias("node_stop"), F.col("name").alias("reference"), r0.alias("ref_start"), r1.alias("ref_stop"))
