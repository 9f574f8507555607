"""The runs from a shell: `python -m strandloom assemble|levels|kmers OUT K [input ...] [option ...]`.

Inputs come as `--short FILE...`, `--short2`, `--short-paired`, `--short2-paired`, `--long`, `--long-paired`,
`--reference`; layouts are found by the first bytes unless `--layout` names one. With `--separate`, two files a library
hold the mates. Every option of `settings.AssemblySettings` is `--name VALUE` (lists with commas; library options as
`LIBRARY:VALUE`); others are refused. OUT gets contigs.fa, stats.txt, Graph and Log, each a folder of parts in order.
"""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..settings import AssemblySettings, k_values
from ..sources import seqreads, sinks
from .assemble import assemble
from .metagenome import assemble_levels

#: Input switches and their categories.
INPUTS = {"short": 0, "short-paired": 1, "short2": 2, "short2-paired": 3, "long": 4, "long-paired": 5, "reference": 6}


def _value(name: str, text: str):
    """An option's value by the kind of its default."""
    default = next(f.default if f.default is not MISSING else f.default_factory() for f in fields(AssemblySettings) if f.name == name)
    if isinstance(default, bool):
        if text not in ("yes", "no"):
            raise ValueError(f"{name} takes yes or no")
        return text == "yes"
    if isinstance(default, dict):
        return {int(a): int(b) for a, b in (x.split(":") for x in text.split(","))}
    if isinstance(default, frozenset):
        return frozenset(int(x) for x in text.split(","))
    if isinstance(default, tuple):
        return tuple(float(x) for x in text.split(","))
    if isinstance(default, int) or name == "min_contig_lgth":
        return int(text)
    return text if text == "auto" else float(text)


def parsed(argv: list[str]) -> tuple[argparse.Namespace, dict[str, object]]:
    p = argparse.ArgumentParser(prog="strandloom")
    p.add_argument("run", choices=("assemble", "levels", "kmers"))
    p.add_argument("out")
    p.add_argument("k")
    p.add_argument("--layout", default="auto")
    p.add_argument("--separate", action="store_true")
    for name in INPUTS:
        p.add_argument(f"--{name}", nargs="+", action="append", default=[])
    names = [f.name for f in fields(AssemblySettings) if f.name != "k"]
    for name in names:
        p.add_argument(f"--{name}")
    got = p.parse_args(argv)
    return got, {n: _value(n, getattr(got, n)) for n in names if getattr(got, n) is not None}


def inputs(spark: SparkSession, got: argparse.Namespace) -> DataFrame:
    """All inputs as one table of reads, with ids in the order of the switches above, references first; mates by adjacency."""
    out, first = None, 1
    for name, category in sorted(INPUTS.items(), key=lambda x: (x[1] != 6, x[1])):
        for files in getattr(got, name.replace("-", "_")):
            if got.separate and category % 2 == 1:
                if len(files) != 2:
                    raise ValueError("separate mates come in two files")
                rows = seqreads.zipped(*(seqreads.in_order(seqreads.scan(spark, f, got.layout)) for f in files))
            else:
                rows = seqreads.scan(spark, files, got.layout)
            ids = seqreads.read_ids(rows, category, first)
            n = ids.count()
            # mates are neighbours; the last of an odd number has none and is a single read
            at = F.col("read_id") - first
            mate = F.when((at % 2 == 0) & (at < n - 1), F.col("read_id") + 1).when(at % 2 == 1, F.col("read_id") - 1)
            ids = ids.withColumn("mate_id", mate if category % 2 == 1 else F.lit(None).cast("bigint")).withColumn("second_in_pair", (at % 2 == 1) if category % 2 == 1 else F.lit(False))
            alone = F.col("is_paired") & F.col("mate_id").isNull()
            ids = ids.withColumn("category", F.when(alone, F.col("category") - 1).otherwise(F.col("category")).cast("tinyint")).withColumn("is_paired", F.col("mate_id").isNotNull())
            first += n
            out = ids if out is None else out.unionByName(ids)
    if out is None:
        raise ValueError("no input is given")
    return out


def main(argv: list[str], spark: SparkSession | None = None) -> str:
    """Runs a command; gives the summary line."""
    from ..runtime import local_session

    got, options = parsed(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    reads = inputs(spark, got)
    line = ""
    for k in k_values(got.k):
        out = got.out if "," not in got.k else f"{got.out}_{k}"
        settings = AssemblySettings(k=k, **options)
        if got.run == "kmers":
            from ..operators.hashing import kmer_rows, roadmaps

            sinks.write_lines(sinks.sequences(reads), f"{out}/Sequences", ["read_id"])
            roads = roadmaps(kmer_rows(reads, k, settings.strand_specific, packed=True))
            sinks.write_lines(sinks.roadmaps(roads, reads.select("read_id").distinct()), f"{out}/Roadmaps", ["read_id", "ord"])
            line = f"k {k}"
            continue
        run = assemble(reads, settings) if got.run == "assemble" else assemble_levels(reads.filter("category <> 6"), settings).assembly
        nodes = run.nodes
        sinks.write_lines(sinks.fasta(run.contigs, F.col("name"), F.col("seq"), "node_id"), f"{out}/contigs.fa", ["node_id"])
        table = sinks.stats_table(nodes.select("node_id", "length", F.col("cov").alias("cov_0"), F.col("cov").alias("ocov_0"), F.lit(0).cast("bigint").alias("long_cov"), F.lit(0).cast("bigint").alias("nb_0"), F.lit(0).cast("bigint").alias("long_nb")), run.arcs, [0], False)
        sinks.write_lines(table.select("ID", F.concat_ws("\t", *table.columns).alias("line")), f"{out}/stats.txt", ["ID"])
        sinks.write_lines(sinks.graph(nodes, run.arcs, k), f"{out}/Graph", ["part", "a", "b"])
        for name, extra in (("UnusedReads.fa", run.unused), ("filtered.fa", run.filtered)):
            if extra is not None:
                key = "read_id" if name == "UnusedReads.fa" else "node_id"
                sinks.write_lines(sinks.fasta(extra, F.col(key).cast("string"), F.col("seq"), key), f"{out}/{name}", [key])
        if run.amos is not None:
            sinks.write_lines(run.amos, f"{out}/assembly.afg", ["part", "a", "b"])
        if run.alignments is not None:
            a = run.alignments
            sinks.write_lines(a.select("node_id", "node_start", F.concat_ws("\t", *a.columns).alias("line")), f"{out}/alignments.tsv", ["node_id", "node_start"])
        line = run.summary.first()["line"]
        log = [(0, " ".join(argv)), (1, f"median coverage {stats.weighted_median_coverage(nodes).first()}"), (2, line)]
        sinks.write_lines(spark.createDataFrame(log, "a int, line string"), f"{out}/Log", ["a"])
    return line
