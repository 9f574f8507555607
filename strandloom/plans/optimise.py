"""Parameter search around a run: word lengths, coverage cutoff, and merging of several assemblies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, stats, tools
from ..runtime import materialize
from ..settings import AssemblySettings
from .assemble import Assembly, assemble


def sweep(reads: DataFrame, ks: Sequence[int], settings: AssemblySettings, expression: str = "n50") -> tuple[DataFrame, dict[int, Assembly]]:
    """Metrics and score of a run for each word length: (k, contigs, total, longest, n50, score), and the runs.

    The expression may use LNbp, Lbp, Lcon, max, n50, ncon, tbp."""
    out, runs = None, {}
    for k in ks:
        run = assemble(reads, replace(settings, k=k))
        runs[run_k := replace(settings, k=k).k] = run
        m = tools.assembly_metrics(run.nodes)
        every = m.filter("scope = 'all'").select(F.col("contigs").alias("ncon"), F.col("total").alias("tbp"), F.col("longest").alias("max"), F.col("n50"))
        long_ = m.filter("scope = 'long'").agg(F.coalesce(F.max("contigs"), F.lit(0)).alias("Lcon"), F.coalesce(F.max("total"), F.lit(0)).alias("Lbp"), F.coalesce(F.max("n50"), F.lit(0)).alias("LNbp"))
        one = tools.score(every.crossJoin(long_).withColumn("k", F.lit(run_k)), expression)  # one row each
        out = one if out is None else out.unionByName(one)
    return out, runs


def best_cutoff(nodes: DataFrame, expected: float, low: float = 0.0) -> tuple[float, float]:
    """Coverage cutoff, and the length of long nodes it leaves, by golden section up to 0.8 of the expected coverage.

    Long means at least 1,000 k-mers; where no node is that long, all nodes count."""
    kept, _ = materialize(nodes.select("node_id", "length", "cov"), "cutoff")
    least = 1000 if kept.filter("length >= 1000").limit(1).count() else 1

    def left(cutoff: float) -> float:
        rest = stats.without(kept, stats.low_coverage(kept, cutoff)).filter(F.col("length") >= least)
        return float(rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])

    return tools.golden_section(left, low, 0.8 * expected)


def merged(reads: DataFrame, ks: Sequence[int], settings: AssemblySettings) -> Assembly:
    """The contigs of several word lengths, taken as reads, assembled once more at the largest of them.

    Reads that no exploratory contig uses join in, so nothing is lost."""
    parts = None
    unused = None
    for k in ks:
        run = assemble(reads, replace(settings, k=k, unused_reads=True, read_trkg=True))
        seqs = run.nodes.filter(F.col("length") >= 2 * k).select("seq")
        parts = seqs if parts is None else parts.unionByName(seqs)
        if run.unused is not None:
            ids = run.unused.select("read_id")
            unused = ids if unused is None else unused.join(ids, "read_id", "left_semi")
    rest = reads.join(unused, "read_id", "left_semi").select("seq") if unused is not None else reads.select("seq").limit(0)
    from ..operators.ordered import numbered

    rows = numbered(parts.unionByName(rest).withColumn("tie", F.xxhash64("seq")), ["tie", "seq"], "read_id")
    both, _ = materialize(rows.select("read_id", F.lit(4).alias("category"), "seq"), "merge")
    nodes, arcs = graph.unitigs(both, max(replace(settings, k=k).k for k in ks))
    k = max(replace(settings, k=k).k for k in ks)
    nodes, arcs = graph.clip_tips(nodes, arcs, k, minority=True)
    nodes, arcs = graph.pop_bubbles(nodes, arcs, k)
    from ..sources import sinks

    contigs = sinks.contigs(nodes, settings.least_contig, k)
    return Assembly(nodes, arcs, contigs, sinks.final_line(nodes, stats.n50(nodes), both.select("read_id").limit(0), both))
