"""The metagenome run: coverage levels are peeled from high to low, each resolved as a single genome.

1. correction as for one genome; levels from the coverage histogram, or as given;
2. nodes below half the lowest level go (cutoff auto), then dead ends;
3. for each level and the one below it: parts of the graph that mix both may be left out, repeats that both
   pass through become two nodes where densities and links agree;
4. for each level, its own nodes are labelled unique (with the stricter log-odds) and joined by long reads and pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, longreads, meta, stats
from ..runtime import materialize
from ..settings import LONG, AssemblySettings
from .assemble import Assembly, State, accepted_links, corrected, finished, inserts, resolved_by_long_reads, scaffolded


@dataclass
class LevelAssembly:
    assembly: Assembly
    levels: list[float]
    parts: DataFrame | None = None
    splits: DataFrame | None = None


def coverage_levels(nodes: DataFrame, settings: AssemblySettings) -> list[float]:
    """Levels from high to low: as given, otherwise the peaks of the histogram between the limits; none found: the median."""
    if settings.exp_covs:
        return sorted((float(x) for x in settings.exp_covs), reverse=True)
    found = meta.coverage_peaks(nodes.filter("length > 0"), settings.histo_bin_width, settings.histo_sn_ratio)
    # peaks of a histogram: a bounded list
    levels = [float(r["coverage"]) for r in found.filter(F.col("coverage").between(settings.min_peak_cov, settings.max_peak_cov)).orderBy("place").collect()]
    if levels:
        return levels
    row = stats.weighted_median_coverage(nodes).first()
    return [float(row[0])] if row else []


def _threaded(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, settings: AssemblySettings) -> State:
    threads, _ = materialize(graph.thread(reads, nodes, settings.k, settings.strand_specific), "threads")
    places = materialize(graph.read_starts(threads, nodes), "places")[0]
    return State(nodes, arcs, places, materialize(longreads.passage_markers(threads, LONG), "markers")[0])


def _links(reads: DataFrame, state: State, level: float, settings: AssemblySettings) -> DataFrame | None:
    if "mate_id" not in reads.columns or not settings.use_connections:
        return None
    mates = reads.filter("mate_id is not null").select("read_id", "mate_id", F.expr("cast(category div 2 as int)").alias("library"))
    unique = state.nodes.filter(stats.unique_node(level, False)).select("node_id")
    return accepted_links(state, state.places, mates, inserts(reads, state, mates, settings), unique, replace(settings, min_pair_count=1))


def assemble_levels(reads: DataFrame, settings: AssemblySettings) -> LevelAssembly:
    k = settings.k
    nodes, arcs = corrected(reads, settings)
    levels = coverage_levels(nodes, settings)
    cutoff = settings.cov_cutoff
    if cutoff == "auto" or cutoff is None:
        cutoff = levels[-1] / 2 if levels else 0.0
    gone, _ = materialize(stats.low_coverage(nodes, cutoff), "filtered")
    nodes, arcs, _ = graph.concatenate(*graph.removed(nodes, arcs, gone.select("node_id")), k)
    nodes, arcs = graph.clip_tips(nodes, arcs, k, minority=False)
    splits = None
    for high, low in zip(levels, levels[1:]):
        if settings.discard_chimera:
            bad, _ = materialize(meta.chimeric_nodes(nodes, arcs, high, low, settings.max_chimera_rate), "chimeric")
            nodes, arcs, _ = graph.concatenate(*graph.removed(nodes, arcs, bad), k)
        decided = meta.repeat_splits(nodes, arcs, [high, low], settings.repeat_cov_sd, settings.min_split_length)
        links = _links(reads, _threaded(reads, nodes, arcs, settings), high, settings)
        if links is not None:
            decided = meta.consistent(decided, links, settings.valid_connections, settings.noise_connections)
            decided = decided.withColumn("split", F.col("split") & F.col("linked")).drop("linked")
        decided, _ = materialize(decided, "splits")
        if settings.report_split_detail:
            splits = decided if splits is None else splits.unionByName(decided)
        if decided.filter("split").limit(1).count():
            nodes, arcs, _ = graph.concatenate(*meta.split_repeats(nodes, arcs, decided), k)
    parts = materialize(meta.level_parts(nodes, arcs, levels), "parts")[0] if settings.report_subgraph and levels else None
    state = _threaded(reads, nodes, arcs, settings)
    for level in levels:
        # nodes keep their ids or take that of a chain's first node, so levels are told anew after each one is resolved
        own = meta.peeled(state.nodes, levels).filter(F.col("level") == level).select("node_id")
        own, _ = materialize(own, "level")
        state = resolved_by_long_reads(state, level, settings, plus=False)
        if "mate_id" in reads.columns:
            state = scaffolded(reads, state, level, settings, plus=False, among=own)
    return LevelAssembly(finished(reads, state, settings, gone if settings.export_filtered else None), levels, parts, splits)
