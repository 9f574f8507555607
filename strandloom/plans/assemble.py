"""The whole run: reads to contigs, in the fixed order of its steps.

reads(read_id, category, seq[, mate_id, library, second_in_pair]) -> nodes, arcs, contigs, statistics.
Each step is a table in the shared folder; a lost executor repeats tasks, not steps.

1. graph of all reads, unambiguous chains merged; tips by the minority rule, bubbles, tips again;
2. nodes below the coverage cutoffs or above the limit go, and reads on the low ones become dubious;
3. every dead end goes;
4. long reads join unique nodes, round by round, until none are linked any more;
5. read pairs join unique nodes: first those of all libraries but mate-pair ones, then one mate-pair library after
   the other, each until no unique node can be extended. Links are kept by the model of expected pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, joining, longreads, pairs, stats
from ..runtime import materialize
from ..settings import LONG, REFERENCE, AssemblySettings
from ..sources import sinks


@dataclass
class Assembly:
    nodes: DataFrame
    arcs: DataFrame
    contigs: DataFrame
    summary: DataFrame
    filtered: DataFrame | None = None
    gaps: DataFrame | None = None
    unused: DataFrame | None = None
    places: DataFrame | None = None
    dubious: DataFrame | None = None
    amos: DataFrame | None = None
    alignments: DataFrame | None = None


@dataclass
class State:
    """The graph under way and what follows it through merges."""

    nodes: DataFrame
    arcs: DataFrame
    places: DataFrame | None = None
    markers: DataFrame | None = None
    gaps: DataFrame | None = None
    low: DataFrame | None = None

    def joined(self, made: tuple[DataFrame, DataFrame, DataFrame], k: int) -> State:
        """The state after nodes were joined (see `joining.joined`)."""
        nodes, new, members = made
        old = self.nodes

        def kept(df, label):
            return materialize(df, label)[0]

        def spans(df):
            return None if df is None else joining.moved_spans(df, members, old, k)

        gaps = new if self.gaps is None else kept(spans(self.gaps).unionByName(new), "gaps")
        return State(
            nodes, kept(joining.moved_arcs(self.arcs, members, old), "arcs"),
            None if self.places is None else kept(joining.moved_places(self.places, members, old), "places"),
            None if self.markers is None else kept(joining.moved_markers(self.markers, members, old), "markers"),
            gaps, None if self.low is None else kept(spans(self.low), "low"),
        )


def median_coverage(nodes: DataFrame) -> float:
    row = stats.weighted_median_coverage(nodes).first()
    return float(row[0]) if row else 0.0


def thresholds(nodes: DataFrame, settings: AssemblySettings) -> tuple[float | None, float | None]:
    """Expected coverage and coverage cutoff, estimated where asked for."""
    expected = median_coverage(nodes) if settings.exp_cov == "auto" else settings.exp_cov
    cutoff = settings.cov_cutoff
    if cutoff == "auto" or (cutoff is None and settings.exp_cov == "auto"):
        cutoff = median_coverage(nodes) / 2
    return expected, cutoff


def corrected(reads: DataFrame, settings: AssemblySettings) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs after tips and bubbles."""
    k = settings.k
    nodes, arcs = graph.unitigs(reads, k, settings.strand_specific)
    nodes, arcs = graph.clip_tips(nodes, arcs, k, minority=True)
    limits = {"max_gaps": settings.max_gap_count, "max_divergence": settings.max_divergence, "max_branch": settings.max_branch_length}
    nodes, arcs = graph.pop_bubbles(nodes, arcs, k, **limits)
    return graph.clip_tips(nodes, arcs, k, minority=True)


def _filtered(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, cutoff: float | None, settings: AssemblySettings):
    """(nodes, arcs, removed contigs, dubious reads) after the coverage filters."""
    k, out, dubious = settings.k, None, None
    references = reads.filter(F.col("category") == REFERENCE)
    for step in ("low", "low again", "long", "high"):
        if step in ("low", "low again"):
            if cutoff is None or cutoff < 0:
                continue
            # a node on a reference is spared; once chains are merged, only one that a reference ends on
            marks = longreads.passage_markers(graph.thread(references, nodes, k, settings.strand_specific), (REFERENCE,))
            spared = (marks if step == "low" else longreads.terminal(marks)).select(F.abs("node").alias("node_id"))
            gone = stats.low_coverage(nodes, cutoff, spared)
        elif step == "long":
            if settings.long_cov_cutoff is None:
                continue
            seen = graph.coverage(graph.thread(reads.filter(F.col("category").isin(*LONG)), nodes, k, settings.strand_specific)).groupBy("node_id").agg(F.sum("cov").alias("seen"))
            rows = nodes.join(seen, "node_id", "left").withColumn("cov", F.coalesce("seen", F.lit(0))).drop("seen")
            gone = nodes.join(stats.low_coverage(rows, settings.long_cov_cutoff).select("node_id"), "node_id", "left_semi")
        else:
            if settings.max_coverage is None:
                continue
            gone = stats.high_coverage(nodes, settings.max_coverage)
        gone, _ = materialize(gone, "filtered")
        if settings.export_filtered:
            kept = gone.filter(F.col("length") > settings.least_contig)
            out = kept if out is None else out.unionByName(kept)
        if step != "high" and settings.tracking:
            on = graph.thread(reads, gone, k, settings.strand_specific).select("read_id").distinct()
            dubious = on if dubious is None else dubious.union(on).distinct()
        nodes, arcs = graph.removed(nodes, arcs, gone.select("node_id"))
        nodes, arcs, _ = graph.concatenate(nodes, arcs, k)
    return nodes, arcs, out, None if dubious is None else materialize(dubious, "dubious")[0]


def low_spans(threads: DataFrame, nodes: DataFrame, cutoff: int, k: int) -> DataFrame:
    """node_id, start, stop (bases): where fewer than `cutoff` reads lie."""
    reads = threads.groupBy("read_id", F.abs("node").alias("node_id")).agg(F.min("off").alias("start"), (F.max("off") + k).alias("stop")).select("node_id", "start", "stop", F.lit(1).alias("weight"))
    own = nodes.select("node_id", F.lit(0).cast("bigint").alias("start"), (F.col("length") + (k - 1)).alias("stop"), F.lit(0).alias("weight"))
    return stats.low_coverage_intervals(reads.unionByName(own), cutoff)


def assemble(reads: DataFrame, settings: AssemblySettings) -> Assembly:
    k = settings.k
    real = reads.filter(F.col("category") != REFERENCE)
    nodes, arcs = corrected(real, settings)
    expected, cutoff = thresholds(nodes, settings)
    nodes, arcs, filtered, dubious = _filtered(reads, nodes, arcs, cutoff, settings)
    spared = None
    if settings.conserve_long:
        long_ = real.filter(F.col("category").isin(*LONG))
        spared = lambda n: graph.thread(long_, n, k, settings.strand_specific).select(F.abs("node").alias("node_id")).distinct()
    nodes, arcs = graph.clip_tips(nodes, arcs, k, minority=False, spared=spared)
    state = State(nodes, arcs)
    if settings.tracked:
        threads, _ = materialize(graph.thread(real, nodes, k, settings.strand_specific), "threads")
        state.places = materialize(graph.read_starts(threads, nodes), "places")[0]
        state.low = materialize(low_spans(threads, nodes, settings.coverage_mask, k), "low")[0]
        state.markers = materialize(longreads.passage_markers(threads, LONG), "markers")[0]
    if expected and state.places is not None:
        state = resolved_by_long_reads(state, float(expected), settings)
        if "mate_id" in reads.columns:
            state = scaffolded(real, state, float(expected), settings, dubious)
    return finished(reads, state, settings, filtered, dubious)


def resolved_by_long_reads(state: State, expected: float, settings: AssemblySettings, plus: bool = True) -> State:
    """Unique nodes joined along long reads, until a round joins none: every round leaves fewer nodes."""
    while True:
        unique = state.nodes.filter(stats.unique_node(expected, plus)).select("node_id")
        made = longreads.resolved(state.nodes, state.markers, unique, settings.k, settings.long_mult_cutoff)
        if made is None:
            return state
        state = state.joined(made, settings.k)


def inserts(reads: DataFrame, state: State, mates: DataFrame, settings: AssemblySettings) -> DataFrame:
    """library, ins_len, ins_var: as given, otherwise as seen on nodes that hold both mates."""
    seen = pairs.insert_estimates(pairs.insert_sizes(state.places, mates, state.nodes, settings.k)).select(
        F.col("library").cast("int").alias("library"), F.col("ins_len").cast("double").alias("ins_len"), F.col("ins_var").cast("double").alias("ins_var")
    )
    given = [(n, float(m), float(v)) for n in settings.ins_length for m, v in [settings.library(n)]]
    if given:
        own = reads.sparkSession.createDataFrame(given, "library int, ins_len double, ins_var double")
        seen = seen.join(own, "library", "left_anti").select("library", "ins_len", "ins_var").unionByName(own)
    return materialize(seen, "libraries")[0]


def accepted_links(state: State, places: DataFrame, mates: DataFrame, libraries: DataFrame, unique: DataFrame, settings: AssemblySettings) -> DataFrame:
    """Connections between nodes that are numerous enough, measured against the pairs that each library's model expects."""
    links = pairs.pair_links(places, mates, state.nodes, libraries).unionByName(pairs.read_links(places, state.nodes))
    conns, _ = materialize(pairs.connections(links), "connections")
    ln = state.nodes.select("node_id", "length")
    own = conns.filter("distance is not null")
    for c in ("1", "2"):
        end = "src" if c == "1" else "dst"
        own = own.join(ln.select(F.col("node_id").alias("i"), F.col("length").alias(f"l{c}")), F.abs(end) == F.col("i")).drop("i")
    longer = F.when(F.col("l1") >= F.col("l2"), F.abs("src")).otherwise(F.abs("dst"))
    library = mates.select("read_id", "library").distinct()
    counts = places.join(library, "read_id").groupBy(F.abs("node").alias("longer"), "library").agg(F.count(F.lit(1)).alias("reads"))
    rows = own.withColumn("longer", longer).join(counts, "longer").join(libraries, "library").withColumn("density", F.col("reads") / F.greatest("l1", "l2"))
    expected = pairs.expected_links(rows).groupBy("src", "dst").agg(F.sum("expected").alias("expected"))
    u = unique.select("node_id", F.lit(True).alias("is_unique"))
    for c, end in (("a", "src"), ("b", "dst")):
        conns = conns.join(u.select(F.col("node_id").alias("i"), F.col("is_unique").alias(c)), F.abs(end) == F.col("i"), "left").drop("i")
    judged = conns.withColumn("dst_unique", F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))).join(expected, ["src", "dst"], "left").fillna(0, ["expected"])
    return pairs.accepted(judged, settings.min_pair_count, settings.paired_exp_fraction).select("src", "dst", "distance", "variance", "direct", "paired")


def scaffolded(reads: DataFrame, state: State, expected: float, settings: AssemblySettings, dubious: DataFrame | None = None, plus: bool = True, among: DataFrame | None = None) -> State:
    """Unique nodes joined over read pairs. `among` (node_id) restricts the unique nodes, as the levels of a metagenome do."""
    mates = reads.filter("mate_id is not null").select("read_id", "mate_id", F.coalesce(F.col("library").cast("int") if "library" in reads.columns else F.expr("category div 2"), F.lit(0)).alias("library"))
    if dubious is not None:
        mates = pairs.detach(mates, dubious)
    mates, _ = materialize(mates, "mates")
    short = reads.filter(~F.col("category").isin(*LONG)).select("read_id")
    libraries = inserts(reads, state, mates, settings)
    late = sorted(settings.short_mate_paired)
    rounds = [~F.col("library").isin(*late) if late else F.lit(True), *[F.col("library") == n for n in late]]
    for chosen in rounds:
        while True:
            unique = state.nodes.filter(stats.unique_node(expected, plus)).select("node_id")
            if among is not None:
                unique = unique.join(among, "node_id", "left_semi")
            own = mates.filter(chosen)
            # a long read lies on many nodes and links them by its markers; pairs of its nodes would be many
            near = state.places.join(short, "read_id", "left_semi")
            conns, _ = materialize(accepted_links(state, near, own, libraries.filter(chosen), unique, settings), "accepted")
            made = pairs.scaffolds(state.nodes, conns, unique, settings.k, arcs=state.arcs, jump=settings.scaffolding)
            if made is None:
                break
            state = state.joined(made, settings.k)
    return state


def finished(reads: DataFrame, state: State, settings: AssemblySettings, filtered: DataFrame | None = None, dubious: DataFrame | None = None) -> Assembly:
    """Contigs, summary and the files asked for."""
    k, nodes, least = settings.k, state.nodes, settings.least_contig
    contigs = sinks.contigs(nodes, least, k, state.gaps, state.low)
    places = state.places
    long_ = nodes.filter(F.col("length") >= least).select("node_id")
    used = places.join(long_, F.abs("node") == F.col("node_id"), "left_semi").select("read_id") if places is not None else reads.select("read_id").limit(0)
    summary = sinks.final_line(nodes, stats.n50(nodes), used, reads)
    unused = sinks.unused_reads(reads, places, nodes, least) if settings.unused_reads else None
    amos = alignments = None
    if settings.amos_file:
        size = reads.select("read_id", F.length("seq").alias("n"))
        tiles = places.filter("position >= 0").join(size, "read_id").join(nodes.select("node_id", "length"), F.abs("node") == F.col("node_id"))
        # a read on the other strand is told by its clear range, which runs backwards
        off = F.when(F.col("node") > 0, F.col("position") - F.col("offset")).otherwise(F.col("length") + (k - 1) - (F.col("position") - F.col("offset")) - F.col("n"))
        ahead = F.col("node") > 0
        tiles = tiles.select("node_id", "read_id", off.alias("off"), F.when(ahead, 0).otherwise(F.col("n")).alias("clear_start"), F.when(ahead, F.col("n")).otherwise(0).alias("clear_stop"))
        mates = reads.filter("mate_id is not null").select("read_id", "mate_id", F.expr("category div 2").alias("library")) if "mate_id" in reads.columns else None
        libraries = inserts(reads, state, mates, settings) if mates is not None else reads.sparkSession.createDataFrame([], "library int, ins_len double, ins_var double")
        amos = sinks.amos(contigs.select("node_id", "seq"), tiles.join(contigs.select("node_id"), "node_id", "left_semi"), reads, libraries, mates)
    if settings.alignments:
        refs = reads.filter(F.col("category") == REFERENCE)
        marks = longreads.passage_markers(graph.thread(refs, nodes, k, settings.strand_specific), (REFERENCE,))
        name = F.col("name") if "name" in refs.columns else F.concat(F.lit("ref"), F.col("read_id"))
        areas = refs.select(F.col("read_id").alias("ref_id"), name.alias("name"), F.lit(True).alias("positive"), F.lit(1).cast("bigint").alias("region_start"), F.length("seq").cast("bigint").alias("region_finish"))
        alignments = sinks.alignments(marks, areas, nodes, least, k)
    return Assembly(nodes, state.arcs, contigs, summary, filtered, state.gaps, unused, places, dubious, amos, alignments)
